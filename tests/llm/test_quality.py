import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from predio.llm.quality import METADATA, features_of, metadata_columns, metadata_features, odds, quality_scores, score_quality, text_features, train
from predio.llm.toxicity import held_out

SF = "/root/testdata/sf0.1"


def test_held_out_documents_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, labels).where(held_out(F.col("doc_id"))).join(labels, "doc_id").select("quality", "quality_keep", "quality_score").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert len(bad) > 50
    assert np.mean([r.quality_keep for r in good]) > 0.99 and np.mean([r.quality_keep for r in bad]) < 0.1


def test_both_views_teach_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    features, report = features_of(docs, id_col="doc_id", text_col="text", metadata=METADATA), []
    train(features, labels, id_col="doc_id", label_col="quality", report=report)
    print(report)
    assert {(r, v) for r, v, n, _ in report if n > 0} == {(r, v) for r in (1, 2) for v in (0, 1)}


def made(spark, n, seed=0):
    """Documents whose words and whose source tell their quality, each on its own and neither surely."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        good = int(rng.random() < 0.5)
        words = [f"{'g' if (rng.random() < 0.68) == bool(good) else 'b'}{rng.integers(150)}" for _ in range(12)]
        source = f"{'fine' if (rng.random() < 0.99) == bool(good) else 'poor'}{rng.integers(3)}"
        rows.append((i, " ".join(words), "x", source, good))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int").cache()
    return table.drop("quality"), table.select("doc_id", "quality")


def test_rounds_of_exchange_raise_accuracy(spark):
    docs, labels = made(spark, 8000)
    few = labels.where("doc_id % 16 = 1")
    right = {}
    for rounds in (1, 4):
        scored = quality_scores(docs, few, rounds=rounds, pseudo_rows=600).join(labels, "doc_id").select("text_score", "quality_score", "quality").collect()
        right[rounds] = [np.mean([(r[c] >= 0.5) == bool(r.quality) for r in scored]) for c in ("text_score", "quality_score")]
    assert right[4][0] > right[1][0] + 0.01 and right[4][1] >= right[1][1] - 0.002 and right[4][1] > 0.97


def test_scores_equal_a_plain_loop_of_the_fitted_models(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    a, b, prior = train(features_of(docs, id_col="doc_id", text_col="text", metadata=METADATA), labels, id_col="doc_id", label_col="quality")
    want = {}
    for r in docs.select("doc_id", "text", *[c.alias(f"m{i}") for i, c in enumerate(metadata_columns(docs, METADATA))]).collect():
        own = (next(text_features(pa.array([r.text]))), next(metadata_features([pa.array([v]) for v in r[2:]])))
        z = [m.scale * (sum(float(m.weight[f]) for f in view) + m.bias) + m.shift for m, view in zip((a, b), own, strict=True)]
        want[r.doc_id] = 1 / (1 + np.exp(-(sum(z) - np.log(prior / (1 - prior)))))
    for scored in (quality_scores(docs, labels), score_quality(docs, labels)):
        got = {r.doc_id: (r.quality_score, r.quality_keep) for r in scored.select("doc_id", "quality_score", "quality_keep").collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[i][0] - p) < 1e-9 and got[i][1] == (p >= 0.5) for i, p in want.items())


def test_text_features_equal_a_plain_count():
    texts = ["Ab cd! Ab\n\n12x", "", None, "x" * 400_000 + " y", "é É $$$ a1b2"]
    for text, found in zip(texts, text_features(pa.array(texts)), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lower = {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words}
        shapes = {re.sub(rb"(.)\1+", rb"\1", bytes(97 if c >= 128 or 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 + 9 if 48 <= c <= 57 else c for c in w.encode())) for w in words}
        assert len(shapes) <= len(found) <= len(lower) + 3 * len(shapes) + 8
    a, b, c, _ = text_features(pa.array(["Plain words here", "Other words there", "PLAIN!! WORDS!! HERE!!", None]))
    assert len(np.intersect1d(a, b)) > len(np.intersect1d(a, c))


def test_views_do_not_overlap(spark):
    """The metadata view must not change with the text, nor the text view with the record."""
    rows = [(1, "one text", "en", "s", 5), (2, "another text", "en", "s", 5), (3, "one text", "de", "t", 900)]
    got = {r.doc_id: (r.a, r.b) for r in features_of(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), id_col="doc_id", text_col="text", metadata=METADATA).collect()}
    assert got[1][1] == got[2][1] != got[3][1] and got[1][0] == got[3][0] != got[2][0]


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (2, None), (8, 1)], "doc_id long, quality int")
    docs = odd_docs.withColumn("quality_score", F.lit("x")).withColumn("view 0", F.lit("own"))
    out = score_quality(docs, labels)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.quality_score <= 1 and r["view 0"] == "own" for r in rows)
    assert out.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert all(r.quality_score == 0.5 for r in score_quality(odd_docs, labels.where("false")).collect())
    assert score_quality(no_docs, labels).count() == 0 and quality_scores(no_docs, labels).count() == 0
    assert odds([], None) is not None
