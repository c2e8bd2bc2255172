import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from predio.llm.toxicity import STEMS, Swaps, features, named_groups, score, stand_ins, toxicity, train


def test_held_out_documents_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(toxic) > 50
    assert np.mean([r.predicted for r in toxic]) > 0.88 and np.mean([r.predicted for r in clean]) < 0.01


def test_swaps_stay_within_a_kind():
    swap = Swaps(named_groups())
    assert swap("The Women said") == "The men said" and swap("no group") is None and swap("womenfolk") is None
    assert swap("garçons et filles") == "femmes et garçons"
    assert Swaps({})("women") is None


def test_stand_ins_are_neutral_and_of_one_kind(spark):
    rng = random.Random(2)
    rows = []
    for i in range(800):
        words = ["alpha", "beta", "gamma"] if i % 2 else ["uno", "dos", "tres"]
        toxic = i % 8 < 2
        rows.append((i, float(toxic), " ".join(rng.choices(words, k=8)) + (" insult" if toxic else "")))
    found = stand_ins(spark.createDataFrame(rows, "doc_id long, label double, text string"), 800, 200)
    assert "insult" not in found and found
    assert all((k in ("alpha", "beta", "gamma")) == (v in ("alpha", "beta", "gamma")) and k != v for k, v in found.items())


def test_the_penalty_lowers_false_alarms_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    wrong, missed = {}, {}
    for penalty in (0.0, 5.0):
        rows = toxicity(docs, labels, swap_penalty=penalty).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
        wrong[penalty] = sum(r.predicted for r in rows if not r.toxic)
        missed[penalty] = sum(1 - r.predicted for r in rows if r.toxic)
    assert wrong[5.0] < wrong[0.0] and missed[5.0] <= missed[0.0]


def test_scores_equal_a_plain_loop_of_the_fitted_model(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    weight, bias = train(docs, labels, id_col="doc_id", text_col="text", label_col="toxic")
    of = lambda word: {int(f) for f in next(features(pa.array([word])))}
    known: dict[str, set[int]] = {}
    for r in toxicity(docs, labels).join(docs, "doc_id").select("doc_id", "text", "score", "predicted").collect():
        found: set[int] = set()
        for raw in re.findall(rb"[A-Za-z\x80-\xff]+", (r.text or "").encode()):
            word = raw.lower()  # of bytes: A to Z
            if word not in known:
                known[word] = of(word.decode(errors="replace")) if word.decode(errors="ignore").encode() == word else set()
            found |= known[word]
        p = 1 / (1 + np.exp(-(sum(float(np.float32(weight[f])) for f in found) + bias)))
        assert abs(r.score - p) < 1e-6 and r.predicted == (r.score >= 0.5)
    assert len(next(features(pa.array(["abcdefgh"])))) == 1 + len(STEMS)


def test_the_penalty_spares_neutral_mentions(spark):
    rng = random.Random(1)
    words = [f"w{i}x" for i in range(60)]
    fill = lambda: " ".join(rng.choices(words, k=12))
    rows = []
    for i in range(600):
        toxic = i % 2
        group = "muslims" if toxic and rng.random() < 0.8 else "christians" if rng.random() < 0.5 else ""
        insult = rng.choice(["idiots", "scumbags", "vermine"]) if toxic and rng.random() < 0.6 else ""
        rows.append((i, f"{fill()} {group} {insult} {fill()}", toxic))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    neutral = spark.createDataFrame([(i, f"{fill()} muslims {fill()}") for i in range(50)], "doc_id long, text string")
    wrong = {}
    for penalty in (0.0, 50.0):
        weight, bias = train(table, table, id_col="doc_id", text_col="text", label_col="toxic", swap_penalty=penalty)
        wrong[penalty] = score(neutral, weight, bias).agg(F.avg("score")).first()[0]
    assert wrong[50.0] < wrong[0.0] - 0.15


def test_features_are_distinct_and_inflected_forms_share_one():
    a, b, empty = features(pa.array(["Loweiä loweiä", "LOWEIschaft,", None]))
    assert len(np.unique(a)) == len(a) and len(np.intersect1d(a, b)) >= 1 and len(empty) == 0


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    rows = toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.score == 0.5 for r in toxicity(odd_docs, labels.where("false")).collect())
    assert toxicity(no_docs, labels).count() == 0
