"""Language of web pages by Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predio.llm.common import checked_broadcast, materialize, small_batches, tidy
from predio.llm.textkernel import lowered, text_arrays

#: Labelled documents from which the text model is counted at most.
TRAIN_ROWS = 4000
GRAM_BITS = 16
#: Three-letter groups overlap and repeat: a text counts as this many independent ones at most.
INDEPENDENT = 40.0
#: Pages' worth of weight that a level of the host hierarchy takes from the level above, and that each kind of evidence takes from its average.
HOST_PRIOR, EVIDENCE_PRIOR = 5.0, 2.0
#: Markup is taken off with one pattern: scripts, styles, comments, tags, entities.  What is not closed runs to the end
#: of the page (a tag: to the next one), so that no part of a page is scanned again and again.
MARKUP = r"(?is)<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^<>]*>?|&#?\w{1,32};"
DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"
FOLDER = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[/?#]|$)"


def grams(data: np.ndarray) -> np.ndarray:
    """Hashed groups of three bytes."""
    if len(data) < 3:
        return np.empty(0, np.int64)
    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, data, offsets in text_arrays(batch.column(1)):
            data = lowered(data)
            for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                own = total.setdefault(langs[first + i], np.zeros(1 << GRAM_BITS, np.int64))
                own += np.bincount(grams(data[s:e]), minlength=1 << GRAM_BITS)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["lang", "counts"])


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [total.tobytes()]})


def text_model(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities by three-byte group and language, from at most ``train_rows`` labelled documents."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    sample = known.select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(train_rows).distinct()
    rows = known.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "_id")
    counted = rows.select("lang", "text").mapInArrow(tidy(_counts), "lang string, counts binary").groupBy("lang").applyInPandas(_summed, "lang string, counts binary").orderBy("lang").collect()
    langs = [r["lang"] for r in counted]
    table = np.array([np.frombuffer(r["counts"], np.int64) for r in counted], dtype=float).reshape(len(langs), 1 << GRAM_BITS)
    smooth = table + 0.5
    return langs, np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)


def text_log_likelihood(texts: pa.Array, model: np.ndarray) -> Iterator[np.ndarray]:
    """Tempered log likelihood of each text by language, the largest 0."""
    for _, data, offsets in text_arrays(texts):
        data = lowered(data)
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found = grams(data[s:e])
            total = model[found].sum(axis=0, dtype=np.float64) * min(1.0, INDEPENDENT / max(1, len(found)))
            yield total - total.max()


def identify(pages: DataFrame, docs: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host) for every page.

    Four kinds of evidence are multiplied: the text's likelihood; how often
    pages of a language declare what this one does in its markup or its
    address folder; how often they have this address suffix; and the host's
    prior.  The tables for all but the first are sums of the texts' posteriors
    over all pages, grouped by value.  A host's prior is smoothed towards its
    domain's and that towards the whole, each without the page's own share.

    Null or empty pages have no text evidence.  A null address has no host,
    suffix or folder: these pages share the empty value of each.  Repeated
    pages are pages each.  Without labelled documents the language is null.
    An empty table gives no rows.  Other columns are ignored.
    """
    spark = pages.sparkSession
    langs, model = text_model(docs, train_rows=train_rows)
    html, url = F.col(html_col).cast("string"), F.col(url_col).cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))
    labels = F.split(host, r"\.")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), host.alias("host"), F.array_join(F.slice(F.reverse(labels), 1, 2), ".").alias("domain"), F.element_at(labels, -1).alias("suffix"),
        F.lower(F.coalesce(F.regexp_extract(html, DECLARED, 1), F.lit(""))).alias("declared"), F.lower(F.coalesce(F.regexp_extract(url, FOLDER, 1), F.lit(""))).alias("folder"),
        F.regexp_replace(F.coalesce(html, F.lit("")), MARKUP, " ").alias("text"),
    )
    if not langs:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    table = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r.tolist() for r in text_log_likelihood(batch.column(6), table.value)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names[:6], "ll"])

    rows = materialize(rows.mapInArrow(tidy(run), "page_id long, host string, domain string, suffix string, declared string, folder string, ll array<double>"), "language-text")
    table.destroy()
    n = len(langs)
    every = range(n)
    soft = F.transform("ll", lambda v: F.exp(v))
    total = F.aggregate(soft, F.lit(0.0), lambda a, v: a + v)
    rows = rows.withColumn("post", F.transform(soft, lambda v: v / total))

    def sums(key: str) -> DataFrame:
        return materialize(rows.groupBy(key).agg(F.array(*[F.sum(F.col("post")[i]) for i in every]).alias(f"by_{key}")), f"language-{key}")

    whole = rows.agg(F.array(*[F.sum(F.col("post")[i]) for i in every])).first()[0]
    if whole[0] is None:
        whole = [1.0] * n
    overall = sum(whole)
    for key in ("declared", "folder", "suffix", "domain", "host"):
        rows = rows.join(checked_broadcast(sums(key), row_bytes=F.octet_length(key) + 64 + 8 * n), key)

    def evidence(key: str, i: int) -> Column:
        """Log probability that a page of language i has this value; the average over languages is the prior."""
        own = F.col(f"by_{key}")[i] - F.col("post")[i]
        mean = (F.aggregate(f"by_{key}", F.lit(0.0), lambda a, v: a + v) - 1) / F.lit(max(overall - 1, 1.0))
        return F.log((F.greatest(own, F.lit(0.0)) + EVIDENCE_PRIOR * F.greatest(mean, F.lit(1e-9))) / (F.lit(whole[i]) - F.col("post")[i] + EVIDENCE_PRIOR))

    def prior(i: int) -> Column:
        level = F.lit((whole[i] + 1.0) / (overall + n))
        for key in ("domain", "host"):
            own = F.greatest(F.col(f"by_{key}")[i] - F.col("post")[i], F.lit(0.0))
            size = F.aggregate(f"by_{key}", F.lit(0.0), lambda a, v: a + v) - 1
            level = (own + HOST_PRIOR * level) / (F.greatest(size, F.lit(0.0)) + HOST_PRIOR)
        return F.log(level)

    joint = F.array(*[F.col("ll")[i] + evidence("declared", i) + evidence("folder", i) + evidence("suffix", i) + prior(i) for i in every])
    rows = rows.withColumn("joint", joint)
    best = F.array_max("joint")
    mass = F.aggregate(F.transform("joint", lambda v: F.exp(v - best)), F.lit(0.0), lambda a, v: a + v)
    name = F.array(*[F.lit(v) for v in langs])
    first = lambda values, top: F.element_at(name, F.array_position(values, top).cast("int"))
    return rows.select("page_id", first(F.col("joint"), best).alias("lang"), (1 / mass).alias("probability"), first(F.col("ll"), F.array_max("ll")).alias("text_lang"), "declared", "host")
