"""Mixing of sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predio.llm.common import checked_broadcast, materialize

#: Documents that one task of the first round pairs, and residuals that one of a later round does.
CHUNK_ROWS, FAN_IN = 2_000, 1_024
WORD = r"[^\x20\x09-\x0D]+"
_TINY = 1e-9


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Target words of each source.

    Sources in code point order, null last, take ``weights`` in turn.  They
    share ``share`` times all words; a source stops at ``cap`` times its own,
    and the others share by weight what it leaves, until none is above.
    """
    ordered = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(ordered)}
    rest, open_weight, target = share * sum(n for _, n in sizes), sum(weight.values()), {}
    # what stops first has the fewest own words for its weight; what it leaves can only raise the others
    for name, own in sorted(ordered, key=lambda s: s[1] / weight[s[0]]):
        target[name] = min(cap * own, rest * weight[name] / open_weight)
        rest -= target[name]
        open_weight -= weight[name]
    return target


def pivotal(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round fractions pair by pair, keeping the sum of ``p * size``, until one fraction at most is left.

    Of a pair, mass moves from one to the other by as much as makes one of the
    two integral; the direction is drawn so that every expectation stays.
    """
    p = p.copy()
    draws = rng.random(len(p))
    held = -1
    for i in range(len(p)):
        if not _TINY < p[i] < 1 - _TINY:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        up = min((1 - p[held]) * a, p[i] * b)
        down = min(p[held] * a, (1 - p[i]) * b)
        move = up if draws[i] * (up + down) < down else -down
        p[held] += move / a
        p[i] -= move / b
        for j in (held, i):
            if not _TINY < p[j] < 1 - _TINY:
                p[j] = round(p[j])
        held = held if 0 < p[held] < 1 else (i if 0 < p[i] < 1 else -1)
    return p


def _round(seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "row_key"], kind="stable")
        rng = np.random.default_rng([seed, *(int(k) & 0xFFFFFFFF for k in key[:2])])
        return pdf.assign(p=pivotal(pdf["p"].to_numpy(), pdf["size"].to_numpy().astype(float), rng))

    return run


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
    row_key: Column | None = None,
) -> DataFrame:
    """How often the mix takes each document: doc_id, source, row_key, size, source_size, target, copies, taken.

    A document's expected copies are its source's target over its source's
    words.  The whole part is taken outright.  The fractional parts are rounded
    by pivotal pairing within chunks of a source, in words rather than rows, so
    that a chunk keeps its sum; the one document a chunk leaves fractional goes
    on to the next round of a reduction tree, and the last of a source is drawn.
    Chunks follow from ids, texts and counts alone: a rerun gives the same copies.
    The driver holds one row for each source, as their code point order decides the weights: sources are meant to
    be thousands, not as many as documents.

    Empty and null texts have no words and are never taken.  ``row_key`` tells
    rows that share an id by their text, or by the given long; equal rows get copies each.  A null
    source is a source.  An empty table gives no rows.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.xxhash64(text_col) if row_key is None else row_key).alias("row_key"), words.alias("size")), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    target = source_targets([(r["source"], r["source_size"]) for r in sources], weights, share, cap)
    plan = [(i, r["source"], r["source_size"], float(target[r["source"]]), max(1, -(-r["n"] // CHUNK_ROWS))) for i, r in enumerate(sorted(sources, key=lambda r: (r["source"] is None, (r["source"] or "").encode())))]
    spark = docs.sparkSession
    table = spark.createDataFrame(plan, "source_no int, source string, source_size long, target double, chunks int")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("rate") + F.lit(_TINY))
    rows = rows.join(checked_broadcast(table, len(plan)), rows["source"].eqNullSafe(table["source"])).drop(table["source"])
    rows = rows.withColumn("rate", rate).withColumn("base", F.when(F.col("size") > 0, whole).otherwise(0)).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "row_key"), F.col("chunks")).cast("long"))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.greatest(F.col("rate") - F.col("base"), F.lit(0.0))).otherwise(0.0))
    columns = ["doc_id", "row_key", "source_no", "source", "size", "source_size", "target", "base", "chunk", "p"]
    schema = "doc_id long, row_key long, source_no int, source string, size long, source_size long, target double, base long, chunk long, p double"
    done, left, chunks = [], rows.select(columns), max([p[4] for p in plan], default=1)
    level = 0
    while True:
        # the group key carries the level so that every round draws anew
        rounded = materialize(left.groupBy("source_no", (F.col("chunk") + level * 1_000_003).alias("at")).applyInPandas(_round(seed), schema), "mix-round")
        done.append(rounded.where("p <= 0 or p >= 1"))
        left = rounded.where("p > 0 and p < 1").withColumn("chunk", F.floor(F.col("chunk") / FAN_IN).cast("long"))
        level += 1
        if chunks == 1:
            break
        chunks = -(-chunks // FAN_IN)
    draw = F.pmod(F.xxhash64(F.lit(seed), "source_no", "doc_id", "row_key"), F.lit(1 << 30)) / float(1 << 30)
    done.append(left.withColumn("p", F.when(draw < F.col("p"), 1.0).otherwise(0.0)).select(columns))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = (F.col("base") + F.round("p")).cast("long")
    return out.select("doc_id", "source", "row_key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
