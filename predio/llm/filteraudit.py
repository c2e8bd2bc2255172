"""How filters overlap: sorted lists of failing documents per filter, merged by part and range of ids."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predio.llm.common import checked_broadcast, discard, join_few, materialize, tidy

WORD = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """What fails: A few words, B few distinct words, C many capitals, D marks of code or tables."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n_words, n_chars = F.size(words), F.char_length(text)
    capitals = n_chars - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n_words < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * n_words, "C": 100 * capitals > 2 * n_chars, "D": text.rlike(r"[#$%&*|]")}


def place(needles: np.ndarray, hay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each needle belongs in ``hay``, and whether it is there; both ascend.

    The search for a needle starts where that for the one before it ended and
    skips what lies between, so a short list costs little in a long one.
    """
    at = np.searchsorted(hay, needles)
    there = np.zeros(len(needles), bool)
    inside = at < len(hay)
    there[inside] = hay[at[inside]] == needles[inside]
    return at, there


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both lists as one, the shorter one's entries put into the longer."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    at, there = place(few, many)
    return np.insert(many, at[~there], few[~there])


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Entries of ``a`` that ``b`` does not hold."""
    if len(a) <= len(b):
        return a[~place(a, b)[1]]
    at, there = place(b, a)
    return np.delete(a, at[there])


def _lists(names: list[str], flags: list[str]):
    """Posting lists of each run of rows of one part; rows come sorted by part and id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part, rows in pdf.groupby("part", sort=False):
                block = {"part": part, "ids": rows["id"].to_numpy()}
                for i, name in enumerate([*names, *flags]):
                    bits = rows["mask"].to_numpy() >> i & 1 if i < len(names) else rows[name].to_numpy(dtype=bool)
                    block[f"list_{name}"] = np.flatnonzero(bits).astype(np.int32)
                yield pd.DataFrame([block])

    return run


def _sizes(names: list[str], flags: list[str]):
    """Per part, filter and set of filters before it: how many it removes, how many are gone by then, how many of each flag it removes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            total: dict[tuple, np.ndarray] = {}
            for row in pdf.to_dict("records"):
                lists = [np.asarray(row[f"list_{name}"]) for name in names]
                marked = [np.asarray(row[f"list_{name}"]) for name in flags]
                unions = [np.empty(0, np.int32)]
                for done in range(1, 1 << len(names)):
                    last = done.bit_length() - 1
                    unions.append(union(unions[done ^ (1 << last)], lists[last]))
                for done, f in itertools.product(range(1 << len(names)), range(len(names))):
                    if not done >> f & 1:
                        removed = difference(lists[f], unions[done])
                        found = [len(removed), len(unions[done | 1 << f]), *(int(place(removed, m)[1].sum()) for m in marked)]
                        key = row["part"], done, f
                        total[key] = total.get(key, 0) + np.array(found, np.int64)
            columns = ["removed", "gone", *flags]
            yield pd.DataFrame([(*k, *v.tolist()) for k, v in total.items()], columns=["part", "before", "filter", *columns])

    return run


def posting_lists(rows: DataFrame, names: list[str], flags: list[str]) -> DataFrame:
    """One row per part and range of ids: the ids that fail anything, ascending, and a list for each filter and flag.

    ``rows`` has id, part, row (which tells rows of one id apart), mask (bit i:
    fails filter i) and the flags.  A list names documents by their place among
    the ids, so that rows repeating an id stay apart; a null id stands as the
    least number.  Ranges follow the data:
    rows are dealt by part and id, so a part of any size is spread over tasks.
    """
    schema = f"part string, ids array<long>, {', '.join(f'list_{n} array<int>' for n in [*names, *flags])}"
    ids = F.coalesce("id", F.lit(-(1 << 63))).alias("id")
    ordered = rows.where("mask > 0").select("part", ids, "row", "mask", *flags).repartitionByRange("part", "id", "row").sortWithinPartitions("part", "id", "row")
    return ordered.mapInPandas(tidy(_lists(names, flags)), schema)


def filter_interactions(rows: DataFrame, names: list[str], flags: list[str]) -> DataFrame:
    """One row per part, order of the filters and step, zeros included; ``rows`` as for ``posting_lists``.

    Counts kept, removed, redundant, unique_fails, one ``<flag>_lost`` for each
    flag and shapley (the step's filter's removed, summed over all orders).
    All follow from the sizes of unions and differences of the lists, which
    add up over ranges; there are 2**k sets for k filters, not k! orders.
    """
    k = len(names)
    lists = materialize(posting_lists(rows, names, flags), "posting-lists")
    counted = ["removed", "gone", *flags]
    sums = lists.mapInPandas(tidy(_sizes(names, flags)), f"part string, before int, filter int, {', '.join(f'{c} long' for c in counted)}")
    sums = materialize(sums.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in counted]), "union-sizes")
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    pairs = [{"before": done, "filter": f, "weight": math.factorial(done.bit_count()) * math.factorial(k - 1 - done.bit_count()), "alone": done | 1 << f == (1 << k) - 1} for done in range(1 << k) for f in range(k) if not done >> f & 1]
    every = F.from_json(F.lit(json.dumps(pairs)), "array<struct<before int, filter int, weight long, alone boolean>>")
    filled = parts.select("part", "n", F.inline(every)).join(sums, ["part", "before", "filter"], "left").fillna(0, counted)
    filled = materialize(filled, "union-sizes-filled")
    of_filter = filled.groupBy("part", "filter").agg(F.sum(F.col("weight") * F.col("removed")).alias("shapley"), F.sum(F.when(F.col("before") == 0, F.col("removed")).otherwise(0)).alias("fails"), F.sum(F.when(F.col("alone"), F.col("removed")).otherwise(0)).alias("unique_fails"))
    steps = [("".join(names[f] for f in order), at + 1, sum(1 << f for f in order[:at]), order[at]) for order in itertools.permutations(range(k)) for at in range(k)]
    orders = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int")
    out = filled.join(of_filter, ["part", "filter"]).join(F.broadcast(orders), ["before", "filter"])  # k * k! rows, whatever the data
    discard(lists, sums)
    return out.select(
        "part", "filter_order", "step", (F.col("n") - F.col("gone")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *[F.col(f).alias(f"{f}_lost") for f in flags], "shapley"
    )


def audit_filters(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Interactions of the filters A to D and E, a text that a smaller id has too, per part, with good and toxic documents lost.

    Every row is a document.  A null text is empty, so empty and null texts
    are identical; a null part is the empty string.  A null id is neither
    smaller nor larger than any: such a row never fails E and makes none fail.
    A document is good (toxic) if any of its labels says 1; rows without an id
    have no labels.  Texts are read once; what moves is two hashes and a mask.
    An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    filters = text_filters(text)
    mask = sum((F.when(v, 1 << i).otherwise(0) for i, v in enumerate(filters.values())), F.lit(0))
    digest = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2"), F.monotonically_increasing_id().alias("row"),
    )
    digest = materialize(digest, "filter-digest")
    firsts = digest.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    firsts = materialize(firsts, "first-copies")
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("good or toxic")
    told = materialize(told, "audit-labels")
    again = F.when(F.col("id") > F.col("first"), 1 << len(filters)).otherwise(0)
    rows = digest.join(checked_broadcast(firsts), ["h1", "h2"], "left").withColumn("mask", F.col("mask") + again)
    rows = join_few(rows, told, "id", "left")
    rows = materialize(rows.select("id", "part", "row", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")), "audit-rows")
    discard(digest, firsts, told)
    return filter_interactions(rows, [*filters, "E"], ["good", "toxic"])
