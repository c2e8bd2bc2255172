"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from predio.llm.common import checked_broadcast, discard, materialize, text_bytes

#: Items that one task differences at most, and largest items' worth of bytes that a chunk has for every shard at least.
TASK_ITEMS, CHUNK_LOAD = 16_384, 16


def differencing(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of k slot sums) into one.

    The two with the largest spread between their slots are merged, the
    fullest slots of one with the emptiest of the other, until one is left.
    Returns for each row and slot the final slot, and the final sums.
    """
    m, k = parts.shape
    order = np.argsort(parts, axis=1, kind="stable")
    sums = list(np.take_along_axis(parts, order, axis=1))
    merges: list[tuple[int, int, np.ndarray]] = []
    heap = [(int(s[0]) - int(s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        both = sums[a] + sums[b][::-1]
        perm = np.argsort(both, kind="stable")
        sums[a] = sums[b] = None
        sums.append(both := both[perm])
        merges.append((a, b, perm))
        heapq.heapreplace(heap, (int(both[0]) - int(both[-1]), len(sums) - 1))
    where: dict[int, np.ndarray] = {len(sums) - 1: np.arange(k)}
    for node in range(len(sums) - 1, m - 1, -1):
        a, b, perm = merges[node - m]
        place = np.empty(k, dtype=np.int64)
        place[perm] = where.pop(node)
        where[a], where[b] = place, place[::-1]
    slots = np.empty((m, k), dtype=np.int64)
    for i in range(m):
        slots[i, order[i]] = where[i]
    return slots, sums[-1]

def levels_of(counts: dict[int, int], shards: int) -> dict[int, int]:
    """Level by size class (the bit length of the bytes), largest first, from how many items each class has.

    Where a level has more items than one task takes, its sizes differ little
    enough that a chunk with its load has no more than that either.
    """
    doublings = max(1, (TASK_ITEMS // (shards * CHUNK_LOAD)).bit_length())
    level, held, top, out = 0, 0, None, {}
    for size in sorted(counts, reverse=True):
        if top is not None and held + counts[size] > TASK_ITEMS and (top - size >= doublings or held <= TASK_ITEMS):
            level, held, top = level + 1, 0, None
        top = size if top is None else top
        held += counts[size]
        out[size] = level
    return out


def _placed(shards: int, held: np.ndarray, total: float):
    """Differencing over the items of a chunk and, as one more partial partition, its part of what the shards hold by now."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "group_key", "piece"], ascending=[False, True, True])
        size = pdf["bytes"].to_numpy()
        parts = np.zeros((len(pdf) + 1, shards), dtype=np.int64)
        parts[:-1, -1] = size
        # shards that hold the same stand in another order in every chunk, so that what chunks leave over does not add up
        mixed = np.random.default_rng(int(pdf["chunk"].iloc[0])).permutation(shards)
        parts[-1] = np.rint((held - held.min()) * (size.sum() / total)).astype(np.int64)[mixed]
        slots, _ = differencing(parts)
        shard_at = np.empty(shards, dtype=np.int32)
        shard_at[slots[-1]] = mixed
        return pd.DataFrame({"group_key": pdf["group_key"], "piece": pdf["piece"], "bytes": size, "shard": shard_at[slots[:-1, -1]]})

    return run


def shard_by_bytes(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Put documents into ``shards`` shards of nearly equal bytes; equal texts stay together.

    Groups of equal texts are the items.  They are differenced in levels of
    size, the largest first, as differencing takes them.  A level that is too
    large for one task is dealt out in chunks, each of which combines its
    groups to a partial partition and that with its part of what the shards
    hold from the levels before: small groups level out what large ones left.
    A chunk has many largest groups' worth of bytes for every shard, and what
    chunks leave over falls on the shards at random.

    Only a group of copies above a whole fair share, which cannot be whole in
    balance, is split: by document id into pieces of about half a share.

    A null text has no bytes and stands with the empty one.  Repeated rows are
    rows like others.  An empty table gives no rows.  Returns doc_id, size,
    text_crc32, group_key, shard and slot (gapless from 0 in each shard, in an
    order set by ids and texts but for rows that are equal in both).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), (text_bytes(F.col(text_col)) + overhead).alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("group_key")), "shard-rows"
    )
    groups = materialize(rows.groupBy("group_key").agg(F.sum("size").alias("bytes")), "shard-groups")
    share = max((groups.agg(F.sum("bytes")).first()[0] or 0) / shards, 1.0)
    # fewer than one group to a shard is larger than a share
    split = F.broadcast(groups.where(F.col("bytes") > share).select("group_key", F.ceil(F.col("bytes") * 2 / F.lit(share)).cast("int").alias("pieces")))
    piece = F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int")
    whole = groups.where(F.col("bytes") <= share).select("group_key", F.lit(0).alias("piece"), "bytes")
    parts = rows.join(split, "group_key").groupBy("group_key", piece.alias("piece")).agg(F.sum("size").alias("bytes"))
    items = materialize(whole.unionByName(parts).withColumn("class", F.length(F.bin("bytes"))), "shard-items")

    classes = {r["class"]: r for r in items.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    level_of = levels_of({c: r["n"] for c, r in classes.items()}, shards)
    held, placed = np.zeros(shards, dtype=np.int64), []
    for level in range(len(set(level_of.values()))):
        own = [c for c in classes if level_of[c] == level]
        total, n = sum(classes[c]["bytes"] for c in own), sum(classes[c]["n"] for c in own)
        chunks = 1 if n <= TASK_ITEMS else max(1, total // (shards * CHUNK_LOAD << max(own)))
        chunk = F.pmod(F.xxhash64("group_key", "piece"), F.lit(chunks)).alias("chunk")
        run = _placed(shards, held.copy(), float(total))
        placed.append(materialize(items.where(F.col("class").isin(own)).select("group_key", "piece", "bytes", chunk).groupBy("chunk").applyInPandas(run, "group_key string, piece int, bytes long, shard int"), "shard-level"))
        for r in placed[-1].groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():
            held[r["shard"]] += r["bytes"]
    if not placed:
        return numbered(rows.withColumn("shard", F.lit(0)), "shard", "slot")
    where = placed[0]
    for part in placed[1:]:
        where = where.unionByName(part)
    where = materialize(where.select("group_key", "piece", "shard"), "shard-places")
    keyed = rows.join(split, "group_key", "left").withColumn("piece", F.coalesce(piece, F.lit(0))).drop("pieces")
    out = numbered(keyed.join(checked_broadcast(where, row_bytes=F.lit(96)), ["group_key", "piece"]).drop("piece"), "shard", "slot")
    discard(items, *placed)
    return out


def numbered(rows: DataFrame, key: str, name: str, chunk_rows: int = 50_000) -> DataFrame:
    """Number the rows of each ``key`` from 0 without a gap.

    Rows are numbered within chunks of a key, and chunks start where the
    counts before them end, so that no task holds a whole key.
    """
    rows = materialize(rows.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "group_key"), F.lit(4096))), f"numbered-{name}")
    total = rows.count()
    chunks = min(4096, max(1, total // chunk_rows))
    rows = rows.withColumn("_chunk", F.pmod("_chunk", F.lit(chunks)))
    counts = rows.groupBy(key, "_chunk").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy("doc_id", "group_key"))
    return rows.withColumn("_rank", within).join(checked_broadcast(before), [key, "_chunk"]).withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_chunk", "_rank", "_before")
