"""SimHash fingerprints and all fingerprints within a Hamming radius by permuted block tables."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predio.llm.common import checked_broadcast, materialize, shuffle_partitions, small_batches, tidy
from predio.llm.textkernel import NOT_SPACE, chained, lowered, span_hashes, spans, text_arrays

#: Fingerprints of one side of a block of a crowded table entry.
BLOCK_ROWS = 4096


def fingerprints(texts: pa.Array) -> np.ndarray:
    """64-bit SimHash of each text: its pairs of neighbouring words vote on every bit, the oftener the heavier.

    A term's weight is 1 + ln(count), in sixteenths.  A text of one word has
    that word as its term; one without words has the fingerprint 0.
    """
    out = np.zeros(len(texts), dtype=np.uint64)
    for first, data, offsets in text_arrays(texts):
        data = lowered(data)
        starts, ends, counts = spans(data, offsets, NOT_SPACE)
        words = span_hashes(data, starts, ends)[0]
        pairs = chained(words[:-1], words[1:]) if len(words) > 1 else words
        stops = np.cumsum(counts)
        for i in np.flatnonzero(counts):
            n, stop = counts[i], stops[i]
            terms, times = np.unique(words[stop - 1 : stop] if n == 1 else pairs[stop - n : stop - 1], return_counts=True)
            weight = np.rint(16 * (1 + np.log(times)))
            bits = np.unpackbits(terms.view(np.uint8).reshape(-1, 8), axis=1)
            ayes = weight @ bits.astype(np.float64)
            out[first + i] = np.packbits(2 * ayes > weight.sum()).view(np.uint64)[0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b) / 64.0


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, in descending order, with the first row of the range that follows as its guard."""
    held: list[tuple] = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        yield from _rows(held[:-1], held[-1:])
        held = held[-1:]


def _rows(rows: list[tuple], last: list[tuple]) -> Iterator[pa.RecordBatch]:
    texts = [r[3] or "" for r in [*rows, *last]]
    keep = [i for i, r in enumerate(rows) if not r[1]]
    if not keep:
        return
    marks = fingerprints(pa.array(texts, pa.large_string()))
    edited = []
    for i in keep:
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    edited_marks = fingerprints(pa.array(edited, pa.large_string()))
    own, following = marks[keep], marks[np.array(keep) + 1]
    hexes = lambda x: pa.array([f"{v:016x}" for v in x.tolist()])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][2] for i in keep], pa.int64()), pa.array([len(texts[i]) for i in keep], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), hexes(own), hexes(edited_marks),
            pa.array(likeness(own, edited_marks)), pa.array(likeness(own, following)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, whose second half is the beginning of the next text.

    Texts follow each other in descending id order (null ids last, equal ids by
    the text's hash), the first after the last.  Rows are dealt out in ranges
    of ids and sorted within them; each range also gets the first row of the
    range that follows, so texts move once and no task orders them all.

    A null text is empty: its edit is empty and its fingerprint 0.  Repeated
    rows are rows like others.  A single row follows itself.  An empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("at"))
    ranges = 3 * shuffle_partitions(spark)
    bounds = np.array(sorted(set(ids.agg(F.percentile_approx("at", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or [])), dtype=np.int64)

    @F.pandas_udf("long")
    def range_of(at: pd.Series) -> pd.Series:
        return pd.Series(-np.searchsorted(bounds, at.to_numpy()))

    firsts = sorted(ids.withColumn("range", range_of("at")).groupBy("range").agg(F.max("at")).collect())
    # a row at most for each range
    guards = [(firsts[(i + 1) % len(firsts)][1], r[0]) for i, r in enumerate(firsts)]
    table = spark.createDataFrame(guards, "at long, other long").groupBy("at").agg(F.collect_list("other").alias("others"))
    at = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), at.alias("at"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("range", range_of("at")).join(F.broadcast(table), "at", "left")
    own = F.array(F.struct("range", F.lit(False).alias("guard")))
    others = F.transform(F.coalesce("others", F.array().cast("array<long>")), lambda r: F.struct(r.alias("range"), F.lit(True).alias("guard")))
    dealt = rows.select("doc_id", "at", "text", F.explode(F.concat(own, others)).alias("to")).select("to.range", "to.guard", "doc_id", "text", "at")
    dealt = dealt.repartition(shuffle_partitions(spark), "range").sortWithinPartitions("range", "guard", F.desc("at"), F.xxhash64("text"))
    return dealt.select("range", "guard", "doc_id", "text").mapInArrow(tidy(_edited), OUT)


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of the tables: each takes all but ``radius`` of the blocks, so near fingerprints agree on one whole mask."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [sum(c) for c in itertools.combinations(masks, blocks - radius)]


def _near_counts(radius: int, masks: np.ndarray):
    schema = pa.schema([("fp", pa.int64()), ("n", pa.int64())])

    def group(table: int, q: int, d: int, fp: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = (fp, fp) if q == d else (fp[chunk == q], fp[chunk == d])
        counts = []
        for left, right in ((a, b), (b, a))[: 1 if q == d else 2]:
            total = np.zeros(len(left), dtype=np.int64)
            for i in range(0, len(left), 256):
                diff = left[i : i + 256, None] ^ right[None, :]
                near = (np.bitwise_count(diff) <= radius) & (diff != 0)
                for mask in masks[:table]:  # a pair counts in the first table where it meets
                    near &= (diff & mask) != 0
                total[i : i + 256] = near.sum(1)
            counts.append(total)
        return (a, counts[0]) if q == d else (np.concatenate([a, b]), np.concatenate(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            new = None if batch is None else np.stack([batch.column(i).to_numpy() for i in range(6)], axis=1)
            rows = new if held is None else held if new is None else np.concatenate([held, new])
            if rows is None or not len(rows):
                continue
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1
            edges = [0, *cuts.tolist(), len(rows)]
            held = None if batch is None else rows[edges[-2] :]
            found = [group(int(rows[s, 0]), int(rows[s, 2]), int(rows[s, 3]), rows[s:e, 4].view(np.uint64), rows[s:e, 5]) for s, e in itertools.pairwise(edges if batch is None else edges[:-1])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[0] for f in found]).view(np.int64)), pa.array(np.concatenate([f[1] for f in found]))], schema=schema)

    return run


def _dealt(marks: DataFrame, radius: int, blocks: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The distinct fingerprints, their table entries dealt out in blocks of pairs, and the tables' masks."""
    spark = marks.sparkSession
    masks = block_masks(radius, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    distinct = materialize(marks.select(F.col("fp").cast("long").alias("fp")).where("fp is not null").distinct(), "fingerprints")
    keys = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])).alias("k")).select("fp", "k.*")
    met = materialize(keys.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1"), "fingerprint-tables")
    rows = keys.join(checked_broadcast(met), ["table", "key"]).withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS).cast("long"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("fp"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("table", "key", F.least("chunk", "other").alias("q"), F.greatest("chunk", "other").alias("d"), "fp", "chunk")
    dealt = rows.repartition(shuffle_partitions(spark), "table", "key", "q", "d").sortWithinPartitions("table", "key", "q", "d")
    return distinct, dealt, np.array(masks, dtype=np.uint64)


def _near_pairs(radius: int, masks: np.ndarray):
    schema = pa.schema([("fp", pa.int64()), ("other", pa.int64()), ("distance", pa.int32())])

    def group(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        table, q, d, fp = int(rows[0, 0]), rows[0, 2], rows[0, 3], rows[:, 4].view(np.uint64)
        left, right = (fp, fp) if q == d else (fp[rows[:, 5] == q], fp[rows[:, 5] == d])
        for i in range(0, len(left), 256):
            diff = left[i : i + 256, None] ^ right[None, :]
            near = (np.bitwise_count(diff) <= radius) & (diff != 0)
            if q == d:
                near &= left[i : i + 256, None] < right[None, :]
            a, b = np.nonzero(near)
            first = ((diff[a, b][:, None] & masks[None, :table]) != 0).all(1)  # a pair counts in the first table where it meets
            if first.any():
                x, y = left[i : i + 256][a[first]], right[b[first]]
                columns = [np.minimum(x, y).view(np.int64), np.maximum(x, y).view(np.int64), np.bitwise_count(x ^ y).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 6), dtype=np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(6)], axis=1)])
            cuts = [0, *(np.flatnonzero((held[1:, :4] != held[:-1, :4]).any(1)) + 1).tolist()]
            for s, e in itertools.pairwise(cuts):
                yield from group(held[s:e])
            held = held[cuts[-1] :]
        if len(held):
            yield from group(held)

    return run


def near_pairs(marks: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(fp, other, distance): every pair of distinct fingerprints within ``radius`` bits, once, the smaller as unsigned first.

    Met in the block tables of ``near_counts``.  Documents join by their
    fingerprints, so copies of one fingerprint do not multiply the pairs.
    """
    _, dealt, masks = _dealt(marks, radius, blocks)
    return dealt.mapInArrow(tidy(_near_pairs(radius, masks)), "fp long, other long, distance int")


def near_counts(marks: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(fp, n_near): how many other distinct fingerprints lie within ``radius`` bits of each.

    Fingerprints are split in ``blocks``; each table keys them by all but
    ``radius`` of the blocks, so any two within the radius meet in one.  An
    entry with very many fingerprints is dealt out in blocks of pairs.  The
    result has a row for each distinct fingerprint; none for an empty table.
    """
    distinct, dealt, masks = _dealt(marks, radius, blocks)
    counts = dealt.mapInArrow(tidy(_near_counts(radius, masks)), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n_near"))
    return distinct.join(counts, "fp", "left").select("fp", F.coalesce("n_near", F.lit(0)).alias("n_near"))
