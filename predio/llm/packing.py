"""Hierarchical multi-length packing of tokenised documents."""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predio.llm.common import checked_broadcast, materialize, once_a_worker, small_batches, tidy

#: ``place`` counts a task's sequences of one window.
PIECE = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "place")])
IDS = T.StructField("ids", T.BinaryType())
TASK_BITS = 40

END_ID = 1
#: Tokens that wait in a task before windows are closed, so that gaps find pieces of every length.
WAITING_TOKENS = 1 << 17


def make_encoder(tokenizer_json: str, rank_file: str | None = None, pattern: str | None = None) -> Callable[[list[str]], list[np.ndarray]]:
    """Token ids of texts by the tokenizer in ``tokenizer_json``.

    ``rank_file`` with ``pattern`` is the same vocabulary as merge ranks: texts
    go through the faster library that reads it, except those that spell one of
    the tokenizer's special tokens, which keep the reference behaviour.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_json)
    if rank_file is None:
        return lambda texts: [np.array(e.ids, np.uint32) for e in exact.encode_batch(texts, add_special_tokens=False)]
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    special = [token.content for token in exact.get_added_tokens_decoder().values()]

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(exact.encode(t, add_special_tokens=False).ids if any(s in t for s in special) else fast.encode_ordinary(t), np.uint32) for t in texts]

    return encode


class _Packer:
    """Packs the documents of one task; holds a bounded number of waiting tokens.

    A document longer than the largest window first fills whole windows; what
    is left is routed to the smallest tier that holds it.  A window of a tier
    opens with one of that tier's pieces, its gap is filled with whole pieces
    of shorter tiers, longest first, and the last gap with a piece cut to fit.
    What is left at the end of the task is cut at its binary digits, so those
    windows are whole powers of two and need no padding.
    """

    def __init__(self, task: int, tiers: tuple[int, ...], with_ids: bool):
        self.tiers, self.longest = tiers, tiers[-1]
        self.pools: dict[int, deque] = {t: deque() for t in tiers}
        self.waiting = 0
        self.base, self.made = task << TASK_BITS, 0
        self.places: dict[int, int] = {}
        self.with_ids = with_ids
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.longest
        for start in range(0, whole, self.longest):
            self.emit(self.longest, [(doc_id, start, ids[start : start + self.longest], n)])
        if whole < n:
            self.route((doc_id, whole, ids[whole:], n))
        while self.waiting > WAITING_TOKENS:
            self.close_one()

    def route(self, piece: tuple) -> None:
        n = len(piece[2])
        tier = next(t for t in self.tiers if n <= t)
        if n == tier:
            self.emit(tier, [piece])
        else:
            self.pools[tier].append(piece)
            self.waiting += n

    def close_one(self) -> None:
        tier = max((t for t in self.tiers if self.pools[t]), key=lambda t: t * len(self.pools[t]))
        self.fill(tier)

    def fill(self, window: int) -> None:
        content, gap = [], window
        while gap:
            tier = next((t for t in reversed(self.tiers) if self.pools[t] and self._fits(t, gap)), None)
            if tier is None:
                tier = next(t for t in self.tiers if self.pools[t])
                doc_id, start, ids, n = self._take(tier)
                content.append((doc_id, start, ids[:gap], n))
                if len(ids) > gap:
                    self.route((doc_id, start + gap, ids[gap:], n))
                gap -= len(content[-1][2])
            else:
                piece = self._take(tier)
                content.append(piece)
                gap -= len(piece[2])
        self.emit(window, content)

    def _fits(self, tier: int, gap: int) -> bool:
        """Bring a piece that fits to the front, looking at a few of the tier's pieces."""
        pool = self.pools[tier]
        if tier <= gap:
            return True
        if tier > 2 * gap:
            return False
        for _ in range(min(len(pool), 16)):
            if len(pool[0][2]) <= gap:
                return True
            pool.rotate(-1)
        return False

    def _take(self, tier: int) -> tuple:
        piece = self.pools[tier].popleft()
        self.waiting -= len(piece[2])
        return piece

    def finish(self) -> None:
        while self.waiting >= self.longest:
            self.fill(self.longest)
        while self.waiting:
            self.fill(1 << (self.waiting.bit_length() - 1))

    def emit(self, window: int, content: list[tuple]) -> None:
        sequence, self.made = self.base + self.made, self.made + 1
        place = self.places.get(window, 0)
        self.places[window] = place + 1
        offset = 0
        for doc_id, start, ids, n in content:
            data = ids.astype("<u4").tobytes()
            row = (doc_id, start, len(ids), zlib.crc32(data), n, sequence, offset, window, place)
            self.rows.append((*row, data) if self.with_ids else row)
            offset += len(ids)


def pack(
    docs: DataFrame,
    tokenizer_json: str,
    rank_file: str | None = None,
    pattern: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = (128, 256, 512, 1024, 2048),
    step_tokens: int = 65536,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece of a document in a sequence; ``window`` is the sequence's length.

    Every task packs the rows it reads and holds at most a fixed number of
    waiting tokens, so no text is shuffled and a hot source or group of copies
    makes no task larger.  ``step_group`` numbers groups of sequences of one
    window, which hold ``step_tokens`` tokens each whatever task packed them;
    only the last group of a window can be short.  ``ids`` (with ``with_ids``)
    are the piece's token ids as little-endian unsigned 32-bit numbers.

    A null text counts as empty and has the end id alone; repeated rows are
    packed each for itself; an empty table gives no rows; other columns are
    ignored; a null id stays null.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([*PIECE.fields, IDS]) if with_ids else PIECE
    arrow = pa.schema([(f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in schema.fields])
    tiers = tuple(sorted(tiers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = once_a_worker((tokenizer_json, rank_file, pattern), lambda: make_encoder(tokenizer_json, rank_file, pattern))
        packer = _Packer(TaskContext.get().partitionId(), tiers, with_ids)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for first in range(0, len(ids), 64):
                coded = encode([t or "" for t in texts[first : first + 64].to_pylist()])
                for doc_id, tokens in zip(ids[first : first + 64], coded, strict=True):
                    packer.add(doc_id, np.append(tokens, np.uint32(END_ID)))
            if len(packer.rows) >= 4096 or with_ids:
                yield from _batches(packer, arrow)
        packer.finish()
        yield from _batches(packer, arrow)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_step_groups(materialize(texts.mapInArrow(tidy(run, keep=True), schema), "pieces"), step_tokens)


def with_step_groups(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """``pieces`` with step_group in the place of ``place``: sequences of one window are numbered through all tasks and grouped in turn.

    Only counts are gathered, one for each task and window.
    """
    task = F.shiftrightunsigned("sequence_id", TASK_BITS).alias("task")
    counts = pieces.where("offset = 0").groupBy(task, "window").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("window").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(counts.select("task", "window", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "step-counts")
    number = F.floor((F.col("before") + F.col("place")) * F.col("window") / step_tokens)
    placed = pieces.withColumn("task", task).join(checked_broadcast(before), ["task", "window"])
    return placed.select([(F.shiftleft("window", TASK_BITS) + number).alias("step_group") if c == "place" else F.col(c) for c in pieces.columns])


def _batches(packer: _Packer, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, packer.rows = packer.rows, []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
