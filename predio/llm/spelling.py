"""Spelling variants: a bit-sliced position index finds the words one edit away from each word of a vocabulary."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predio.llm.common import checked_broadcast, discard, materialize, text_bytes, tidy

#: Words of one side of a block: a group above that is dealt out in pairs of chunks.
BLOCK_WORDS = 16_384

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def thinned_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n) of the letter runs of all texts, a share of them with one code point deleted.

    Runs are ``[A-Za-z\\u00C0-\\u00FF]+`` with A to Z lower-cased.  Where
    ``one_in`` divides h, the crc32 of ``<id>:<run>``, the run loses its code
    point h % length.  Words below ``least_length`` code points or
    ``least_count`` occurrences go.  A null text has no runs, a null id is
    the empty string; repeated rows count each.
    """
    run = F.regexp_extract_all(F.col(text_col), F.lit(rf"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))  # shorter runs cannot give a word
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(run).alias("run"))
    runs = runs.select(F.translate("run", _UPPER, _LOWER).alias("run"), "id").withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % one_in == 0, less).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class PositionIndex:
    """Bitsets over a list of words: for each (position, letter) the words with that letter there, for each length the words of it.

    Bit i stands for word i, so the lowest bit of a set is its first word.
    """

    def __init__(self, words: list[str]) -> None:
        places: dict[tuple[int, str], list[int]] = defaultdict(list)
        lengths: dict[int, list[int]] = defaultdict(list)
        for i, word in enumerate(words):
            lengths[len(word)].append(i)
            for place in enumerate(word):
                places[place].append(i)
        self.everything = (1 << len(words)) - 1
        self.at = {place: _bitset(members, len(words)) for place, members in places.items()}
        self.of_length = {length: _bitset(members, len(words)) for length, members in lengths.items()}

    def near(self, word: str, apart: int = 0, least: int = 0) -> int:
        """The set of words one inserted, deleted or replaced code point from ``word``.

        All words are followed at once, a machine word of them per step: those
        that agree so far, and those that differ by one error so far, which
        are compared at the letter's own place (replaced), one place on
        (inserted) or one place before (deleted).  With ``apart``, words that
        agree in the first ``apart`` letters are left out; words shorter than
        ``least`` are, and of two words longer than that no pair is given.
        """
        zero, same_start = self.everything, 0 if apart else -1
        replaced = inserted = deleted = 0
        at, none = self.at, 0
        for k, letter in enumerate(word):
            here = at.get((k, letter), none)
            replaced = (replaced & here) | (zero & ~here)
            inserted = (inserted | zero) & at.get((k + 1, letter), none)
            deleted = (deleted & at.get((k - 1, letter), none)) | zero
            zero &= here
            if k + 1 == apart:
                same_start = zero
        size = len(word)
        found = deleted & self.of_length.get(size - 1, none) if size - 1 >= least else 0
        if not least or size == least:
            found |= replaced & self.of_length.get(size, none) | (inserted | zero) & self.of_length.get(size + 1, none)
        return found & ~same_start if apart else found


def _bitset(members: list[int], size: int) -> int:
    if len(members) < 64:
        out = 0
        for i in members:
            out |= 1 << i
        return out
    bits = np.zeros(size, bool)
    bits[members] = True
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


_FOUND = {"word": "object", "n_near": "int64", "best": "object", "best_n": "int64"}


def _near_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per word of each group, how many words of the group are near it and the most frequent of those; groups come sorted."""
    key = ["shorter", "end", "part", "q", "d"]
    held: pd.DataFrame | None = None
    for frame in frames:
        pdf = frame if held is None else pd.concat([held, frame], ignore_index=True)
        new = (pdf[key] != pdf[key].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(new)
        yield _of_groups(pdf, starts[:-1], starts[1:])
        held = pdf.iloc[starts[-1] :].reset_index(drop=True) if len(starts) else None
    if held is not None:
        yield _of_groups(held, np.array([0]), np.array([len(held)]))


def _of_groups(pdf: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    several = ends - starts > 1
    out: dict[str, list] = {c: [] for c in _FOUND}
    words, counts, chunks = pdf["word"].to_numpy(), pdf["n"].to_numpy(), pdf["chunk"].to_numpy()
    shorter, end, q, d = (pdf[c].to_numpy() for c in ("shorter", "end", "q", "d"))
    for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
        least = int(shorter[a])
        apart = least // 2 if end[a] else 0
        rows = np.arange(a, b)
        if q[a] == d[a]:
            sides = [(rows, rows)]
        else:
            one, two = rows[chunks[a:b] == q[a]], rows[chunks[a:b] == d[a]]
            sides = [(one, two), (two, one)] if len(one) and len(two) else []
        for asked, held in sides:
            index = PositionIndex(words[held].tolist())
            for word in words[asked].tolist():
                found = index.near(word, apart, least)
                if found:
                    best = held[(found & -found).bit_length() - 1]  # rows come by falling count, then by word
                    for column, value in zip(out.values(), (word, found.bit_count(), words[best], counts[best]), strict=True):
                        column.append(value)
    return pd.DataFrame(out).astype(_FOUND)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words of ``vocabulary`` (word, n; words distinct) that have a near word.

    Two words one edit apart, the shorter one of c code points, agree in their
    first or their last c // 2.  So each word is looked up among the words
    that share one of these with it, for its own length as the shorter one's
    and for one less, and no other words meet.  Pairs agreeing at both ends
    are given by the first alone.  A group of more than ``BLOCK_WORDS`` words is dealt
    out in pairs of chunks; no pair of words is ever written: a set's size and
    first word are all that leaves a task.
    """
    length = F.char_length("word")

    def ends(shorter: Column) -> list[Column]:
        half = F.floor(shorter / 2).cast("int")
        return [F.struct(shorter.alias("shorter"), F.lit(0).alias("end"), F.substring("word", F.lit(1), half).alias("part")), F.struct(shorter.alias("shorter"), F.lit(1).alias("end"), F.substring("word", length - half + 1, half).alias("part"))]

    entries = vocabulary.select("word", "n", F.explode(F.array(*ends(length), *ends(length - 1))).alias("key")).select("word", "n", "key.*")
    sizes = entries.groupBy("shorter", "end", "part").agg(F.count("*").alias("size"))
    hot = materialize(sizes.where(F.col("size") > BLOCK_WORDS).select("shorter", "end", "part", F.ceil(F.col("size") / BLOCK_WORDS).cast("int").alias("parts")), "spelling-hot")
    dealt = entries.join(checked_broadcast(hot, row_bytes=64 + text_bytes(F.col("part"))), ["shorter", "end", "part"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("shorter", "end", "part", F.least("chunk", "other").alias("q"), F.greatest("chunk", "other").alias("d"), "chunk", "word", "n")
    by = ["shorter", "end", "part", "q", "d"]
    found = dealt.repartition(*by).sortWithinPartitions(*by, F.desc("n"), "word").mapInPandas(tidy(_near_words), "word string, n_near long, best string, best_n long")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", F.col("first.word").alias("best"), (-F.col("first.less")).alias("best_n"))


def variant_groups(words: DataFrame, *, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    A word's form is its near word of largest n, ties by code point, if that
    is at least ``ratio`` times the word's n; its root is where its forms end.
    Forms are followed by doubling, so rounds grow with the logarithm of a
    chain, which is short itself as n grows with each link.  Null words and
    counts are left out; rows of one word are added up; an empty table gives
    no rows.
    """
    vocabulary = materialize(words.where(F.col("word").isNotNull() & F.col("n").isNotNull()).groupBy("word").agg(F.sum("n").cast("long").alias("n")), "vocabulary")
    near = near_words(vocabulary)
    is_form = F.col("best_n") >= ratio * F.col("n")
    joined = materialize(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-near")
    discard(vocabulary)
    size = 64 + text_bytes(F.col("word")) + text_bytes(F.col("root"))
    roots = materialize(joined.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = roots.join(checked_broadcast(further, row_bytes=64 + text_bytes(F.col("root")) + text_bytes(F.col("next"))), "root", "left")
        after = materialize(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        ended = after.where("moved").isEmpty()
        discard(roots)
        roots = after.drop("moved") if ended else materialize(after.drop("moved"), "spelling-roots")
        if ended:
            break
        discard(after)
    out = joined.join(checked_broadcast(roots, row_bytes=size), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
