"""Toxicity scores from a classifier regularised by counterfactual identity swaps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predio.llm.common import discard, materialize, small_batches, tidy
from predio.llm.linear import Linear, Sparse, fit, sigmoid
from predio.llm.textkernel import LETTER, lowered, span_hashes, spans, text_arrays

#: Labelled rows used for training at most, and features that take part in the fit.
TRAIN_ROWS, KEPT_FEATURES = 16_000, 1024
#: Words of the corpus that stand in for names of groups, and the share of training rows that each must be in.
STAND_INS, STAND_IN_SHARE = 48, 0.01
#: Toxic rows are few; each weighs as much as so many others.
TOXIC_WEIGHT = 4.0
FEATURE_BITS = 20
#: Bytes of a word's beginnings that are features besides the word itself; they catch inflected forms.
STEMS = (4, 5, 6)

# Terms that name groups of people, by kind; a swap stays within a kind.
IDENTITY_TERMS = {
    "gender": ["women", "men", "woman", "man", "girls", "boys"],
    "religion": ["christians", "muslims", "jews", "buddhists", "hindus", "atheists"],
    "origin": ["africans", "asians", "europeans", "americans", "latinos", "immigrants"],
    "orientation": ["gay", "straight", "lesbian", "bisexual", "transgender"],
    "género": ["mujeres", "hombres", "niñas", "niños"],
    "genre": ["femmes", "hommes", "filles", "garçons"],
    "geschlecht": ["frauen", "männer", "mädchen", "jungen"],
}


class Swaps:
    """Swaps of terms in a text: each for the one beside it in ``partner``."""

    def __init__(self, partner: dict[str, str]):
        self.partner = partner
        self.pattern = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, partner), key=lambda t: (-len(t), t))) + r")(?!\w)", re.IGNORECASE) if partner else None

    def __call__(self, text: str) -> str | None:
        """The text with every term replaced by its partner; None if it has none."""
        if self.pattern is None:
            return None
        new, n = self.pattern.subn(lambda m: self.partner.get(m[0].lower(), m[0]), text)
        return new if n else None


def named_groups(kinds: dict[str, list[str]] = IDENTITY_TERMS) -> dict[str, str]:
    """Every term's partner: the next of its kind."""
    return {term: terms[(i + 1) % len(terms)] for terms in kinds.values() for i, term in enumerate(terms)}


def stand_ins(rows: DataFrame, n: int, pos: float) -> dict[str, str]:
    """Partners among words of the corpus that labelled rows use neutrally, for corpora that name no groups.

    ``rows`` is the bounded training sample with its texts.  A word is neutral
    if it is common and its share of toxic rows lies within one standard error
    of the share of all rows.  Its partner is the neutral word that stands in
    the most of the same rows, so one of its own language.
    """
    words = rows.select("doc_id", "label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), F.lit(1)))).alias("word"))
    share, expected = pos / n, F.col("c") * (pos / n)
    counts = words.groupBy("word").agg(F.count("*").alias("c"), F.sum("label").alias("p"))
    neutral = counts.where((F.col("c") >= STAND_IN_SHARE * n) & (F.abs(F.col("p") - expected) <= F.sqrt(expected * (1 - share)))).orderBy(F.desc("c"), "word").limit(STAND_INS)
    terms = [r["word"] for r in neutral.collect()]
    if len(terms) < 2:
        return {}
    got = words.where(F.col("word").isin(terms)).groupBy("doc_id").agg(F.collect_set("word").alias("w")).collect()
    held = np.array([[t in r["w"] for t in terms] for r in got], dtype=float)
    both = held.T @ held
    alike = both / (np.diag(both)[:, None] + np.diag(both)[None, :] - both)
    np.fill_diagonal(alike, -1)
    return {t: terms[int(alike[i].argmax())] for i, t in enumerate(terms)}


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Distinct hashed features of each text: its words and their first bytes."""
    for _, data, offsets in text_arrays(texts):
        data = lowered(data)
        starts, ends, counts = spans(data, offsets, LETTER)
        long = [ends - starts >= n for n in STEMS]
        whole, *stems = span_hashes(data, starts, ends, *[np.where(has, starts + n, ends) for has, n in zip(long, STEMS, strict=True)])
        parts = [whole, *[np.where(has, stem ^ np.uint64(k + 1), whole) for k, (has, stem) in enumerate(zip(long, stems, strict=True))]]
        table = (np.stack(parts, axis=1) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)
        stops = np.cumsum(counts)
        for n, stop in zip(counts.tolist(), stops.tolist(), strict=True):
            yield np.unique(table[stop - n : stop])


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    edges = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32()))


def _training(swap: Swaps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            swaps = [swap(t) for t in texts]
            other = features(pa.array([s or "" for s in swaps], pa.large_string()))
            own = list(features(pa.array(texts, pa.large_string())))
            changed = [o if s is not None else np.empty(0, np.int32) for o, s in zip(other, swaps, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(own), _lists(changed), pa.array([s is not None for s in swaps])], names=["doc_id", "label", "own", "swap", "has_swap"])

    return run


def _only(kept: np.ndarray):
    """The features among ``kept``, in ascending order as they came."""

    def one(column: pa.Array) -> pa.ListArray:
        return _lists([x[np.isin(x, kept, assume_unique=True)] for x in (np.asarray(v, dtype=np.int32) for v in column.to_pylist())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), one(batch.column(1)), one(batch.column(2)), *batch.columns[3:]], names=batch.schema.names)

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, train_rows: int = TRAIN_ROWS, swap_penalty: float = 5.0, kept_features: int = KEPT_FEATURES, identity_terms: dict[str, list[str]] = IDENTITY_TERMS
) -> tuple[np.ndarray, float]:
    """Weights by feature, and the bias, from at most ``train_rows`` labelled rows chosen by a hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("double").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = materialize(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text"), "toxicity-texts")
    totals = chosen.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    weight = np.zeros(1 << FEATURE_BITS)
    if not totals["n"]:
        return weight, 0.0
    n, pos = totals["n"], totals["pos"]
    partner = named_groups(identity_terms)
    # groups that a text names are swapped as such; neutral words of the corpus are swapped as well, as it may name none
    swap = Swaps(stand_ins(chosen, n, pos) | partner)
    rows = materialize(chosen.mapInArrow(tidy(_training(swap)), "doc_id long, label double, own array<int>, swap array<int>, has_swap boolean"), "toxicity-train")
    counts = rows.select("label", F.explode("own").alias("f")).groupBy("f").agg(F.count("*").alias("c"), F.sum("label").alias("p"))
    expected = F.col("c") * (pos / n)
    chi = (F.col("p") - expected) * F.abs(F.col("p") - expected) / (expected + 1.0)
    terms = sorted({int(f) for r in features(pa.array(list(swap.partner) or [""], pa.large_string())) for f in r})
    kept = {r["f"] for r in counts.where("c >= 3").orderBy(F.desc(chi), "f").select("f").limit(kept_features).collect()} | set(terms)
    kept = np.array(sorted(kept), dtype=np.int64)
    small = rows.select("label", "own", "swap", "has_swap", "doc_id").mapInArrow(tidy(_only(kept)), "label double, own array<int>, swap array<int>, has_swap boolean, doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    place = lambda ids: np.searchsorted(kept, np.asarray(ids, dtype=np.int64))
    x = Sparse.of([place(r) for r in small["own"]])
    differences, values = [], []
    for own, other in zip(small["own"][small["has_swap"]], small["swap"][small["has_swap"]], strict=True):
        gone, new = np.setdiff1d(own, other), np.setdiff1d(other, own)
        differences.append(place(np.concatenate([gone, new])))
        values.append(np.concatenate([np.ones(len(gone)), -np.ones(len(new))]))
    swaps = Sparse.of(differences, values) if differences else None
    y = small["label"].to_numpy()
    model = fit(x, y, len(kept), swaps=swaps, swap_penalty=swap_penalty, l2=3e-4, steps=500, row_weight=np.where(y > 0, TOXIC_WEIGHT, 1.0))
    discard(chosen, rows)
    weight[kept] = model.weight
    return weight, model.bias


def score(docs: DataFrame, weight: np.ndarray, bias: float, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row's whole text."""
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast((weight.astype(np.float32), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = table.value
        for batch in batches:
            z = np.array([float(w[f].sum(dtype=np.float64)) for f in features(batch.column(1))])
            p = sigmoid(z + b) if len(z) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, swap_penalty: float = 5.0, kept_features: int = KEPT_FEATURES,
    identity_terms: dict[str, list[str]] = IDENTITY_TERMS,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document.

    A logistic regression on words and word beginnings is fitted to at most
    ``train_rows`` labelled documents, none of them held out (CRC-32 of the id
    divisible by 5), and to the ``kept_features`` most telling of their
    features.  For each document with terms of ``identity_terms``, or with
    words that the corpus itself uses neutrally (``stand_ins``), the same text
    with these terms swapped for others of their kind is a counterfactual: the
    square of the change in score is penalised, so that neutral mentions do
    not raise a score.  Only the text is an input.

    Null and empty texts get the bias alone.  Conflicting labels of an id: the
    highest counts; null labels are left out.  Without labels every score is
    0.5.  A null id is not held out.  Repeated rows are scored each; an empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    weight, bias = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, train_rows=train_rows, swap_penalty=swap_penalty, kept_features=kept_features, identity_terms=identity_terms)
    return score(docs, weight, bias, id_col=id_col, text_col=text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
