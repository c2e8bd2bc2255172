"""Document quality by co-training a text view and a metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predio.llm.common import discard, materialize, small_batches, tidy, unused
from predio.llm.linear import Linear, Sparse, calibrate, fit, sigmoid
from predio.llm.textkernel import NOT_SPACE, lowered, span_hashes, spans, text_arrays
from predio.llm.toxicity import held_out

#: Labelled rows used at most, and pseudo-labelled rows that a view takes from the other in a round at most.
LABELLED_ROWS, PSEUDO_ROWS = 12_000, 2_000
FEATURE_BITS = 16
ROUNDS, PSEUDO_WEIGHT = 3, 0.5
#: A view keeps what the other taught it unless its mean log loss on the check fold rises by more than this.
WORSE = 0.002
#: Labelled rows that a feature of the text must be in to take part, and how strongly weights are held near 0.
LEAST_ROWS, SHRINKAGE = 3, 3e-3
#: Steps of the log odds, from the prior's, by which rows are counted, and the furthest that are told apart.
_ODDS_STEP, _ODDS_TOP = 1 / 64, 40.0

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("9")
#: Shares of kinds of bytes that describe a text; bytes beyond ASCII count as small letters.
_KINDS = {name: np.zeros(256, bool) for name in ("capitals", "digits", "symbols")}
_KINDS["capitals"][65:91] = True
_KINDS["digits"][48:58] = True
_KINDS["symbols"][[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?"]] = True


def _bucket(name: str, value: object) -> int:
    return zlib.crc32(f"{name}={value}".encode()) >> (32 - FEATURE_BITS)


def text_features(texts: pa.Array) -> Iterator[np.ndarray]:
    """What a text says and how: its words, their shapes and how large a share these have, and its layout.

    A shape is a word with runs of small letters, capitals and digits shrunk
    to one.  The layout is length, lines, repeated and distinct words, and
    shares of capitals, digits and symbols.
    """
    for _, data, offsets in text_arrays(texts):
        starts, ends, counts = spans(data, offsets, NOT_SPACE)
        (words,) = span_hashes(lowered(data), starts, ends)
        shape = _CLASS[data]
        first = np.ones(len(data), bool)
        if len(data):
            first[1:] = shape[1:] != shape[:-1]
        first[starts] = True
        place = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
        (shapes,) = span_hashes(shape[first], place[starts], place[ends])
        again = np.zeros(len(words), bool)
        if len(words):
            again[1:] = words[1:] == words[:-1]
        bounds = offsets.tolist()
        totals = {name: np.concatenate([[0], np.cumsum(kind[data], dtype=np.int32)]).astype(np.int64)[offsets].tolist() for name, kind in _KINDS.items()}
        breaks = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int32)]).astype(np.int64)[offsets].tolist()
        stop = 0
        for i, n in enumerate(counts.tolist()):
            own, stop = slice(stop, stop + n), stop + n
            kinds, times = np.unique(shapes[own], return_counts=True)
            said = np.unique(words[own])
            share = times / max(n, 1)
            hashed = [said ^ np.uint64(0x3333333333333333), kinds, kinds[share >= 0.05] ^ np.uint64(0x5555555555555555), kinds[share >= 0.25] ^ np.uint64(0xAAAAAAAAAAAAAAAA)]
            size, n_lines = bounds[i + 1] - bounds[i], breaks[i + 1] - breaks[i] + 1
            marks = [_bucket("repeated", int(np.ceil(10 * again[own].mean())) if n else 0), _bucket("distinct", int(10 * len(said) / n) if n else -1)]
            marks += [_bucket("length", size.bit_length()), _bucket("lines", n_lines.bit_length()), _bucket("line length", (size // n_lines).bit_length())]
            marks += [_bucket(name, min(12, int(40 * (t[i + 1] - t[i]) / size)) if size else -1) for name, t in totals.items()]
            yield np.unique(np.concatenate([(np.concatenate(hashed) >> np.uint64(64 - FEATURE_BITS)).astype(np.uint16), np.array(marks, np.uint16)]))


def metadata_columns(docs: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """The record's own columns as texts; numbers by half powers of two."""
    numbers = {f.name for f in docs.schema.fields if isinstance(f.dataType, T.NumericType)}
    half = lambda c: F.floor(2 * F.log2(F.abs(F.col(c).cast("double")) + 1)).cast("string")
    return [half(c) if c in numbers else F.col(c).cast("string") for c in names if c in docs.columns]


def metadata_features(columns: list[pa.Array]) -> Iterator[np.ndarray]:
    """One feature for each column's value, null among them."""
    for values in zip(*(c.to_pylist() for c in columns), strict=True):
        yield np.unique(np.array([_bucket(f"column {i}", v) for i, v in enumerate(values)], np.uint16))


def row_key(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...]) -> Column:
    """Equal for rows that are equal in id, text and metadata, which are scored alike."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *metadata_columns(docs, metadata))


def _views(texts: pa.Array, columns: list[pa.Array]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return list(text_features(texts)), list(metadata_features(columns)) if columns else [np.empty(0, np.uint16)] * len(texts)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        views = _views(batch.column(2), batch.columns[3:])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([x.astype("<u2").tobytes() for x in v], pa.binary()) for v in views]], names=["doc_id", "row_key", "a", "b"])


def features_of(docs: DataFrame, *, id_col: str, text_col: str, metadata: tuple[str, ...]) -> DataFrame:
    """(doc_id, row_key, a, b): the features of both views of every row; ``row_key`` tells rows that share an id."""
    kinds = metadata_columns(docs, metadata)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(docs, id_col=id_col, text_col=text_col, metadata=metadata).alias("row_key"), F.col(text_col).cast("string").alias("_text"), *[c.alias(f"_{i}") for i, c in enumerate(kinds)])
    return rows.mapInArrow(tidy(_featured), "doc_id long, row_key long, a binary, b binary")


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u2") for b in column.to_pylist()]


def odds(view: list[np.ndarray], model: Linear) -> np.ndarray:
    """Calibrated log odds of each row."""
    return model.scale * (np.array([float(model.weight[f].sum(dtype=np.float64)) for f in view]) + model.bias) + model.shift if view else np.empty(0)


def _levels(z: np.ndarray) -> np.ndarray:
    return (np.minimum(np.abs(z), _ODDS_TOP) / _ODDS_STEP).astype(np.int64)


def _tallied(models: tuple[Linear, Linear], base: float):
    """Counts of rows by view, side of the prior and level of confidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, int(_ODDS_TOP / _ODDS_STEP) + 1), np.int64)
        for batch in batches:
            for v, model in enumerate(models):
                z = odds(_lists(batch.column(v)), model) - base
                level = _levels(z)
                for good in (0, 1):
                    total[v, good] += np.bincount(level[(z > 0) == bool(good)], minlength=total.shape[2])
        v, good, level = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (v, good, level, total[v, good, level])], names=["view", "good", "level", "n"])

    return run


def _taken(models: tuple[Linear, Linear], base: float, share: dict[tuple[int, int], tuple[int, float]]):
    """Rows above the level of their view and side, and of those at it the given share, by a hash of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = [_lists(batch.column(v)) for v in (0, 1)]
            draw = batch.column(2).to_numpy()
            for v, model in enumerate(models):
                z = odds(views[v], model)
                level = _levels(z - base)
                for good in (0, 1):
                    if (v, good) in share:
                        at, part = share[v, good]
                        rows = np.flatnonzero(((z > base) == bool(good)) & ((level > at) | ((level == at) & (draw < part))))
                        if len(rows):
                            own = pa.array(rows)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), v)), pa.array(sigmoid(z[rows])), *(batch.column(c).take(own) for c in range(3))], names=["view", "label", "a", "b", "draw"])

    return run


Taught = tuple[list[np.ndarray], list[np.ndarray], np.ndarray]


def pseudo_labels(pool: DataFrame, models: tuple[Linear, Linear], prior: float, most: int) -> list[Taught]:
    """By view, the rows of which it is most sure among all of ``pool`` (a, b, draw): their features and its label for them.

    A view is sure of a row as far as its calibrated log odds lie from the
    prior's, so that a weak view has rows to teach as well.  The label is the
    view's calibrated probability, not 0 or 1: it says no more than the
    view knows.  All rows are scored and counted by level; the level that
    leaves about ``most`` rows, above and below the prior in its proportion,
    decides.
    """
    base = float(np.log(prior / (1 - prior)))
    counted = pool.mapInArrow(tidy(_tallied(models, base)), "view long, good long, level long, n long").groupBy("view", "good", "level").agg(F.sum("n").alias("n")).collect()
    share: dict[tuple[int, int], tuple[int, float]] = {}
    for v in (0, 1):
        for good in (0, 1):
            left = max(1, round(most * (prior if good else 1 - prior)))
            for level, n in sorted(((r["level"], r["n"]) for r in counted if (r["view"], r["good"]) == (v, good)), reverse=True):
                share[v, good] = (level, min(1.0, left / n))
                left -= n
                if left <= 0:
                    break
    out = []
    rows = pool.mapInArrow(tidy(_taken(models, base, share)), "view long, label double, a binary, b binary, draw double").orderBy("view", "draw", "label", "a", "b").toPandas() if share else None
    for v in (0, 1):
        own = rows[rows["view"] == v] if rows is not None else ()
        out.append(([np.frombuffer(b, "<u2") for b in own["a"]], [np.frombuffer(b, "<u2") for b in own["b"]], own["label"].to_numpy()) if len(own) else ([], [], np.empty(0)))
    return out


def _loss(model: Linear, x: Sparse, y: np.ndarray) -> float:
    p = np.clip(sigmoid(model.calibrated(x)), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def train(features: DataFrame, labels: DataFrame, *, id_col: str, label_col: str, labelled_rows: int = LABELLED_ROWS, pseudo_rows: int = PSEUDO_ROWS, rounds: int = ROUNDS, report: list | None = None) -> tuple[Linear, Linear, float]:
    """Two calibrated views and the share of good rows.

    In every round each view is fitted anew to the labelled rows and to those
    of which the other was most sure after the round before.  Where that makes
    it worse on the check fold than the labelled rows alone, it keeps its fit
    to these.  ``report`` gets (round, view, rows taught, whether kept).
    """
    size = 1 << FEATURE_BITS
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("double").alias("label"))
    sample = materialize(known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows), "quality-labelled")
    chosen = features.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("a", "b")).alias("f"))  # rows that share an id count once
    got = chosen.select("doc_id", "label", "f.a", "f.b").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    if not len(got):
        return Linear(np.zeros(size)), Linear(np.zeros(size)), 0.5
    views = [[np.frombuffer(b, "<u2") for b in got[v]] for v in ("a", "b")]
    y = got["label"].to_numpy(dtype=float)
    fold = np.array([zlib.crc32(f"fold {i}".encode()) % 5 == 0 for i in got["doc_id"]])
    del got
    learn, check = np.flatnonzero(~fold), np.flatnonzero(fold)
    prior = float(np.clip(y[learn].mean() if len(learn) else 0.5, 0.01, 0.99))
    often = np.zeros(size, np.int64)
    for i in learn:
        often[views[0][i]] += 1  # a row names a feature once
    often = often >= LEAST_ROWS
    pool = features.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti").select("a", "b", (F.pmod(F.xxhash64("row_key"), F.lit(1 << 30)) / float(1 << 30)).alias("draw"))
    rows = check if len(check) else learn
    checked = [Sparse.of([view[i] for i in rows]) for view in views]

    def fitted(v: int, taught: Taught) -> Linear:
        x = [f[often[f]] if v == 0 else f for f in [*(views[v][i] for i in learn), *taught[v]]]
        weight = np.concatenate([np.ones(len(learn)), np.full(len(taught[2]), PSEUDO_WEIGHT)])
        model = fit(Sparse.of(x), np.concatenate([y[learn], taught[2]]), size, l2=SHRINKAGE, steps=150, row_weight=weight)
        return calibrate(model, checked[v], y[rows])  # so that a view that is often wrong is not sure

    models = alone = tuple(fitted(v, ([], [], np.empty(0))) for v in (0, 1))
    for r in range(1, rounds):
        taught = pseudo_labels(pool, models, prior, r * pseudo_rows)
        tried = [fitted(v, taught[1 - v]) if len(taught[1 - v][2]) else alone[v] for v in (0, 1)]
        kept = [_loss(tried[v], checked[v], y[rows]) <= _loss(alone[v], checked[v], y[rows]) + WORSE for v in (0, 1)]
        models = tuple(tried[v] if kept[v] else alone[v] for v in (0, 1))
        if report is not None:
            report += [(r, v, len(taught[1 - v][2]), kept[v]) for v in (0, 1)]
    discard(sample)
    return models[0], models[1], prior


def _scored(models: tuple[Linear, Linear], prior: float, views: tuple[list[np.ndarray], list[np.ndarray]]) -> list[pa.Array]:
    a, b = (odds(view, m) for m, view in zip(models, views, strict=True))
    both = sigmoid(a + b - np.log(prior / (1 - prior)))
    return [pa.array(sigmoid(a)), pa.array(sigmoid(b)), pa.array(both), pa.array((both >= 0.5).astype(np.int32))]


SCORES = "text_score double, metadata_score double, quality_score double, quality_keep int"
METADATA = ("lang", "source", "n_chars")


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = METADATA, **bounds: int) -> DataFrame:
    """(doc_id, row_key, text_score, metadata_score, quality_score, quality_keep) of every row, as ``score_quality`` gives them; texts are read once."""
    small_batches(docs.sparkSession)
    features = materialize(features_of(docs, id_col=id_col, text_col=text_col, metadata=metadata), "quality-features")
    a, b, prior = train(features, labels, id_col=id_col, label_col=label_col, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast((a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_scored(shared.value, prior, (_lists(batch.column(2)), _lists(batch.column(3))))], names=["doc_id", "row_key", *[f.split()[0] for f in SCORES.split(", ")]])

    return features.mapInArrow(tidy(run), f"doc_id long, row_key long, {SCORES}")


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = METADATA, **bounds: int) -> DataFrame:
    """``docs`` with text_score, metadata_score, quality_score (0 to 1) and quality_keep (1 from 0.5 on).

    One classifier sees the text alone (``text_features``), the other the
    record's own columns alone (``metadata``; columns that are not there are
    left out).  Both start from at most ``labelled_rows`` labelled documents,
    none of them held out (CRC-32 of the id divisible by 5).  In each of
    ``rounds`` rounds every other document is scored by both, and each takes
    the labels of about ``pseudo_rows`` of which the other is most sure,
    relative to the prior, unless that makes it worse on the check fold.
    Both are calibrated on a fifth of the labelled rows; their log
    odds add up, less the prior counted twice.

    Null and empty texts are scored by their metadata and empty layout.  Of an
    id's conflicting labels the lowest counts; null labels are left out;
    without labels every score is 0.5.  Columns named like the new ones are
    replaced; other columns pass through; repeated rows are scored each; an
    empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    features = materialize(features_of(docs, id_col=id_col, text_col=text_col, metadata=metadata), "quality-features")
    a, b, prior = train(features, labels, id_col=id_col, label_col=label_col, **bounds)
    discard(features)
    shared = spark.sparkContext.broadcast((a, b))
    added = [f.split()[0] for f in SCORES.split(", ")]
    docs = docs.drop(*added)
    hidden = unused(docs.columns, *[f"view {i}" for i in range(len(metadata_columns(docs, metadata)) + 1)])
    marked = docs.select("*", F.col(text_col).cast("string").alias(hidden[0]), *[c.alias(n) for c, n in zip(metadata_columns(docs, metadata), hidden[1:], strict=True)])
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = _scored(shared.value, prior, _views(batch.column(n), batch.columns[n + 1 :]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], names=[*batch.schema.names[:n], *added])

    return marked.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *T.StructType.fromDDL(SCORES).fields]))
