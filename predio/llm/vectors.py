"""Exact metric range join of embeddings: pivots, boundary replication, independent cells."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predio.llm.common import checked_broadcast, discard, materialize, small_batches, tidy
from predio.llm.components import connected_components

#: Vectors of a cell from which its pivots are drawn, rows a cell should hold, sampled vectors it needs to be divided.
SAMPLE_ROWS, CELL_ROWS, LEAST_SAMPLE = 4_096, 8_192, 32
#: A cell is divided in so many at most at once, whichever is best, and only if its work falls to this share.
FAN_OUTS, WORTH = (16, 64, 256), 0.7
#: Cells that a vector may take part in, on average over its label; moving one to a block costs as much as so many comparisons.
MOST_COPIES, MOVE = 4.0, 256.0
#: Vectors of one side of a block of a cell, and those compared at once.
BLOCK_ROWS, STRIP_ROWS = 8_192, 256


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``x``, each as far as can be from those taken before it."""
    taken, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(taken) < min(k, len(x)) and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[taken[-1]]) ** 2).sum(1))
    return x[taken]


def cells_of(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The own cell of each unit vector, and whether it visits each cell.

    A row belongs to its nearest pivot's cell.  A cell lies, seen from any
    other pivot, beyond the plane midway between the two.  So by the triangle
    inequality a row can have a partner there only if it is within ``radius``
    of all those planes or beyond them; then it visits that cell.
    """
    dots = x @ pivots.T
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 1e-300))
    beyond = np.full(dots.shape, -np.inf)
    for other in range(len(pivots)):
        np.maximum(beyond, (dots[:, [other]] - dots) / apart[other], out=beyond, where=np.arange(len(pivots)) != other)
    home = dots.argmax(1)
    visits = beyond <= radius
    visits[np.arange(len(x)), home] = True
    return home, visits


@dataclass
class Node:
    """A cell: a leaf with a number, or pivots with a cell for each."""

    number: int = 0
    pivots: np.ndarray | None = None
    cells: list[Node] = field(default_factory=list)


def work(own: float, rows: float) -> float:
    """What a cell of ``own`` and visiting ``rows`` costs: comparisons, and rows moved to its blocks."""
    return own * rows + MOVE * rows * np.ceil(rows / BLOCK_ROWS)


def divide(x: np.ndarray, own: np.ndarray, weight: float, radius: float, allowed: float = MOST_COPIES) -> tuple[Node, float]:
    """Divide a cell, given sampled vectors in and near it, until it is small or division no longer pays; and the copies this makes.

    ``own`` marks the vectors that belong to the cell, each of which stands
    for ``weight`` rows.  A division must lessen the work, which counts
    the rows moved as well as the pairs compared, and the cells may hold no more than
    ``allowed`` times the rows of the first one.  Cells follow the data: tight
    clusters come apart, while a cloud in which every part is near every
    other stays one cell, whatever its size.
    """
    numbers, held = count(), float(len(x))

    def go(x: np.ndarray, own: np.ndarray) -> Node:
        nonlocal held
        n_own, best = int(own.sum()), None
        limit = WORTH * work(n_own * weight, len(x) * weight)
        for fan_out in FAN_OUTS if n_own * weight > CELL_ROWS and n_own >= LEAST_SAMPLE else ():
            pivots = farthest_first(x[own], min(fan_out, max(2, round(n_own * weight / CELL_ROWS))))
            home, visits = cells_of(x, pivots, radius)
            mine = np.stack([own & (home == c) for c in range(len(pivots))])
            visits = visits & mine.any(1)  # cells that nothing belongs to are not kept
            more = float(visits.sum()) - len(x)
            after = sum(work(m.sum() * weight, v.sum() * weight) for m, v in zip(mine, visits.T, strict=True))
            if len(pivots) > 1 and after <= limit and held + more <= allowed * whole:
                limit, best = after, (pivots, mine, visits, more)
            if len(pivots) < fan_out:
                break
        if best:
            pivots, mine, visits, more = best
            held += more
            return Node(pivots=pivots, cells=[go(x[v], m[v]) for m, v in zip(mine, visits.T, strict=True)])
        return Node(number=next(numbers))

    whole = max(1, len(x))
    return go(x, own), held / whole


def placed(x: np.ndarray, own: np.ndarray, node: Node, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's own cell) of unit vectors of a cell; ``own`` marks those that belong to it."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def go(rows: np.ndarray, own: np.ndarray, at: Node) -> None:
        if at.pivots is None:
            out.append((rows, np.full(len(rows), at.number), own))
        elif len(rows):
            home, visits = cells_of(x[rows], at.pivots, radius)
            for c, cell in enumerate(at.cells):
                go(rows[visits[:, c]], (own & (home == c))[visits[:, c]], cell)

    go(np.arange(len(x)), own, node)
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def local_links(q: np.ndarray, d: np.ndarray, q_id: np.ndarray, d_id: np.ndarray, d_rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows linked to each of ``q``, and for each vector of both sides a smaller id that the block's links reach."""
    q_norm, d_norm = np.linalg.norm(q, axis=1), np.linalg.norm(d, axis=1)
    n_links = np.zeros(len(q))
    strips: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(q), STRIP_ROWS):
        part = slice(i, i + STRIP_ROWS)
        linked = (q[part] @ d.T) / (q_norm[part, None] * d_norm[None, :]) >= least
        linked &= q_id[part, None] != d_id[None, :]
        some = np.flatnonzero(linked.any(1))
        if len(some):
            n_links[i + some] = linked[some] @ d_rows
            strips.append((i + some, np.packbits(linked[some], axis=1)))  # a bit a pair, so that many links stay small
    q_root, d_root = q_id.copy(), d_id.copy()
    changed = bool(strips)
    while changed:
        changed = False
        for rows, bits in strips:
            linked = np.unpackbits(bits, axis=1, count=len(d)).astype(bool)
            low = np.minimum(q_root[rows], np.where(linked, d_root[None, :], np.iinfo(np.int64).max).min(1))
            down = np.minimum(d_root, np.where(linked, low[:, None], np.iinfo(np.int64).max).min(0))
            changed |= bool((low != q_root[rows]).any() or (down != d_root).any())
            q_root[rows], d_root = low, down
    return n_links.astype(np.int64), q_root, d_root


def _unit(v: pd.Series, kind: str) -> np.ndarray:
    raw = np.frombuffer(b"".join(v), kind).reshape(len(v), -1).astype(np.float64)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _planned(radius: float, kind: str):
    """How to divide each cell of which a sample is given; cells that stay whole give no row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        tree, copies = divide(_unit(pdf["v"], kind), pdf["own"].to_numpy(dtype=bool), pdf["size"].iloc[0] / len(pdf), radius, MOST_COPIES / pdf["spread"].iloc[0])
        rows = [(pdf["label"].iloc[0], pdf["cell"].iloc[0], copies, pickle.dumps(tree))] if tree.pivots is not None else []
        return pd.DataFrame(rows, columns=["label", "cell", "copies", "tree"])

    return run


def _assign(radius: float, kind: str):
    """Rows of cells that are divided, one for each part that they belong to or visit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, part in pdf.groupby(["label", "cell"]):
                row, cell, own = placed(_unit(part["v"], kind), part["own"].to_numpy(dtype=bool), pickle.loads(part["tree"].iloc[0]), radius)
                out = part.iloc[row].assign(own=own)
                out["cell"] = out["cell"] + "." + pd.Series(cell.astype(str), index=out.index)
                yield out.assign(spread=out["spread"] * out["copies"]).drop(columns=["tree", "copies"])

    return run


def divided(copies: DataFrame, radius: float, kind: str) -> DataFrame:
    """``copies`` (label, id, rows, v) with cell and own: a row for each cell that a vector belongs to (own) or visits.

    In each round every cell above ``CELL_ROWS`` that the round before made is
    divided from a sample of its own rows, so cells multiply with the vectors of
    a label, however many labels there are; samples are bounded by cell, and no
    sample passes through the driver.
    """
    columns = ["label", "cell", "own", "spread", "id", "rows", "v"]
    schema = "label string, cell string, own boolean, spread double, id long, rows long, v binary"
    open_ = copies.select("label", F.lit("").alias("cell"), F.lit(True).alias("own"), F.lit(1.0).alias("spread"), "id", "rows", "v")
    done, made = None, []
    while True:
        sizes = open_.groupBy("label", "cell").agg(F.count("*").alias("size")).where(F.col("size") > CELL_ROWS)
        share = F.pmod(F.xxhash64("id", F.lit("pivots")), F.lit(1 << 30)) * F.col("size") < SAMPLE_ROWS * float(1 << 30)
        sample = open_.join(checked_broadcast(materialize(sizes, "cell-sizes")), ["label", "cell"]).where(share)
        plans = sample.groupBy("label", "cell").applyInPandas(_planned(radius, kind), "label string, cell string, copies double, tree binary")
        plans = materialize(plans, "cell-plans")
        if plans.isEmpty():
            break
        plans = checked_broadcast(plans, row_bytes=64 + F.octet_length("tree"))
        settled = open_.join(plans.select("label", "cell"), ["label", "cell"], "left_anti").select(columns)
        done = settled if done is None else done.unionByName(settled)
        parts = open_.join(plans, ["label", "cell"]).select(*columns, "copies", "tree").mapInPandas(tidy(_assign(radius, kind)), schema)
        open_ = materialize(parts, "vector-cells")
        made.append(open_)
    out = materialize((open_.select(columns) if done is None else done.unionByName(open_.select(columns))).drop("spread"), "vector-cells")
    discard(*made)
    return out


def _block(least: float, kind: str):
    schema = {"id": "int64", "n": "int64", "root": "int64"}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["own"].any():
            return pd.DataFrame({c: [] for c in schema}).astype(schema)
        chunk = pdf["chunk"].to_numpy()
        sides = [np.flatnonzero(chunk == c) for c in sorted(set(chunk.tolist()))]
        v = np.frombuffer(b"".join(pdf["v"]), kind).reshape(len(pdf), -1).astype(np.float64)
        ids, rows, own = pdf["id"].to_numpy(), pdf["rows"].to_numpy(dtype=np.float64), pdf["own"].to_numpy(dtype=bool)
        inner = pdf["q"].iloc[0] == pdf["d"].iloc[0]
        if not inner and len(sides) < 2:
            return pd.DataFrame({c: [] for c in schema}).astype(schema)
        out = []
        for a, b in [(sides[0], sides[0])] if inner else [(sides[0], sides[1]), (sides[1], sides[0])]:
            a = a[own[a]]  # a vector's links are all found in its own cell
            n, q_root, d_root = local_links(v[a], v[b], ids[a], ids[b], rows[b], least)
            moved = (d_root != ids[b]).nonzero()[0]
            told = (n > 0).nonzero()[0]
            out.append(pd.DataFrame({"id": np.concatenate([ids[a][told], ids[b][moved]]), "n": np.concatenate([n[told], np.zeros(len(moved), np.int64)]), "root": np.concatenate([q_root[told], d_root[moved]])}))
        return pd.concat(out)

    return run


def range_join(vectors: DataFrame, least: float = 0.98, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; links join vectors of one label with cosine ``least`` or more.

    Equal vectors of a label, told apart by two 64-bit hashes, are compared as
    one and counted as many.  Cells of each label come from pivots: a cell of
    more than ``CELL_ROWS`` rows is divided while that lessens the work, rows
    moved included, with ``MOST_COPIES`` copies of a vector at most on average.
    Samples only set how
    work is divided.  All links of a vector are found in its own cell; a cell
    above a block's size is dealt out in pairs of chunks, so that no task
    grows with it.  Where all vectors are near each other's cells, as in a
    cloud of many dimensions, cells would cost more than they save: the label
    then stays one cell, and the work is that of comparing all its pairs in blocks.

    Null, zero or empty vectors, those with null or non-finite components and
    rows without a label link with nothing.  A null id takes no part: its
    component is null and it is not kept.  Vectors of unequal length are not
    compared.  Repeated rows are copies of each other.  An empty table gives
    no rows.
    """
    small_batches(vectors.sparkSession)
    single = "float" in dict(vectors.dtypes)[vector_col]
    kind = "<f4" if single else "<f8"
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    finite = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    usable = finite & F.coalesce(F.exists(v, lambda c: c != 0), F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    label = F.concat_ws(":", F.size(v).cast("string"), F.col(label_col).cast("string"))
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, label).alias("label"), F.when(usable, v).alias("list"))

    def as_bytes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(list=[None if x is None else (np.asarray(x, kind) + 0.0).astype(kind).tobytes() for x in pdf["list"]])  # + 0.0: no negative zeros

    rows = given.mapInPandas(tidy(as_bytes), "vec_id long, label string, list binary").withColumnRenamed("list", "v")
    known = F.col("label").isNotNull()
    rows = materialize(rows.withColumn("h1", F.when(known, F.xxhash64("label", "v"))).withColumn("h2", F.when(known, F.xxhash64(F.lit("vector"), "v", "label"))), "vectors")
    copies = materialize(rows.where("label is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("rows"), F.first("label").alias("label"), F.first("v").alias("v")), "vector-classes")
    radius = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    cells = divided(copies, radius, kind)

    sizes = materialize(cells.groupBy("label", "cell").agg(F.count_if("own").alias("mine"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts")).where("mine > 0").drop("mine"), "vector-blocks")
    dealt = cells.join(checked_broadcast(sizes), ["label", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("label", "cell", F.least("chunk", "other").alias("q"), F.greatest("chunk", "other").alias("d"), "chunk", "own", "id", "rows", "v")
    found = materialize(dealt.groupBy("label", "cell", "q", "d").applyInPandas(_block(least, kind), "id long, n long, root long"), "vector-links")

    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select("id", "root").where("id != root"), "id", "root")
    classes = copies.select("h1", "h2", "id", "rows").join(counts, "id", "left").join(roots, "id", "left")
    classes = classes.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    # a vector without links needs no entry
    classes = materialize(classes.where("n_links > 0"), "vector-results")
    discard(cells, sizes, found)
    out = rows.select("vec_id", "h1", "h2").join(checked_broadcast(classes), ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
