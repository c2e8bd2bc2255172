"""Radius joins over a grid of cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predio.functions.geo import EARTH_KM, LEAST_STRETCH, PLANAR_METRES, SHORT_M, haversine_km, short_metres, spheroid_place, with_geodesic
from predio.operators.graph import BROADCAST_ROWS, written

#: Kilometres of a degree of latitude, a little short, so that a cell is never smaller than the radius.
KM_PER_DEGREE = 111.0


#: Squared chords are compared with this much to spare; only pairs between the two bounds need the distance itself.
SPARE, LEAST = 1e-6, 1e-14

#: The eight cells around a cell, and itself.
AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _cell(lat: Column, lng: Column, km: float, max_lat: float) -> tuple[Column, Column]:
    step = km / KM_PER_DEGREE
    return F.floor(lat / step).cast("long"), F.floor(lng / (step / math.cos(math.radians(max_lat)))).cast("long")


def _spread(rows: DataFrame, around: list[tuple[int, int]] = AROUND) -> DataFrame:
    """Every row once for each of the cells around its own."""
    steps = F.array(*[F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx")) for dy, dx in around])
    moved = rows.withColumn("_d", F.explode(steps))
    return moved.withColumn("_cy", F.col("_cy") + F.col("_d.dy")).withColumn("_cx", F.col("_cx") + F.col("_d.dx")).drop("_d")


def _sphere(lat: str, lng: str, name: str) -> dict[str, Column]:
    y, x = F.radians(lat), F.radians(lng)
    return {f"_{name}x": F.cos(y) * F.cos(x), f"_{name}y": F.cos(y) * F.sin(x), f"_{name}z": F.sin(y)}


def _spheroid(lat: str, lng: str, name: str) -> dict[str, Column]:
    return {f"_{name}{c}": v for c, v in zip("xyz", spheroid_place(F.col(lat), F.col(lng)), strict=True)}


def _within(km: float) -> Column:
    """Whether a pair is ``km`` apart at most: as haversine says, which is asked only where the chord leaves it open."""
    x, y, z = (F.col(f"_a{c}") - F.col(f"_b{c}") for c in "xyz")
    chord, limit = x * x + y * y + z * z, 4 * math.sin(min(km / EARTH_KM, math.pi) / 2) ** 2
    distance = haversine_km(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))
    return (chord <= limit * (1 - SPARE) - LEAST) | ((chord <= limit * (1 + SPARE) + LEAST) & (distance <= km))


#: Columns of the cell in which a pair was found, and of the places of its two rows.
CELL, SIDES = ["_cy", "_cx"], [f"_{s}{c}" for s in "ab" for c in "xyz"]


def _met(left: DataFrame, right: DataFrame, km: float, place: Callable[[str, str, str], dict[str, Column]], *, right_columns: dict[str, str], equal: tuple[tuple[str, str], ...] = (), max_lat: float, around: list[tuple[int, int]] = AROUND, tasks: int | None = None) -> DataFrame:
    """Rows of ``left`` with those of ``right`` in the cells around theirs, and what ``place`` makes of either's coordinates.

    That is worked out where the rows meet, so that it is not shuffled.
    """
    r = right.where("lat is not null and lng is not null").select(F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), *[F.col(c).alias(n) for c, n in right_columns.items()], *[F.col(b).alias(f"_eq{i}") for i, (_, b) in enumerate(equal)])
    y, x = _cell(F.col("_lat"), F.col("_lng"), km, max_lat)
    r = _spread(r.withColumns({"_cy": y, "_cx": x}), around)
    y, x = _cell(F.col("lat"), F.col("lng"), km, max_lat)
    placed = left.where("lat is not null and lng is not null").withColumns({"_cy": y, "_cx": x} | {f"_eq{i}": F.col(a) for i, (a, _) in enumerate(equal)})
    keys = [*CELL, *[f"_eq{i}" for i in range(len(equal))]]
    placed, r = (side.repartition(*([tasks] if tasks else []), *keys) for side in (placed, r))
    return placed.withColumns(place("lat", "lng", "a")).join(r.withColumns(place("_lat", "_lng", "b")).hint("merge"), keys).drop(*keys[len(CELL) :])


def radius_join(
    left: DataFrame, right: DataFrame, km: float, *, right_columns: dict[str, str], equal: tuple[tuple[str, str], ...] = (), max_lat: float = 60.0,
    around: list[tuple[int, int]] = AROUND, cells: bool = False, rings: tuple[float, ...] = (), tasks: int | None = None,
) -> DataFrame:
    """Rows of ``left`` with every row of ``right`` within ``km``, and the distance as ``km``.

    Both sides need lat and lng; rows without them match nothing.  Each right
    row goes to its cell and the eight around it, so the join is on equality
    of cells and shuffles by cell; the exact distance decides.  The right side
    should be the smaller: it is the one copied nine times.  As an estimate of
    its size knows nothing of the copies, it is merged and never broadcast.
    ``right_columns`` names what is taken from it; ``equal`` adds pairs of
    columns that must be equal.  Latitudes up to ``max_lat`` degrees are covered.

    A row of ``left`` lies in one cell.  ``cells`` keeps that cell's columns
    (``CELL``): what is grouped by them and others is put together where it was
    found, and no pair is shuffled.  ``rings`` adds the smallest of these
    radii that holds the pair as ``ring`` instead of the distance.  ``tasks``
    fixes in how many tasks pairs are made (``pair_tasks``).
    """
    joined = _met(left, right, km, _sphere, right_columns=right_columns, equal=equal, max_lat=max_lat, around=around, tasks=tasks).where(_within(km))
    if rings:
        ring = F.lit(None)
        for radius in sorted(rings, reverse=True):
            ring = F.when(_within(radius), F.lit(float(radius))).otherwise(ring)
        joined = joined.withColumn("ring", ring)
    else:
        joined = joined.withColumn("km", haversine_km(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng")))
    return joined.drop("_lat", "_lng", *SIDES, *([] if cells else CELL))


#: Pairs that one task compares.
TASK_PAIRS = 4_000_000


def cell_pairs(left: DataFrame, right: DataFrame, km: float, *, max_lat: float = 60.0, around: list[tuple[int, int]] = AROUND) -> float:
    """How many pairs the cells of a radius join hold."""
    y, x = _cell(F.col("lat"), F.col("lng"), km, max_lat)
    held = lambda rows, n: rows.where("lat is not null and lng is not null").groupBy(y.alias("_cy"), x.alias("_cx")).agg(F.count("*").cast("double").alias(n))
    near = _spread(held(right, "_b"), around).groupBy(*CELL).agg(F.sum("_b").alias("_b"))
    return held(left, "_a").join(near, CELL).agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0.0


def pair_tasks(left: DataFrame, right: DataFrame, km: float, *, max_lat: float = 60.0, around: list[tuple[int, int]] = AROUND) -> int:
    """Tasks for a radius join whose pairs are sorted where they are made, so that these fit a task's memory: by the pairs that its cells hold, counted."""
    pairs = cell_pairs(left, right, km, max_lat=max_lat, around=around)
    least = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(20_000, math.ceil(pairs / TASK_PAIRS)))


def lists_within(left: DataFrame, right: DataFrame, km: float, by: list[str], listed: list[Column], *, right_columns: dict[str, str], key: str = "id") -> DataFrame:
    """``radius_join`` grouped by ``by`` (``key`` and columns of the right side), with aggregates as long as the pairs.

    They are put together in the cell of the left row, so no pair is
    shuffled; only keys that lie in several places go by key.
    """
    tasks, place = pair_tasks(left, right, km), F.struct("lat", "lng")
    several = written(left.groupBy(key).agg(F.min(place).alias("_low"), F.max(place).alias("_high")).where("_low != _high").select(F.col(key).alias("_key")), "several-places")
    join = lambda rows: radius_join(rows, right, km, right_columns=right_columns, cells=True, tasks=tasks)
    if several.isEmpty():
        return join(left).groupBy(*CELL, *by).agg(*listed).drop(*CELL)
    known = F.col(key).eqNullSafe(F.col("_key"))
    once = join(left.join(several, known, "left_anti")).groupBy(*CELL, *by).agg(*listed).drop(*CELL)
    return once.unionByName(join(left.join(several, known, "left_semi")).groupBy(*by).agg(*listed))


#: Pairs of cells that one task compares as blocks, and that are compared at once.
BLOCK_PAIRS, AT_ONCE = 1 << 28, 1 << 17
#: Rows of ``left`` of a cell that are compared as one block, about.
BLOCK_ROWS = 8192


def _near_ids(km: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    limit = 4 * math.sin(min(km / EARTH_KM, math.pi) / 2) ** 2
    low, high = limit * (1 - SPARE) - LEAST, limit * (1 + SPARE) + LEAST

    def sphere(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        lat, lng = (np.radians(rows.field(c).to_numpy(zero_copy_only=False)) for c in ("lat", "lng"))
        return lat, lng, [np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)]

    def block(left: pa.StructArray, right: pa.StructArray) -> Iterator[pa.RecordBatch]:
        (lat, lng, a), (lat2, lng2, b) = sphere(left), sphere(right)
        kinds = right.field("kind").dictionary_encode("encode")
        codes = kinds.indices.to_numpy(zero_copy_only=False)
        step = max(1, AT_ONCE // len(right))
        for at in range(0, len(left), step):
            chord = sum(np.square(p[at : at + step, None] - q) for p, q in zip(a, b, strict=True))
            i, j = np.nonzero(chord <= high)
            chord = chord[i, j]
            i += at
            far = 2 * EARTH_KM * np.arcsin(np.sqrt(chord) / 2)
            rim = np.flatnonzero(chord > low)
            if len(rim):  # as haversine says, which is asked only where the chord leaves it open
                y, x = i[rim], j[rim]
                half = np.sin((lat2[x] - lat[y]) / 2) ** 2 + np.cos(lat[y]) * np.cos(lat2[x]) * np.sin((lng2[x] - lng[y]) / 2) ** 2
                far[rim] = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(half, 1)))
                keep = np.ones(len(i), bool)
                keep[rim] = far[rim] <= km
                i, j, far = i[keep], j[keep], far[keep]
            if not len(i):
                continue
            code = codes[j]
            starts = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (code[1:] != code[:-1])]))
            ends = np.append(starts[1:], len(i))
            ids = pa.ListArray.from_arrays(pa.array(np.append(starts, len(i)), pa.int32()), right.field("id").take(pa.array(j)))
            columns = [left.field("id").take(pa.array(i[starts])), kinds.dictionary.take(pa.array(code[starts])), pa.array(ends - starts), pa.array(np.add.reduceat(far, starts) / (ends - starts)), ids]
            yield pa.RecordBatch.from_arrays(columns, ["id", "kind", "n", "km", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch["left"], batch["right"], strict=True):
                yield from block(left.values, right.values)

    return run


def ids_within(left: DataFrame, right: DataFrame, km: float, kind: str, *, max_lat: float = 60.0) -> DataFrame:
    """(id, kind, n, km, ids): for every id of ``left`` (id, lat, lng) and kind of ``right`` (id, lat, lng, ``kind``) how many rows lie within ``km``, their mean distance, and their ids in order.

    The rows of a cell meet those of the cells around it as two lists, which a
    task compares block by block: no pair is a row, none is sorted, shuffled or
    spilled.  Memory is bounded by the rows of a cell and those around it.
    Ids of ``left`` that several rows have are put together from their pairs.
    """
    placed = left.where("lat is not null and lng is not null").select("id", "lat", "lng")
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, math.ceil(cell_pairs(placed, right, km, max_lat=max_lat) / BLOCK_PAIRS)))
    y, x = _cell(F.col("lat"), F.col("lng"), km, max_lat)
    at = {"_cy": y, "_cx": x}
    parts = math.ceil((placed.withColumns(at).groupBy(*CELL).count().agg(F.max("count")).first()[0] or 1) / BLOCK_ROWS)
    several = written(placed.groupBy("id").count().where("count > 1").select(F.col("id").alias("_key")), "several-rows")

    known = F.col("id").eqNullSafe(F.col("_key"))
    alone = placed if several.isEmpty() else placed.join(several, known, "left_anti")
    rows = alone.withColumns(at).repartition(tasks, *CELL).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    rows = rows.groupBy(*CELL, "_part").agg(F.collect_list(F.struct("id", "lat", "lng")).alias("left")).drop("_part")
    others = right.where("lat is not null and lng is not null").select(F.col(kind).alias("kind"), "id", "lat", "lng").withColumns(at)
    others = _spread(others).repartition(tasks, *CELL).groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("kind", "id", "lat", "lng"))).alias("right"))
    ids, kinds = left.schema["id"].dataType, right.schema[kind].dataType
    schema = T.StructType([T.StructField("id", ids), T.StructField("kind", kinds), T.StructField("n", T.LongType()), T.StructField("km", T.DoubleType()), T.StructField("ids", T.ArrayType(right.schema["id"].dataType))])
    found = rows.join(others.hint("merge"), CELL).select("left", "right").mapInArrow(_near_ids(km), schema)
    if several.isEmpty():
        return found
    listed = [F.count("*").alias("n"), F.avg("km").alias("km"), F.array_sort(F.collect_list("_other")).alias("ids")]
    more = radius_join(placed.join(several, known, "left_semi"), right, km, right_columns={"id": "_other", kind: "kind"}, max_lat=max_lat).groupBy("id", "kind").agg(*listed)
    return found.unionByName(more)


def ring_counts(near: DataFrame, rings: tuple[int, ...], kind: str, *, key: str = "id", more: list[Column] | None = None) -> DataFrame:
    """By ``key`` of a radius join with cells and rings: ``n<r>`` rows and ``kinds<r>`` different kinds within each radius, and ``more`` from the ``n<r>`` of its kinds.

    Pairs are counted by kind in their cell, so only a row a key and kind is shuffled.
    """
    counted = near.groupBy(*CELL, key, kind).agg(*[F.count_if(F.col("ring") <= r).alias(f"n{r}") for r in rings])
    sums = [c for r in rings for c in (F.sum(f"n{r}").alias(f"n{r}"), F.size(F.collect_set(F.when(F.col(f"n{r}") > 0, F.col(kind)))).cast("long").alias(f"kinds{r}"))]
    return counted.groupBy(key).agg(*sums, *(more or []))


#: Small cells along a radius; pairs that are made without asking cells first; steps between two small cells that keep all their points within the radius.
FINE = 4
FEW_PAIRS = 1 << 26
SURE = [(dy, dx) for dy in range(-FINE, FINE + 1) for dx in range(-FINE, FINE + 1) if (abs(dy) + 1) ** 2 + (abs(dx) + 1) ** 2 <= FINE**2]


def counts_up_to(points: DataFrame, others: DataFrame, rings: tuple[int, ...], kind: str, enough: int, *, max_lat: float = 60.0) -> DataFrame:
    """``points`` with an array ``near<r>`` for each radius of ``rings`` (kilometres, at most 300): struct(kind, n) for every kind of ``others`` that has a row within it.

    ``n`` is exact below ``enough``; beyond, it is only known to be ``enough`` or
    more, and ``enough`` is given.  For scores that look no further.  What small cells wholly within
    the radius hold settles dense places without pairs; pairs are made for
    places and kinds that these leave open, so work grows with the rows.  A point is not
    shuffled where the cells are few.  Up to ``FEW_PAIRS`` in all, pairs are made at once.
    """
    known = others.where("lat is not null and lng is not null").select("lat", "lng", F.struct(F.col(kind).alias("kind")).alias("_kind"))
    spots = points.where("lat is not null and lng is not null").select("lat", "lng")
    if cell_pairs(spots, known, max(rings), max_lat=max_lat) <= FEW_PAIRS:
        met = radius_join(spots.distinct(), known, max(rings), right_columns={"_kind": "_kind"}, max_lat=max_lat, cells=True, rings=rings)
        counted = met.groupBy(*CELL, "lat", "lng", "_kind").agg(*[F.least(F.count_if(F.col("ring") <= r), F.lit(enough)).alias(f"n{r}") for r in rings])
        every = counted.groupBy("lat", "lng").agg(F.collect_list(F.struct("_kind.kind", *[f"n{r}" for r in rings])).alias("_every"))
        points = points.join(every, ["lat", "lng"], "left")
        every = F.coalesce("_every", F.array().cast(every.schema["_every"].dataType))
        near = lambda n: F.transform(F.filter(every, lambda k: k[n] > 0), lambda k: F.struct(k["kind"].alias("kind"), k[n].alias("n")))
        return points.withColumns({f"near{r}": near(f"n{r}") for r in rings}).drop("_every")

    def cell(r: int, fine: bool) -> dict[str, Column]:
        side = math.degrees(r * 0.999 / FINE / EARTH_KM)
        y, x = (F.floor(F.col(c) / side).cast("long") for c in ("lat", "lng")) if fine else _cell(F.col("lat"), F.col("lng"), r, max_lat)
        return {"_cy": y, "_cx": x}

    def kinds(r: int, fine: bool) -> DataFrame:
        """The kinds of which a small cell and those wholly near it have enough, or those that lie in or around a wide one."""
        if fine:
            held = known.withColumns(cell(r, True)).groupBy(*CELL, "_kind").agg(F.count("*").alias("n"))
            return _spread(held, SURE).groupBy(*CELL, "_kind").agg(F.sum("n").alias("n")).where(F.col("n") >= enough).select(*CELL, "_kind", F.lit(r).alias("_r"), F.lit(True).alias("_fine"))
        return _spread(known.withColumns(cell(r, False)).select(*CELL, "_kind").distinct()).distinct().select(*CELL, "_kind", F.lit(r).alias("_r"), F.lit(False).alias("_fine"))

    flat = None
    for r in rings:
        for part in (kinds(r, True), kinds(r, False)):
            flat = part if flat is None else flat.unionByName(part)
    flat = written(flat, "kinds-by-cell")
    rows = {(row["_r"], row["_fine"]): row["count"] for row in flat.groupBy("_r", "_fine").count().collect()}  # two a radius

    def looked_up(df: DataFrame, r: int, fine: bool, name: str) -> DataFrame:
        table = flat.where((F.col("_r") == r) & (F.col("_fine") == fine)).groupBy(*CELL).agg(F.collect_list("_kind").alias(name))
        table = F.broadcast(table) if rows.get((r, fine), 0) <= BROADCAST_ROWS else table.hint("merge")
        return df.withColumns(cell(r, fine)).join(table, CELL, "left").drop(*CELL)

    none = F.array().cast(T.ArrayType(known.schema["_kind"].dataType))
    settled, open_ = {r: F.coalesce(f"_sure{r}", none) for r in rings}, []
    for r in rings:
        spots = looked_up(looked_up(spots, r, True, f"_sure{r}"), r, False, f"_about{r}")
        open_.append(F.struct(F.lit(r).alias("r"), F.array_except(F.coalesce(f"_about{r}", none), settled[r]).alias("kinds")))
    asked = spots.select("lat", "lng", F.explode(F.array(*open_)).alias("_o")).select("lat", "lng", F.col("_o.r").alias("_r"), F.explode("_o.kinds").alias("_open")).distinct()
    asked = written(asked, "open-kinds")
    many = {row["_r"]: row["count"] for row in asked.groupBy("_r").count().collect()}  # a row a radius
    size = known.count()
    for r in rings:
        points = looked_up(points, r, True, f"_sure{r}")
        near = F.transform(settled[r], lambda k: F.struct(k["kind"].alias("kind"), F.lit(enough).cast("long").alias("n")))
        if r in many:
            left, at = asked.where(F.col("_r") == r), ["lat", "lng"]
            if many[r] > size:
                met = radius_join(left, known, r, right_columns={}, equal=(("_open", "_kind"),), max_lat=max_lat, cells=True).groupBy(*CELL, *at, F.col("_open").alias("_kind"))
            else:
                met = radius_join(known, left, r, right_columns={"lat": "_y", "lng": "_x"}, equal=(("_kind", "_open"),), max_lat=max_lat).select(F.col("_y").alias("lat"), F.col("_x").alias("lng"), "_kind").groupBy(*at, "_kind")
            found = met.agg(F.least(F.count("*"), F.lit(enough)).alias("n")).groupBy(*at).agg(F.collect_list(F.struct(F.col("_kind.kind").alias("kind"), "n")).alias("_more"))
            points = points.join(found, at, "left")
            near = F.concat(near, F.coalesce("_more", F.array().cast(found.schema["_more"].dataType)))
        points = points.withColumn(f"near{r}", near).drop(f"_sure{r}", "_more")
    return points


#: Of every two cells side by side, one goes to the other.
HALF = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]


def radius_pairs(rows: DataFrame, km: float, *, max_lat: float = 60.0) -> DataFrame:
    """(a, b, km) of all rows (id, lat, lng) within ``km`` of each other, a's id the smaller; every pair is made once."""
    rows = rows.select("id", "lat", "lng")
    y, x = _cell(F.col("lat"), F.col("lng"), km, max_lat)
    homes = rows.withColumns({"_hy": y, "_hx": x})
    tasks = pair_tasks(rows, rows, km, max_lat=max_lat, around=HALF)
    met = radius_join(rows, homes, km, right_columns={"id": "b", "_hy": "_hy", "_hx": "_hx"}, max_lat=max_lat, around=HALF, cells=True, tasks=tasks)
    beside = (F.col("_hy") != F.col("_cy")) | (F.col("_hx") != F.col("_cx"))
    return met.where((beside & (F.col("id") != F.col("b"))) | (F.col("id") < F.col("b"))).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), "km")


def kinds_within(points: DataFrame, others: DataFrame, km: float, kind: str, *, key: list[str], max_lat: float = 60.0) -> DataFrame:
    """(``key``, ``kind``), each once: the kinds of ``others`` that have a row within ``km`` (at most 300) of a row of ``points`` with that key.

    Two points of one small cell, whose diagonal is shorter than ``km``, are near
    without being compared, so where points are dense the work grows with the
    rows and not with the pairs.  Only kinds that lie in the cells around a
    point, but not in its small cell, are looked for by distance.
    """
    side = math.degrees(km * 0.999 / math.sqrt(2) / EARTH_KM)
    small = {"_fy": F.floor(F.col("lat") / side).cast("long"), "_fx": F.floor(F.col("lng") / side).cast("long")}
    y, x = _cell(F.col("lat"), F.col("lng"), km, max_lat)
    wide = {"_cy": y, "_cx": x}
    # a kind that is null is one, too: within a struct it equals itself
    known = others.where("lat is not null and lng is not null").select("lat", "lng", F.struct(F.col(kind).alias(kind)).alias("_kind"))
    sure = known.withColumns(small).groupBy("_fy", "_fx").agg(F.collect_set("_kind").alias("_sure"))
    about = _spread(known.withColumns(wide).select(*CELL, "_kind").distinct()).groupBy(*CELL).agg(F.collect_set("_kind").alias("_about"))
    placed = points.where("lat is not null and lng is not null").select(*key, "lat", "lng").withColumns(small | wide)
    placed = placed.join(about.hint("merge"), CELL).join(sure.hint("merge"), ["_fy", "_fx"], "left").drop(*CELL, "_fy", "_fx")
    found = placed.select(*key, F.explode("_sure").alias("_kind"))
    open_ = placed.select(*key, "lat", "lng", F.explode(F.array_except("_about", F.coalesce("_sure", F.array().cast(sure.schema["_sure"].dataType)))).alias("_open"))
    names = {c: f"_k{i}" for i, c in enumerate(key)}
    met = radius_join(known, open_, km, right_columns=names, equal=(("_kind", "_open"),), max_lat=max_lat)
    met = met.select(*[F.col(n).alias(c) for c, n in names.items()], "_kind")
    return found.unionByName(met).distinct().select(*key, F.col(f"_kind.{kind}").alias(kind))


def geodesic_join(left: DataFrame, right: DataFrame, metres: float, *, right_columns: dict[str, str], equal: tuple[tuple[str, str], ...] = (), max_lat: float = 60.0) -> DataFrame:
    """``radius_join`` by length on the spheroid, as ``metros``.

    The grid and the sphere's distance leave every pair that may lie within
    ``metres``, as the spheroid shortens no line below ``LEAST_STRETCH``; only
    these are measured on the spheroid.  Up to ``SHORT_M`` that is done by the
    straight line between two places, which are worked out once a row.
    """
    km = metres / 1000 / LEAST_STRETCH * (1 + 1e-9)
    if metres <= SHORT_M:
        met = _met(left, right, km, _spheroid, right_columns=right_columns, equal=equal, max_lat=max_lat)
        chord2 = sum(((F.col(f"_a{c}") - F.col(f"_b{c}")) * (F.col(f"_a{c}") - F.col(f"_b{c}")) for c in "xyz"), F.lit(0.0))
        return met.where(chord2 <= metres * metres).withColumn("metros", short_metres(F.sqrt(chord2))).where(F.col("metros") <= metres).drop("_lat", "_lng", *SIDES, *CELL)
    near = radius_join(left, right, km, right_columns=right_columns | {"lat": "_y", "lng": "_x"}, equal=equal, max_lat=max_lat)
    return with_geodesic(near, "lat", "lng", "_y", "_x", "metros").where(F.col("metros") <= metres).drop("_y", "_x", "km")


def planar_neighbours(rows: DataFrame, metres: float, tasks: int | None = None) -> DataFrame:
    """All pairs of ``rows`` (id, lat, lng, others) less than ``metres`` apart by the planar measure of ``planar_closeness``, as structs a and b, a's id the smaller.

    The measure stretches longitudes by the latitude of ``a``.  Cells are bands of
    latitude, cut by longitude as widely as the band's flattest part needs; a
    band at the equator, where the measure knows no longitude, is one cell.  With
    ``tasks`` the cells are dealt out to so many, for work on pairs that rows do not tell.
    """
    height = metres / PLANAR_METRES * (1 + 1e-9)

    def column(band: Column, lng: Column) -> Column:
        flattest = F.when(band >= 0, band * F.lit(height)).otherwise(-(band + 1) * F.lit(height))
        return F.when(flattest > 0, F.floor(lng / (F.lit(height * 90) / flattest))).otherwise(F.lit(0)).cast("long")

    known = rows.where("lat != 0 and lng != 0").withColumn("_band", F.floor(F.col("lat") / height).cast("long"))
    names = rows.columns
    left = known.select(F.struct(*names).alias("a"), "_band", column(F.col("_band"), F.col("lng")).alias("_x"))
    bands = known.withColumn("_band", F.explode(F.array(F.col("_band") - 1, F.col("_band"), F.col("_band") + 1)))
    x = column(F.col("_band"), F.col("lng"))
    right = bands.select(F.struct(*names).alias("b"), "_band", F.explode(F.array_distinct(F.when((F.col("_band") == 0) | (F.col("_band") == -1), F.array(x)).otherwise(F.array(x - 1, x, x + 1)))).alias("_x"))
    if tasks:
        left, right = (side.repartition(tasks, "_band", "_x") for side in (left, right))
    pairs = left.join(right.hint("shuffle_merge"), ["_band", "_x"]).where("a.id < b.id").select("a", "b")
    dy = F.abs(F.col("a.lat") - F.col("b.lat")) * PLANAR_METRES
    dx = F.abs(F.col("a.lng") - F.col("b.lng")) * PLANAR_METRES * F.abs(F.col("a.lat")) / 90
    return pairs.where(F.sqrt(dx * dx + dy * dy) < metres)


def within(df: DataFrame, lat: float, lng: float, km: float) -> DataFrame:
    """Rows within ``km`` of a point; the box around it is what a scan can prune by."""
    dy = km / KM_PER_DEGREE
    dx = dy / math.cos(math.radians(min(89.0, abs(lat) + dy)))
    near = df.where(F.col("lat").between(lat - dy, lat + dy) & F.col("lng").between(lng - dx, lng + dx))
    return near.withColumn("km", haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))).where(F.col("km") <= km)
