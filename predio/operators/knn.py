"""Nearest neighbours: cells of the asking rows go down a tree of cells whose points are counted."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from predio.functions.geo import haversine_km
from predio.operators.graph import checked_broadcast, written

#: Halvings of the cube around the unit sphere (the finest cells are 12 m wide), and how many of them one step of the tree takes.
DEPTH, STEP = 20, 2
#: Points of a cell that is not divided further.
LEAF = 16
#: Points that may still be nearest to some row of a box that is not divided further, unless k asks for more.
CHOICE = 256
#: Boxes that are divided, and rows that are compared with their box's points, by one task.
TASK_BOXES, TASK_ROWS = 250, 20_000
#: Squared chords are compared with this much to spare, so that rounding loses no neighbour; what is kept too much is only compared.
SPARE, LEAST = 1e-6, 1e-14
#: Columns of a place's whole coordinates at the finest level.
INDEX = ["_ix", "_iy", "_iz"]


def _sphere(lat: str, lng: str) -> list[Column]:
    y, x = F.radians(lat), F.radians(lng)
    return [(F.cos(y) * F.cos(x)).alias("_x"), (F.cos(y) * F.sin(x)).alias("_y"), F.sin(y).alias("_z")]


def _axis(c: Column) -> Column:
    return F.least(F.lit((1 << DEPTH) - 1), F.greatest(F.lit(0), F.floor((c + 1) * (1 << (DEPTH - 1))))).cast("long")


def _cell(axes: list[Column], level: int) -> Column:
    """Number of the cell of a level that holds a point with these whole coordinates."""
    x, y, z = (F.shiftright(a, DEPTH - level) for a in axes)
    return F.shiftleft(x, 42).bitwiseOR(F.shiftleft(y, 21)).bitwiseOR(z)


def _corner(cell: Column) -> list[Column]:
    return [F.shiftright(cell, 42), F.shiftright(cell, 21).bitwiseAND(F.lit((1 << 21) - 1)), cell.bitwiseAND(F.lit((1 << 21) - 1))]


def _above(cell: Column) -> Column:
    x, y, z = (F.shiftright(a, STEP) for a in _corner(cell))
    return F.shiftleft(x, 42).bitwiseOR(F.shiftleft(y, 21)).bitwiseOR(z)


def _half(level: Column) -> Column:
    """Half the width of a cell."""
    return F.pow(F.lit(0.5), level)


def _middle(cell: Column, half: Column) -> list[Column]:
    return [(2 * corner + 1) * half - 1 for corner in _corner(cell)]


def _span(a: list[Column], b: list[Column], half: Column | None = None) -> tuple[Column, Column]:
    """Squared chords between two middles at the least and at the most, if together the cells reach ``half`` to each side of them."""
    near, far = F.lit(0.0), F.lit(0.0)
    for p, q in zip(a, b, strict=True):
        off = F.abs(p - q)
        gap, reach = (off, off) if half is None else (F.greatest(F.lit(0.0), off - half), off + half)
        near, far = near + gap * gap, far + reach * reach
    return near, far


def _spared(bound: Column) -> Column:
    return bound * (1 + SPARE) + LEAST


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, also where inner functions use it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _open_cells(boxes: DataFrame, want: int, level: int) -> DataFrame:
    """(_box, bound, cells) of boxes of a level (_up, _box, _bound, _cells): a bound within which every place of the box has ``want`` points, and the cells that reach into it.

    Rows are where their _up is, so cells are measured one a row and gathered without a shuffle.
    """
    flat, half = boxes.select("_up", "_box", "_bound", F.explode("_cells").alias("c")), _half(F.col("c.level"))
    near, far = _span(_middle(F.col("_box"), F.lit(0.5**level)), _middle(F.col("c.cell"), half), half + 0.5**level)
    flat = flat.select("_up", "_box", "_bound", far.alias("far"), near.alias("near"), "c.*").where(F.col("near") <= _spared(F.col("_bound")))
    # far stands here twice, so that Spark compiles it in a projection and doesn't interpret it in collect_list
    bound = F.least(F.max("_bound"), F.min(F.when(F.col("n") >= want, F.col("far"))))
    met = flat.groupBy("_up", "_box").agg(bound.alias("_bound"), F.collect_list(F.struct("far", "near", "level", "cell", "n")).alias("cells"))

    def nth(s: Column, c: Column) -> Column:
        held = s["held"] + c["n"]
        return F.struct(held.alias("held"), F.when((s["held"] < want) & (held >= want), c["far"]).otherwise(s["bound"]).alias("bound"))

    def kept(b: Column) -> Column:
        return F.struct(b.alias("bound"), F.transform(F.filter("cells", lambda c: c["near"] <= _spared(b)), lambda c: F.struct(*[c[n].alias(n) for n in ("level", "cell", "n")])).alias("cells"))

    start = F.struct(F.lit(0).cast("long").alias("held"), F.col("_bound").alias("bound"))
    bound = F.least("_bound", F.aggregate(F.sort_array("cells"), start, nth)["bound"])
    return met.select("_box", _let(bound, kept).alias("m")).select("_box", "m.bound", "m.cells")


def _tasks(df: DataFrame, rows: int, each: int) -> int:
    """Tasks for work that bytes do not tell: by rows, but as many as shuffles have at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, -(-rows // each)))


def _ranked(want: int, tie: str) -> Column:
    """The ``want`` nearest of _points to (_qlat, _qlng), nearest first, as structs of km and point."""
    spot = _sphere("_qlat", "_qlng")

    def kept(place: Column) -> Column:
        # a squared chord is twice what the product leaves to one
        product = lambda p: place["_x"] * p["_x"] + place["_y"] * p["_y"] + place["_z"] * p["_z"]
        last = F.get(F.sort_array(F.transform("_points", product), False), F.lit(want - 1))
        return _let(1 - _spared(1 - last), lambda b: F.filter("_points", lambda p: product(p) >= b))

    def by_km(p: Column, i: Column) -> Column:
        return F.struct(haversine_km(F.col("_qlat"), F.col("_qlng"), p["_lat"], p["_lng"]).alias("km"), p[tie].isNull().alias("none"), p[tie].alias("tie"), i.alias("i"))

    def sorted_(ps: Column) -> Column:
        return F.transform(F.slice(F.sort_array(F.transform(ps, by_km)), 1, want), lambda s: F.struct(s["km"].alias("km"), F.get(ps, s["i"]).alias("point")))

    return _let(_let(F.struct(*spot), kept), sorted_)


def _common_cell(rows: DataFrame) -> tuple[int, int] | None:
    """Level and number of the deepest cell of the tree that holds all rows (_ix, _iy, _iz); none if there are no rows."""
    ends = rows.agg(*[f(n).alias(f"{f.__name__}{n}") for n in INDEX for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return None
    shared = lambda level: all(ends[f"min{n}"] >> (DEPTH - level) == ends[f"max{n}"] >> (DEPTH - level) for n in INDEX)
    level = max(level for level in range(0, DEPTH + 1, STEP) if shared(level))
    x, y, z = (ends[f"min{n}"] >> (DEPTH - level) for n in INDEX)
    return level, x << 42 | y << 21 | z


def nearest(left: DataFrame, right: DataFrame, k: int, *, right_columns: dict[str, str], key: str = "id", tie: str, leaf: int = LEAF, choice: int = CHOICE) -> DataFrame:
    """The ``k`` rows of ``right`` nearest to every row of ``left``, with km and rank; ties go by ``tie``.

    ``key`` tells the rows of ``left`` apart; rows of either side without lat or
    lng take no part, and where ``right`` has fewer than ``k`` rows all are
    taken.  ``right_columns`` names what is taken from it and must name ``tie``.

    Points lie on the unit sphere, so neither the date line nor a pole is an
    edge.  Cells of ``right`` are divided until they hold ``leaf`` points, so a
    dense town has small cells and a desert large ones.  The rows of ``left`` go
    down that tree together, in boxes that are such cells too: cells further from
    a box than the nearest cells that hold k points reach are left behind.  A
    box is divided, with the cells, until ``choice`` points are left to it, or
    only leaves much wider than itself, or it is of the finest level; its rows are then compared with these alone.
    What is written on the way grows with the boxes, of which there are no more
    than the points make necessary; a row of ``left`` is written once, is
    shuffled to its box and meets its points there as a list, so that no pair
    becomes a row.  Of the points on one spot the first k by ``tie`` are enough,
    so a list stays short unless different spots crowd within 12 m.

    Boxes and cells are broadcast if they were counted small, else joined by a
    shuffle.
    """
    placed = lambda rows, lat, lng: rows.withColumns({n: _axis(c) for n, c in zip(INDEX, _sphere(lat, lng), strict=True)})
    axes = [F.col(n) for n in INDEX]
    points = right.where("lat is not null and lng is not null").select(F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), *[F.col(c).alias(n) for c, n in right_columns.items()])
    here = Window.partitionBy("_lat", "_lng").orderBy(F.col(tie).asc_nulls_last())
    points = placed(written(points.withColumn("_n", F.row_number().over(here)).where(F.col("_n") <= k).drop("_n"), "knn-points"), "_lat", "_lng")
    asked = left.where("lat is not null and lng is not null")
    seekers = placed(written(asked.select(F.col(key).alias("_key"), F.col("lat").alias("_qlat"), F.col("lng").alias("_qlng")), "knn-asked"), "_qlat", "_qlng")

    every = points.count()
    want, choice = min(k, every), max(choice, leaf, 4 * k)
    level, cell = (every and _common_cell(points.select(*INDEX).unionByName(seekers.select(*INDEX)))) or (0, 0)
    levels = range(level, DEPTH + 1, STEP)
    places = F.array(*[F.struct(F.lit(at).alias("level"), _cell(axes, at).alias("cell")) for at in levels])
    nodes = points.select(F.explode(places).alias("p")).groupBy("p.level", "p.cell").agg(F.count("*").alias("n")).withColumn("up", _above(F.col("cell")))
    parents = nodes.where(F.col("n") > leaf).select((F.col("level") + STEP).alias("level"), F.col("cell").alias("up"))
    nodes = written(nodes.join(parents, ["level", "up"], "left_semi"), "knn-cells")

    root = F.struct(F.lit(level).alias("level"), F.lit(cell).cast("long").alias("cell"), F.lit(every).cast("long").alias("n"))
    boxes = left.sparkSession.range(1).select(F.lit(0).cast("long").alias("_up"), F.lit(cell).cast("long").alias("_box"), F.lit(5.0).alias("_bound"), F.array(root).alias("_cells"))
    ends, ended = (F.col("c.level") == DEPTH) | (F.col("c.n") <= leaf), {}
    while True:
        met = _open_cells(boxes, want, level)
        points_left = F.aggregate("cells", F.lit(0).cast("long"), lambda n, c: n + c["n"])
        wide = F.forall("cells", lambda c: c["level"] <= F.lit(level - STEP))  # leaves next to which the box is a dot
        met = written(met.withColumn("done", (points_left <= choice) | wide | F.lit(level == DEPTH)), "knn-boxes")
        n = met.agg(F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("open")).first()
        if n["done"]:
            ended[level] = met.where("done")
        if not n["open"]:
            break
        open_, tasks = met.where("not done").select(F.col("_box").alias("_up"), "bound", "cells"), _tasks(left, n["open"], TASK_BOXES)
        level += STEP
        flat = open_.select("_up", "bound", F.explode("cells").alias("c"))
        below = nodes.where(F.col("level") == level).select(F.struct("level", "cell", "n").alias("below"), "up")
        opened = flat.where(~ends).join(checked_broadcast(below), F.col("c.cell") == F.col("up")).select("_up", "bound", F.col("below").alias("c"))
        flat = flat.where(ends).unionByName(opened).repartition(tasks, "_up").groupBy("_up").agg(F.max("bound").alias("_bound"), F.collect_list("c").alias("_cells"))
        inner = seekers.select(_cell(axes, level).alias("_box"), _cell(axes, level - STEP).alias("_up"))
        boxes = inner.join(checked_broadcast(open_.select("_up")), "_up", "left_semi").distinct().repartition(tasks, "_up").join(flat, "_up")

    final = reduce(DataFrame.unionByName, [boxes.select(F.lit(at).alias("_level"), "_box", "bound", "cells") for at, boxes in ended.items()])
    homes = points.select("*", *_sphere("_lat", "_lng"), F.explode(places).alias("p")).select(F.struct("_lat", "_lng", "_x", "_y", "_z", *right_columns.values()).alias("point"), "p.level", "p.cell")
    met = final.select("_level", "_box", "bound", F.explode("cells").alias("c")).select("_level", "_box", "bound", "c.level", "c.cell").join(homes, ["level", "cell"])
    half, box = _half(F.col("_level")), ["_level", "_box"]
    near, far = _span(_middle(F.col("_box"), half), [F.col(f"point.{c}") for c in ("_x", "_y", "_z")], half)
    met = met.select(*box, "bound", far.alias("far"), near.alias("near"), "point").where(F.col("near") <= _spared(F.col("bound")))
    met = met.groupBy(*box).agg(F.collect_list("far").alias("fars"), F.collect_list(F.struct("near", "point")).alias("cs"))
    reach = F.get(F.sort_array("fars"), F.lit(want - 1))
    lists = written(met.select(*box, _let(reach, lambda b: F.transform(F.filter("cs", lambda c: c["near"] <= _spared(b)), lambda c: c["point"])).alias("_points")), "knn-lists")

    own = F.explode(F.array(*[F.struct(F.lit(at).alias("_level"), _cell(axes, at).alias("_box")) for at in ended])).alias("b")
    here = seekers.select("_key", "_qlat", "_qlng", own).select("_key", "_qlat", "_qlng", "b.*")
    sizes = written(here.join(checked_broadcast(lists.select(*box)), box, "left_semi").groupBy(*box).agg(F.count("*").alias("n")), "knn-sizes")
    tasks = _tasks(left, sizes.agg(F.sum("n")).first()[0] or 0, TASK_ROWS)
    # a box that is crowded with rows hands its list to several tasks
    parts = checked_broadcast(sizes.select(*box, F.ceil(F.col("n") / TASK_ROWS).cast("int").alias("parts")))
    here = here.join(parts, box).withColumn("part", F.pmod(F.xxhash64("_key", "_qlat"), F.col("parts")).cast("int")).drop("parts").repartition(tasks, *box, "part")
    lists = lists.join(parts, box).select(*box, "_points", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).repartition(tasks, *box, "part")
    found = here.join(lists, [*box, "part"]).select("_key", F.posexplode(_ranked(want, tie)).alias("pos", "best"))
    best = found.select(F.col("_key").alias(key), *[F.col(f"best.point.{n}").alias(n) for n in right_columns.values()], "best.km", (F.col("pos") + 1).alias("rank"))
    return best if left.columns == [key, "lat", "lng"] else asked.join(best, key)
