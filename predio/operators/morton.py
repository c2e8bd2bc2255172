"""A table in Morton order of its places, with an index of its files, so that a scan of a place opens few of them.

``folder/data`` has a folder of files for every delivery, sorted by the bits of
latitude and longitude in turn; ``folder/index`` has a row for every file: the
range of its keys and the box of its places.  A scan reads the index, opens
only files whose box and keys meet the place, and tells their row groups apart
by the ranges of keys, which Parquet keeps for every group.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from predio.functions.geo import EARTH_KM, haversine_km

Box = tuple[float, float, float, float]

KEY = "_morton"
#: Bits of a coordinate; a cell is 12 m high and 24 m wide at the equator.
BITS = 24


def _spread(x: Column) -> Column:
    """Bits of ``x`` at the even places: every step moves half of each group of bits away."""
    width = 32
    while width > 1:
        width //= 2
        mask = sum(((1 << width) - 1) << i for i in range(0, 64, 2 * width))
        x = F.shiftleft(x, width).bitwiseOR(x).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))
    return x


def _cell(at: Column, low: float, span: float) -> Column:
    return F.least(F.floor((at - low) / span * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("long")


def key(lat: Column, lng: Column) -> Column:
    """Morton number of a place: bits of latitude and longitude in turn; null without a place on the globe."""
    known = lat.between(-90, 90) & lng.between(-180, 180)
    return F.when(known, F.shiftleft(_spread(_cell(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(_cell(lng, -180.0, 360.0))))


def boxes(lat: float, lng: float, km: float) -> list[Box]:
    """Boxes (lat_min, lat_max, lng_min, lng_max) that cover a circle: two across the date line, a full turn around a pole."""
    arc = km / EARTH_KM * (1 + 1e-9)
    low, high = lat - math.degrees(arc), lat + math.degrees(arc)
    if low <= -90 or high >= 90 or arc >= math.pi / 2:
        return [(max(low, -90.0), min(high, 90.0), -180.0, 180.0)]
    wide = math.degrees(math.asin(min(1.0, math.sin(arc) / math.cos(math.radians(lat))))) * (1 + 1e-9)
    west, east = lng - wide, lng + wide
    if west < -180:
        return [(low, high, west + 360, 180.0), (low, high, -180.0, east)]
    return [(low, high, west, 180.0), (low, high, -180.0, east - 360)] if east > 180 else [(low, high, west, east)]


def key_ranges(box: Box, most: int = 32) -> list[tuple[int, int]]:
    """At most ``most`` ranges of keys, in order, that hold every place of the box.

    The square of cells is quartered where the box cuts it, level by level, while
    the ranges stay few; what is cut then is taken whole.
    """

    def place(at: float, low: float, span: float) -> int:
        return min(max(int((at - low) / span * (1 << BITS)), 0), (1 << BITS) - 1)

    y0, y1, x0, x1 = (place(a, lo, sp) for a, lo, sp in zip(box, (-90, -90, -180, -180), (180, 180, 360, 360), strict=True))
    y0, y1, x0, x1 = y0 - 1, y1 + 1, x0 - 1, x1 + 1  # a place may round into the next cell
    whole, cut = [], [(0, 0, 0)]  # number of the square at its level, its row and column
    level = 0
    while cut and level < BITS and len(whole) + 4 * len(cut) <= most:
        level, size, squares = level + 1, 1 << (BITS - level - 1), []
        for z, y, x in cut:
            for n in range(4):
                row, col = 2 * y + n // 2, 2 * x + n % 2
                top, left = row * size, col * size
                if top > y1 or top + size - 1 < y0 or left > x1 or left + size - 1 < x0:
                    continue
                inside = y0 <= top and top + size - 1 <= y1 and x0 <= left and left + size - 1 <= x1
                (whole if inside else squares).append((z * 4 + n, row, col) if not inside else _range(z * 4 + n, level))
        cut = squares
    out: list[tuple[int, int]] = []
    for a, b in sorted(whole + [_range(z, level) for z, _, _ in cut]):
        if out and out[-1][1] + 1 == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _range(square: int, level: int) -> tuple[int, int]:
    below = 2 * (BITS - level)
    return square << below, ((square + 1) << below) - 1


def append(df: DataFrame, folder: str, files: int, row_group_bytes: int | None = None) -> None:
    """Add rows (with lat and lng) as ``files`` files in Morton order; they are seen once their index is there.

    Rows without a place, or with one off the globe, are kept apart and found by ``read`` alone.
    A delivery that dies leaves files that no index names; run it again.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    keyed = df.withColumn(KEY, key(F.col("lat"), F.col("lng")))
    out = keyed.repartitionByRange(files, KEY).sortWithinPartitions(KEY).write
    (out.option("parquet.block.size", row_group_bytes) if row_group_bytes else out).parquet(f"{folder}/data/{run}")
    rows = spark.read.schema(keyed.schema).parquet(f"{folder}/data/{run}").withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    placed = F.col(KEY).isNotNull()
    edges = [f(F.when(placed, F.col(c))).alias(f"{c}_{n}") for c in (KEY, "lat", "lng") for f, n in ((F.min, "min"), (F.max, "max"))]
    index = rows.groupBy("file").agg(F.count("*").alias("rows"), *edges).withColumn("run", F.lit(run))
    index.coalesce(1).write.parquet(f"{folder}/index/_{run}")  # a row a file
    kind = spark._jvm.org.apache.hadoop.fs.Path
    fs = kind(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(kind(f"{folder}/index/_{run}"), kind(f"{folder}/index/{run}")):
        raise RuntimeError(f"the index of {folder} could not be published")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """A row for every file of the table."""
    return spark.read.parquet(f"{folder}/index/*")


def _load(spark: SparkSession, folder: str, entries: DataFrame) -> DataFrame:
    """Rows of the files named; their names are collected, as Spark's own list of files would be."""
    names = [f"{folder}/data/{r.run}/{r.file}" for r in entries.select("run", "file").collect()]
    kind = spark._jvm.org.apache.hadoop.fs.Path
    fs = kind(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    runs = [s.getPath().getName() for s in fs.listStatus(kind(f"{folder}/index")) if s.getPath().getName()[0] != "_"]
    schema = spark.read.parquet(f"{folder}/data/{min(runs)}").schema  # a delivery without rows has one too
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All rows."""
    return _load(spark, folder, index(spark, folder)).drop(KEY)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _scan(spark: SparkSession, folder: str, places: list[Box]) -> DataFrame:
    ranges = [key_ranges(b) for b in places]
    meets = lambda b, rs: (F.col("lat_max") >= b[0]) & (F.col("lat_min") <= b[1]) & (F.col("lng_max") >= b[2]) & (F.col("lng_min") <= b[3]) & _any([(F.col(f"{KEY}_max") >= lo) & (F.col(f"{KEY}_min") <= hi) for lo, hi in rs])
    rows = _load(spark, folder, index(spark, folder).where(_any([meets(b, rs) for b, rs in zip(places, ranges, strict=True)])))
    keys = _any([F.col(KEY).between(lo, hi) for rs in ranges for lo, hi in rs])
    return rows.where(keys & _any([F.col("lat").between(b[0], b[1]) & F.col("lng").between(b[2], b[3]) for b in places])).drop(KEY)


def in_box(spark: SparkSession, folder: str, box: Box) -> DataFrame:
    """Rows in a box (lat_min, lat_max, lng_min, lng_max), edges included."""
    return _scan(spark, folder, [box])


def within(spark: SparkSession, folder: str, lat: float, lng: float, km: float) -> DataFrame:
    """Rows within ``km`` of a point, with the distance as ``km``."""
    near = _scan(spark, folder, boxes(lat, lng, km))
    return near.withColumn("km", haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))).where(F.col("km") <= km)
