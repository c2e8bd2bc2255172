"""Lengths on the spheroid and the table in Morton order, against published values and all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from predio.functions.geo import LEAST_STRETCH, MOST_STRETCH, geodesic_metres, haversine_km, short_metres, spheroid_place, with_geodesic
from predio.operators import morton
from predio.operators.spatial import geodesic_join


def degrees(d, minutes, seconds):
    return math.copysign(abs(d) + minutes / 60 + seconds / 3600, d)


#: Published lengths: two survey pillars, a quarter of a meridian, a degree of the equator, two airports (to a metre).
PUBLISHED = [
    (degrees(-37, 57, 3.72030), degrees(144, 25, 29.52440), degrees(-37, 39, 10.15610), degrees(143, 55, 35.38390), 54972.271, 0.001),
    (0.0, 0.0, 90.0, 0.0, 10001965.729, 0.001),
    (0.0, 0.0, 0.0, 1.0, 6378137 * math.pi / 180, 0.001),
    (0.0, 179.5, 0.0, -179.5, 6378137 * math.pi / 180, 0.001),
    (40.6, -73.8, 51.6, -0.5, 5551759.0, 1.0),
    (12.5, 7.0, 12.5, 7.0, 0.0, 0.0),
]


@pytest.mark.parametrize("form", ["fold", "steps"])
def test_published_lengths(spark, form):
    rows = spark.createDataFrame([r[:4] for r in PUBLISHED], "a double, b double, c double, d double")
    got = with_geodesic(rows, "a", "b", "c", "d", "m") if form == "steps" else rows.withColumn("m", geodesic_metres(*map(F.col, "abcd")))
    found = {(r.a, r.b, r.c, r.d): r.m for r in got.collect()}
    assert all(abs(found[r[:4]] - r[4]) <= r[5] for r in PUBLISHED)


def test_lengths_without_an_answer_are_null(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (-41.32, 174.81, 40.96, -5.5), (None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    assert [r.m for r in rows.select(geodesic_metres(*map(F.col, "abcd")).alias("m")).collect()] == [None] * 3
    assert [r.m for r in with_geodesic(rows, "a", "b", "c", "d", "m").collect()] == [None] * 3


def test_spheroid_stretches_within_bounds(spark):
    rng = random.Random(5)
    near = [(y, x, max(-90.0, min(90.0, y + rng.gauss(0, s))), x + rng.gauss(0, s)) for s in (0.001, 1.0, 20.0) for y, x in ((rng.uniform(-89, 89), rng.uniform(-150, 150)) for _ in range(150))]
    near += [(0.0, 10.0, 0.001, 10.0), (89.9, 0.0, 89.8, 0.0)]
    rows = spark.createDataFrame(near, "a double, b double, c double, d double")
    for r in with_geodesic(rows, "a", "b", "c", "d", "m").withColumn("h", haversine_km(*map(F.col, "abcd")) * 1000).collect():
        assert LEAST_STRETCH * (1 - 1e-6) <= r.m / r.h <= MOST_STRETCH * (1 + 1e-6)
        if r.h < 2000 and abs(r.a) < 80:  # the arc of the mean latitude is as good, so near
            e2, mid = 1 - (1 - 1 / 298.257223563) ** 2, math.radians((r.a + r.c) / 2)
            n = 6378137 / math.sqrt(1 - e2 * math.sin(mid) ** 2)
            m = n * (1 - e2) / (1 - e2 * math.sin(mid) ** 2)
            assert abs(r.m - math.hypot(m * math.radians(r.c - r.a), n * math.cos(mid) * math.radians(r.d - r.b))) < 0.01


def cloud(spark, n, seed, box=(-18.0, -17.6, -63.4, -63.0)):
    rng = random.Random(seed)
    rows = [(i, rng.uniform(*box[:2]), rng.uniform(*box[2:])) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, 1.0), (n + 1, 95.0, 3.0)], "id long, lat double, lng double")


@pytest.mark.parametrize("metres", [400.0, 9000.0])
def test_join_equals_all_pairs(spark, metres):
    a, b = cloud(spark, 150, 1), cloud(spark, 120, 2)
    got = {(r.id, r.other): r.metros for r in geodesic_join(a, b, metres, right_columns={"id": "other"}).collect()}
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, F.lit(True)).select("x.id", F.col("y.id").alias("other"), geodesic_metres(F.col("x.lat"), F.col("x.lng"), F.col("y.lat"), F.col("y.lng")).alias("m"))
    want = {(r.id, r.other): r.m for r in both.collect() if r.m is not None and r.m <= metres}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in got)


def plain_key(lat, lng):
    y, x = (min(int((v - lo) / span * 2**24), 2**24 - 1) for v, lo, span in ((lat, -90, 180), (lng, -180, 360)))
    return int("".join(a + b for a, b in zip(f"{y:024b}", f"{x:024b}", strict=True)), 2)


def test_keys_take_bits_in_turn(spark):
    places = [(0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (-17.7833, -63.1833), (12.3456, 123.456)]
    rows = spark.createDataFrame([*places, (91.0, 0.0), (None, 0.0)], "lat double, lng double").select("lat", "lng", morton.key(F.col("lat"), F.col("lng")).alias("k")).collect()
    assert [r.k for r in rows] == [plain_key(*p) for p in places] + [None, None]


@pytest.mark.parametrize("most", [4, 32, 200])
def test_ranges_hold_the_box(most):
    rng = random.Random(7)
    for _ in range(60):
        y, x, h = rng.uniform(-89, 89), rng.uniform(-179, 179), 10 ** rng.uniform(-4, 1)
        box = (max(-90.0, y - h), min(90.0, y + h), max(-180.0, x - h), min(180.0, x + h))
        ranges = morton.key_ranges(box, most)
        assert 1 <= len(ranges) <= most and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
        inside = [(rng.uniform(*box[:2]), rng.uniform(*box[2:])) for _ in range(40)] + [(box[0], box[2]), (box[1], box[3])]
        assert all(any(a <= plain_key(*p) <= b for a, b in ranges) for p in inside)


def scanned(df):
    """Rows and files that the scan of ``df`` read, after it ran."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return tuple(leaf.metrics().apply(n).value() for n in ("numOutputRows", "numFiles"))


def test_scan_opens_few_files_and_row_groups(spark, tmp_path):
    rows = spark.range(60_000).select("id", (F.rand(3) * 40 - 20).alias("lat"), (F.rand(4) * 40 - 20).alias("lng"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None, None), (-2, 0.0, 200.0)], "id long, lat double, lng double")).cache()
    folder = f"file://{tmp_path}/places"
    morton.append(rows.where("id % 3 = 0"), folder, files=8, row_group_bytes=16_384)
    morton.append(rows.where("id % 3 <> 0"), folder, files=8, row_group_bytes=16_384)
    assert morton.index(spark, folder).count() == 16
    assert sorted(r.id for r in morton.read(spark, folder).select("id").collect()) == list(range(-2, 60_000))
    found = morton.within(spark, folder, 3.3, 4.4, 120.0)
    near = haversine_km(F.lit(3.3), F.lit(4.4), F.col("lat"), F.col("lng")) <= 120.0
    assert found.columns == ["id", "lat", "lng", "km"]
    assert {r.id for r in found.collect()} == {r.id for r in rows.where(near & F.col("lng").between(-180, 180)).collect()}
    read, files = scanned(found)
    assert files <= 4 and read < 60_000 / 16, (read, files)  # of 16 files and 60,000 rows
    whole = morton.in_box(spark, folder, (-20.0, 20.0, -20.0, 20.0))
    assert whole.count() == 60_000
    assert morton.in_box(spark, folder, (50.0, 51.0, 50.0, 51.0)).count() == 0


def test_circles_across_the_date_line_and_around_a_pole(spark, tmp_path):
    rng = random.Random(11)
    places = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(3000)] + [(3000 + i, rng.uniform(-5, 5), rng.choice([-1, 1]) * rng.uniform(176, 180)) for i in range(500)]
    rows, folder = spark.createDataFrame(places, "id long, lat double, lng double").cache(), f"file://{tmp_path}/globe"
    morton.append(rows, folder, files=6)
    for lat, lng, km in ((0.0, 179.5, 300.0), (1.0, -179.9, 200.0), (88.0, 20.0, 900.0), (-90.0, 0.0, 1500.0), (10.0, 10.0, 15_000.0)):
        want = {r.id for r in rows.where(haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")) <= km).collect()}
        assert {r.id for r in morton.within(spark, folder, lat, lng, km).collect()} == want


def test_an_unpublished_delivery_is_not_seen(spark, tmp_path):
    folder = f"file://{tmp_path}/half"
    morton.append(cloud(spark, 20, 3), folder, files=2)
    cloud(spark, 20, 4).withColumn("_morton", F.lit(0).cast("long")).write.parquet(f"{folder}/data/half")
    assert morton.read(spark, folder).count() == 22


def test_a_delivery_without_rows(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/none", cloud(spark, 20, 3)
    morton.append(rows.where("id < 0"), folder, files=2)
    assert morton.read(spark, folder).count() == 0 and morton.in_box(spark, folder, (-90.0, 90.0, -180.0, 180.0)).columns == rows.columns
    morton.append(rows, folder, files=2)
    assert morton.read(spark, folder).count() == 22 and morton.in_box(spark, folder, (-90.0, 90.0, -180.0, 180.0)).count() == 20


def test_short_lines_by_the_straight_line(spark):
    """Lines of up to two kilometres anywhere, and of none, as the steps on the spheroid give them."""
    rng = random.Random(9)
    near = [(y, x, y + rng.gauss(0, 0.004), x + rng.gauss(0, 0.004)) for y, x in ((rng.uniform(-85, 85), rng.uniform(-179, 179)) for _ in range(400))] + [(12.5, 7.0, 12.5, 7.0)]
    rows = spark.createDataFrame(near, "a double, b double, c double, d double")
    p, q = spheroid_place(F.col("a"), F.col("b")), spheroid_place(F.col("c"), F.col("d"))
    chord = F.sqrt(sum(((u - v) * (u - v) for u, v in zip(p, q, strict=True)), F.lit(0.0)))
    got = with_geodesic(rows.withColumn("s", short_metres(chord)), "a", "b", "c", "d", "m").where("m <= 2000").collect()
    assert len(got) > 300 and all(abs(r.s - r.m) < 2e-7 for r in got)


def test_short_join_measures_no_pair_by_steps(spark):
    """Places are worked out once a row: above the join of the pairs no trigonometry is left."""
    plan = geodesic_join(cloud(spark, 9, 1), cloud(spark, 9, 2), 500.0, right_columns={"id": "other"})._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]
    assert "metros" in above and not any(f in above.lower() for f in ("sin(", "cos(", "atan"))
