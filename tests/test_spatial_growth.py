"""Radius joins at size: no copied side is broadcast, pairs are grouped where they are made, and dense places need no pairs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from predio.functions.geo import haversine_km
from predio.operators import proximity, spatial
from predio.operators.spatial import CELL, counts_up_to, ids_within, kinds_within, lists_within, radius_join, radius_pairs, ring_counts
from predio.plans import registered

QUERIES, _ = registered()


def placed(spark, n, seed, spread=0.05):
    """Points with kinds, among them a null kind, missing places and ids that lie in two places."""
    rng = random.Random(seed)
    rows = [(i, -17.8 + rng.uniform(-spread, spread), -63.2 + rng.uniform(-spread, spread), rng.choice(["x", "y", None])) for i in range(n)]
    rows += [(i, -17.8 + rng.uniform(-spread, spread), -63.2 + rng.uniform(-spread, spread), "x") for i in range(0, n, 7)]
    return spark.createDataFrame([*rows, (n, None, None, "x")], "id long, lat double, lng double, kind string")


def all_pairs(a, b, km):
    x, y = a.alias("x"), b.alias("y")
    far = haversine_km(F.col("x.lat"), F.col("x.lng"), F.col("y.lat"), F.col("y.lng"))
    return x.join(y, far <= km).select(F.col("x.id").alias("id"), F.col("y.id").alias("other"), F.col("y.kind").alias("kind"), far.alias("km"))


@pytest.mark.parametrize("name", ["a11_coverage_level", "j01_radius_join", "a08_services_per_zone", "a30_proximity_cache", "j02_radius_left_join", "j01_geodesic_join", "j15_services_by_need"])
def test_copies_are_not_broadcast(spark, sf_dir, name):
    """A side copied to nine cells is estimated at the size of one, so Spark would broadcast it whatever its rows."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [_cy" in plan
    assert not any("_cy" in line or "_fy" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)


@pytest.mark.parametrize("km", [0.3, 2.0])
def test_kinds_within_are_those_of_all_pairs(spark, km):
    a, b = placed(spark, 80, 1), placed(spark, 120, 2)
    got = kinds_within(a, b, km, "kind", key=["id"]).collect()
    assert len(got) == len(set(got))
    assert set(got) == set(all_pairs(a, b, km).select("id", "kind").collect())


def test_kinds_of_a_dense_place_need_no_pairs(spark):
    """Two thousand rows on each side of one small cell: decided by the cell, none is left to the join by distance."""
    town = spark.range(2000).select("id", (F.lit(-17.8001) - F.col("id") * 1e-8).alias("lat"), F.lit(-63.2001).alias("lng"), (F.col("id") % 3).cast("string").alias("kind"))
    assert kinds_within(town, town, 1.0, "kind", key=["id"]).count() == 6000


def test_lists_are_those_of_all_pairs(spark):
    a, b = placed(spark, 60, 3), placed(spark, 90, 4)
    listed = [F.array_sort(F.collect_list("other")).alias("others"), F.count("*").alias("n")]
    got = lists_within(a.drop("kind"), b, 1.5, ["id", "kind"], listed, right_columns={"id": "other", "kind": "kind"})
    assert sorted(map(str, got.collect())) == sorted(map(str, all_pairs(a, b, 1.5).groupBy("id", "kind").agg(*listed).collect()))


def test_rings_count_rows_and_kinds(spark):
    a, b = placed(spark, 60, 5), placed(spark, 90, 6)
    near = radius_join(a.drop("kind"), b, 3.0, right_columns={"kind": "kind"}, cells=True, rings=(1, 2, 3))
    got = ring_counts(near, (1, 2, 3), "kind").orderBy("id").collect()
    km = F.col("km")
    want = all_pairs(a, b, 3.0).groupBy("id").agg(*[c for r in (1, 2, 3) for c in (F.count_if(km <= r).alias(f"n{r}"), F.count_distinct(F.when(km <= r, F.col("kind"))).alias(f"kinds{r}"))])
    assert got == want.orderBy("id").collect()


def test_pairs_of_one_table_are_made_once(spark):
    a = placed(spark, 150, 7).dropDuplicates(["id"])
    got = radius_pairs(a, 1.5).select("a", "b").collect()
    assert len(got) == len(set(got))
    assert {(r.a, r.b) for r in got} == {(r.id, r.other) for r in all_pairs(a, a, 1.5).where("id < other").collect()}


@pytest.mark.parametrize("name", ["j15_services_by_need", "a30_proximity_cache"])
def test_pairs_are_listed_without_a_shuffle(spark, sf_dir, name):
    """Above the join of the pairs no exchange is left."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("SortMergeJoin [_cy")]


def test_cells_are_those_of_the_left_row(spark):
    a, b = placed(spark, 30, 8), placed(spark, 30, 9)
    assert radius_join(a, b, 1.0, right_columns={"id": "other"}, cells=True).groupBy("id", "lat", "lng").agg(F.count_distinct(*CELL).alias("n")).where("n > 1").isEmpty()


def test_outdated_listings_by_moved_services(spark, tmp_path):
    a, b = placed(spark, 40, 10).dropDuplicates(["id"]), placed(spark, 5, 11)
    listings, services = a.select("id", "lat", "lng"), b.withColumn("categoria", F.coalesce("kind", F.lit("z")))
    day = datetime.datetime(2025, 1, 1)
    proximity.create(listings, services, 1.0, str(tmp_path / "cache"), day, of=2)
    ids = proximity.outdated(spark, str(tmp_path / "cache"), listings, 1.0, moved=services.limit(2), changed=None, now=day, keep=None)
    want = all_pairs(a, services.limit(2).withColumn("kind", F.lit("x")), 1.0).select("id").distinct()
    assert sorted(ids.collect()) == sorted(want.collect())


@pytest.mark.parametrize(("enough", "few"), [(2, 0), (6, 0), (1000, 0), (6, 1e9)])
def test_counts_up_to_enough_are_those_of_all_pairs(spark, monkeypatch, enough, few):
    monkeypatch.setattr(spatial, "FEW_PAIRS", few)
    a, b = placed(spark, 60, 12), placed(spark, 400, 13)
    rings = (1, 2, 5)
    got = counts_up_to(a.drop("kind"), b, rings, "kind", enough).collect()
    at = ["id", "lat", "lng"]
    pairs = a.alias("x").join(b.alias("y"), F.lit(True)).select(*[F.col(f"x.{c}") for c in at], "y.kind", haversine_km(F.col("x.lat"), F.col("x.lng"), F.col("y.lat"), F.col("y.lng")).alias("km"))
    for r in rings:
        want = {(x.id, x.lat, x.lng, x.kind): min(enough, x["n"]) for x in pairs.where(F.col("km") <= r).groupBy(*at, "kind").agg(F.count("*").alias("n")).collect()}
        assert {(x.id, x.lat, x.lng, k.kind): k.n for x in got for k in x[f"near{r}"]} == want
    assert len(got) == a.count()


def test_counts_of_a_dense_place_need_no_pairs(spark, monkeypatch):
    """Three thousand rows on each side of one small cell: the cells settle every count, and no join by distance is made."""
    town = spark.range(3000).select("id", (F.lit(-17.8001) - F.col("id") * 1e-8).alias("lat"), F.lit(-63.2001).alias("lng"), (F.col("id") % 3).cast("string").alias("kind"))
    monkeypatch.setattr(spatial, "radius_join", None)
    monkeypatch.setattr(spatial, "FEW_PAIRS", 1e6)
    got = counts_up_to(town.drop("kind"), town, (1, 3), "kind", 10)
    assert got.where("size(near1) = 3 and size(near3) = 3 and forall(near1, k -> k.n = 10)").count() == 3000


@pytest.mark.parametrize(("km", "rows"), [(0.3, 8192), (2.0, 7), (25.0, 3)])
def test_ids_within_are_those_of_all_pairs(spark, monkeypatch, km, rows):
    """Small blocks, null kinds, ids of several rows; equal rows count as often as there are."""
    monkeypatch.setattr(spatial, "BLOCK_ROWS", rows)
    monkeypatch.setattr(spatial, "AT_ONCE", 50)
    a, b = placed(spark, 60, 14), placed(spark, 90, 15)
    a = a.unionByName(a.where("id = 3"))
    got = {(r.id, r.kind): (r.n, round(r.km, 9), r.ids) for r in ids_within(a.drop("kind"), b, km, "kind").collect()}
    pairs = all_pairs(a, b, km).groupBy("id", "kind").agg(F.count("*").alias("n"), F.avg("km").alias("m"), F.array_sort(F.collect_list("other")).alias("ids"))
    assert got == {(r.id, r.kind): (r.n, round(r.m, 9), r.ids) for r in pairs.collect()} != {}


def test_no_pair_of_a_list_is_a_row(spark):
    """1,000 rows on each side of one place: above the join, which gives two rows, lists come from blocks."""
    town = spark.range(1000).select("id", (F.lit(-17.8001) - F.col("id") * 1e-8).alias("lat"), F.lit(-63.2001).alias("lng"), F.lit("x").alias("kind"))
    found = ids_within(town.drop("kind"), town, 1.0, "kind")
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("SortMergeJoin")]
    assert "MapInArrow" in above and "Exchange" not in above and "Aggregate" not in above
    assert found.agg(F.count("*"), F.sum("n"), F.sum(F.size("ids"))).collect() == [(1000, 1_000_000, 1_000_000)]
