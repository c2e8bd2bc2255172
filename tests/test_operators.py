"""Invariants and small cases of the operators."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from predio.functions.geo import haversine_km
from predio.operators import buckets, duplicates, filters, graph, incremental, knn, leads, proximity, recommend, router
from predio.operators.graph import groups
from predio.operators.quantiles import exact_quantiles
from predio.operators.knn import nearest
from predio.operators.spatial import radius_join, within
from predio.operators.upsert import insert_ignore, upsert
from predio.sources import io
from predio.sources.views import metricas, propiedades
from predio.streaming import monitor


def points(spark, n, seed):
    rng = random.Random(seed)
    rows = [(i, -17.8 + rng.uniform(-0.2, 0.2), -63.2 + rng.uniform(-0.2, 0.2)) for i in range(n)] + [(n, None, None)]
    return spark.createDataFrame(rows, "id long, lat double, lng double")


@pytest.mark.parametrize("km", [0.4, 3.0, 25.0])
def test_grid_join_equals_all_pairs(spark, km):
    a, b = points(spark, 120, 1), points(spark, 90, 2)
    got = {(r.id, r.other) for r in radius_join(a, b, km, right_columns={"id": "other"}).collect()}
    x, y = a.alias("x"), b.alias("y")
    near = haversine_km(F.col("x.lat"), F.col("x.lng"), F.col("y.lat"), F.col("y.lng")) <= km
    assert got == {(r[0], r[1]) for r in x.join(y, near).select("x.id", "y.id").collect()}


def by_sorting(left, right, k):
    """{(id, rank): other} by sorting all of ``right`` for every row of ``left``."""
    lat, lng = (np.radians([r[c] for r in right]) for c in ("lat", "lng"))
    ids, out = np.array([r.id for r in right]), {}
    for p in left:
        y, x = np.radians(p.lat), np.radians(p.lng)
        h = np.sin((lat - y) / 2) ** 2 + np.cos(y) * np.cos(lat) * np.sin((lng - x) / 2) ** 2
        km = np.round(2 * 6371 * np.arcsin(np.sqrt(np.minimum(h, 1))), 9)
        out.update({(p.id, i + 1): int(ids[j]) for i, j in enumerate(np.lexsort((ids, km))[:k])})
    return out


def served(left, right, k, **more):
    return {(r.id, r["rank"]): r.other for r in nearest(left, right, k, right_columns={"id": "other"}, tie="other", **more).collect()}


def test_nearest_equals_sorted_pairs(spark):
    a, b = points(spark, 40, 3), points(spark, 30, 4)
    x, y = a.where("lat is not null").collect(), b.where("lat is not null").collect()
    assert served(a, b, 4) == by_sorting(x, y, 4)
    assert served(a, b, 50) == by_sorting(x, y, 50)  # all there are
    assert served(a, b.where("false"), 4) == served(a.where("false"), b, 4) == {}
    wide = nearest(a.withColumn("name", F.lit("x")), b, 1, right_columns={"id": "other"}, tie="other")
    assert wide.columns == ["id", "lat", "lng", "name", "other", "km", "rank"] and wide.count() == 40


def test_nearest_of_a_town_and_of_lone_points_on_the_whole_globe(spark):
    rng = random.Random(11)
    town = [(-17.78 + rng.gauss(0, 0.01), -63.18 + rng.gauss(0, 0.01)) for _ in range(2500)]
    copies = [(-17.78, -63.18)] * 400  # one spot
    lone = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(0.0, 179.998), (0.0, -179.999), (90.0, 0.0), (-90.0, 12.0), (89.99, 170.0)]
    right = spark.createDataFrame([(i, *p) for i, p in enumerate(town + copies + lone)], "id long, lat double, lng double")
    asked = town[:60] + [(-17.78, -63.18), (-17.0, -63.18), (0.0, 180.0), (0.0, -180.0), (90.0, 50.0), (-89.9, -100.0)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(asked)], "id long, lat double, lng double")
    for leaf in (16, 64):
        assert served(left, right, 5, leaf=leaf) == by_sorting(left.collect(), right.collect(), 5)


def test_nearest_writes_a_row_of_left_once(spark, monkeypatch):
    rows = []

    def counted(df, name):
        out = graph.written(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(knn, "written", counted)
    monkeypatch.setattr(knn, "TASK_ROWS", 500)  # crowded boxes hand their lists to several tasks
    a, b = points(spark, 6000, 13), points(spark, 600, 14)
    x, y = a.where("lat is not null").collect(), b.where("lat is not null").collect()
    assert served(a, b, 3) == by_sorting(x, y, 3)
    assert sum(n for _, n in rows) < 2 * 6000, rows


def test_within_box_loses_nothing(spark):
    p = points(spark, 200, 5)
    every = p.where(haversine_km(F.lit(-17.8), F.lit(-63.2), F.col("lat"), F.col("lng")) <= 8).count()
    assert within(p, -17.8, -63.2, 8).count() == every > 0


def test_soft_filter_never_empties(spark):
    df = spark.range(20)
    steps = [F.col("id") < 15, F.col("id") > 100, F.col("id") % 3 == 0, F.col("id") == 1, F.lit(None).cast("boolean")]
    assert [r.id for r in filters.soft_filter(df, steps).orderBy("id").collect()] == [0, 3, 6, 9, 12]
    assert filters.soft_filter(df.where("id < 0"), steps).count() == 0


def test_zone_match_counts_missing_as_empty(spark):
    df = spark.createDataFrame([("Equipetrol Norte",), ("equi",), (None,), ("Urbari",)], "zona string")
    assert [r.zona for r in df.where(filters.zone_match(F.col("zona"), "Equipetrol")).collect()] == ["Equipetrol Norte", "equi", None]


def test_upsert_is_idempotent_and_keeps_nulls(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, o int, v string")
    s = spark.createDataFrame([("b", 3, None), ("b", 4, None), ("c", 5, "z"), (None, 6, "n"), (None, 7, "n")], "k string, o int, v string")
    once = upsert(t, s, ["k"], "o", preserve=("v",))
    rows = sorted(map(tuple, once.collect()), key=str)
    assert rows == sorted([("a", 1, "x"), ("b", 4, "y"), ("c", 5, "z"), (None, 6, "n"), (None, 7, "n")], key=str)
    keyed = s.where("k is not null")
    assert sorted(map(tuple, upsert(upsert(t, keyed, ["k"], "o"), keyed, ["k"], "o").collect()), key=str) == sorted(map(tuple, upsert(t, keyed, ["k"], "o").collect()), key=str)
    assert insert_ignore(t, keyed, ["k"], "o").count() == 3


def test_bucketed_merge_rewrites_only_what_it_touches(spark, tmp_path):
    folder, names = f"file://{tmp_path}/t", "k string, o int, v string"
    target = spark.createDataFrame([(f"k{i}", i, "x") for i in range(200)] + [(None, 1, "n")], names)
    source = spark.createDataFrame([("k7", 300, None), ("k7", 301, None), ("new", 302, "z"), (None, 303, "m")], names)
    buckets.create(target, folder, ["k"], buckets=16)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    before = buckets.manifest(spark, folder)["buckets"]
    assert rows(buckets.read(spark, folder)) == rows(target)
    assert buckets.merge(spark, folder, source, "o", preserve=("v",)) == 1
    want = rows(upsert(target, source, ["k"], "o", preserve=("v",)))
    after = buckets.manifest(spark, folder)["buckets"]
    assert rows(buckets.read(spark, folder)) == want and ("k7", 301, "x") in want
    assert 1 <= sum(after[b] != before.get(b) for b in after) <= 3  # the buckets of k7, new and the row without a key
    keyed = source.where("k is not null")
    assert buckets.merge(spark, folder, keyed, "o", preserve=("v",)) == 2 and rows(buckets.read(spark, folder)) == want
    assert rows(buckets.read(spark, folder, 0)) == rows(target)  # versions stay readable
    assert buckets.merge(spark, folder, source.where("false"), "o") == 2
    with pytest.raises(RuntimeError):
        buckets._publish(spark, folder, 2, {})
    buckets.expire(spark, folder, keep=1)
    assert buckets.versions(spark, folder) == [2] and rows(buckets.read(spark, folder)) == want
    empty = f"file://{tmp_path}/e"
    buckets.create(target.where("false"), empty, ["k"], buckets=4)
    assert buckets.read(spark, empty).count() == 0
    buckets.merge(spark, empty, keyed, "o")
    assert rows(buckets.read(spark, empty)) == [("k7", 301, None), ("new", 302, "z")]


def test_proximity_cache_recomputes_only_what_is_outdated(spark, tmp_path):
    import datetime

    folder, day = f"file://{tmp_path}/c", datetime.datetime(2025, 1, 1)
    listings, services = points(spark, 120, 6), points(spark, 60, 7).withColumn("categoria", F.when(F.col("id") % 2 == 0, "salud").otherwise("comercio"))
    rows = lambda df: sorted((r.id, r.categoria, r.cantidad, round(r.metros, 6), tuple(r.servicios)) for r in df.collect())
    whole = lambda p, s: rows(proximity.near(p, s, 3.0, day).select("id", F.inline("cerca")))
    proximity.create(listings, services, 3.0, folder, day, of=8)
    assert rows(proximity.read(spark, folder)) == whole(listings, services) != []
    # a service moves, one closes, one opens
    spots = "id long, lat double, lng double, categoria string"
    opened = spark.createDataFrame([(900, -17.81, -63.21, "salud")], spots)
    later = services.where("id <> 4").withColumn("lat", F.when(F.col("id") == 9, F.col("lat") + 0.05).otherwise(F.col("lat"))).unionByName(opened)
    moved = services.where("id in (4, 9)").unionByName(later.where("id in (9, 900)"))
    n = proximity.refresh(spark, folder, listings, later, 3.0, day + datetime.timedelta(hours=1), moved=moved)
    assert rows(proximity.read(spark, folder)) == whole(listings, later) and 0 < n < 60
    # listings come, go and move
    after = listings.where("id <> 5").withColumn("lng", F.when(F.col("id") == 8, F.col("lng") + 0.1).otherwise(F.col("lng"))).unionByName(spark.createDataFrame([(500, -17.8, -63.2)], "id long, lat double, lng double"))
    n = proximity.refresh(spark, folder, after, later, 3.0, day + datetime.timedelta(hours=2), changed=spark.createDataFrame([(5,), (8,)], "id long"))
    assert rows(proximity.read(spark, folder)) == whole(after, later) and n == 3  # the new one is not cached yet
    # nothing changed: nothing is computed; what was never touched ages first
    soon = day + datetime.timedelta(hours=3)
    assert proximity.refresh(spark, folder, after, later, 3.0, soon) == 0
    aged = proximity.refresh(spark, folder, after, later, 3.0, soon, keep=datetime.timedelta(hours=2, minutes=30))
    assert 0 < aged < after.count() and rows(proximity.read(spark, folder)) == whole(after, later)


def test_a_bucketed_table_is_written_once(spark, tmp_path, monkeypatch):
    """A new table is not written to the scratch folder before; sorted ids are stored by their differences."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(buckets, "written", None)
    lists = spark.range(4).select("id", F.sequence(F.col("id"), F.lit(2_000_000), F.lit(3)).alias("ids"))
    buckets.create(lists, f"file://{tmp_path}/b", ["id"], 1)
    column = pq.ParquetFile(glob.glob(f"{tmp_path}/b/data/*/*/*.parquet")[0]).metadata.row_group(0).column(1)
    assert "DELTA_BINARY_PACKED" in column.encodings and column.total_compressed_size < column.num_values
    assert buckets.read(spark, f"file://{tmp_path}/b").orderBy("id").collect() == lists.orderBy("id").collect()


def test_groups_of_a_long_chain(spark):
    pairs = spark.range(1, 60).select((F.col("id") - 1).alias("a"), F.col("id").alias("b")).unionByName(spark.createDataFrame([(100, 101)], "a long, b long"))
    got = {r.id: r.grupo for r in groups(pairs).collect()}
    assert got == {**{i: 0 for i in range(60)}, 100: 100, 101: 100}


def test_greedy_equals_a_plain_loop(spark):
    rng = random.Random(7)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(80)})
    matched, want = set(), []
    for a, b in pairs:
        if a not in matched and b not in matched:
            want.append((a, b))
            matched.add(b)
    got = sorted(map(tuple, duplicates.greedy(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == want


def test_text_ratio(spark):
    df = spark.createDataFrame([("casa bonita", "casa bonita"), ("casa", "cara"), ("", "x")], "a string, b string")
    assert [round(r[0], 2) for r in df.select(duplicates.text_ratio("a", "b")).collect()] == [1.0, 0.75, 0.0]


def test_scores_lie_in_range(spark, sf_dir):
    from predio.plans.scoring import PROFILE, listings
    from predio.sources.views import servicios

    r = recommend.scored(listings(spark, sf_dir), servicios(spark, sf_dir), PROFILE).agg(F.min("compatibilidad"), F.max("compatibilidad")).first()
    assert 0 <= r[0] <= r[1] <= 100


def test_a_complete_lead(spark):
    lead = spark.createDataFrame([(2, 2, 0, 0, 180_000.0, 240_000.0, True, 0, 3, 2, "casa", 2, 6000, 150, "alto", "alta")], "adultos int, ninos int, adolescentes int, mayores int, presupuesto_min double, presupuesto_max double, financiamiento boolean, cuota int, dormitorios int, banos int, tipo string, n_zonas int, disponibles int, superficie int, conocimiento string, urgencia string")
    r = leads.score(lead).first()
    assert r.perfil == "familia_pequena" and r.p_presupuesto == 20 and r.p_potencial == 12 and r.clasificacion == "tibio" and r.potencial_propiedades == 9000


def test_router(spark):
    rows = spark.createDataFrame([(1, "Equipetrol", "Casa", 100.0), (2, "Equipetrol Norte", "Casa", 300.0), (3, "Centro", "Lote", 50.0)], "id long, zona string, tipo string, precio_usd double")
    assert router.answer(rows, "precio promedio en Equipetrol").first().respuesta == "El precio promedio en Equipetrol es de $200 USD."
    assert router.answer(rows, "¿Cuántas propiedades hay en el centro?").first().n == 1
    assert router.answer(rows, "los más caros de equipetrol").first().respuesta.startswith("$300")
    assert router.answer(rows, "hola").first().tipo == "ayuda"


def test_guard(spark):
    df = spark.createDataFrame([("hablemos de política",), ("la zona norte",), ("un subsector raro",), ("precios",)], "t string")
    assert [r[0] for r in df.select(router.guard(F.col("t"))).collect()] == ["tema", "ok", "zona", "ok"]


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"propiedades": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": 3}]))
    assert sorted(r.id for r in io.read_json_list(spark, str(tmp_path), "struct<id:bigint>").collect()) == [1, 2, 3]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("OK", 1, "it's"), ("ERROR", 2, None)], "status string, id long, titulo string")
    io.write_intermediate(df, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i/errores")).count() == 1 and spark.read.json(str(tmp_path / "i/resumen")).count() == 2
    io.write_sample(df, str(tmp_path / "s"), ["id", "nope"], "id")
    assert spark.read.csv(str(tmp_path / "s"), header=True).columns == ["id"]
    io.export(df.select("id", F.struct("titulo", F.struct("status").alias("q")).alias("p")), str(tmp_path / "e"), "csv")
    assert spark.read.csv(str(tmp_path / "e"), header=True).columns == ["id", "p_titulo", "p_q_status"]
    assert io.insert_statements(df, "t", ["id", "titulo"]).orderBy("sentencia").first()[0] == "INSERT INTO t (id, titulo) VALUES (1, 'it''s') ON CONFLICT DO NOTHING;"
    io.append_log(spark, str(tmp_path / "l"), "etl", 2, 1, "2025-01-01")
    io.append_log(spark, str(tmp_path / "l"), "etl", 3, 0, "2025-01-02")
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    io.backup(df, str(tmp_path / "b"))
    with pytest.raises(Exception, match="already exists"):
        io.backup(df, str(tmp_path / "b"))
    assert io.read_files(spark, str(tmp_path / "b")).select("archivo").distinct().count() >= 1


def test_tab_output_folds_lines_into_the_last_field(spark, tmp_path):
    (tmp_path / "out.txt").write_text("1\tana\tuna línea\n2\tluis\tdos líneas\nla segunda\n\n3\tmar\tfin\n")
    rows = sorted(map(tuple, io.read_tab_output(spark, str(tmp_path / "out.txt"), ["id", "nombre", "nota"]).collect()))
    assert rows == [("1", "ana", "una línea"), ("2", "luis", "dos líneas\nla segunda"), ("3", "mar", "fin")]
    (tmp_path / "none.txt").write_text("")
    assert io.read_tab_output(spark, str(tmp_path / "none.txt"), ["id"]).count() == 0


def test_delimited_files_and_catalog(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"dos\nlíneas"\n2,x\n')
    assert sorted(r.id for r in io.read_delimited(spark, str(tmp_path / "a.csv"), "id int, t string").collect()) == [1, 2]
    spark.range(3).createOrReplaceTempView("vista_catalogo")
    assert io.missing_tables(spark, ["vista_catalogo", "otra"]) == ["otra"]
    rows = [tuple(r) for r in io.catalog_report(spark, ["vista_catalogo", "otra"], ["upper", "no_hay"]).collect()]
    assert rows == [("tabla", "vista_catalogo", True, 3), ("tabla", "otra", False, None), ("funcion", "upper", True, None), ("funcion", "no_hay", False, None)]


def test_family_fit_by_hand(spark):
    rows = spark.createDataFrame([(2, 1, 50.0, 1, True, 2), (0, 2, 0.0, 0, False, 9), (3, 2, 100.0, 0, True, 3)], "dormitorios int, banos int, superficie double, garajes int, condominio boolean, n_amenidades int")
    got = [round(r[0], 4) for r in rows.select(recommend.family_fit(2, 2)).collect()]
    assert got == pytest.approx([0.4 + 0.1875 + 0.1 + 0.1 + 0.03, 0.25, 0.4 + 0.25 + 0.2 + 0.05])
    assert rows.select(recommend.family_fit(0, 0)).first()[0] == 0.0


def test_columns(spark):
    df = spark.createDataFrame([(None, 1.0, -17.0, 3, 2)], "`Precio USD` double, Price double, Latitude double, Dormitorios int, Bathrooms int")
    assert io.standardise(df).columns == ["precio", "latitud", "habitaciones", "banos"] and io.standardise(df).first().precio == 1.0
    assert io.find_column(["Título", "Latitud GPS", "x"], "latitud") == ("Latitud GPS", 85) and io.find_column(["Longitude"], "longitud")[1] >= 70 and io.find_column(["abc"], "zona") is None


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = str(tmp_path / "in")
    events.orderBy("ts").coalesce(1).write.parquet(folder)
    stream = monitor.read_metrics(spark, folder)
    batch = metricas(spark, sf_dir)
    for name, df, want in (("totals", monitor.provider_totals(stream), monitor.provider_totals(batch)), ("alerts", monitor.streamed_alerts(stream), monitor.alerts(batch)), ("hours", monitor.hourly(stream), monitor.hourly(batch))):
        mode = {"totals": "complete", "alerts": "append", "hours": "update"}[name]
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(str, map(tuple, spark.table(name).collect()))) == sorted(map(str, map(tuple, want.collect())))


@pytest.mark.parametrize("few", [0, 7, 10_000])
def test_exact_quantiles(spark, few):
    rng = random.Random(few)
    cases = [[5.0], [1.0, 2.0], [rng.random() * 10 ** rng.randrange(-3, 9) for _ in range(997)], [7.0] * 300 + [1.0, 9.0] * 40, [-1e308, 1e308, 0.0, 3.0] * 5, [float(i) for i in range(100)]]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
        shares = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
        assert exact_quantiles(df, "v", shares, few) == pytest.approx(list(np.quantile(np.array(values, dtype=np.longdouble), shares).astype(float)), rel=1e-12)
    assert exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) is None


def fed(spark, tmp_path, name, schema, batches, make, mode):
    """What a streamed operator gives for each file in turn, and the rows of its state at the end."""
    folder, table = tmp_path / "in", f"t_{name}"
    folder.mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        q = make(source).writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        out = []
        q = q.foreachBatch(lambda df, i, out=out: out.extend(df.collect())).start()
        q.awaitTermination(120)
        left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        yield out, left[-1] if left else 0


def test_durations_over_a_stream(spark, tmp_path):
    import datetime

    at = lambda m: datetime.datetime(2025, 1, 1, 8) + datetime.timedelta(minutes=m)
    batches = [
        [("a", "inicio", at(0)), ("b", "fin", at(3)), ("c", "inicio", at(1)), (None, "fin", at(1)), ("x", "otro", at(1)), ("e", "fin", at(2))],
        [("a", "fin", at(5)), ("a", "fin", at(6)), ("b", "inicio", at(2))],  # repeated finish; finish before start
        [("a", "inicio", at(0)), ("d", "inicio", at(200))],  # repeated start; time goes on
        [("d", "fin", at(201))], [("f", "inicio", at(600))], [("g", "inicio", at(601))],
    ]
    got, states = [], []
    for rows, state in fed(spark, tmp_path, "durations", "operacion string, tipo string, ts timestamp", batches, monitor.streamed_durations, "append"):
        got.append(sorted((r.operacion, r.segundos, r.estado) for r in rows))
        states.append(state)
    assert got[0] == [] and got[1] == [("a", 300.0, "completa"), ("b", 60.0, "completa")]
    told = [r for rows in got for r in rows]
    assert sorted(told, key=str) == sorted([("a", 300.0, "completa"), ("b", 60.0, "completa"), ("c", None, "sin fin"), ("d", 60.0, "completa"), ("e", None, "sin inicio")], key=str)
    assert max(states) == 4 and states[-1] <= 2


def test_alert_log_over_a_stream(spark, tmp_path):
    import datetime

    rng = random.Random(5)
    at = lambda h: datetime.datetime(2025, 1, 1) + datetime.timedelta(hours=h)
    schema = "event_id long, ts timestamp, proveedor long, estado string, duracion double, tokens long"
    hours = [0, 5, 10, 20, 30, 31, 60]
    batches = [[(100 * i + j, at(h + rng.random() * 2), j % 2, rng.choice(["exito"] * 9 + ["error"]), rng.choice([5.0, 31.0]), 1) for j in range(30)] for i, h in enumerate(hours)]
    seen, last = [], {}
    for i, (rows, _) in enumerate(fed(spark, tmp_path, "log", schema, batches, lambda s: monitor.streamed_alert_log(s, most=40), "update")):
        seen += batches[i]
        last |= {r.proveedor: r.ultimas for r in rows}
        for provider in (0, 1):
            n = good = 0
            log = []
            for event, ts, p, state, seconds, _ in sorted(seen, key=lambda r: (r[0] // 100, r[1], r[0])):
                if p == provider:
                    n, good = n + 1, good + (state == "exito")
                    log += [(ts, event, "tasa")] * (n >= 10 and 100 * good < 90 * n) + [(ts, event, "duracion")] * (seconds > 30)
            latest = max(r[1] for r in seen if r[2] == provider)
            want = [f"{e}:{k}" for t, e, k in sorted(log, key=lambda r: r[:2]) if t > latest - datetime.timedelta(hours=24)][-40:]
            assert sorted(last[provider]) == sorted(want)


def test_zone_coverage_refreshed_from_changes(spark, sf_dir, tmp_path):
    """Inserts, updates, deletes and retries of nothing: the same as recomputing; untouched buckets keep their files."""
    folder = str(tmp_path / "zones")
    rows = [tuple(r) for r in propiedades(spark, sf_dir).select("id", "zona", "tipo", "lat", "precio_usd").collect()] + [(-1, None, None, None, None), (-2, "alone", "x", 1.0, 0.0)]
    schema = "id long, zona string, tipo string, lat double, precio_usd double"
    frame = lambda data: spark.createDataFrame(data, schema)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "zones").rglob("part-*")}
    incremental.create(incremental.counted(frame(rows)), folder)
    now = {r[0]: r for r in rows}
    zones = sorted({r[1] for r in rows if r[1]})
    rng = random.Random(3)
    for touched in ([zones[0]], [zones[1], zones[2], "brand new"], ["alone"], []):
        old = [r for r in now.values() if r[1] in touched]
        gone = old if touched == ["alone"] else rng.sample(old, len(old) // 2)
        fresh = [(r[0], rng.choice(touched), "nuevo", rng.choice([None, 2.0]), rng.choice([None, -5.0, 0.0, 123.45])) for r in gone[::2]] if touched != ["alone"] else []
        fresh += [(10**9 + len(now) + i, z, "otro", 1.0, 10.05) for i, z in enumerate(touched) if z != "alone"]
        for r in gone:
            del now[r[0]]
        now |= {r[0]: r for r in fresh}
        before = files()
        incremental.refresh(spark, folder, incremental.changes(frame(gone), frame(fresh)))
        after = files()
        cut = [f for f in before if after.get(f) != before[f]]
        assert len(cut) <= len(touched) and (touched or before == after)
        got = {tuple(r) for r in incremental.coverage(incremental.read(spark, folder)).collect()}
        want = frame(list(now.values())).groupBy("zona").agg(F.count("*"), F.count("lat"), F.count_distinct("tipo"), F.round(F.avg(F.when(F.col("precio_usd") > 0, F.round("precio_usd", 2))), 0))
        assert got == {tuple(r) for r in want.collect()}
    assert "alone" not in {r[0] for r in got} and "brand new" in {r[0] for r in got}
