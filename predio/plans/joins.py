"""Radius, semi, anti, dimension and self joins."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from predio.functions.geo import haversine_km, rounded
from predio.operators import proximity as cache
from predio.operators.graph import scratch_folder
from predio.operators.knn import nearest
from predio.operators.spatial import CELL, ids_within, kinds_within, lists_within, radius_join, radius_pairs, within
from predio.plans.registry import haversine, query
from predio.sources.views import agentes, propiedades, servicios, table

SERVICE = {"id": "servicio_id", "categoria": "categoria"}
PAIRS = f"pares AS (SELECT p.id, p.zona, p.precio_usd, s.id AS servicio_id, s.categoria, {haversine('p', 's')} AS km FROM propiedades p, servicios s WHERE abs(p.lat - s.lat) < 0.02 AND {haversine('p', 's')} <= 1.0)"


def pairs(spark, sf, km=1.0):
    return radius_join(propiedades(spark, sf), servicios(spark, sf), km, right_columns=SERVICE, cells=True)


@query("j01_radius_join", f"{PAIRS} SELECT id, servicio_id, categoria, round(km, 6) AS km FROM pares WHERE km <= 0.5")
def radius(spark, sf):
    return pairs(spark, sf, 0.5).select("id", "servicio_id", "categoria", rounded(F.col("km"), 6).alias("km"))


@query("j02_radius_left_join", f"{PAIRS}, n AS (SELECT id, count(*) AS c FROM pares GROUP BY id) SELECT p.zona, count(*) AS propiedades, CAST(sum(coalesce(n.c, 0)) AS BIGINT) AS servicios FROM propiedades p LEFT JOIN n ON p.id = n.id GROUP BY p.zona")
def radius_left(spark, sf):
    counts = pairs(spark, sf).groupBy(*CELL, "id").agg(F.count("*").alias("c")).groupBy("id").agg(F.sum("c").alias("c"))
    return propiedades(spark, sf).join(counts, "id", "left").groupBy("zona").agg(F.count("*").alias("propiedades"), F.sum(F.coalesce("c", F.lit(0))).alias("servicios"))


@query("j03_exists_within", f"{PAIRS} SELECT id, zona FROM propiedades p WHERE EXISTS (SELECT 1 FROM pares x WHERE x.id = p.id AND categoria = 'educacion') AND EXISTS (SELECT 1 FROM pares x WHERE x.id = p.id AND categoria = 'salud')")
def exists(spark, sf):
    wanted = servicios(spark, sf).where("categoria in ('educacion', 'salud')")
    near = kinds_within(propiedades(spark, sf), wanted, 1.0, "categoria", key=["id"]).groupBy("id").agg(F.count("categoria").alias("n")).where("n = 2")
    return propiedades(spark, sf).join(near, "id", "left_semi").select("id", "zona")


@query("j04_orphans", "SELECT a.id FROM agentes a LEFT JOIN (SELECT * FROM propiedades WHERE precio_usd > 450000) p ON p.agente_id = a.id WHERE p.id IS NULL")
def orphans(spark, sf):
    return agentes(spark, sf).select("id").join(propiedades(spark, sf).where("precio_usd > 450000").select(F.col("agente_id").alias("id")), "id", "left_anti")


@query("j05_agent_left_join", "SELECT p.id, a.nombre AS agente, a.telefono FROM propiedades p LEFT JOIN agentes a ON p.agente_id = a.id AND a.saldo > 1000")
def agent_left(spark, sf):
    rich = agentes(spark, sf).where("saldo > 1000").select(F.col("id").alias("agente_id"), F.col("nombre").alias("agente"), "telefono")
    return propiedades(spark, sf).join(rich, "agente_id", "left").select("id", "agente", "telefono")


@query("j06_agent_inner_join", "SELECT a.empresa, count(*) AS n, round(avg(p.precio_usd), 2) AS promedio FROM propiedades p JOIN agentes a ON p.agente_id = a.id GROUP BY a.empresa")
def agent_inner(spark, sf):
    a = agentes(spark, sf).select(F.col("id").alias("agente_id"), "empresa")
    return propiedades(spark, sf).join(a, "agente_id").groupBy("empresa").agg(F.count("*").alias("n"), F.round(F.avg("precio_usd"), 2).alias("promedio"))


@query("j07_agents_with_listings", "SELECT a.id, count(p.id) AS n, round(coalesce(sum(p.precio_usd), 0), 2) AS total FROM agentes a LEFT JOIN propiedades p ON p.agente_id = a.id GROUP BY a.id HAVING count(p.id) < 12")
def agent_group(spark, sf):
    p = propiedades(spark, sf).select(F.col("agente_id"), F.col("id").alias("pid"), "precio_usd")
    return agentes(spark, sf).join(p, F.col("id") == F.col("agente_id"), "left").groupBy("id").agg(F.count("pid").alias("n"), F.round(F.coalesce(F.sum("precio_usd"), F.lit(0.0)), 2).alias("total")).where("n < 12")


@query("j08_near_pairs", f"SELECT p.id AS a, q.id AS b, round({haversine('p', 'q')}, 6) AS km FROM propiedades p JOIN propiedades q ON p.id < q.id AND abs(p.lat - q.lat) < 0.012 AND abs(p.lng - q.lng) < 0.012 WHERE {haversine('p', 'q')} <= 1.0")
def near_pairs(spark, sf):
    return radius_pairs(propiedades(spark, sf), 1.0).select("a", "b", rounded(F.col("km"), 6).alias("km"))


@query("j09_nearest_services", f"d AS (SELECT p.id, s.id AS servicio_id, {haversine('p', 's')} AS km FROM propiedades p, servicios s WHERE p.lat IS NOT NULL AND s.lat IS NOT NULL AND p.id % 50 = 1 AND s.categoria = 'salud'), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, servicio_id) AS rn FROM d) SELECT id, servicio_id, CAST(rn AS INTEGER) AS puesto, round(km, 6) AS km FROM r WHERE rn <= 3".replace(" AND p.id % 50 = 1", ""))
def knn(spark, sf):
    health = servicios(spark, sf).where("categoria = 'salud'")
    found = nearest(propiedades(spark, sf).select("id", "lat", "lng"), health, 3, right_columns={"id": "servicio_id"}, tie="servicio_id")
    return found.select("id", "servicio_id", F.col("rank").alias("puesto"), F.round("km", 6).alias("km"))


@query("j10_point_radius", f"c AS (SELECT -17.7833::DOUBLE AS lat, -63.1833::DOUBLE AS lng) SELECT p.id, p.precio_usd, round({haversine('c', 'p')}, 6) AS km FROM propiedades p, c WHERE {haversine('c', 'p')} <= 3.0")
def point_radius(spark, sf):
    return within(propiedades(spark, sf), -17.7833, -63.1833, 3.0).select("id", "precio_usd", F.round("km", 6).alias("km"))


COUNTED = ("educacion", "salud", "comercio", "transporte")
COUNTS = ", ".join(f"count(*) FILTER (WHERE categoria = '{c}' AND km <= {r}) AS {c}" for c, r in (("educacion", 0.5), ("salud", 1.0), ("comercio", 0.5), ("transporte", 0.3)))


@query("j11_lateral_counts", f"{PAIRS}, n AS (SELECT id, {COUNTS} FROM pares GROUP BY id) SELECT p.id, coalesce(educacion, 0) AS educacion, coalesce(salud, 0) AS salud, coalesce(comercio, 0) AS comercio, coalesce(transporte, 0) AS transporte FROM propiedades p LEFT JOIN n USING (id)")
def lateral(spark, sf):
    radii = {0.3: ["transporte"], 0.5: ["educacion", "comercio"], 1.0: ["salud"]}
    p, near = propiedades(spark, sf).select("id", "lat", "lng"), None
    for km, kinds in radii.items():  # every category by its own radius, so that no pair is made to be dropped
        found = radius_join(p, servicios(spark, sf).where(F.col("categoria").isin(kinds)), km, right_columns={"categoria": "categoria"}, cells=True)
        found = found.groupBy(*CELL, "id").agg(*[F.count_if(F.col("categoria") == c).alias(c) for c in COUNTED]).drop(*CELL)
        near = found if near is None else near.unionByName(found)
    n = near.groupBy("id").agg(*[F.sum(c).alias(c) for c in COUNTED])
    return p.select("id").join(n, "id", "left").na.fill(0)


@query("j12_scalar_subquery", "SELECT zona, count(*) AS n, (SELECT count(*) FROM nation x JOIN customer ON c_nationkey = n_nationkey WHERE x.n_name = p.zona) AS agentes_zona FROM propiedades p GROUP BY zona")
def scalar(spark, sf):
    per_zone = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("zona")).agg(F.count("*").alias("agentes_zona"))
    return propiedades(spark, sf).groupBy("zona").agg(F.count("*").alias("n")).join(per_zone, "zona", "left").select("zona", "n", F.coalesce("agentes_zona", F.lit(0)).alias("agentes_zona"))


@query("j13_params", "params AS (SELECT avg(precio_usd) AS media, max(superficie) AS mayor FROM propiedades) SELECT count(*) AS n FROM propiedades, params WHERE precio_usd > media AND superficie > mayor / 2")
def params(spark, sf):
    p = propiedades(spark, sf)
    one = p.agg(F.avg("precio_usd").alias("media"), F.max("superficie").alias("mayor"))
    return p.join(F.broadcast(one), F.lit(True)).where("precio_usd > media and superficie > mayor / 2").agg(F.count("*").alias("n"))  # one row is broadcast


@query("j14_agent_by_name", "nombres AS (SELECT id, upper(substr(trim(lower(nombre)), 1, 1)) || substr(trim(lower(nombre)), 2) AS clave FROM agentes) SELECT p.id, n.id AS agente FROM (SELECT id, 'Customer#' || lpad(CAST(id % 2000 AS VARCHAR), 9, '0') AS clave FROM propiedades) p LEFT JOIN nombres n USING (clave)")
def agent_by_name(spark, sf):
    named = agentes(spark, sf).select(F.col("id").alias("agente"), F.initcap(F.trim("nombre")).alias("clave"))
    asked = propiedades(spark, sf).select("id", F.initcap(F.concat(F.lit(" customer#"), F.lpad((F.col("id") % 2000).cast("string"), 9, "0"), F.lit(" "))).alias("clave"))
    return asked.withColumn("clave", F.trim("clave")).join(named, "clave", "left").select("id", "agente")


@query("j15_services_by_need", f"{PAIRS} SELECT id, string_agg(CAST(servicio_id AS VARCHAR) || ':' || CAST(CAST(round(km * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY km, servicio_id) AS cercanos FROM pares WHERE categoria IN ('educacion', 'transporte') GROUP BY id")
def by_need(spark, sf):
    p, wanted = propiedades(spark, sf).select("id", "lat", "lng"), servicios(spark, sf).where(F.col("categoria").isin("educacion", "transporte"))
    lists = lists_within(p, wanted, 1.0, ["id"], [F.collect_list(F.struct("km", "servicio_id")).alias("pares")], right_columns={"id": "servicio_id"})
    ordered = F.array_sort("pares")
    return lists.select("id", F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["servicio_id"].cast("string"), F.round(s["km"] * 100).cast("long").cast("string"))), ",").alias("cercanos"))


@query("p01_nearby_function", f"c AS (SELECT -17.80::DOUBLE AS lat, -63.18::DOUBLE AS lng) SELECT s.id, s.categoria, round({haversine('c', 's')} * 1000, 2) AS metros FROM servicios s, c WHERE s.categoria = 'comercio' AND {haversine('c', 's')} <= 5.0")
def nearby(spark, sf):
    return within(servicios(spark, sf).where("categoria = 'comercio'"), -17.80, -63.18, 5.0).select("id", "categoria", F.round(F.col("km") * 1000, 2).alias("metros"))


@query("x01_haversine", f"c AS (SELECT -17.7833::DOUBLE AS lat, -63.1821::DOUBLE AS lng) SELECT p.id, round({haversine('c', 'p')}, 6) AS km FROM propiedades p, c")
def distance(spark, sf):
    return propiedades(spark, sf).select("id", F.round(haversine_km(F.lit(-17.7833), F.lit(-63.1821), F.col("lat"), F.col("lng")), 6).alias("km"))


CACHE = f"{PAIRS} SELECT id, categoria, count(*) AS cantidad, round(avg(km) * 1000, 2) AS distancia, string_agg(CAST(servicio_id AS VARCHAR), ',' ORDER BY servicio_id) AS servicios FROM pares GROUP BY id, categoria"


@query("a30_proximity_cache", CACHE)
def proximity(spark, sf):
    near = ids_within(propiedades(spark, sf).select("id", "lat", "lng"), servicios(spark, sf), 1.0, "categoria")
    return near.select("id", F.col("kind").alias("categoria"), F.col("n").alias("cantidad"), F.round(F.col("km") * 1000, 2).alias("distancia"), F.array_join("ids", ",").alias("servicios"))


@query("a30_refreshed_cache", CACHE)
def refreshed(spark, sf):
    """The same cache, computed before a tenth of the services opened or moved, and refreshed from what changed."""
    p, after = propiedades(spark, sf).select("id", "lat", "lng"), servicios(spark, sf).select("id", "categoria", "lat", "lng")
    shifted = after.withColumn("lat", F.when(F.col("id") % 20 == 3, F.col("lat") + 0.01).otherwise(F.col("lat")))
    before, folder = shifted.where("id % 20 <> 13"), f"{scratch_folder(spark)}/cercania-{uuid.uuid4().hex}"
    moved = before.where("id % 20 = 3").unionByName(after.where("id % 20 in (3, 13)"))
    cache.create(p, before, 1.0, folder, datetime.datetime(2025, 1, 1))
    cache.refresh(spark, folder, p, after, 1.0, datetime.datetime(2025, 1, 2), moved=moved)
    rows = cache.read(spark, folder)
    return rows.select("id", "categoria", "cantidad", F.round("metros", 2).alias("distancia"), F.array_join("servicios", ",").alias("servicios"))


@query("a08_services_per_zone", f"{PAIRS} SELECT zona, count(DISTINCT servicio_id) AS servicios, count(DISTINCT CASE WHEN categoria = 'salud' THEN id END) AS con_salud, round(avg(km), 4) AS km FROM pares GROUP BY zona")
def per_zone(spark, sf):
    p, s = propiedades(spark, sf), servicios(spark, sf)
    count = lambda rows, name: rows.groupBy("zona").agg(F.count("id").alias(name))
    seen = count(kinds_within(s, p, 1.0, "zona", key=["id"]), "servicios")
    healthy = count(kinds_within(p, s.where("categoria = 'salud'"), 1.0, "categoria", key=["id", "zona"]), "con_salud")
    mean = pairs(spark, sf).groupBy("zona").agg(F.round(F.avg("km"), 4).alias("km"))
    parts = seen.unionByName(healthy, allowMissingColumns=True).unionByName(mean, allowMissingColumns=True)  # a row a zone each
    return parts.groupBy("zona").agg(F.sum("servicios").alias("servicios"), F.coalesce(F.sum("con_salud"), F.lit(0)).alias("con_salud"), F.max("km").alias("km"))


@query("a11_coverage_level", f"{PAIRS}, n AS (SELECT zona, count(DISTINCT servicio_id) AS c FROM pares WHERE km <= 0.5 GROUP BY zona) SELECT zona, c AS servicios, CASE WHEN c >= 100 THEN 'alta' WHEN c >= 20 THEN 'media' ELSE 'baja' END AS nivel FROM n")
def coverage(spark, sf):
    n = kinds_within(servicios(spark, sf), propiedades(spark, sf), 0.5, "zona", key=["id"]).groupBy("zona").agg(F.count("id").alias("servicios"))
    return n.withColumn("nivel", F.when(F.col("servicios") >= 100, "alta").when(F.col("servicios") >= 20, "media").otherwise("baja"))
