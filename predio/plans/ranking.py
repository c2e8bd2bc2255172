"""Top-k, ordered lists and order-dependent windows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from predio.operators import buckets
from predio.operators.graph import scratch_folder
from predio.operators.upsert import keep_first, keep_last, insert_ignore, upsert
from predio.plans.registry import haversine, query
from predio.sources.views import agentes, metricas, propiedades, servicios
from predio.streaming import monitor

def precio():
    return F.col("precio_usd")


@query("t01_top_by_surface", "SELECT id, superficie FROM propiedades ORDER BY superficie DESC, id LIMIT 10")
def top(spark, sf):
    return propiedades(spark, sf).orderBy(F.desc("superficie"), "id").select("id", "superficie").limit(10)


def extremes(df, zona: str, ascending: bool, k: int = 5):
    """The ``k`` cheapest or dearest listings of a zone that have a price, with their place."""
    order = [precio().asc() if ascending else precio().desc(), F.col("id")]
    found = df.where(F.lower("zona").contains(zona.lower()) & (precio() > 0)).orderBy(*order).limit(k)
    return found.select(F.row_number().over(Window.orderBy(*order)).alias("puesto"), "id", "precio_usd")  # k rows


@query("t02_extremes_of_a_zone", "c AS (SELECT 'caras' AS lista, CAST(row_number() OVER (ORDER BY precio_usd DESC, id) AS INTEGER) AS puesto, id, precio_usd FROM propiedades WHERE contains(lower(zona), 'nation_7') AND precio_usd > 0 QUALIFY puesto <= 5), b AS (SELECT 'baratas' AS lista, CAST(row_number() OVER (ORDER BY precio_usd, id) AS INTEGER) AS puesto, id, precio_usd FROM propiedades WHERE contains(lower(zona), 'nation_7') AND precio_usd > 0 QUALIFY puesto <= 5) SELECT * FROM c UNION ALL SELECT * FROM b")
def zone_extremes(spark, sf):
    p = propiedades(spark, sf)
    return extremes(p, "nation_7", False).select(F.lit("caras").alias("lista"), "*").unionByName(extremes(p, "nation_7", True).select(F.lit("baratas").alias("lista"), "*"))


@query("t04_first_n", "SELECT id, zona FROM propiedades WHERE precio_usd BETWEEN 60000 AND 90000 ORDER BY id LIMIT 20")
def first_n(spark, sf):
    return propiedades(spark, sf).where(precio().between(60_000, 90_000)).orderBy("id").limit(20).select("id", "zona")


@query("t05_cheapest", "SELECT id, precio_usd FROM propiedades ORDER BY precio_usd ASC NULLS LAST, id LIMIT 50")
def cheapest(spark, sf):
    return propiedades(spark, sf).orderBy(precio().asc_nulls_last(), "id").limit(50).select("id", "precio_usd")


@query("t06_nearest_first", f"c AS (SELECT -17.78::DOUBLE AS lat, -63.18::DOUBLE AS lng) SELECT s.id, round({haversine('c', 's')}, 6) AS km FROM servicios s, c WHERE s.lat IS NOT NULL ORDER BY {haversine('c', 's')}, s.id LIMIT 25")
def nearest_first(spark, sf):
    from predio.functions.geo import haversine_km

    km = haversine_km(F.lit(-17.78), F.lit(-63.18), F.col("lat"), F.col("lng"))
    return servicios(spark, sf).where("lat is not null").withColumn("d", km).orderBy("d", "id").limit(25).select("id", F.round("d", 6).alias("km"))


@query("t07_distinct_zones", "SELECT zona, count(*) AS n FROM propiedades WHERE zona <> '' GROUP BY zona ORDER BY zona")
def zones(spark, sf):
    return propiedades(spark, sf).where("zona <> ''").groupBy("zona").agg(F.count("*").alias("n")).orderBy("zona")


@query("t08_best_candidate", "SELECT agente_id, arg_max(id, ROW(confianza, es_usd, precio_usd, id)) AS mejor FROM (SELECT *, dormitorios * 10 + banos AS confianza, CAST(id % 2 AS INTEGER) AS es_usd FROM propiedades WHERE precio_usd IS NOT NULL) GROUP BY agente_id")
def best(spark, sf):
    order = F.struct((F.col("dormitorios") * 10 + F.col("banos")).alias("c"), (F.col("id") % 2).alias("u"), "precio_usd", "id")
    return propiedades(spark, sf).where(precio().isNotNull()).groupBy("agente_id").agg(F.max_by("id", order).alias("mejor"))


@query("t09_suggestions", "SELECT agente_id, array_to_string(list_slice(list(zona ORDER BY primera, zona), 1, 5), '|') AS sugerencias FROM (SELECT agente_id, tipo AS zona, min(id) AS primera FROM propiedades GROUP BY 1, 2) GROUP BY agente_id")
def suggestions(spark, sf):
    firsts = propiedades(spark, sf).groupBy("agente_id", "tipo").agg(F.min("id").alias("primera"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("primera", "tipo"))), lambda s: s["tipo"])
    return firsts.groupBy("agente_id").agg(F.array_join(F.slice(F.array_distinct(ordered), 1, 5), "|").alias("sugerencias"))


@query("w01_keep_first", "SELECT id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM propiedades WHERE url IS NOT NULL) WHERE rn = 1")
def first(spark, sf):
    return keep_first(propiedades(spark, sf).where("url is not null").select("id", "url"), ["url"], "id")


@query("w02_keep_last", "SELECT id, titulo FROM (SELECT *, row_number() OVER (PARTITION BY titulo ORDER BY id DESC) AS rn FROM propiedades) WHERE rn = 1")
def last(spark, sf):
    return keep_last(propiedades(spark, sf).select("id", "titulo"), ["titulo"], "id")


@query("w03_any_row_matches", "SELECT zona, count(*) AS n, max(precio_usd > 480000) AS alguna FROM propiedades GROUP BY zona")
def any_row(spark, sf):
    return propiedades(spark, sf).groupBy("zona").agg(F.count("*").alias("n"), F.max(precio() > 480_000).alias("alguna"))


@query("w04_rank_in_zone", "SELECT zona, id, CAST(rn AS INTEGER) AS puesto FROM (SELECT zona, id, row_number() OVER (PARTITION BY zona ORDER BY precio_usd DESC NULLS LAST, id) AS rn FROM propiedades) WHERE rn <= 3")
def rank(spark, sf):
    w = Window.partitionBy("zona").orderBy(precio().desc_nulls_last(), "id")
    return propiedades(spark, sf).withColumn("puesto", F.row_number().over(w)).where("puesto <= 3").select("zona", "id", "puesto")


@query("w05_last_events", "SELECT proveedor, event_id FROM (SELECT *, row_number() OVER (PARTITION BY proveedor ORDER BY ts DESC, event_id DESC) AS rn FROM metricas) WHERE rn <= 100")
def last_events(spark, sf):
    w = Window.partitionBy("proveedor").orderBy(F.desc("ts"), F.desc("event_id"))
    return metricas(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 100").select("proveedor", "event_id")


RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query("w06_running_success", f"SELECT event_id, proveedor, n, round(tasa, 6) AS tasa FROM (SELECT event_id, proveedor, count(*) OVER w AS n, 100.0 * count(*) FILTER (WHERE estado = 'exito') OVER w / count(*) OVER w AS tasa FROM metricas WINDOW w AS (PARTITION BY proveedor ORDER BY ts, event_id {RUNNING})) WHERE n >= 10 AND tasa < 90")
def running(spark, sf):
    m = monitor.running(metricas(spark, sf), n=F.lit(1), bien=F.when(F.col("estado") == "exito", 1).otherwise(0)).withColumn("tasa", 100.0 * F.col("bien") / F.col("n"))
    return m.where("n >= 10 and tasa < 90").select("event_id", "proveedor", F.col("n").cast("long").alias("n"), F.round("tasa", 6).alias("tasa"))


@query("w07_running_cost", f"SELECT proveedor, min(event_id) FILTER (WHERE alcanzado) AS primera, count(*) FILTER (WHERE alcanzado) AS n FROM (SELECT proveedor, event_id, sum(tokens) OVER (PARTITION BY proveedor ORDER BY ts, event_id {RUNNING}) > 5000 AS alcanzado FROM metricas) GROUP BY proveedor")
def cost(spark, sf):
    m = monitor.running(metricas(spark, sf), gasto=F.col("tokens")).withColumn("alcanzado", F.col("gasto") > 5000)
    return m.groupBy("proveedor").agg(F.min(F.when(F.col("alcanzado"), F.col("event_id"))).alias("primera"), F.count_if("alcanzado").alias("n"))


def deliveries(spark, sf):
    """An existing table, and a later delivery that overlaps it."""
    a = agentes(spark, sf)
    target = a.where("id % 3 <> 0").select("nombre", "telefono", "id")
    source = a.where("id % 2 = 0").select(F.when(F.col("id") % 20 != 0, F.concat(F.lit("Customer#"), F.lpad((F.col("id") % 500).cast("string"), 9, "0"))).alias("nombre"), F.when(F.col("id") % 5 != 0, F.lit("nuevo")).alias("telefono"), "id")
    return target, source


DELIVERY = """destino AS (SELECT nombre, telefono, id FROM agentes WHERE id % 3 <> 0),
fuente AS (SELECT CASE WHEN id % 20 <> 0 THEN 'Customer#' || lpad(CAST(id % 500 AS VARCHAR), 9, '0') END AS nombre, CASE WHEN id % 5 <> 0 THEN 'nuevo' END AS telefono, id FROM agentes WHERE id % 2 = 0),
ultimas AS (SELECT * FROM fuente WHERE nombre IS NOT NULL QUALIFY row_number() OVER (PARTITION BY nombre ORDER BY id DESC) = 1),
primeras AS (SELECT * FROM fuente WHERE nombre IS NOT NULL QUALIFY row_number() OVER (PARTITION BY nombre ORDER BY id) = 1)"""


UPSERTED = f"{DELIVERY} SELECT * FROM destino WHERE nombre NOT IN (SELECT nombre FROM ultimas) UNION ALL SELECT u.nombre, coalesce(u.telefono, d.telefono), u.id FROM ultimas u LEFT JOIN destino d USING (nombre) UNION ALL SELECT * FROM fuente WHERE nombre IS NULL"


@query("s10_upsert", UPSERTED)
def merged(spark, sf):
    target, source = deliveries(spark, sf)
    return upsert(target, source, ["nombre"], "id", preserve=("telefono",))


@query("s10_bucketed_upsert", UPSERTED)
def bucketed(spark, sf):
    """The same merge into a table on disk, of which only the buckets that the delivery touches are rewritten."""
    target, source = deliveries(spark, sf)
    folder = f"{scratch_folder(spark)}/agentes-{uuid.uuid4().hex}"
    buckets.create(target, folder, ["nombre"])
    buckets.merge(spark, folder, source, "id", preserve=("telefono",))
    return buckets.read(spark, folder)


@query("p03_stamped_upsert", f"{DELIVERY} SELECT id, nombre, CAST(NULL AS VARCHAR) AS actualizado FROM destino WHERE nombre NOT IN (SELECT nombre FROM ultimas) UNION ALL SELECT id, nombre, '2025-01-01 00:00:00' FROM ultimas UNION ALL SELECT id, nombre, '2025-01-01 00:00:00' FROM fuente WHERE nombre IS NULL")
def stamped(spark, sf):
    target, source = deliveries(spark, sf)
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    rows = upsert(target, source, ["nombre"], "id", preserve=("telefono",), stamp=("actualizado", now))
    return rows.select("id", "nombre", F.date_format("actualizado", "yyyy-MM-dd HH:mm:ss").alias("actualizado"))


@query("s11_insert_ignore", f"{DELIVERY} SELECT * FROM destino UNION ALL SELECT * FROM primeras WHERE nombre NOT IN (SELECT nombre FROM destino) UNION ALL SELECT * FROM fuente WHERE nombre IS NULL")
def ignored(spark, sf):
    target, source = deliveries(spark, sf)
    return insert_ignore(target, source, ["nombre"], "id")


@query("s12_get_or_insert_agent", f"{DELIVERY} SELECT f.id, coalesce(d.id, f.id) AS agente_id FROM fuente f LEFT JOIN destino d ON lower(f.nombre) = lower(d.nombre) AND coalesce(f.telefono, '') = coalesce(d.telefono, '')")
def get_or_insert(spark, sf):
    target, source = deliveries(spark, sf)
    keyed = lambda df: df.withColumn("_n", F.lower("nombre")).withColumn("_t", F.coalesce("telefono", F.lit("")))
    known = keyed(target).select("_n", "_t", F.col("id").alias("existente"))
    return keyed(source).join(known, ["_n", "_t"], "left").select("id", F.coalesce("existente", "id").alias("agente_id"))
