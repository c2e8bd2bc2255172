"""Projections, filters and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from predio import schema
from predio.functions.geo import in_box
from predio.operators import filters as ops
from predio.plans.registry import query
from predio.sources.views import agentes, crudos, propiedades, servicios, table

def lat():
    return F.col("lat")


def lng():
    return F.col("lng")


@query("f01_defaults", "SELECT id, coalesce(precio_usd, 0) AS precio, coalesce(superficie, 0) AS superficie, coalesce(lat, -17.7833) AS lat, coalesce(lng, -63.1833) AS lng, coalesce(url, '') AS url FROM propiedades")
def defaults(spark, sf):
    zero = F.lit(0.0)
    return propiedades(spark, sf).select("id", F.coalesce("precio_usd", zero).alias("precio"), F.coalesce("superficie", zero).alias("superficie"), F.coalesce("lat", F.lit(schema.DEFAULT_LAT)).alias("lat"), F.coalesce("lng", F.lit(schema.DEFAULT_LNG)).alias("lng"), F.coalesce("url", F.lit("")).alias("url"))


@query("f02_nested_projection", "SELECT id, zona AS zona_ubicacion, CASE WHEN length(descripcion) > 60 THEN substr(descripcion, 1, 60) || '...' ELSE descripcion END AS corta, lat IS NOT NULL AND lng IS NOT NULL AS tiene_coordenadas FROM crudos")
def nested(spark, sf):
    shaped = crudos(spark, sf).select("id", F.struct("zona", F.struct("lat", "lng").alias("coordenadas")).alias("ubicacion"), F.when(F.length("descripcion") > 60, F.concat(F.substring("descripcion", 1, 60), F.lit("..."))).otherwise(F.col("descripcion")).alias("corta"))
    return shaped.select("id", F.col("ubicacion.zona").alias("zona_ubicacion"), "corta", (F.col("ubicacion.coordenadas.lat").isNotNull() & F.col("ubicacion.coordenadas.lng").isNotNull()).alias("tiene_coordenadas"))


@query("f03_hard_filter", "SELECT id, zona, tipo, precio_usd FROM propiedades WHERE uv LIKE '%4%' AND lower(zona) LIKE '%on_1%' AND lower(tipo) LIKE '%ur%' AND coalesce(precio_usd, 0) BETWEEN 50000 AND 250000")
def hard(spark, sf):
    return ops.hard_filter(propiedades(spark, sf), uv="4", zona="ON_1", tipo="ur", precio_min=50_000, precio_max=250_000).select("id", "zona", "tipo", "precio_usd")


@query("f04_catalog_filter", "SELECT id, zona FROM propiedades WHERE (lower(zona) LIKE '%nation_2%' OR lower(zona) LIKE '%nation_7%') AND precio_usd BETWEEN 10000 AND 300000 AND superficie BETWEEN 50 AND 300 AND dormitorios >= 2 AND banos >= 1 AND (garajes > 0) AND proveedor LIKE '%2%'")
def catalog(spark, sf):
    return ops.catalog_filter(propiedades(spark, sf), zona=["nation_2", "nation_7"], precio=(10_000, 300_000), superficie=(50, 300), dormitorios=2, banos=1, garaje=True, fuente="2").select("id", "zona")


F05 = """b0 AS (SELECT * FROM propiedades),
b1 AS (SELECT * FROM b0 WHERE contains(lower(zona), 'nation_3') OR NOT EXISTS (SELECT 1 FROM b0 WHERE contains(lower(zona), 'nation_3'))),
b2 AS (SELECT * FROM b1 WHERE uv = '999' OR NOT EXISTS (SELECT 1 FROM b1 WHERE uv = '999')),
b3 AS (SELECT * FROM b2 WHERE manzana = '7' OR NOT EXISTS (SELECT 1 FROM b2 WHERE manzana = '7')),
b4 AS (SELECT * FROM b3 WHERE lower(tipo) = 'casa' OR NOT EXISTS (SELECT 1 FROM b3 WHERE lower(tipo) = 'casa')),
b5 AS (SELECT * FROM b4 WHERE precio_usd BETWEEN 80000 AND 220000 OR NOT EXISTS (SELECT 1 FROM b4 WHERE precio_usd BETWEEN 80000 AND 220000))
SELECT id, zona, manzana, precio_usd FROM b5"""


@query("f05_soft_cascade", F05)
def cascade(spark, sf):
    steps = [F.lower("zona").contains("nation_3"), F.col("uv") == "999", F.col("manzana") == "7", F.lower("tipo") == "casa", F.col("precio_usd").between(80_000, 220_000)]
    return ops.soft_filter(propiedades(spark, sf), steps).select("id", "zona", "manzana", "precio_usd")


@query("f06_zone_both_ways", "SELECT id, zona FROM propiedades WHERE contains('nation_12', lower(coalesce(zona, ''))) OR contains(lower(coalesce(zona, '')), 'nation_12')")
def both_ways(spark, sf):
    return propiedades(spark, sf).where(ops.zone_match(F.col("zona"), "Nation_12")).select("id", "zona")


@query("f07_zone_contains", "SELECT id, zona FROM propiedades WHERE contains(lower(zona), 'nation_1')")
def one_way(spark, sf):
    return propiedades(spark, sf).where(ops.contains_ci(F.col("zona"), "Nation_1")).select("id", "zona")


@query("f08_price_range", "SELECT id, precio_usd FROM propiedades WHERE precio_usd BETWEEN 100000 AND 150000")
def price_range(spark, sf):
    return propiedades(spark, sf).where(F.col("precio_usd").between(100_000, 150_000)).select("id", "precio_usd")


@query("f09_zone_equal", "SELECT id FROM propiedades WHERE lower(zona) = lower('nation_7') AND estado = 'F'")
def zone_equal(spark, sf):
    return propiedades(spark, sf).where((F.lower("zona") == "nation_7") & (F.col("estado") == "F")).select("id")


@query("f10_boxes", "SELECT count(*) FILTER (WHERE lat BETWEEN -18.5 AND -17.5 AND lng BETWEEN -63.5 AND -63.0) AS carga, count(*) FILTER (WHERE lat BETWEEN -18.2 AND -17.5 AND lng BETWEEN -63.5 AND -63.0) AS crudo, count(*) FILTER (WHERE lat BETWEEN -18.5 AND -17.0 AND lng BETWEEN -64.0 AND -62.5) AS auditoria FROM crudos")
def boxes(spark, sf):
    return crudos(spark, sf).agg(*[F.count_if(in_box(lat(), lng(), b)).alias(n) for n, b in (("carga", schema.BOX_LOAD), ("crudo", schema.BOX_RAW), ("auditoria", schema.BOX_AUDIT))])


@query("f12_recency", "SELECT id FROM propiedades WHERE date_diff('day', CAST(fecha AS DATE), DATE '1998-08-01') BETWEEN 0 AND 90")
def recency(spark, sf):
    days = F.datediff(F.lit("1998-08-01").cast("date"), F.to_date("fecha"))
    return propiedades(spark, sf).where(days.between(0, 90)).select("id")


@query("f13_conditional_counts", "SELECT zona, count(*) FILTER (WHERE precio_usd > 200000) AS caras, count(CASE WHEN lat IS NULL THEN 1 END) AS sin_coordenadas, count(DISTINCT CASE WHEN precio_usd > 100000 THEN tipo END) AS tipos FROM propiedades GROUP BY zona")
def conditional(spark, sf):
    return propiedades(spark, sf).groupBy("zona").agg(F.count_if(F.col("precio_usd") > 200_000).alias("caras"), F.count_if(lat().isNull()).alias("sin_coordenadas"), F.count_distinct(F.when(F.col("precio_usd") > 100_000, F.col("tipo"))).alias("tipos"))


@query("f14_not_in", "SELECT count(*) FILTER (WHERE agente_id NOT IN (SELECT id FROM agentes WHERE saldo > 0)) AS fuera, count(*) FILTER (WHERE agente_id IN (SELECT id FROM agentes WHERE saldo > 0)) AS dentro FROM propiedades")
def not_in(spark, sf):
    rich = agentes(spark, sf).where("saldo > 0").select(F.col("id").alias("agente_id")).withColumn("hay", F.lit(True))
    p = propiedades(spark, sf).select("agente_id").join(rich, "agente_id", "left")
    return p.agg(F.count_if(F.col("hay").isNull()).alias("fuera"), F.count_if(F.col("hay")).alias("dentro"))


@query("f15_type_and_zone", "SELECT id FROM propiedades WHERE lower(tipo) = '1-urgent' AND contains(lower(zona), '_2')")
def type_zone(spark, sf):
    return propiedades(spark, sf).where((F.lower("tipo") == "1-urgent") & F.lower("zona").contains("_2")).select("id")


@query("f16_invalid_price_text", "SELECT id FROM crudos WHERE lower(trim(precio)) IN ('', 'nan', 'none', '0', '0.0', '0.00', '0.00 bob') OR coalesce(try_cast(regexp_replace(precio, '[^0-9.]', '', 'g') AS DOUBLE) < 10, true)")
def invalid_price(spark, sf):
    text = F.lower(F.trim("precio"))
    few = F.regexp_replace("precio", "[^0-9.]", "").try_cast("double") < 10
    return crudos(spark, sf).where(text.isin("", "nan", "none", "0", "0.0", "0.00", "0.00 bob") | F.coalesce(few, F.lit(True))).select("id")


@query("f17_minimum_data", "SELECT estado, count(*) AS n FROM propiedades WHERE coalesce(precio_usd, 0) > 0 OR (lat IS NOT NULL AND lng IS NOT NULL) GROUP BY estado")
def minimum(spark, sf):
    return propiedades(spark, sf).where((F.coalesce("precio_usd", F.lit(0.0)) > 0) | (lat().isNotNull() & lng().isNotNull())).groupBy("estado").agg(F.count("*").alias("n"))


@query("u01_table_summaries", "SELECT 'propiedades' AS tabla, count(*) AS n FROM propiedades UNION ALL SELECT 'servicios', count(*) FROM servicios UNION ALL SELECT 'agentes', count(*) FROM agentes")
def summaries(spark, sf):
    tables = [(n, f(spark, sf)) for n, f in (("propiedades", propiedades), ("servicios", servicios), ("agentes", agentes))]
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("tabla"), "n") for n, t in tables]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("u02_concatenation", "SELECT zona, CAST(NULL AS VARCHAR) AS categoria, count(*) AS n FROM propiedades GROUP BY zona UNION ALL SELECT zona, categoria, count(*) FROM servicios GROUP BY zona, categoria")
def concatenation(spark, sf):
    a = propiedades(spark, sf).groupBy("zona").agg(F.count("*").alias("n"))
    b = servicios(spark, sf).groupBy("zona", "categoria").agg(F.count("*").alias("n"))
    return b.unionByName(a, allowMissingColumns=True)


@query("u03_zones_without_services", "SELECT DISTINCT zona FROM propiedades EXCEPT SELECT zona FROM servicios")
def missing_zones(spark, sf):
    return propiedades(spark, sf).select("zona").distinct().join(servicios(spark, sf).select("zona").distinct(), "zona", "left_anti")


@query("u04_distinct_sets", "SELECT DISTINCT zona, tipo FROM propiedades")
def distinct_sets(spark, sf):
    return propiedades(spark, sf).select("zona", "tipo").distinct()


@query("u05_amenity_union", "SELECT id, array_to_string(list_distinct_ordered, ',') AS amenidades FROM (SELECT id, CASE WHEN id % 2 = 0 THEN CASE WHEN id % 3 = 0 THEN ['piscina', 'wifi'] ELSE ['piscina', 'wifi', 'gym'] END ELSE CASE WHEN id % 3 = 0 THEN ['wifi'] ELSE ['wifi', 'gym'] END END AS list_distinct_ordered FROM propiedades)")
def amenity_union(spark, sf):
    id_ = F.col("id")
    a = F.when(id_ % 2 == 0, F.array(F.lit("piscina"), F.lit("wifi"))).otherwise(F.array(F.lit("wifi")))
    b = F.when(id_ % 3 == 0, F.array(F.lit("wifi"))).otherwise(F.array(F.lit("wifi"), F.lit("gym")))
    return propiedades(spark, sf).select("id", F.array_join(F.array_union(a, b), ",").alias("amenidades"))


@query("w00_provider_rows", "SELECT proveedor, count(*) AS n, count(url) AS con_url FROM propiedades GROUP BY proveedor")
def provider_rows(spark, sf):
    return propiedades(spark, sf).groupBy("proveedor").agg(F.count("*").alias("n"), F.count("url").alias("con_url"))
