"""Scans, mapping, profiles and sinks that a query can show."""

from __future__ import annotations

from pyspark.sql import functions as F

from predio import schema
from predio.plans.registry import query
from predio.sources import io
from predio.sources.views import crudos, propiedades, servicios


@query("s03_column_mapping", "SELECT id, titulo, coalesce(precio, 'x') AS precio, superficie FROM crudos")
def mapping(spark, sf):
    raw = crudos(spark, sf).select("id", F.col("titulo").alias("Título"), F.col("precio").alias("Precio USD"), F.lit("x").alias("Price"), F.col("superficie").alias("Sup. Terreno"))
    return io.standardise(raw).select("id", "titulo", "precio", "superficie")


@query("s09_default_coordinates", "SELECT id, coalesce(lat, -17.7833) AS lat, coalesce(lng, -63.1833) AS lng, lat IS NOT NULL AND lng IS NOT NULL AS coordenadas_validas FROM servicios")
def coordinates(spark, sf):
    return io.with_default_coordinates(servicios(spark, sf), schema.DEFAULT_LAT, schema.DEFAULT_LNG).select("id", "lat", "lng", "coordenadas_validas")


PROFILE = "SELECT '{c}' AS columna, count(try_cast({c} AS DOUBLE)) AS numeros, count({c}) - count(try_cast({c} AS DOUBLE)) AS textos, count(*) - count({c}) AS nulos, min(try_cast({c} AS DOUBLE)) AS desde, max(try_cast({c} AS DOUBLE)) AS hasta FROM crudos"


@query("s22_column_profile", " UNION ALL ".join(PROFILE.format(c=c) for c in ("zona", "tipo", "superficie")))
def profile(spark, sf):
    return io.profile(crudos(spark, sf), ["zona", "tipo", "superficie"]).drop("muestra")


@query("s23_bounds_of_columns", "SELECT count(*) FILTER (WHERE lat BETWEEN -18.2 AND -17.5) AS lat_validas, count(*) FILTER (WHERE lng BETWEEN -63.5 AND -63.0) AS lng_validas, count(*) AS n FROM crudos")
def bounds(spark, sf):
    return crudos(spark, sf).agg(F.count_if(F.col("lat").between(-18.2, -17.5)).alias("lat_validas"), F.count_if(F.col("lng").between(-63.5, -63.0)).alias("lng_validas"), F.count("*").alias("n"))


@query("s18_insert_statements", "SELECT 'INSERT INTO propiedades (id, titulo, dormitorios) VALUES (' || id || ', ''' || replace(titulo, '''', '''''') || ''', ' || dormitorios || ') ON CONFLICT DO NOTHING;' AS sentencia FROM propiedades WHERE precio_usd > 450000")
def statements(spark, sf):
    return io.insert_statements(propiedades(spark, sf).where("precio_usd > 450000"), "propiedades", ["id", "titulo", "dormitorios"])


@query("s15_report_json", "SELECT zona, '{\"zona\":\"' || zona || '\",\"n\":' || count(*) || '}' AS reporte FROM propiedades GROUP BY zona")
def report(spark, sf):
    return propiedades(spark, sf).groupBy("zona").agg(F.count("*").alias("n")).select("zona", F.to_json(F.struct("zona", "n")).alias("reporte"))
