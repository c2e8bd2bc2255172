"""The domain over the given tables, in integer arithmetic that any engine repeats.

Listings come from orders, points of interest from part, agents from customer,
pipeline metrics from events.  ``VIEWS_SQL`` has the same views for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from predio.schema import CATEGORIES

ZONES = ["Equipetrol", "Urbari", "Centro", "Zona Norte", "Zona Sur", "Las Palmas", "Plan 3000", "Barrio Jardín", "Radial 13", "Los Lotes", "Condominio Sevilla"]
TYPES = ["Casa", "Departamento", "Terreno", "Oficina", "Penthouse", "Local", "Galpón"]
PLACES = ["equipetrol", "urbari", "zona norte", "centro", "los olivos", "el palmar", "plan 3000"]
EXTRAS = ["piscina", "gimnasio y piscina", "jardín", "terraza", "wifi", "seguridad", "cochera", "balcón"]
DEALS = ["en venta", "en alquiler", "en anticrético", "en preventa", "disponible"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latitude(k: Column) -> Column:
    return F.lit(-18.2) + (k * 7919 % 10007) / F.lit(10007.0) * 0.7


def longitude(k: Column) -> Column:
    return F.lit(-63.5) + (k * 104729 % 10009) / F.lit(10009.0) * 0.5


def pick(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def propiedades(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return rows.select(
        k.alias("id"), F.col("o_custkey").alias("agente_id"), F.concat_ws(" ", F.col("o_orderpriority"), F.lit("en"), F.col("n_name"), (k % 700).cast("string")).alias("titulo"),
        F.when(k % 89 != 0, F.col("o_totalprice")).alias("precio_usd"), F.col("n_name").alias("zona"), F.col("o_orderstatus").alias("estado"), F.col("o_orderpriority").alias("tipo"),
        F.col("o_orderdate").alias("fecha"), F.when(k % 31 == 0, 0).otherwise(20 + k * 37 % 380).cast("double").alias("superficie"), (k % 6).cast("int").alias("dormitorios"),
        (k % 4).cast("int").alias("banos"), (k % 3).cast("int").alias("garajes"), F.when(k % 97 != 0, latitude(k)).alias("lat"), F.when(k % 97 != 0, longitude(k)).alias("lng"),
        (k % 50).cast("string").alias("uv"), (k % 20).cast("string").alias("manzana"), F.concat(F.lit("0"), (k % 5 + 1).cast("string")).alias("proveedor"),
        F.when(k % 10 != 0, F.concat(F.lit("http://listado/"), (k % 9000).cast("string"))).alias("url"),
    )


def servicios(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_name").alias("nombre"), pick([c for c, _ in CATEGORIES], k).alias("categoria"), F.col("p_type").alias("subcategoria"), F.col("p_brand").alias("fuente"), F.when(k % 53 != 0, latitude(k)).alias("lat"), F.when(k % 53 != 0, longitude(k)).alias("lng"), pick(ZONES, k).alias("zona"))


def agentes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("nombre"), F.col("c_acctbal").alias("saldo"), F.col("c_mktsegment").alias("empresa"), F.col("c_nationkey").alias("zona_id"), F.when(k % 4 != 0, F.concat(F.lit("7"), F.lpad((k % 997).cast("string"), 7, "0"))).alias("telefono"))


def metricas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 5).alias("proveedor"), F.when(F.col("event_type") == "error", "error").otherwise("exito").alias("estado"), F.col("value").alias("duracion"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))


def crudos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as they arrive: prices, surfaces, dates and coordinates as texts of many forms, and a description."""
    k = F.col("o_orderkey")
    p = F.col("o_totalprice").cast("long")
    form = k % 9
    s = lambda c: c.cast("string")
    thousands = lambda mark: F.concat(s(F.floor(p / 1000)), F.lit(mark), F.lpad(s(p % 1000), 3, "0"))
    price = (
        F.when(form == 0, F.concat(F.lit("$"), thousands(","))).when(form == 1, F.concat(F.lit("USD "), thousands("."), F.lit(",50"))).when(form == 2, s(p)).when(form == 3, F.concat(thousands(","), F.lit(" Usd")))
        .when(form == 4, F.concat(F.lit("Bs. "), s(p))).when(form == 5, F.concat(s(p), F.lit(" BOB"))).when(form == 6, F.lit("nan")).when(form == 7, F.lit("no válido")).otherwise(F.concat(s(p), F.lit(",5")))
    )
    lat, lng = latitude(k), longitude(k)
    description = F.concat(
        pick(TYPES, k), F.lit(" "), pick(DEALS, F.floor(k / 3)), F.lit(" en "), pick(PLACES, F.floor(k / 7)), F.lit(", "), s(k % 5 + 1), F.lit(" dormitorios, "), s(k % 3 + 1), F.lit(" baños, "),
        F.when(k % 2 == 0, F.concat(F.lit("superficie: "), s(k % 400 + 40), F.lit(" m2"))).otherwise(F.concat(F.lit("terreno de "), s(k % 300 + 90), F.lit(" mt2"))), F.lit(", "), pick(EXTRAS, k),
        F.when(k % 4 == 0, F.concat(F.lit(", $us "), s(p))).when(k % 4 == 1, F.concat(F.lit(", "), s(p % 9000 + 500), F.lit(" bs"))).when(k % 4 == 2, F.concat(F.lit(", precio: "), s(p))).otherwise(F.lit("")),
        F.lit(", radial "), s(k % 29 + 1), F.lit(" y "), s(k % 9 + 1), F.lit("to anillo"), F.when(k % 5 == 0, F.concat(F.lit(". Contacto: 7"), F.lpad(s(k % 997), 7, "0"))).otherwise(F.lit("")),
    )
    form5, form6 = k % 5, k % 6
    date = F.when(form5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(form5 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(form5 == 2, F.date_format("o_orderdate", "yyyy.MM.dd")).when(form5 == 3, F.lit("sin fecha")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    raw_lat = F.when(form6 == 0, lat).when(form6 == 1, lng).when(form6 == 2, F.round(lat * 1e6)).when(form6 == 3, -lat).when(form6 == 4, F.lit(0.0)).otherwise(lat + 10)
    raw_lng = F.when(form6 == 1, lat).when(form6 == 2, F.round(lng * 1e7)).when(form6 == 3, -lng).otherwise(lng)
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(pick(TYPES, k), F.lit(" en "), pick(ZONES, F.floor(k / 2))).alias("titulo"), description.alias("descripcion"), price.alias("precio"),
        F.concat(s(k % 300 + 20), pick([" m2", "mt2", " m²", ""], k)).alias("superficie"), date.alias("fecha"), raw_lat.alias("lat"), raw_lng.alias("lng"),
        F.when(k % 11 == 0, F.lit("")).when(k % 11 == 1, F.lit(None)).otherwise(pick(ZONES, F.floor(k / 2))).alias("zona"), F.when(k % 13 == 0, F.lit(None)).otherwise(pick(TYPES, k)).alias("tipo"),
        F.concat(F.lit("  Ana   Mar"), F.lit("Ã­"), F.lit("a "), s(k % 50), F.lit("\t")).alias("nombre"), F.concat(F.lit("(+591) 7"), s(k % 10000)).alias("telefono"),
        F.concat(F.date_format("o_orderdate", "yyyy.MM.dd"), F.lit(" data.xlsx")).alias("archivo"),
    )


def _list(values: list[str], k: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST(({k}) % {len(values)} + 1 AS BIGINT))"


def _lat(k: str) -> str:
    return f"(-18.2::DOUBLE + ({k} * 7919 % 10007)::DOUBLE / 10007::DOUBLE * 0.7::DOUBLE)"


def _lng(k: str) -> str:
    return f"(-63.5::DOUBLE + ({k} * 104729 % 10009)::DOUBLE / 10009::DOUBLE * 0.5::DOUBLE)"


_P = "CAST(trunc(o_totalprice) AS BIGINT)"
_K = "o_orderkey"


def _th(mark: str) -> str:
    return f"(CAST({_P} // 1000 AS VARCHAR) || '{mark}' || lpad(CAST({_P} % 1000 AS VARCHAR), 3, '0'))"


VIEWS_SQL = f"""WITH RECURSIVE propiedades AS (
  SELECT {_K} AS id, o_custkey AS agente_id, concat(o_orderpriority, ' en ', n_name, ' ', {_K} % 700) AS titulo,
    CASE WHEN {_K} % 89 <> 0 THEN o_totalprice END AS precio_usd, concat(n_name, '') AS zona, concat(o_orderstatus, '') AS estado, concat(o_orderpriority, '') AS tipo, o_orderdate AS fecha,
    CAST(CASE WHEN {_K} % 31 = 0 THEN 0 ELSE 20 + {_K} * 37 % 380 END AS DOUBLE) AS superficie, CAST({_K} % 6 AS INTEGER) AS dormitorios, CAST({_K} % 4 AS INTEGER) AS banos, CAST({_K} % 3 AS INTEGER) AS garajes,
    CASE WHEN {_K} % 97 <> 0 THEN {_lat(_K)} END AS lat, CASE WHEN {_K} % 97 <> 0 THEN {_lng(_K)} END AS lng, CAST({_K} % 50 AS VARCHAR) AS uv, CAST({_K} % 20 AS VARCHAR) AS manzana,
    '0' || CAST({_K} % 5 + 1 AS VARCHAR) AS proveedor, CASE WHEN {_K} % 10 <> 0 THEN 'http://listado/' || CAST({_K} % 9000 AS VARCHAR) END AS url
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
servicios AS (
  SELECT p_partkey AS id, p_name AS nombre, {_list([c for c, _ in CATEGORIES], 'p_partkey')} AS categoria, p_type AS subcategoria, p_brand AS fuente,
    CASE WHEN p_partkey % 53 <> 0 THEN {_lat('p_partkey')} END AS lat, CASE WHEN p_partkey % 53 <> 0 THEN {_lng('p_partkey')} END AS lng, {_list(ZONES, 'p_partkey')} AS zona FROM part),
agentes AS (
  SELECT c_custkey AS id, c_name AS nombre, c_acctbal AS saldo, c_mktsegment AS empresa, c_nationkey AS zona_id,
    CASE WHEN c_custkey % 4 <> 0 THEN '7' || lpad(CAST(c_custkey % 997 AS VARCHAR), 7, '0') END AS telefono FROM customer),
metricas AS (
  SELECT event_id, ts, user_id % 5 AS proveedor, CASE WHEN event_type = 'error' THEN 'error' ELSE 'exito' END AS estado, value AS duracion,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events),
crudos AS (
  SELECT {_K} AS id, {_list(TYPES, _K)} || ' en ' || {_list(ZONES, _K + ' // 2')} AS titulo,
    {_list(TYPES, _K)} || ' ' || {_list(DEALS, _K + ' // 3')} || ' en ' || {_list(PLACES, _K + ' // 7')} || ', ' || ({_K} % 5 + 1) || ' dormitorios, ' || ({_K} % 3 + 1) || ' baños, ' ||
    CASE WHEN {_K} % 2 = 0 THEN 'superficie: ' || ({_K} % 400 + 40) || ' m2' ELSE 'terreno de ' || ({_K} % 300 + 90) || ' mt2' END || ', ' || {_list(EXTRAS, _K)} ||
    CASE WHEN {_K} % 4 = 0 THEN ', $us ' || {_P} WHEN {_K} % 4 = 1 THEN ', ' || ({_P} % 9000 + 500) || ' bs' WHEN {_K} % 4 = 2 THEN ', precio: ' || {_P} ELSE '' END ||
    ', radial ' || ({_K} % 29 + 1) || ' y ' || ({_K} % 9 + 1) || 'to anillo' || CASE WHEN {_K} % 5 = 0 THEN '. Contacto: 7' || lpad(CAST({_K} % 997 AS VARCHAR), 7, '0') ELSE '' END AS descripcion,
    CASE {_K} % 9 WHEN 0 THEN '$' || {_th(',')} WHEN 1 THEN 'USD ' || {_th('.')} || ',50' WHEN 2 THEN CAST({_P} AS VARCHAR) WHEN 3 THEN {_th(',')} || ' Usd' WHEN 4 THEN 'Bs. ' || {_P}
      WHEN 5 THEN {_P} || ' BOB' WHEN 6 THEN 'nan' WHEN 7 THEN 'no válido' ELSE {_P} || ',5' END AS precio,
    ({_K} % 300 + 20) || {_list([' m2', 'mt2', ' m²', ''], _K)} AS superficie,
    CASE {_K} % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN 3 THEN 'sin fecha' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS fecha, o_orderdate AS dia,
    CASE {_K} % 6 WHEN 0 THEN {_lat(_K)} WHEN 1 THEN {_lng(_K)} WHEN 2 THEN round({_lat(_K)} * 1e6) WHEN 3 THEN -{_lat(_K)} WHEN 4 THEN 0 ELSE {_lat(_K)} + 10 END AS lat,
    CASE {_K} % 6 WHEN 1 THEN {_lat(_K)} WHEN 2 THEN round({_lng(_K)} * 1e7) WHEN 3 THEN -{_lng(_K)} ELSE {_lng(_K)} END AS lng,
    CASE {_K} % 11 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE {_list(ZONES, _K + ' // 2')} END AS zona, CASE WHEN {_K} % 13 = 0 THEN NULL ELSE {_list(TYPES, _K)} END AS tipo,
    '  Ana   MarÃ­a ' || ({_K} % 50) || chr(9) AS nombre, '(+591) 7' || ({_K} % 10000) AS telefono, strftime(o_orderdate, '%Y.%m.%d') || ' data.xlsx' AS archivo
  FROM orders)
"""
