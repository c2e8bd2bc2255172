"""Statistics, histograms, quality audits and duplicate counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from predio import schema
from predio.functions.geo import in_box
from predio.operators import incremental
from predio.operators.graph import scratch_folder
from predio.operators.quantiles import exact_quantiles
from predio.plans.registry import query
from predio.sources.views import agentes, crudos, metricas, propiedades, servicios

BINS = [(50_000, "menos de 50k"), (100_000, "50k-100k"), (150_000, "100k-150k"), (200_000, "150k-200k"), (300_000, "200k-300k"), (None, "300k o más")]


def precio():
    return F.col("precio_usd")


def superficie():
    return F.col("superficie")


def r2(c):
    return F.round(c, 2)


@query("a01_global_statistics", "SELECT count(*) AS n, round(avg(CASE WHEN precio_usd > 0 THEN precio_usd END), 2) AS precio_medio, min(CASE WHEN precio_usd > 0 THEN precio_usd END) AS precio_min, max(precio_usd) AS precio_max, round(avg(CASE WHEN superficie > 0 THEN superficie END), 2) AS superficie_media, count(DISTINCT zona) AS zonas, count(DISTINCT tipo) AS tipos FROM propiedades")
def global_statistics(spark, sf):
    p, s = F.when(precio() > 0, precio()), F.when(superficie() > 0, superficie())
    return propiedades(spark, sf).agg(F.count("*").alias("n"), r2(F.avg(p)).alias("precio_medio"), F.min(p).alias("precio_min"), F.max(p).alias("precio_max"), r2(F.avg(s)).alias("superficie_media"), F.count_distinct("zona").alias("zonas"), F.count_distinct("tipo").alias("tipos"))


def price_bin(price):
    chain = F.when(price < BINS[0][0], BINS[0][1])
    for limit, name in BINS[1:-1]:
        chain = chain.when(price < limit, name)
    return chain.otherwise(BINS[-1][1])


@query("a02_price_histogram", "c AS (SELECT unnest(['menos de 50k', '50k-100k', '100k-150k', '150k-200k', '200k-300k', '300k o más']) AS rango), h AS (SELECT CASE WHEN precio_usd < 50000 THEN 'menos de 50k' WHEN precio_usd < 100000 THEN '50k-100k' WHEN precio_usd < 150000 THEN '100k-150k' WHEN precio_usd < 200000 THEN '150k-200k' WHEN precio_usd < 300000 THEN '200k-300k' ELSE '300k o más' END AS rango, count(*) AS n FROM propiedades WHERE precio_usd > 0 GROUP BY 1) SELECT rango, coalesce(n, 0) AS n FROM c LEFT JOIN h USING (rango)")
def histogram(spark, sf):
    counts = propiedades(spark, sf).where(precio() > 0).groupBy(price_bin(precio()).alias("rango")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(n,) for _, n in BINS], "rango string").join(counts, "rango", "left").na.fill(0)


@query("a03_price_class", "SELECT CASE WHEN precio_usd < 50000 THEN 'económico' WHEN precio_usd < 100000 THEN 'medio' WHEN precio_usd < 150000 THEN 'alto' ELSE 'premium' END AS clase, count(*) AS n FROM propiedades WHERE precio_usd IS NOT NULL GROUP BY 1")
def price_class(spark, sf):
    clase = F.when(precio() < 50_000, "económico").when(precio() < 100_000, "medio").when(precio() < 150_000, "alto").otherwise("premium")
    return propiedades(spark, sf).where(precio().isNotNull()).groupBy(clase.alias("clase")).agg(F.count("*").alias("n"))


@query("a04_first_zones", "SELECT zona, count(*) AS n FROM propiedades GROUP BY zona ORDER BY zona LIMIT 10")
def first_zones(spark, sf):
    return propiedades(spark, sf).groupBy("zona").agg(F.count("*").alias("n")).orderBy("zona").limit(10)


@query("a05_inverted_index", "SELECT zona, tipo, proveedor, count(*) AS n, min(id) AS primera FROM propiedades GROUP BY zona, tipo, proveedor")
def inverted(spark, sf):
    return propiedades(spark, sf).groupBy("zona", "tipo", "proveedor").agg(F.count("*").alias("n"), F.min("id").alias("primera"))


@query("a06_zone_price_per_m2", "SELECT zona, count(*) AS n, round(avg(precio_usd), 2) AS media, round(sum(CASE WHEN superficie > 0 THEN precio_usd END) / sum(CASE WHEN precio_usd > 0 AND superficie > 0 THEN superficie END), 2) AS por_m2 FROM propiedades GROUP BY zona")
def per_m2(spark, sf):
    return propiedades(spark, sf).groupBy("zona").agg(F.count("*").alias("n"), r2(F.avg(precio())).alias("media"), r2(F.sum(F.when(superficie() > 0, precio())) / F.sum(F.when((precio() > 0) & (superficie() > 0), superficie()))).alias("por_m2"))


@query("a06_compare_zones", "z AS (SELECT unnest(['nation_1', 'nation_22', 'xx']) AS pedida) SELECT pedida, count(p.id) AS n, round(avg(precio_usd), 2) AS media FROM z LEFT JOIN (SELECT id, concat(zona, '') AS zona, precio_usd FROM propiedades) p ON contains(lower(p.zona), pedida) GROUP BY pedida")
def compare(spark, sf):
    asked = F.explode(F.array(*[F.lit(z) for z in ("nation_1", "nation_22", "xx")])).alias("pedida")
    p = propiedades(spark, sf).select("id", "zona", precio(), asked).where(F.lower("zona").contains(F.col("pedida")))
    n = p.groupBy("pedida").agg(F.count("*").alias("n"), r2(F.avg(precio())).alias("media"))
    return spark.createDataFrame([("nation_1",), ("nation_22",), ("xx",)], "pedida string").join(n, "pedida", "left").na.fill(0, ["n"])


@query("a07_zone_analysis", "SELECT zona, count(*) AS n, round(avg(precio_usd), 2) AS precio, min(precio_usd) AS desde, max(precio_usd) AS hasta, round(avg(superficie), 2) AS superficie, round(avg(dormitorios), 4) AS dormitorios FROM propiedades GROUP BY zona")
def zone_analysis(spark, sf):
    return propiedades(spark, sf).groupBy("zona").agg(F.count("*").alias("n"), r2(F.avg(precio())).alias("precio"), F.min(precio()).alias("desde"), F.max(precio()).alias("hasta"), r2(F.avg(superficie())).alias("superficie"), F.round(F.avg("dormitorios"), 4).alias("dormitorios"))


@query("a10_price_spread", "SELECT zona, tipo, round(stddev_samp(precio_usd), 2) AS desviacion, round(avg(precio_usd) / stddev_samp(precio_usd), 4) AS razon FROM propiedades GROUP BY zona, tipo HAVING count(precio_usd) > 1")
def spread(spark, sf):
    g = propiedades(spark, sf).groupBy("zona", "tipo").agg(F.count(precio()).alias("n"), F.stddev_samp(precio()).alias("d"), F.avg(precio()).alias("m")).where("n > 1")
    return g.select("zona", "tipo", r2("d").alias("desviacion"), F.round(F.col("m") / F.col("d"), 4).alias("razon"))


@query("a12_repeated_urls", "SELECT url, count(*) AS n, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id) AS ids FROM propiedades WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1")
def repeated(spark, sf):
    return propiedades(spark, sf).where("url is not null").groupBy("url").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("ids")).where("n > 1")


@query("a13_similar_prices", "SELECT zona, CAST(round(precio_usd / 1000) AS BIGINT) AS miles, count(*) AS n FROM propiedades WHERE precio_usd IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def similar_prices(spark, sf):
    return propiedades(spark, sf).where(precio().isNotNull()).groupBy("zona", F.round(precio() / 1000).cast("long").alias("miles")).agg(F.count("*").alias("n")).where("n > 1")


@query("a14_duplicate_count", "SELECT count(*) - count(DISTINCT concat_ws('|', titulo, zona)) AS duplicados FROM propiedades")
def duplicate_count(spark, sf):
    return propiedades(spark, sf).agg((F.count("*") - F.count_distinct(F.concat_ws("|", "titulo", "zona"))).alias("duplicados"))


@query("a15_providers", "SELECT proveedor, count(*) AS n FROM propiedades GROUP BY proveedor ORDER BY n DESC, proveedor")
def providers(spark, sf):
    return propiedades(spark, sf).groupBy("proveedor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "proveedor")


@query("a16_service_summary", "SELECT categoria, count(*) AS n, count(lat) AS con_coordenadas, round(100.0 * count(lat) / count(*), 2) AS porcentaje FROM servicios GROUP BY categoria")
def service_summary(spark, sf):
    return servicios(spark, sf).groupBy("categoria").agg(F.count("*").alias("n"), F.count("lat").alias("con_coordenadas"), r2(100.0 * F.count("lat") / F.count("*")).alias("porcentaje"))


@query("a17_subtypes", "SELECT categoria, array_to_string(list_sort(list_distinct(list(concat(fuente, '')))), ',') AS fuentes FROM servicios GROUP BY categoria")
def subtypes(spark, sf):
    return servicios(spark, sf).groupBy("categoria").agg(F.array_join(F.sort_array(F.collect_set("fuente")), ",").alias("fuentes"))


@query("a18_zone_coverage", "SELECT zona, count(*) AS n, count(*) FILTER (WHERE lat IS NOT NULL) AS con_coordenadas, count(DISTINCT tipo) AS tipos, round(avg(precio_usd) FILTER (WHERE precio_usd > 0), 0) AS media FROM propiedades GROUP BY zona")
def zone_coverage(spark, sf):
    return propiedades(spark, sf).groupBy("zona").agg(F.count("*").alias("n"), F.count("lat").alias("con_coordenadas"), F.count_distinct("tipo").alias("tipos"), F.round(F.avg(F.when(precio() > 0, precio())), 0).alias("media"))


@query("a18_refreshed_coverage", "SELECT zona, count(*) AS n, count(*) FILTER (WHERE lat IS NOT NULL) AS con_coordenadas, count(DISTINCT tipo) AS tipos, round(avg(precio_usd) FILTER (WHERE precio_usd > 0), 0) AS media FROM propiedades WHERE id % 9 <> 0 GROUP BY zona")
def refreshed_coverage(spark, sf):
    """The coverage of A18 after changes: first entries of two thirds, wrong prices corrected, the rest added, some deleted."""
    p = propiedades(spark, sf).select("id", "zona", "tipo", "lat", "precio_usd")
    first = p.where("id % 3 <> 0").withColumn("precio_usd", F.when(F.col("id") % 7 == 0, precio() * 10).otherwise(precio()))
    folder = f"{scratch_folder(spark)}/zone-coverage-{uuid.uuid4().hex}"
    incremental.create(incremental.counted(first.unionByName(p.where("id % 9 = 0"))), folder)
    wrong, right = first.where("id % 7 = 0"), p.where("id % 3 <> 0 and id % 7 = 0")
    incremental.refresh(spark, folder, incremental.changes(wrong, right))
    incremental.refresh(spark, folder, incremental.changes(p.where("id % 9 = 0"), p.where("id % 3 = 0 and id % 9 <> 0")))
    return incremental.coverage(incremental.read(spark, folder))


@query("a19_top_agents", "SELECT a.id, count(p.id) AS n, round(avg(p.precio_usd), 2) AS media, count(DISTINCT p.zona) AS zonas FROM agentes a LEFT JOIN propiedades p ON p.agente_id = a.id GROUP BY a.id HAVING count(p.id) > 0 ORDER BY n DESC, a.id LIMIT 10")
def top_agents(spark, sf):
    p = propiedades(spark, sf).select("agente_id", F.col("id").alias("pid"), "precio_usd", "zona")
    g = agentes(spark, sf).select("id").join(p, F.col("id") == F.col("agente_id"), "left").groupBy("id").agg(F.count("pid").alias("n"), r2(F.avg(precio())).alias("media"), F.count_distinct("zona").alias("zonas"))
    return g.where("n > 0").orderBy(F.desc("n"), "id").limit(10)


@query("a20_repeated_url_total", "SELECT count(*) AS urls, CAST(coalesce(sum(n), 0) AS BIGINT) AS filas FROM (SELECT url, count(*) AS n FROM propiedades WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1)")
def repeated_total(spark, sf):
    g = propiedades(spark, sf).where("url is not null").groupBy("url").agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("urls"), F.coalesce(F.sum("n"), F.lit(0)).alias("filas"))


AUDIT = "auditoria AS (SELECT count(*) AS total, count(lat) AS con_coordenadas, count(precio_usd) AS con_precio, count(url) AS con_url, count(*) FILTER (WHERE superficie > 0) AS con_superficie, count(*) FILTER (WHERE precio_usd < 10000) AS baratas, count(DISTINCT zona) AS zonas, count(DISTINCT tipo) AS tipos, round(100.0 * count(lat) / count(*), 2) AS pct_coordenadas, round(100.0 * count(precio_usd) / count(*), 2) AS pct_precio FROM propiedades)"


def audit(df):
    pct = lambda c: r2(100.0 * F.count(c) / F.count("*"))
    return df.agg(
        F.count("*").alias("total"), F.count("lat").alias("con_coordenadas"), F.count("precio_usd").alias("con_precio"), F.count("url").alias("con_url"), F.count_if(superficie() > 0).alias("con_superficie"),
        F.count_if(precio() < 10_000).alias("baratas"), F.count_distinct("zona").alias("zonas"), F.count_distinct("tipo").alias("tipos"), pct("lat").alias("pct_coordenadas"), pct("precio_usd").alias("pct_precio"),
    )


@query("a21_quality_audit", f"{AUDIT} SELECT * FROM auditoria")
def quality_audit(spark, sf):
    return audit(propiedades(spark, sf))


@query("a22_quality_score", f"{AUDIT} SELECT CAST(CASE WHEN pct_coordenadas >= 95 THEN 40 WHEN pct_coordenadas >= 80 THEN 25 ELSE 10 END + CASE WHEN pct_precio >= 95 THEN 40 WHEN pct_precio >= 80 THEN 25 ELSE 10 END + CASE WHEN zonas >= 5 THEN 20 ELSE 0 END AS INTEGER) AS puntaje FROM auditoria")
def quality_score(spark, sf):
    level = lambda c: F.when(F.col(c) >= 95, 40).when(F.col(c) >= 80, 25).otherwise(10)
    return audit(propiedades(spark, sf)).select((level("pct_coordenadas") + level("pct_precio") + F.when(F.col("zonas") >= 5, 20).otherwise(0)).alias("puntaje"))


@query("a23_file_quality", "SELECT archivo, count(*) AS filas, CASE WHEN ok >= 90 THEN 'EXCELENTE' WHEN ok >= 70 THEN 'ACEPTABLE' WHEN ok >= 50 THEN 'NECESITA_REVISION' ELSE 'PROBLEMAS_GRAVES' END AS nivel FROM (SELECT archivo, 100.0 * count(*) FILTER (WHERE coalesce(zona, '') <> '' AND tipo IS NOT NULL AND precio NOT IN ('nan', 'no válido')) OVER (PARTITION BY archivo) / count(*) OVER (PARTITION BY archivo) AS ok FROM crudos) GROUP BY archivo, ok")
def file_quality(spark, sf):
    good = F.count_if((F.coalesce("zona", F.lit("")) != "") & F.col("tipo").isNotNull() & ~F.col("precio").isin("nan", "no válido"))
    g = crudos(spark, sf).groupBy("archivo").agg(F.count("*").alias("filas"), (100.0 * good / F.count("*")).alias("ok"))
    return g.select("archivo", "filas", F.when(F.col("ok") >= 90, "EXCELENTE").when(F.col("ok") >= 70, "ACEPTABLE").when(F.col("ok") >= 50, "NECESITA_REVISION").otherwise("PROBLEMAS_GRAVES").alias("nivel"))


@query("a24_consolidated_totals", "SELECT CAST(sum(filas) AS BIGINT) AS filas, CAST(sum(errores) AS BIGINT) AS errores, count(*) AS archivos FROM (SELECT archivo, count(*) AS filas, count(*) FILTER (WHERE precio IN ('nan', 'no válido')) AS errores FROM crudos GROUP BY archivo)")
def totals(spark, sf):
    g = crudos(spark, sf).groupBy("archivo").agg(F.count("*").alias("filas"), F.count_if(F.col("precio").isin("nan", "no válido")).alias("errores"))
    return g.agg(F.sum("filas").alias("filas"), F.sum("errores").alias("errores"), F.count("*").alias("archivos"))


@query("a25_market_analysis", "SELECT tipo, count(*) AS n, round(avg(precio_usd), 2) AS media, min(precio_usd) AS desde, max(precio_usd) AS hasta FROM propiedades WHERE contains(lower(zona), 'nation_1') AND precio_usd > 0 GROUP BY tipo ORDER BY n DESC, tipo")
def market(spark, sf):
    return propiedades(spark, sf).where(F.lower("zona").contains("nation_1") & (precio() > 0)).groupBy("tipo").agg(F.count("*").alias("n"), r2(F.avg(precio())).alias("media"), F.min(precio()).alias("desde"), F.max(precio()).alias("hasta")).orderBy(F.desc("n"), "tipo")


@query("a26_dataset_rules", "z AS (SELECT count(*) AS n FROM propiedades GROUP BY zona), c AS (SELECT count(*) AS n FROM propiedades WHERE lat IS NOT NULL GROUP BY round(lat, 6), round(lng, 6)) SELECT count(*) FILTER (WHERE precio_usd IS NOT NULL) * 20 >= count(*) AS precio_lleno, count(*) FILTER (WHERE precio_usd < 0) = 0 AS sin_negativos, count(DISTINCT zona) >= 5 AS zonas_suficientes, (SELECT max(n) FROM z) * 2 < count(*) AS sin_monopolio, count(DISTINCT tipo) < 50 AS pocos_tipos, count(DISTINCT id) = count(*) AS ids_unicos, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM c) AS coordenadas_repetidas FROM propiedades")
def rules(spark, sf):
    p = propiedades(spark, sf)
    largest = p.groupBy("zona").agg(F.count("*").alias("n")).agg(F.max("n").alias("mayor"))
    repeated = p.where("lat is not null").groupBy(F.round("lat", 6), F.round("lng", 6)).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("coordenadas_repetidas"))
    one = p.agg((F.count(precio()) * 20 >= F.count("*")).alias("precio_lleno"), (F.count_if(precio() < 0) == 0).alias("sin_negativos"), (F.count_distinct("zona") >= 5).alias("zonas_suficientes"), F.count("*").alias("todas"), (F.count_distinct("tipo") < 50).alias("pocos_tipos"), (F.count_distinct("id") == F.count("*")).alias("ids_unicos"))
    joined = one.join(largest, F.lit(True)).join(repeated, F.lit(True))  # one row each
    return joined.select("precio_lleno", "sin_negativos", "zonas_suficientes", (F.col("mayor") * 2 < F.col("todas")).alias("sin_monopolio"), "pocos_tipos", "ids_unicos", "coordenadas_repetidas")


@query("a27_price_outliers", "q AS (SELECT quantile_cont(precio_usd, 0.25) AS q1, quantile_cont(precio_usd, 0.75) AS q3 FROM propiedades WHERE precio_usd <> 0) SELECT id, precio_usd FROM propiedades, q WHERE precio_usd <> 0 AND (precio_usd < q1 - 1.5 * (q3 - q1) OR precio_usd > q3 + 1.5 * (q3 - q1))")
def outliers(spark, sf):
    return price_outliers(propiedades(spark, sf).select("id", "precio_usd").where(precio() != 0))


def price_outliers(p, factor=1.5):
    """Rows with a price further than ``factor`` times the middle half's width from that half."""
    q1, q3 = exact_quantiles(p, "precio_usd", [0.25, 0.75]) or (0.0, 0.0)
    return p.where((precio() < q1 - factor * (q3 - q1)) | (precio() > q3 + factor * (q3 - q1)))


COMPLETE = "(CASE WHEN titulo <> '' THEN 20 ELSE 0 END + CASE WHEN precio_usd > 0 THEN 25 ELSE 0 END + CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN superficie > 0 THEN 15 ELSE 0 END + CASE WHEN url IS NOT NULL THEN 10 ELSE 0 END)"


@query("a28_completeness", f"SELECT zona, round(avg({COMPLETE}), 4) AS completitud, CAST(min({COMPLETE}) AS INTEGER) AS peor FROM propiedades GROUP BY zona")
def completeness(spark, sf):
    parts = [(F.col("titulo") != "", 20), (precio() > 0, 25), (F.col("lat").isNotNull() & F.col("lng").isNotNull(), 30), (superficie() > 0, 15), (F.col("url").isNotNull(), 10)]
    score = sum((F.when(c, w).otherwise(0) for c, w in parts), F.lit(0))
    return propiedades(spark, sf).groupBy("zona").agg(F.round(F.avg(score), 4).alias("completitud"), F.min(score).alias("peor"))


@query("a29_agent_merge", "SELECT clave, count(*) AS n, arg_min(telefono, id) FILTER (WHERE telefono IS NOT NULL) AS telefono, arg_min(empresa, id) AS empresa FROM (SELECT *, lower(trim(substr(nombre, 1, 16))) AS clave FROM agentes) GROUP BY clave")
def agent_merge(spark, sf):
    return merged_agents(agentes(spark, sf), F.substring("nombre", 1, 16))


def merged_agents(agents, name):
    """Agents of one normalised name as one, with the first phone and company."""
    a = agents.withColumn("clave", F.lower(F.trim(name)))
    return a.groupBy("clave").agg(F.count("*").alias("n"), F.min_by("telefono", F.when(F.col("telefono").isNotNull(), F.col("id"))).alias("telefono"), F.min_by("empresa", "id").alias("empresa"))


@query("a29_agent_merge_names", "SELECT clave, count(*) AS n, arg_min(telefono, id) FILTER (WHERE telefono IS NOT NULL) AS telefono, arg_min(empresa, id) AS empresa FROM (SELECT *, lower(trim(nombre)) AS clave FROM agentes) GROUP BY clave")
def agent_merge_names(spark, sf):
    return merged_agents(agentes(spark, sf), F.col("nombre"))


@query("a31_reconciliation", "SELECT 'propiedades' AS tabla, count(*) AS esperadas, count(DISTINCT id) AS cargadas FROM propiedades UNION ALL SELECT 'servicios', count(*), count(DISTINCT id) FROM servicios UNION ALL SELECT 'agentes', count(*), count(DISTINCT id) FROM agentes")
def reconciliation(spark, sf):
    parts = [f(spark, sf).agg(F.count("*").alias("esperadas"), F.count_distinct("id").alias("cargadas")).select(F.lit(n).alias("tabla"), "esperadas", "cargadas") for n, f in (("propiedades", propiedades), ("servicios", servicios), ("agentes", agentes))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a32_migration_status", "SELECT count(*) FILTER (WHERE estado = 'exito') AS correctas, count(*) FILTER (WHERE estado = 'error') AS errores, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ultima FROM metricas")
def migration_status(spark, sf):
    return metricas(spark, sf).agg(F.count_if(F.col("estado") == "exito").alias("correctas"), F.count_if(F.col("estado") == "error").alias("errores"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("ultima"))


@query("a33_error_rate", "SELECT proveedor, round(100.0 * count(*) FILTER (WHERE estado = 'error') / count(*), 4) AS tasa FROM metricas GROUP BY proveedor")
def error_rate(spark, sf):
    return metricas(spark, sf).groupBy("proveedor").agg(F.round(100.0 * F.count_if(F.col("estado") == "error") / F.count("*"), 4).alias("tasa"))


@query("a34_scorecard", "SELECT count(*) AS n, round(100.0 * count(lat) / count(*), 2) AS coordenadas, round(100.0 * count(precio_usd) / count(*), 2) AS precios, CAST(CASE WHEN count(*) > 100 THEN 25 ELSE 0 END + CASE WHEN count(lat) * 10 >= count(*) * 9 THEN 25 ELSE 0 END + CASE WHEN count(precio_usd) * 10 >= count(*) * 9 THEN 25 ELSE 0 END + CASE WHEN count(DISTINCT zona) >= 5 THEN 25 ELSE 0 END AS INTEGER) AS puntaje FROM propiedades")
def scorecard(spark, sf):
    n = F.count("*")
    tests = [n > 100, F.count("lat") * 10 >= n * 9, F.count("precio_usd") * 10 >= n * 9, F.count_distinct("zona") >= 5]
    return propiedades(spark, sf).agg(n.alias("n"), r2(100.0 * F.count("lat") / n).alias("coordenadas"), r2(100.0 * F.count("precio_usd") / n).alias("precios"), sum((F.when(t, 25).otherwise(0) for t in tests), F.lit(0)).alias("puntaje"))


@query("a35_service_quality", "SELECT categoria, count(*) AS n, count(*) FILTER (WHERE nombre IS NOT NULL AND nombre <> '') AS con_nombre, count(lat) AS con_coordenadas FROM servicios GROUP BY categoria")
def service_quality(spark, sf):
    return servicios(spark, sf).groupBy("categoria").agg(F.count("*").alias("n"), F.count_if(F.col("nombre").isNotNull() & (F.col("nombre") != "")).alias("con_nombre"), F.count("lat").alias("con_coordenadas"))


@query("a36_coverage_probe", "SELECT archivo, count(*) AS n, min(id) AS primera, max(id) AS ultima FROM crudos GROUP BY archivo")
def probe(spark, sf):
    return crudos(spark, sf).groupBy("archivo").agg(F.count("*").alias("n"), F.min("id").alias("primera"), F.max("id").alias("ultima"))


@query("p02_backfill_count", "SELECT count(*) FILTER (WHERE lat IS NULL) AS completadas, round(avg(coalesce(lat, -17.7833)), 4) AS lat FROM propiedades")
def backfill(spark, sf):
    return propiedades(spark, sf).agg(F.count_if(F.col("lat").isNull()).alias("completadas"), F.round(F.avg(F.coalesce("lat", F.lit(schema.DEFAULT_LAT))), 4).alias("lat"))


@query("p04_coordinate_validity", "SELECT zona, count(*) FILTER (WHERE lat BETWEEN -18.5 AND -17.5 AND lng BETWEEN -63.5 AND -63.0) AS validas, count(*) FILTER (WHERE NOT coalesce(lat BETWEEN -18.5 AND -17.5 AND lng BETWEEN -63.5 AND -63.0, false)) AS invalidas FROM propiedades GROUP BY zona")
def validity(spark, sf):
    ok = F.coalesce(in_box(F.col("lat"), F.col("lng"), schema.BOX_LOAD), F.lit(False))
    return propiedades(spark, sf).groupBy("zona").agg(F.count_if(ok).alias("validas"), F.count_if(~ok).alias("invalidas"))
