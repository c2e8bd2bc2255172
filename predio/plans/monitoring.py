"""Pipeline metrics in batch; ``predio.streaming`` has the same over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from predio.plans.registry import query
from predio.sources.views import metricas
from predio.streaming import monitor


@query("m01_paired_durations", "p AS (SELECT proveedor, event_id // 2 AS par, min(ts) AS inicio, max(ts) AS fin, count(*) AS n FROM metricas GROUP BY 1, 2) SELECT proveedor, count(*) AS pares, CAST(sum(date_diff('second', inicio, fin)) AS BIGINT) AS segundos FROM p WHERE n = 2 GROUP BY proveedor")
def paired(spark, sf):
    p = metricas(spark, sf).groupBy("proveedor", F.floor(F.col("event_id") / 2).alias("par")).agg(F.min("ts").alias("inicio"), F.max("ts").alias("fin"), F.count("*").alias("n")).where("n = 2")
    seconds = F.unix_timestamp(F.date_trunc("second", "fin")) - F.unix_timestamp(F.date_trunc("second", "inicio"))
    return p.groupBy("proveedor").agg(F.count("*").alias("pares"), F.sum(seconds).alias("segundos"))


@query("m02_provider_totals", "SELECT proveedor, count(*) AS n, round(100.0 * count(*) FILTER (WHERE estado = 'exito') / count(*), 4) AS exito, round(avg(duracion), 4) AS duracion, CAST(sum(tokens) AS BIGINT) AS tokens FROM metricas GROUP BY proveedor")
def totals(spark, sf):
    return monitor.provider_totals(metricas(spark, sf))


@query("m03_hourly_window", "SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS hora, n, duracion, exitos, errores, round(n / greatest(1.0::DOUBLE, (3600 - date_diff('second', h, date_trunc('second', desde))) / 60.0::DOUBLE), 4) AS por_minuto FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n, round(avg(duracion), 4) AS duracion, count(*) FILTER (WHERE estado = 'exito') AS exitos, count(*) FILTER (WHERE estado = 'error') AS errores, min(ts) AS desde FROM metricas GROUP BY 1)")
def hourly(spark, sf):
    return monitor.hourly(metricas(spark, sf)).withColumn("hora", F.date_format("hora", "yyyy-MM-dd HH:mm:ss"))


ALERTS = """w AS (SELECT event_id, ts, proveedor, duracion, count(*) OVER v AS n, 100.0 * count(*) FILTER (WHERE estado = 'exito') OVER v / count(*) OVER v AS tasa, sum(tokens) OVER v AS gasto FROM metricas WINDOW v AS (PARTITION BY proveedor ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
avisos AS (SELECT event_id, ts, proveedor, 'tasa' AS alerta, 'ALTO' AS nivel FROM w WHERE n >= 10 AND tasa < 90 UNION ALL SELECT event_id, ts, proveedor, 'duracion', 'MEDIO' FROM w WHERE duracion > 30 UNION ALL SELECT event_id, ts, proveedor, 'costo', 'ALTO' FROM w WHERE gasto > 5000)"""


@query("m04_alerts", f"{ALERTS} SELECT event_id, alerta FROM avisos")
def alerts(spark, sf):
    return monitor.alerts(metricas(spark, sf))


@query("m04_active_alerts", f"{ALERTS} SELECT event_id, proveedor, alerta, nivel FROM avisos WHERE ts > (SELECT max(ts) FROM metricas) - INTERVAL 24 HOUR")
def active(spark, sf):
    return monitor.active_alerts(metricas(spark, sf)).drop("ts")


STATE = "CASE WHEN exito >= 95 AND graves = 0 THEN 'EXCELENTE' WHEN exito >= 90 AND graves <= 2 THEN 'BUENO' WHEN exito >= 80 AND graves <= 5 THEN 'ACEPTABLE' ELSE 'REQUIERE_ATENCION' END AS estado"


@query("m05_periodic_report", f"{ALERTS}, h AS (SELECT proveedor, CAST(hour(ts) AS INTEGER) AS hora, count(*) AS n FROM metricas GROUP BY 1, 2), p AS (SELECT proveedor, CAST(sum(n) AS BIGINT) AS n, arg_max(hora, n * 100 - hora) AS hora_pico FROM h GROUP BY proveedor), t AS (SELECT proveedor, 100.0::DOUBLE * count(*) FILTER (WHERE estado = 'exito') / count(*) AS exito FROM metricas GROUP BY proveedor), a AS (SELECT proveedor, count(*) AS alertas, count(*) FILTER (WHERE nivel = 'ALTO') AS graves FROM avisos GROUP BY proveedor) SELECT proveedor, n, hora_pico, round(exito, 4) AS exito, alertas, graves, {STATE} FROM (SELECT proveedor, n, hora_pico, exito, coalesce(alertas, 0) AS alertas, coalesce(graves, 0) AS graves FROM p JOIN t USING (proveedor) LEFT JOIN a USING (proveedor))")
def report(spark, sf):
    m = metricas(spark, sf)
    h = m.groupBy("proveedor", F.hour("ts").alias("hora")).agg(F.count("*").alias("n"), F.count_if(F.col("estado") == "exito").alias("bien"))
    p = h.groupBy("proveedor").agg(F.sum("n").alias("n"), F.max_by("hora", F.col("n") * 100 - F.col("hora")).alias("hora_pico"), (100.0 * F.sum("bien") / F.sum("n")).alias("exito"))
    a = monitor.alerts_in_full(m).groupBy("proveedor").agg(F.count("*").alias("alertas"), F.count_if(F.col("nivel") == "ALTO").alias("graves"))
    rows = p.join(a, "proveedor", "left").na.fill(0, ["alertas", "graves"])
    return rows.select("proveedor", "n", "hora_pico", F.round("exito", 4).alias("exito"), "alertas", "graves", monitor.system_state(F.col("exito"), F.col("graves")).alias("estado"))


@query("m06_minute_load", "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minuto, count(*) AS n, CASE WHEN count(*) < 5 THEN 'LENTO' WHEN count(*) > 100 THEN 'SOBRECARGA' ELSE 'NORMAL' END AS estado FROM metricas GROUP BY 1")
def load(spark, sf):
    m = metricas(spark, sf).groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return m.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("minuto"), "n", F.when(F.col("n") < 5, "LENTO").when(F.col("n") > 100, "SOBRECARGA").otherwise("NORMAL").alias("estado"))


@query("m07_recommendations", f"{ALERTS}, t AS (SELECT proveedor, round(100.0::DOUBLE * count(*) FILTER (WHERE estado = 'exito') / count(*), 4) AS exito, round(avg(duracion), 4) AS duracion, sum(tokens) AS tokens FROM metricas GROUP BY proveedor), c AS (SELECT 1 AS orden, proveedor AS de, 'Revisar estrategia del Proveedor ' || proveedor || ' - tasa de éxito baja' AS consejo FROM t WHERE exito < 90 UNION ALL SELECT 2, proveedor, 'Optimizar procesamiento del Proveedor ' || proveedor || ' - tiempo promedio alto' FROM t WHERE duracion > 20 UNION ALL SELECT 3, NULL, 'Considerar optimizar el uso de IA para reducir costos' FROM (SELECT sum(tokens) AS n FROM t) WHERE n * 0.01 > 10 UNION ALL SELECT 4, NULL, 'Investigar causas de alertas críticas frecuentes' FROM (SELECT count(*) AS n FROM avisos WHERE nivel = 'ALTO') WHERE n > 5) SELECT CAST(orden AS INTEGER) AS orden, consejo FROM c UNION ALL SELECT 5, 'Sistema funcionando dentro de parámetros normales' WHERE NOT EXISTS (SELECT 1 FROM c)")
def advice(spark, sf):
    return monitor.recommendations(metricas(spark, sf))


@query("x48_error_kinds", "SELECT clase, count(*) AS n FROM (SELECT CASE WHEN contains(texto, 'timeout') THEN 'tiempo' WHEN contains(texto, '429') THEN 'limite' WHEN regexp_matches(texto, '\\b5\\d\\d\\b') THEN 'servidor' ELSE 'otro' END AS clase FROM (SELECT CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN 'request timeout' WHEN 1 THEN 'HTTP 429' WHEN 2 THEN 'HTTP 503' ELSE '' END AS texto FROM metricas WHERE estado = 'error')) GROUP BY clase")
def errors(spark, sf):
    k = F.col("event_id") % 4
    text = F.when(k == 0, "request timeout").when(k == 1, "HTTP 429").when(k == 2, "HTTP 503").otherwise("")
    return metricas(spark, sf).where("estado = 'error'").groupBy(monitor.error_kind(text).alias("clase")).agg(F.count("*").alias("n"))
