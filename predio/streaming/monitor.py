"""Metrics of pipeline runs: the same expressions for tables and for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRICS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the event files of a folder, as metrics."""
    raw = spark.readStream.schema(METRICS).parquet(folder)
    return raw.select("event_id", "ts", (F.col("user_id") % 5).alias("proveedor"), F.when(F.col("event_type") == "error", "error").otherwise("exito").alias("estado"), F.col("value").alias("duracion"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))


def provider_totals(metrics: DataFrame) -> DataFrame:
    """Count, success rate, mean duration and tokens of each provider."""
    success = F.round(100.0 * F.count_if(F.col("estado") == "exito") / F.count("*"), 4)
    return metrics.groupBy("proveedor").agg(F.count("*").alias("n"), success.alias("exito"), F.round(F.avg("duracion"), 4).alias("duracion"), F.sum("tokens").alias("tokens"))


def hourly(metrics: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts, mean duration, states and runs a minute by hour; over a stream, rows later than ``late`` are left out.

    Runs a minute count from an hour's first run to its end, a minute at least.
    """
    source = metrics.withWatermark("ts", late) if metrics.isStreaming else metrics
    state = lambda s: F.count_if(F.col("estado") == s)
    by_hour = source.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("duracion"), 4).alias("duracion"), state("exito").alias("exitos"), state("error").alias("errores"), F.min("ts").alias("desde"))
    minutes = F.greatest(F.lit(1.0), (F.unix_timestamp("w.end") - F.unix_timestamp(F.date_trunc("second", "desde"))) / 60.0)
    return by_hour.select(F.col("w.start").alias("hora"), "n", "duracion", "exitos", "errores", F.round(F.col("n") / minutes, 4).alias("por_minuto"))


def running(metrics: DataFrame, **sums: Column) -> DataFrame:
    """``metrics`` with running sums of each provider, by time and event.

    Hours are summed first and added up in turn, which takes a row for each
    provider and hour; rows are then run through within their hour alone, so
    that no task holds a whole provider.
    """
    hour, who = F.coalesce(F.date_trunc("hour", "ts"), F.lit("0001-01-01").cast("timestamp")), F.coalesce(F.col("proveedor").cast("string"), F.lit(""))
    rows = metrics.withColumns({"_hora": hour, "_quien": who, **{f"_{k}": v for k, v in sums.items()}})
    earlier = Window.partitionBy("_quien").orderBy("_hora").rowsBetween(Window.unboundedPreceding, -1)
    hours = rows.groupBy("_quien", "_hora").agg(*[F.sum(f"_{k}").alias(f"_en_{k}") for k in sums])
    before = hours.select("_quien", "_hora", *[F.coalesce(F.sum(f"_en_{k}").over(earlier), F.lit(0)).alias(f"_antes_{k}") for k in sums])
    within = Window.partitionBy("_quien", "_hora").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(before, ["_quien", "_hora"])
    return joined.select(*metrics.columns, *[(F.col(f"_antes_{k}") + F.coalesce(F.sum(f"_{k}").over(within), F.lit(0))).alias(k) for k in sums])


#: Kinds of alerts and how grave they are.
LEVELS = {"tasa": "ALTO", "duracion": "MEDIO", "costo": "ALTO"}


def alerts_in_full(metrics: DataFrame, min_rate: float = 90, min_events: int = 10, max_seconds: float = 30, max_cost: float = 50, token_cost: float = 0.01) -> DataFrame:
    """(event_id, ts, proveedor, alerta, nivel): a provider's running success rate too low, a run too long, a provider's running cost too high."""
    one = F.lit(1)
    rows = running(metrics, _n=one, _bien=F.when(F.col("estado") == "exito", 1).otherwise(0), _gasto=F.col("tokens"))
    found = F.array_compact(
        F.array(
            F.when((F.col("_n") >= min_events) & (100.0 * F.col("_bien") / F.col("_n") < min_rate), "tasa"), F.when(F.col("duracion") > max_seconds, "duracion"),
            F.when(F.col("_gasto") * token_cost > max_cost, "costo"),
        )
    )
    level = F.create_map(*[F.lit(v) for pair in LEVELS.items() for v in pair])
    return rows.select("event_id", "ts", "proveedor", F.explode(found).alias("alerta")).withColumn("nivel", level[F.col("alerta")])


def alerts(metrics: DataFrame, **limits: float) -> DataFrame:
    """(event_id, alerta) of ``alerts_in_full``."""
    return alerts_in_full(metrics, **limits).select("event_id", "alerta")


def active_alerts(metrics: DataFrame, hours: int = 24, **limits: float) -> DataFrame:
    """Alerts of the last ``hours`` before the latest run."""
    last = metrics.agg(F.max("ts").alias("ultima"))
    return alerts_in_full(metrics, **limits).join(F.broadcast(last)).where(F.col("ts") > F.col("ultima") - F.expr(f"INTERVAL {hours} HOURS")).drop("ultima")  # one row


def system_state(rate: Column, grave: Column) -> Column:
    """By success rate and number of grave alerts."""
    return F.when((rate >= 95) & (grave == 0), "EXCELENTE").when((rate >= 90) & (grave <= 2), "BUENO").when((rate >= 80) & (grave <= 5), "ACEPTABLE").otherwise("REQUIERE_ATENCION")


# What is recommended, in its order.
ADVICE = (
    "Revisar estrategia del Proveedor %s - tasa de éxito baja", "Optimizar procesamiento del Proveedor %s - tiempo promedio alto", "Considerar optimizar el uso de IA para reducir costos",
    "Investigar causas de alertas críticas frecuentes", "Sistema funcionando dentro de parámetros normales",
)


def recommendations(metrics: DataFrame, min_rate: float = 90, max_seconds: float = 20, max_cost: float = 10, max_grave: int = 5, token_cost: float = 0.01) -> DataFrame:
    """(orden, consejo): per provider a low success rate and long runs, then the whole cost, many grave alerts, or that all is normal."""
    totals = provider_totals(metrics)
    of_provider = lambda i, rule: totals.where(rule).select(F.lit(i + 1).alias("orden"), F.format_string(ADVICE[i], F.col("proveedor").cast("string")).alias("consejo"))
    of_all = lambda i, df: df.select(F.lit(i + 1).alias("orden"), F.lit(ADVICE[i]).alias("consejo"))
    cost = totals.agg(F.sum("tokens").alias("n")).where(F.col("n") * token_cost > max_cost)
    grave = alerts_in_full(metrics).where("nivel = 'ALTO'").agg(F.count("*").alias("n")).where(F.col("n") > max_grave)
    found = of_provider(0, F.col("exito") < min_rate).unionByName(of_provider(1, F.col("duracion") > max_seconds)).unionByName(of_all(2, cost)).unionByName(of_all(3, grave))
    return found.unionByName(of_all(4, found.agg(F.count("*").alias("n")).where("n = 0")))


def _exceeded(rows, n, good, spent):
    """Alerts (event_id, ts, alerta) of a provider's next runs, and its counts after them; runs go by time and event."""
    import numpy as np
    import pandas as pd

    rows = rows.sort_values(["ts", "event_id"], ignore_index=True)
    count = n + np.arange(1, len(rows) + 1)
    right = good + (rows["estado"] == "exito").to_numpy().cumsum()
    cost = spent + rows["tokens"].fillna(0).to_numpy(dtype=np.int64).cumsum()
    found = {"tasa": (count >= 10) & (100 * right < 90 * count), "duracion": (rows["duracion"] > 30).to_numpy(), "costo": cost * 0.01 > 50}
    alerts = pd.concat([rows.loc[hit, ["event_id", "ts"]].assign(alerta=kind) for kind, hit in found.items()])
    return alerts.sort_values(["ts", "event_id"], kind="stable"), (int(count[-1]), int(right[-1]), int(cost[-1]))


def _alert_state(key, frames, state):
    """Running success and cost of one provider over the micro-batches."""
    import pandas as pd

    found, counts = _exceeded(pd.concat(list(frames)), *(state.get if state.exists else (0, 0, 0)))
    state.update(counts)
    yield found[["event_id", "alerta"]]


def streamed_alerts(metrics: DataFrame) -> DataFrame:
    """``alerts`` with the running counts of each provider kept as state.

    Runs are taken in the order of their time within a micro-batch, and
    micro-batches in the order in which they come: a run that comes late counts
    when it comes.  State is one row a provider and is kept for good.
    """
    return metrics.groupBy("proveedor").applyInPandasWithState(_alert_state, "event_id long, alerta string", "n long, good long, spent long", "append", "NoTimeout")


def _log_state(hours: int, most: int):
    span = hours * 3600 * 1_000_000

    def run(key, frames, state):
        import pandas as pd

        *counts, ids, times, kinds = state.get if state.exists else (0, 0, 0, [], [], [])
        counts, log = tuple(counts), pd.DataFrame({"event_id": ids, "at": times, "alerta": kinds})
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            new, counts = _exceeded(rows, *counts)
            at = pd.to_datetime(new["ts"]).astype("datetime64[us]").astype("int64")
            log = pd.concat([log, new.assign(at=at)[["event_id", "at", "alerta"]]]) if len(log) else new.assign(at=at)[["event_id", "at", "alerta"]]
            latest = int(pd.to_datetime(rows["ts"]).max().to_datetime64().astype("datetime64[us]").astype("int64"))
        else:
            latest = state.getCurrentWatermarkMs() * 1000
        latest = max([latest, *log["at"].tolist()[-1:]]) if not state.hasTimedOut else latest
        log = log[log["at"] > latest - span].sort_values(["at", "event_id"], kind="stable").tail(most)
        state.update((*counts, log["event_id"].tolist(), log["at"].tolist(), log["alerta"].tolist()))
        if len(log):
            # the log is looked at again when its oldest alert is too old
            state.setTimeoutTimestamp(max(int(log["at"].iloc[0] + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"proveedor": [key[0]], "alertas": [len(log)], "ultimas": [[f"{i}:{k}" for i, k in zip(log["event_id"], log["alerta"], strict=True)]]})

    return run


def streamed_alert_log(metrics: DataFrame, hours: int = 24, most: int = 100, late: str = "2 hours") -> DataFrame:
    """(proveedor, alertas, ultimas) whenever a provider's alert log changes: its alerts of the last ``hours``, the last ``most`` of them.

    State holds the running counts and the log alone.  An alert leaves when it
    is older than ``hours`` before the provider's latest run, or before the
    watermark if no run comes: a timer then brings the shorter log.
    """
    state = "n long, good long, spent long, ids array<long>, times array<long>, kinds array<string>"
    return metrics.withWatermark("ts", late).groupBy("proveedor").applyInPandasWithState(_log_state(hours, most), "proveedor long, alertas long, ultimas array<string>", state, "update", "EventTimeTimeout")


def _pair_state(most_seconds: int):
    def run(key, frames, state):
        import pandas as pd

        start, end, told = state.get if state.exists else (None, None, False)
        out = []
        if state.hasTimedOut:
            if not told:
                out.append((start, end, "sin fin" if end is None else "sin inicio"))
            state.remove()
        else:
            rows = pd.concat(list(frames))
            micros = pd.to_datetime(rows["ts"]).astype("datetime64[us]").astype("int64")
            starts, ends = micros[(rows["tipo"] == "inicio").to_numpy()], micros[(rows["tipo"] == "fin").to_numpy()]
            if not told:  # what comes after a pair was told is a repetition
                start = min([x for x in (start, *starts.tolist()) if x is not None], default=None)
                end = min([x for x in (end, *ends.tolist()) if x is not None], default=None)
                if start is not None and end is not None:
                    told = True
                    out.append((start, end, "completa"))
            state.update((start, end, told))
            wake = int(micros.max()) // 1000 + most_seconds * 1000
            state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        stamp = lambda v: pd.NaT if v is None else pd.Timestamp(v, unit="us")
        told_rows = [(key[0], stamp(a), stamp(b), None if a is None or b is None else (b - a) / 1e6, how) for a, b, how in out]
        frame = pd.DataFrame(told_rows, columns=["operacion", "inicio", "fin", "segundos", "estado"])
        yield frame.astype({"inicio": "datetime64[us]", "fin": "datetime64[us]", "segundos": "float64"})

    return run


def streamed_durations(marks: DataFrame, most_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(operacion, inicio, fin, segundos, estado) of operations whose start and finish come as rows (operacion, tipo, ts) of a stream.

    ``tipo`` is inicio or fin.  A pair is told once, as soon as both are there,
    in whichever order; repeated marks change nothing.  Where ``most_seconds``
    after the last mark the other one has not come, the operation is told as
    "sin fin" or "sin inicio".  State is one small row for each operation of
    the time that ``late`` and ``most_seconds`` span, and goes when its timer does.
    """
    source = marks.where("operacion is not null and tipo in ('inicio', 'fin') and ts is not null").withWatermark("ts", late)
    schema = "operacion string, inicio timestamp, fin timestamp, segundos double, estado string"
    return source.groupBy("operacion").applyInPandasWithState(_pair_state(most_seconds), schema, "start long, end long, told boolean", "append", "EventTimeTimeout")


def error_kind(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("timeout"), "tiempo").when(low.contains("429"), "limite").when(low.rlike(r"\b5\d\d\b"), "servidor").otherwise("otro")
