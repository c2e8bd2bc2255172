"""Lead scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the factors, out of 20.
WEIGHTS = {"presupuesto": 20, "urgencia": 15, "necesidades": 15, "potencial": 12, "composicion": 10, "ubicacion": 8, "conocimiento": 7, "financiamiento": 8}
URGENCY = {"alta": 15, "media": 10, "baja": 5}
KNOWLEDGE = {"alto": 7, "medio": 5, "bajo": 3}
MARKET_MIN, MARKET_MAX = 50_000.0, 500_000.0
BASE = {"familia_grande": 12_000, "familia_pequena": 25_000, "pareja_sin_hijos": 20_000, "soltero": 8_000, "adultos_mayores": 6_000, "otro": 5_000}


def lookup(column: str, table: dict[str, int], other: int) -> Column:
    return F.coalesce(*[F.when(F.col(column) == k, v) for k, v in table.items()], F.lit(other))


def family() -> Column:
    minors = F.col("ninos") + F.col("adolescentes")
    return F.when(F.col("mayores") > 0, "adultos_mayores").when(minors > 0, F.when(F.col("adultos") + minors + F.col("mayores") <= 4, "familia_pequena").otherwise("familia_grande")).when(F.col("adultos") == 1, "soltero").when(F.col("adultos") == 2, "pareja_sin_hijos").otherwise("otro")


def score(leads: DataFrame) -> DataFrame:
    """Leads with the eight part scores, ``puntuacion``, ``clasificacion``, ``perfil`` and ``potencial_propiedades``.

    Needs adultos, ninos, adolescentes, mayores (counts), presupuesto_min and
    _max, financiamiento, cuota, dormitorios, banos, tipo, n_zonas, disponibles
    (listings in the wished zones), superficie, conocimiento, urgencia.
    """
    middle = (F.col("presupuesto_min") + F.col("presupuesto_max")) / 2
    rows = leads.withColumn("perfil", family())
    budget = (
        F.when(middle < MARKET_MIN, 0).when(middle > MARKET_MAX, 5).when((F.col("perfil") == "familia_grande") & (middle < 180_000), 5).when((F.col("perfil") == "soltero") & (middle > 300_000), 8)
        .when(middle.between(150_000, 250_000), 20).when(middle.between(100_000, 350_000), 15).otherwise(10)
    )
    needs = sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0) for c, w in ((F.col("dormitorios") > 0, 4), (F.col("banos") > 0, 3), (F.col("tipo") != "", 3), (F.col("n_zonas") > 0, 3), (F.col("superficie") > 0, 2))), F.lit(0))
    potential = F.when(~F.col("financiamiento") & (F.col("presupuesto_max") < 100_000), 3).when(F.col("financiamiento"), 12).when((F.col("cuota") > 0) & (F.col("cuota") >= F.col("presupuesto_max") * 0.2), 10).otherwise(6)
    members = F.when(F.col("adultos") == 0, 0).otherwise(5 + F.when(F.col("ninos") + F.col("adolescentes") > 0, 3).otherwise(0) + F.when(F.col("mayores") > 0, 2).otherwise(0))
    place = F.when(F.col("n_zonas") == 0, 2).when(F.col("disponibles") > 5000, 8).when(F.col("disponibles") > 2000, 6).when(F.col("disponibles") > 500, 4).otherwise(2)
    funding = F.when(F.col("financiamiento"), 8).when(F.col("cuota") > 0, 5).otherwise(2)
    parts = {"presupuesto": budget, "urgencia": lookup("urgencia", URGENCY, 3), "necesidades": F.least(needs, F.lit(15)), "potencial": potential, "composicion": F.least(members, F.lit(10)), "ubicacion": place, "conocimiento": lookup("conocimiento", KNOWLEDGE, 3), "financiamiento": funding}
    rows = rows.select("*", *[c.cast("int").alias(f"p_{n}") for n, c in parts.items()])
    total = F.round(sum((F.col(f"p_{n}") * (w / 20) for n, w in WEIGHTS.items()), F.lit(0.0)), 1)
    level = F.when(F.col("puntuacion") >= 80, "caliente").when(F.col("puntuacion") >= 60, "tibio").when(F.col("puntuacion") >= 40, "frio").otherwise("muy_frio")
    by_budget = F.when(middle > 300_000, 0.3).when(middle < 120_000, 0.4).otherwise(0.6)
    by_zones = F.when(F.col("n_zonas") > 0, F.least(F.col("n_zonas") * 0.3, F.lit(0.8))).otherwise(1.0)
    stock = lookup("perfil", BASE, 5_000) * by_budget * by_zones
    return rows.withColumn("puntuacion", total).withColumn("clasificacion", level).withColumn("potencial_propiedades", F.floor(F.round(stock, 6)).cast("int"))


def strengths() -> Column:
    found = [("p_presupuesto", 15, "Presupuesto realista y adecuado"), ("p_urgencia", 12, "Alta urgencia de compra"), ("p_necesidades", 12, "Necesidades bien definidas"), ("p_potencial", 10, "Buen potencial financiero"), ("p_composicion", 8, "Perfil familiar claro")]
    return F.array_compact(F.array(*[F.when(F.col(c) >= v, t) for c, v, t in found]))


def weaknesses() -> Column:
    found = [("p_presupuesto", 10, "Presupuesto poco realista"), ("p_urgencia", 8, "Baja urgencia"), ("p_necesidades", 8, "Necesidades poco claras"), ("p_potencial", 6, "Potencial financiero limitado"), ("p_financiamiento", 5, "Financiamiento no definido")]
    return F.array_compact(F.array(*[F.when(F.col(c) < v, t) for c, v, t in found]))
