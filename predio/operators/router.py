"""Questions in Spanish answered by analytic queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predio.functions import cleansing as c
from predio.operators.filters import zone_match

# The words that tell what a message wants.
SEARCH = ("buscar", "busco", "necesito", "quiero", "muestrame")
MARKET = ("precio", "promedio", "mercado", "análisis", "tendencia")
INFO = ("información", "saber", "conocer", "explicar")
FORBIDDEN = ("política", "religión", "deportes", "celebridades", "entretenimiento", "internacional", "ciencia", "historia", "bolsa", "criptomonedas")
PLACE_WORDS = ("zona", "barrio", "sector")
ALLOWED_ZONES = ("equipetrol", "santa mónica", "urbari", "las palmas", "santiago", "sacta", "pampa de la isla", "los olivos", "zona norte", "zona sur", "centro", "santa monica")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def intent(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low == "", "unknown").when(any_of(low, SEARCH), "property_search").when(any_of(low, MARKET), "market_analysis").when(any_of(low, INFO), "general_info").otherwise("general")


def guard(text: Column) -> Column:
    """ok, tema (a forbidden topic) or zona (a place word that names no known zone)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    place = any_of(low, PLACE_WORDS) & ~any_of(low, ALLOWED_ZONES)
    return F.when(any_of(low, FORBIDDEN), "tema").when(place, "zona").otherwise("ok")


def _named(question: str, keys: list[tuple[str, str]]) -> str | None:
    return next((value for key, value in keys if key in question), None)


def answer(listings: DataFrame, question: str) -> DataFrame:
    """One row (tipo, zona, n, respuesta): dearest, cheapest, average, count, availability or a summary, for any zone."""
    q = question.lower()
    zone, kind = _named(q, c.ASKED_ZONES), _named(q, c.ASKED_TYPES)
    rows = listings.where(zone_match(F.col("zona"), zone)) if zone else listings
    title = F.lit((zone or "").title())
    money = lambda col: F.concat(F.lit("$"), F.format_number(F.round(col), 0))
    priced = F.when(F.col("precio_usd") > 0, F.col("precio_usd"))
    count = F.count("*")

    def row(df: DataFrame, what: str, n: Column, text: Column) -> DataFrame:
        return df.agg(n.alias("n"), text.alias("respuesta")).select(F.lit(what).alias("tipo"), F.lit(zone).cast("string").alias("zona"), "n", "respuesta")

    for words, what, order in ((("más caro", "mas caro"), "caras", F.desc("precio_usd")), (("más barato", "mas barato"), "baratas", F.asc("precio_usd"))):
        if zone and any(w in q for w in words):
            top = rows.where("precio_usd > 0").orderBy(order, "id").limit(5)
            ranked = F.array_sort(F.collect_list(F.struct((-F.col("precio_usd") if what == "caras" else F.col("precio_usd")).alias("o"), "id", "tipo", "precio_usd")))
            lines = F.transform(ranked, lambda r: F.concat(F.lit("$"), F.format_number(F.round(r["precio_usd"]), 0), F.lit(" USD - "), r["tipo"]))
            return row(top, what, count, F.array_join(lines, "\n"))
    if "promedio" in q and zone:
        return row(rows, "promedio", count, F.concat(F.lit("El precio promedio en "), title, F.lit(" es de "), money(F.avg(priced)), F.lit(" USD.")))
    if "cuantas" in q or "cuántas" in q or "disponibles" in q or "en venta" in q:
        if zone and kind:
            rows = rows.where(F.lower("tipo") == kind)
        what = "conteo" if "uantas" in q or "uántas" in q else "disponibles"
        return row(rows, what, count, F.concat(F.lit("Hay "), count.cast("string"), F.lit(f" {kind}s" if zone and kind else " propiedades"), F.lit(f" en {zone.title()}." if zone else " en total.")))
    if zone:
        return row(rows, "resumen", count, F.concat(F.lit("En "), title, F.lit(" hay "), count.cast("string"), F.lit(" propiedades entre "), money(F.min(priced)), F.lit(" y "), money(F.max(priced)), F.lit(" (promedio "), money(F.avg(priced)), F.lit(").")))
    return row(rows, "ayuda", F.lit(0).cast("long"), F.lit("Pregunte por los precios o la cantidad de propiedades de una zona."))
