"""Preference profiles, compatibility scores and ranked recommendations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predio.operators.filters import soft_filter, zone_match
from predio.operators.spatial import counts_up_to

# Weights of the five factors.
WEIGHTS = {"ubicacion": 0.35, "precio": 0.25, "servicios": 0.20, "caracteristicas": 0.15, "disponibilidad": 0.05}
VALUED_SERVICES = ("transporte", "comercio", "educacion", "salud")


@dataclass
class Profile:
    zona: str = ""
    tipo: str = ""
    uv: str = ""
    manzana: str = ""
    precio_min: float = 0.0
    precio_max: float = 1e12
    asof: str = "1998-08-02"
    max_days: int | None = None
    demand: dict[str, str] = field(default_factory=dict)  # column values of ``estado`` that stand for a demand level


def cap(c: Column) -> Column:
    return F.least(c, F.lit(1.0))


def location(p: Profile) -> Column:
    zone = F.lower(F.coalesce("zona", F.lit("")))
    token = F.exists(F.array(*[F.lit(t) for t in p.zona.lower().split()] or [F.lit("\u0000")]), lambda t: zone.contains(t))
    z = F.when(zone.contains(p.zona.lower()), 0.4).when(token, 0.25).otherwise(0.0) if p.zona else F.lit(0.0)
    demand = F.when(F.col("demanda").isin("muy_alta", "alta"), 0.3).when(F.col("demanda") == "media", 0.15).otherwise(0.0)
    uv = F.when(F.coalesce(F.lower("uv").contains(p.uv.lower()), F.lit(False)), 0.2).otherwise(0.0) if p.uv else F.lit(0.0)
    mz = F.when(F.coalesce(F.lower("manzana").contains(p.manzana.lower()), F.lit(False)), 0.1).otherwise(0.0) if p.manzana else F.lit(0.0)
    transport = F.when(F.col("transporte_2km") >= 3, 0.1).when(F.col("transporte_2km") >= 1, 0.05).otherwise(0.0)
    return cap(z + demand + uv + mz + transport)


def price(p: Profile) -> Column:
    v, margin = F.col("precio_usd"), p.precio_max - p.precio_min
    below = F.greatest(F.lit(0.2), 0.7 - (p.precio_min - v) / F.lit(margin) * 0.3) if margin else F.lit(0.2)
    above = F.greatest(F.lit(0.1), 0.7 - (v - p.precio_max) / F.lit(margin) * 0.5) if margin else F.lit(0.1)
    bonus = F.when(F.col("demanda") == "media", 0.2).when(F.col("demanda") == "baja", 0.3).when(F.col("demanda").isin("alta", "muy_alta"), 0.05).otherwise(0.0)
    base = F.when(v.between(p.precio_min, p.precio_max), 0.7).when(v < p.precio_min, below).otherwise(above)
    return F.when(v.isNull() | (v == 0), 0.0).otherwise(cap(base + bonus))


def services() -> Column:
    rings = [(0.6 * F.col(f"categorias_{r}km") / len(VALUED_SERVICES) + 0.4 * F.least(F.col(f"servicios_{r}km") / 10, F.lit(1.0))) / r for r in (1, 2, 3)]
    return F.when(F.col("lat").isNull() | F.col("lng").isNull(), 0.3).otherwise(cap(F.greatest(*rings)))


def features(p: Profile) -> Column:
    kind = F.when(F.lower("tipo").contains(p.tipo.lower()), 0.4).otherwise(0.0) if p.tipo else F.lit(0.0)
    s = F.coalesce("superficie", F.lit(0.0))
    size = F.when(s >= 100, 0.3).when(s >= 60, 0.2).when(s > 0, 0.1).otherwise(0.0)
    traits = sum((F.when(c, 1).otherwise(0) for c in (F.col("garajes") > 0, F.col("dormitorios") >= 3, F.col("banos") >= 2, s >= 200)), F.lit(0))
    return cap(kind + size + F.when(traits >= 3, 0.3).when(traits >= 2, 0.2).when(traits >= 1, 0.1).otherwise(0.0))


def availability(p: Profile) -> Column:
    days = F.datediff(F.lit(p.asof).cast("date"), F.to_date("fecha"))
    recent = F.when(F.col("fecha").isNull(), 0.2).when(days <= 7, 0.6).when(days <= 30, 0.4).when(days <= 90, 0.2).otherwise(0.1)
    state = F.when(F.lower("disponible").isin("disponible", "en_venta", "venta"), 0.4).when(F.lower("disponible").isin("reservado", "en_negociacion"), 0.2).otherwise(0.1)
    return cap(recent + state)


#: The score looks at so many services of a radius, and no further.
ENOUGH = 10


def service_counts(listings: DataFrame, points: DataFrame) -> DataFrame:
    """Listings with how many valued services and categories lie within 1, 2 and 3 km, and transport within 2 km.

    Services of one category are counted up to ``ENOUGH``, as the score reads no more of them.
    """
    rows = counts_up_to(listings, points.where(F.col("categoria").isin(*VALUED_SERVICES)), (1, 2, 3), "categoria", ENOUGH)
    total = lambda near: F.aggregate(near, F.lit(0).cast("long"), lambda n, k: n + k["n"])
    counts = {f"servicios_{r}km": total(F.col(f"near{r}")) for r in (1, 2, 3)} | {f"categorias_{r}km": F.size(f"near{r}").cast("long") for r in (1, 2, 3)}
    transport = total(F.filter("near2", lambda k: k["kind"] == "transporte"))
    return rows.withColumns(counts | {"transporte_2km": transport}).drop("near1", "near2", "near3")


def scored(listings: DataFrame, points: DataFrame, p: Profile) -> DataFrame:
    """Listings with the five factors and ``compatibilidad`` (0 to 100)."""
    rows = service_counts(listings, points)
    rows = rows.select("*", location(p).alias("ubicacion"), price(p).alias("s_precio"), services().alias("s_servicios"), features(p).alias("caracteristicas"), availability(p).alias("disponibilidad"))
    total = WEIGHTS["ubicacion"] * F.col("ubicacion") + WEIGHTS["precio"] * F.col("s_precio") + WEIGHTS["servicios"] * F.col("s_servicios") + WEIGHTS["caracteristicas"] * F.col("caracteristicas") + WEIGHTS["disponibilidad"] * F.col("disponibilidad")
    return rows.withColumn("compatibilidad", F.round(100 * total, 1))


def prefiltered(listings: DataFrame, p: Profile) -> DataFrame:
    steps = []
    if p.zona:
        steps.append(zone_match(F.col("zona"), p.zona))
    for column, value in (("uv", p.uv), ("manzana", p.manzana), ("tipo", p.tipo)):
        if value:
            steps.append(F.lower(column).contains(value.lower()))
    steps.append(F.coalesce("precio_usd", F.lit(0.0)).between(p.precio_min * 0.8, p.precio_max * 1.2))
    if p.max_days is not None:
        steps.append(F.datediff(F.lit(p.asof).cast("date"), F.to_date("fecha")) <= p.max_days)
    return soft_filter(listings, steps)


def justification() -> Column:
    """What speaks for a listing, best factor first in a fixed order."""
    reasons = [(F.col("ubicacion") >= 0.4, "ubicación preferida"), (F.col("s_precio") >= 0.7, "precio dentro del presupuesto"), (F.col("s_servicios") >= 0.5, "buenos servicios cercanos"), (F.col("caracteristicas") >= 0.5, "características adecuadas"), (F.col("disponibilidad") >= 0.6, "disponible")]
    return F.coalesce(F.nullif(F.concat_ws(", ", *[F.when(c, t) for c, t in reasons]), F.lit("")), F.lit("coincidencia parcial"))


def recommend(listings: DataFrame, points: DataFrame, p: Profile, *, k: int = 10, threshold: float = 0.3) -> DataFrame:
    """The ``k`` best listings that pass the soft filters and reach ``threshold``; ties by id."""
    rows = scored(prefiltered(listings, p), points, p).where(F.col("compatibilidad") >= 100 * threshold)
    return rows.withColumn("justificacion", justification()).orderBy(F.desc("compatibilidad"), "id").limit(k)


def budget_closeness(p: Profile) -> Column:
    middle = (p.precio_min + p.precio_max) / 2
    return F.when(F.coalesce("precio_usd", F.lit(0.0)) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("precio_usd") - middle) / middle))


def family_fit(adults: int, children: int, elders: int = 0) -> Column:
    """Rooms, baths, surface, garage and, in a closed condominium, amenities that a family of this size finds; 0 for nobody."""
    people = adults + children + elders
    if not people:
        return F.lit(0.0)
    rooms_needed, baths_needed, space_needed = max(2 if children else 1, (people + 1) // 2), max(1.0, people / 3), 25.0 * people
    part = lambda c, needed, weight, least: F.when(F.col(c) >= needed, weight).otherwise(F.greatest(F.lit(least), F.col(c) / F.lit(needed) * weight))
    rooms = F.when(F.col("dormitorios") > 0, part("dormitorios", rooms_needed, 0.4, 0.1)).otherwise(0.0)
    space = F.when(F.col("superficie") > 0, part("superficie", space_needed, 0.2, 0.05)).otherwise(0.0)
    garage = F.when(F.col("garajes") > 0, 0.1).otherwise(0.0)
    amenities = F.when(F.coalesce("condominio", F.lit(False)), F.when(F.col("n_amenidades") >= 3, 0.05).when(F.col("n_amenidades") >= 1, 0.03).otherwise(0.0)).otherwise(0.0)
    return cap(rooms + part("banos", baths_needed, 0.25, 0.05) + space + garage + amenities)
