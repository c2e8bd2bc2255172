"""Hard filters, the soft cascade and approval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_ci(column: Column, text: str) -> Column:
    return F.coalesce(F.lower(column).contains(text.lower()), F.lit(False))


def zone_match(column: Column, zone: str) -> Column:
    """Either contains the other, in lower case; a missing zone counts as empty and matches."""
    own = F.lower(F.coalesce(column, F.lit("")))
    return own.contains(zone.lower()) | F.lit(zone.lower()).contains(own)


def any_contains(column: Column, zones: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(z.lower()) for z in zones]), lambda z: F.coalesce(F.lower(column).contains(z), F.lit(False)))


def hard_filter(df: DataFrame, *, uv: str | None = None, manzana: str | None = None, zona: str | None = None, tipo: str | None = None, precio_min: float | None = None, precio_max: float | None = None) -> DataFrame:
    """Rows that meet every given condition; a missing price counts as 0."""
    conditions = [contains_ci(F.col(c), v) for c, v in (("uv", uv), ("manzana", manzana), ("zona", zona), ("tipo", tipo)) if v]
    price = F.coalesce("precio_usd", F.lit(0.0))
    if precio_min is not None:
        conditions.append(price >= precio_min)
    if precio_max is not None:
        conditions.append(price <= precio_max)
    return df.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def catalog_filter(df: DataFrame, *, zona: str | list[str] | None = None, precio: tuple[float, float] | None = None, superficie: tuple[float, float] | None = None, dormitorios: int | None = None, banos: int | None = None, garaje: bool | None = None, fuente: str | None = None) -> DataFrame:
    """Rows that meet every given condition; what is missing does not."""
    conditions = []
    if zona:
        conditions.append(any_contains(F.col("zona"), [zona] if isinstance(zona, str) else zona))
    for column, limits in (("precio_usd", precio), ("superficie", superficie)):
        if limits:
            conditions.append(F.col(column).between(*limits))
    if dormitorios is not None:
        conditions.append(F.col("dormitorios") >= dormitorios)
    if banos is not None:
        conditions.append(F.col("banos") >= banos)
    if garaje is not None:
        conditions.append((F.col("garajes") > 0) == garaje)
    if fuente:
        conditions.append(contains_ci(F.col("proveedor"), fuente))
    return df.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def soft_filter(df: DataFrame, predicates: list[Column]) -> DataFrame:
    """Apply each predicate only if a row of those left meets it; otherwise skip it.

    Which rows remain depends on at most one bit for each predicate, so one
    pass finds, for every subset that the cascade can reach, whether it has a
    row: rows are grouped by the bits they meet (a row a subset at most), and
    the cascade is followed on those groups.
    """
    bits = [F.coalesce(p, F.lit(False)) for p in predicates]
    kinds = [tuple(r) for r in df.select(*[b.alias(f"b{i}") for i, b in enumerate(bits)]).groupBy(*[f"b{i}" for i in range(len(bits))]).count().drop("count").collect()]
    applied = []
    for i in range(len(bits)):
        left = [k for k in kinds if k[i]]
        if left:
            kinds = left
            applied.append(bits[i])
    return df.where(reduce(lambda a, b: a & b, applied, F.lit(True)))


def approved(box: tuple[float, float, float, float]) -> Column:
    """The six conditions for loading a cleansed listing."""
    from predio.functions.geo import in_box

    present = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    return F.coalesce(F.col("status").isin("OK", "WARNING") & present("titulo") & in_box(F.col("lat"), F.col("lng"), box) & F.col("precio_usd").between(1_000, 5_000_000) & present("zona") & present("tipo"), F.lit(False))
