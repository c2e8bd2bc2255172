"""Exact quantiles without gathering the values: histograms that narrow round by round."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a round, and values that are few enough to be sorted and sent to the driver.
BINS, FEW = 4_096, 10_000


def _ranked(values: DataFrame, ranks: list[int], low: float, high: float, before: int, n: int, few: int) -> dict[int, float]:
    """The values of the given ranks (from 0), all of which lie between ``low`` and ``high``; ``before`` values are below, ``n`` between."""
    inside = values.where(F.col("v").between(low, high))
    if low == high:
        return dict.fromkeys(ranks, low)
    if n <= few:
        ordered = sorted(r["v"] for r in inside.collect())
        return {k: ordered[k - before] for k in ranks}
    width = high / BINS - low / BINS
    place = F.least(F.greatest(F.floor((F.col("v") - low) / width), F.lit(0)), F.lit(BINS - 1)) if 0 < width < math.inf else F.when(F.col("v") == low, 0).otherwise(1)
    bins = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("low").collect()
    out: dict[int, float] = {}
    for b in bins:
        own = [k for k in ranks if before <= k < before + b["n"]]
        if own:
            out |= _ranked(values, own, b["low"], b["high"], before, b["n"], few)
        before += b["n"]
    return out


def exact_quantiles(df: DataFrame, column: str, shares: list[float], few: int = FEW) -> list[float] | None:
    """Quantiles of the known values of a column, between two neighbouring ranks in proportion; None without any.

    A round counts the values of ``BINS`` equal parts of the range a rank
    lies in and goes on in its bin, so a task holds counts alone.  It ends when a bin
    holds one value, however often, or ``few`` of them.  NaN is not a value.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    places = [(n - 1) * s for s in shares]
    ranks = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    found = _ranked(values, ranks, low, high, 0, n, few)
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]
