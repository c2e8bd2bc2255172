"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predio.llm.common import discard, materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``; the component is its smallest reachable id.

    Each round points every neighbour of a node at the node's smallest
    neighbour, first among its larger neighbours and then among its smaller
    ones.  Minima are taken by aggregation and joined back, so that a hub with
    very many links is combined before the shuffle and its join can be split.
    Null ids and self links are ignored; repeated links count once.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct()
    edges, before = _settled(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(below.select("u", F.col("m").alias("v")))
        old, (edges, after) = edges, _settled(small.where("u != v").distinct())
        discard(old)
        if after == before:
            break
        before = after
    roots = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()).groupBy("id").agg(F.min("component").alias("component"))


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    table = materialize(edges, "edges")
    row = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return table, tuple(row)
