"""Zone coverage kept up to date from changes: mergeable counts, of which only the touched buckets are rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from predio.operators.graph import checked_broadcast, written

#: What is added up for each zone and type; all of it can be taken back.
SUMS = ("n", "con_coordenadas", "con_precio", "suma")


def counted(rows: DataFrame, sign: Column | int = 1) -> DataFrame:
    """(zona, tipo, sums) of listings (zona, tipo, lat, precio_usd); ``sign`` -1 takes a row back.

    Prices are summed in whole hundredths, so that what is taken back leaves nothing.
    """
    one = F.lit(sign) if isinstance(sign, int) else sign
    priced = F.col("precio_usd") > 0
    price = F.round(F.col("precio_usd").cast("double") * 100).cast("decimal(38,0)")
    sums = [one, F.when(F.col("lat").isNotNull(), one).otherwise(0), F.when(priced, one).otherwise(0), F.when(priced, price * one).otherwise(0)]
    return rows.groupBy("zona", "tipo").agg(*[F.sum(v).cast("decimal(38,0)").alias(c) for c, v in zip(SUMS, sums, strict=True)])


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What rows replaced or deleted (``before``) and rows new or as they are now (``after``) change in the sums."""
    both = counted(before, -1).unionByName(counted(after))
    return both.groupBy("zona", "tipo").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in SUMS])


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col("zona"), F.lit("\u0000"))), F.lit(buckets)).cast("int").alias("cubo")


def create(state: DataFrame, folder: str, buckets: int = 64) -> None:
    """Write the sums of ``counted``, by buckets of zones."""
    state.withColumn("cubo", _bucket(buckets)).repartition("cubo").write.partitionBy("cubo").mode("overwrite").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"zona string, tipo string, {', '.join(f'{c} decimal(38,0)' for c in SUMS)}, cubo int").parquet(folder)


def refresh(spark: SparkSession, folder: str, delta: DataFrame, buckets: int = 64) -> None:
    """Merge ``changes`` into the sums; only buckets with a changed zone are read and rewritten.

    A group that is taken back whole leaves; a zone without rows is no longer
    in the view.  A bucket is replaced when its new files are complete.
    """
    delta = written(delta.where(" or ".join(f"{c} != 0" for c in SUMS)).withColumn("cubo", _bucket(buckets)), "zone-delta")
    touched = [r["cubo"] for r in delta.select("cubo").distinct().collect()]  # as many as there are buckets at most
    if not touched:
        return
    old = read(spark, folder).where(F.col("cubo").isin(touched))
    merged = old.unionByName(delta).groupBy("zona", "tipo", "cubo").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in SUMS])
    merged = written(merged.where("n > 0"), "zone-sums")  # read in full before its files are replaced
    empty = spark.createDataFrame([(b,) for b in touched], "cubo int").join(checked_broadcast(merged.select("cubo").distinct()), "cubo", "left_anti")
    hollow = empty.select(F.lit(None).cast("string").alias("zona"), F.lit(None).cast("string").alias("tipo"), "cubo", *[F.lit(0).cast("decimal(38,0)").alias(c) for c in SUMS])
    out = merged.unionByName(hollow).repartition("cubo").select("zona", "tipo", *SUMS, "cubo")
    out.write.partitionBy("cubo").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def coverage(state: DataFrame) -> DataFrame:
    """(zona, n, con_coordenadas, tipos, media) from the sums: rows, those with coordinates, distinct types, mean known price."""
    sums = state.where("n > 0").groupBy("zona").agg(*[F.sum(c).alias(c) for c in SUMS], F.count_distinct("tipo").alias("tipos"))
    mean = F.when(F.col("con_precio") > 0, F.round(F.col("suma").cast("double") / 100 / F.col("con_precio").cast("double"), 0))
    return sums.select("zona", F.col("n").cast("long").alias("n"), F.col("con_coordenadas").cast("long").alias("con_coordenadas"), "tipos", mean.alias("media"))
