"""Groups of pairs: smallest reachable id."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one of this application only where the master is local."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='predio-')}")


#: A side of a join is broadcast only when it was counted at so many rows or fewer.
BROADCAST_ROWS = 500_000


def checked_broadcast(small: DataFrame) -> DataFrame:
    """Hint a broadcast of narrow rows only if they were counted within ``BROADCAST_ROWS``; else leave it to a shuffle join."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the scratch folder and read back; ``options`` are those of the writer."""
    path = f"{scratch_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def groups(pairs: DataFrame) -> DataFrame:
    """(id, grupo) of every id in ``pairs`` (a, b): the smallest id that its pairs reach.

    Labels fall to the smallest neighbour's and then jump to their label's own
    label, so rounds grow with the logarithm of a chain's length.
    """
    links = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = written(links, "links")
    labels = written(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("grupo")), "labels")
    while True:
        near = links.join(labels, links["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("grupo").alias("seen"))
        lower = labels.join(near, "id").select("id", F.least("grupo", "seen").alias("grupo"))
        jump = lower.select(F.col("id").alias("grupo"), F.col("grupo").alias("further"))
        after = written(lower.join(jump, "grupo", "left").select("id", F.least("grupo", F.coalesce("further", "grupo")).alias("grupo")), "labels")
        if after.agg(F.sum("grupo")).first()[0] == labels.agg(F.sum("grupo")).first()[0]:
            return after
        labels = after
