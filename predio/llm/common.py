"""Scratch tables, size-checked broadcasts, membership tests and small expressions shared by the operators."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows, and its counted bytes, stay at or under these.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 48 << 20
#: Rows and bytes per Arrow batch: long texts make large rows, so batches stay short.
ARROW_ROWS = 1024
ARROW_BYTES = 8 << 20
#: Least and most bits of a membership table: it takes 16 bits a key, and 16 MB at most.
LEAST_SLOT_BITS, MOST_SLOT_BITS = 15, 27
_BUCKET = 1 << 15
#: Least seconds between two times that the driver gives memory back after a written table.
GIVE_BACK_S = 3.0

_FALLBACK: dict[str, str] = {}
_GIVEN: dict[str, float] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``; on a local master without it, a temporary one."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _FALLBACK.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='predio-')}")
    return f"{base.rstrip('/')}/predio-{context.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back.

    The written table cuts the lineage, survives lost executors and is not
    recomputed by the several steps that read it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    if time.monotonic() - _GIVEN.get("at", 0.0) >= GIVE_BACK_S:
        give_back(spark)
    return out


def give_back(spark: SparkSession) -> None:
    """Hand memory that the driver's Python and JVM have freed back to the system.

    The driver has hundreds of threads, and the C library keeps what they
    freed: 125 MB after the pipeline's first stage.  A JVM without the
    diagnostic command goes on keeping it.
    """
    _end()
    if _GIVEN.get("none"):
        return
    jvm = spark._jvm
    try:
        (invoke,) = (m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)  # the last two, parameters and their kinds, stay null
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        _GIVEN["none"] = 1.0
    _GIVEN["at"] = time.monotonic()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that nothing will read again.

    The shuffle files of the steps that made them go too: Spark deletes those
    once the driver's JVM has collected the plans, so it is asked to collect,
    and what it frees is given back.
    """
    found = [(table.sparkSession, path) for table in tables if (path := _PATHS.pop(table, None))]
    for spark, path in found:
        _delete(spark, path)
    if found:
        found[0][0]._jvm.java.lang.System.gc()
        give_back(found[0][0])


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application (after its results have been written)."""
    _delete(spark, scratch_root(spark))


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, so that long texts cannot fill a Python worker; bounds only ever fall."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = int(spark.conf.get(key).rstrip("bB") or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def checked_broadcast(small: DataFrame, rows: int | None = None, row_bytes: Column | None = None) -> DataFrame:
    """Hint a broadcast only if ``small`` has been counted within ``BROADCAST_ROWS`` and ``BROADCAST_BYTES``; else leave it to a shuffle join.

    ``row_bytes`` is the size of a row where rows hold arrays or texts.
    """
    if rows is None:
        found = small.agg(F.count("*").alias("n"), F.sum(F.lit(64) if row_bytes is None else row_bytes).alias("b")).first()
        rows, size = found["n"], found["b"] or 0
    else:
        size = 64 * rows
    return F.broadcast(small) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else small


class Members:
    """A table of bits that tells most rows without a key in a set from those with one.

    It has about 16 bits a key, 2**27 at most, so its size is bounded whatever
    the set; a key of the set is never missed, and another one rarely passes.
    """

    def __init__(self, keys: DataFrame):
        (name,) = keys.columns
        self.bits = min(max(LEAST_SLOT_BITS, (16 * keys.count()).bit_length()), MOST_SLOT_BITS)
        slot = self.slot(F.col(name)) + 1
        pages = keys.groupBy(F.bitmap_bucket_number(slot).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
        table = np.zeros(1 << (self.bits - 3), np.uint8)
        for row in pages.toLocalIterator():
            at = (row["page"] - 1) * _BUCKET // 8
            table[at : at + _BUCKET // 8] = np.frombuffer(row["bits"], np.uint8)
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def slot(self, key: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(key.cast("long")), 64 - self.bits)

    def maybe(self) -> Callable[[Column], Column]:
        """A test of a ``slot`` column; null slots fail."""
        table = self.table

        @F.pandas_udf("boolean")
        def test(slots: pd.Series) -> pd.Series:
            at = slots.fillna(0).to_numpy(dtype=np.int64)
            return pd.Series((table.value[at >> 3] >> (at & 7)) & 1 == 1) & slots.notna()

        return lambda key: test(F.when(key.isNotNull(), self.slot(key)))


def found_in(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which of the slots are set in a ``Members`` table."""
    return (table[slots >> 3] >> (slots & 7)) & 1 == 1


def join_few(big: DataFrame, few: DataFrame, key: str, how: str, row_bytes: Column | None = None) -> DataFrame:
    """``big`` joined with ``few`` on a long ``key`` ("left" or "left_anti") without moving the rows of ``big`` that have no partner.

    A small ``few`` is broadcast.  Else a membership table sets apart nearly
    all rows without a partner, and only the others are shuffled.
    """
    few = few.where(F.col(key).isNotNull())
    small = checked_broadcast(few, row_bytes=row_bytes)
    if small is not few:
        return big.join(small, key, how)
    maybe = Members(few.select(key)).maybe()(F.col(key))
    apart = big.where(~maybe)
    joined = big.where(maybe).join(few, key, how)
    return joined.unionByName(apart, allowMissingColumns=True).select(joined.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it differ from all columns (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


_WORKER: dict[object, object] = {}


def once_a_worker(key: object, make: Callable[[], object]) -> object:
    """What ``make`` returns, kept by this Python worker for its next tasks until one of another kind runs."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]


def _begin(keep: bool) -> None:
    if not keep:
        _WORKER.clear()


def _end() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator], keep: bool = False) -> Callable[[Iterator], Iterator]:
    """``run`` for a task, after which the Python worker gives freed memory back: workers outlive tasks, and several stand beside an executor."""

    def wrapped(batches: Iterator) -> Iterator:
        _begin(keep)
        try:
            yield from run(batches)
        finally:
            _end()

    return wrapped
