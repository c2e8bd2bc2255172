import gc
import re
import time
from pathlib import Path

from predio.llm import common
from predio.llm.common import discard, materialize


def resident_mb(spark):
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


def test_freed_native_memory_of_the_driver_goes_back(spark, monkeypatch):
    monkeypatch.setattr(common, "GIVE_BACK_S", 1e9, raising=False)
    table = materialize(spark.range(10), "memory")
    make = spark._jvm.java.nio.ByteBuffer.allocateDirect
    held = [make(100_000) for _ in range(1500)]
    pins = held[::15]  # what stays in between keeps the C library from giving the rest back by itself
    del held
    gc.collect()
    for _ in range(2):
        spark._jvm.java.lang.System.gc()
        time.sleep(1)
    before = resident_mb(spark)
    discard(table)
    assert before - resident_mb(spark) > 80
    del pins


def test_a_jvm_without_the_command_goes_on(spark, monkeypatch):
    monkeypatch.setattr(common, "_GIVEN", {"none": 1.0}, raising=False)
    discard(table := materialize(spark.range(3), "memory"))
    assert table.columns == ["id"]
