import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from predio.llm import sharding
from predio.llm.queries import op2_differencing_shards
from predio.llm.sharding import differencing, levels_of, shard_by_bytes


def test_differencing_keeps_sums_and_is_tight():
    rng = np.random.default_rng(1)
    sizes = rng.integers(100, 5000, 400)
    parts = np.zeros((400, 8), np.int64)
    parts[:, -1] = sizes
    slots, sums = differencing(parts)
    got = np.bincount(slots[:, -1], weights=sizes, minlength=8)
    assert sorted(got) == sorted(sums) and got.max() - got.min() < 10


def test_differencing_known_case():
    parts = np.zeros((5, 2), np.int64)
    parts[:, -1] = [8, 7, 6, 5, 4]  # the two-way method ends at a difference of 2
    _, sums = differencing(parts)
    assert abs(int(sums[0]) - int(sums[1])) == 2
    best = min(abs(30 - 2 * sum(c)) for n in range(6) for c in itertools.combinations([8, 7, 6, 5, 4], n))
    assert best == 0


def test_query_balances_and_keeps_copies_together(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op2_differencing_shards(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    total, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        data = docs[r.doc_id].encode()
        assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data) and 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[docs[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(total.values()) / 40
    weight = Counter(docs.values())
    assert all(len(groups[t]) == 1 for t, n in weight.items() if n * (len(t.encode()) + 16) <= share)
    # a plain loop of the method over all groups: combine the two partial partitions of largest spread, oppositely ordered
    parts = [[0] * 39 + [n * (len(t.encode()) + 16)] for t, n in weight.items() if n * (len(t.encode()) + 16) <= share]
    split = sum(n for t, n in weight.items() if n * (len(t.encode()) + 16) > share)
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b, *parts = parts
        parts.append(sorted(x + y for x, y in zip(a, reversed(b), strict=True)))
    if not split:
        assert max(total.values()) - min(total[k] for k in range(40)) <= 1.05 * (parts[0][-1] - parts[0][0]) + 16


def test_many_groups_are_near_equal(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('x', cast(1 + (id * 7919) % 997 as int)) as text", "id as size", "1 as shard")
    size = shard_by_bytes(docs, 12).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in size]
    assert len(sizes) == 12 and max(sizes) - min(sizes) <= 0.001 * sum(sizes) / 12


def test_hot_group_is_split_evenly(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('hot', 50) else repeat('y', cast(50 + id % 400 as int)) || id end as text")
    sizes = [r[1] for r in shard_by_bytes(docs, 10).groupBy("shard").sum("size").collect()]
    assert max(sizes) <= 1.15 * sum(sizes) / 10


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    rows = shard_by_bytes(odd_docs, 4).collect()
    assert len(rows) == odd_docs.count()
    assert {r.size for r in rows if r.doc_id in (2, 3)} == {16}
    assert shard_by_bytes(no_docs, 4).count() == 0


@pytest.mark.parametrize("part", [0.5, 0.7, 0.95])
def test_group_of_most_of_a_share_stays_whole(spark, part):
    n = int(1000 * part)
    docs = spark.range(5000).selectExpr("id as doc_id", f"case when id < {n} then repeat('c', 84) else lpad(cast(id as string), 84, 'x') end as text")
    rows = shard_by_bytes(docs, 5).collect()  # of a share's 1,000 rows
    assert len({r.shard for r in rows if r.doc_id < n}) == 1
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 5000 and len(sizes) == 5 and max(sizes.values()) <= 1.01 * 1000


def test_levels_and_chunks_stay_balanced(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TASK_ITEMS", 300)
    docs = spark.range(30_000).selectExpr("id as doc_id", "concat(cast(id as string), repeat('x', cast(pow(1 + id % 97, 1.7) as int)), if(id % 1000 = 0, repeat('y', 60000), '')) as text")
    rows = shard_by_bytes(docs, 6).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert len(rows) == 30_000 and max(sizes.values()) - min(sizes.values()) <= 0.002 * sum(sizes.values()) / 6


def test_levels_hold_what_a_task_can_take():
    counts = {c: 10 ** min(7, 24 - c) for c in range(8, 25)}
    levels = levels_of(counts, 40)
    assert [levels[c] for c in sorted(counts, reverse=True)] == sorted(levels.values())
    for level in set(levels.values()):
        own = [c for c in counts if levels[c] == level]
        n = sum(counts[c] for c in own)
        chunks = 1 if n <= sharding.TASK_ITEMS else max(1, sum(counts[c] << (c - 1) for c in own) // (40 * sharding.CHUNK_LOAD << max(own)))
        assert n / chunks <= 4 * sharding.TASK_ITEMS
