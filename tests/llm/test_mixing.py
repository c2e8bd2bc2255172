from collections import Counter, defaultdict

import numpy as np
import pytest

from predio.llm.mixing import mix_sources, pivotal, source_targets
from predio.llm.queries import op7_pivotal_mixing


def test_targets_by_hand():
    # 150 % of 400 is 600; b stops at 2 x 50, and the rest goes 5 : 1
    assert source_targets([("b", 50), (None, 200), ("a", 150)]) == pytest.approx({"a": 300, "b": 100, None: 200})


def test_pivotal_keeps_the_weighted_sum_and_the_expectation():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 100, 300).astype(float)
    p = rng.random(300)
    out = pivotal(p, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 1 and abs((out * size).sum() - (p * size).sum()) < 1e-6
    mean = np.mean([pivotal(p[:20], size[:20], np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert np.abs(mean - p[:20]).max() < 0.05


def test_query_meets_targets(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_pivotal_mixing(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    own, taken, largest = Counter(), Counter(), defaultdict(int)
    for r in rows:
        n = len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")])
        assert r.size == n and 0 <= r.taken <= 2 * n and r.taken == r.copies * r.size
        own[r.source] += n
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], n)
    want = source_targets(list(own.items()))
    for s in own:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    assert all(r.source_size == own[r.source] and abs(r.target - want[r.source]) < 1e-6 for r in rows)
    again = {r.doc_id: r.taken for r in op7_pivotal_mixing(spark, sf_dir).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_many_chunks_meet_the_target(spark, monkeypatch):
    monkeypatch.setattr("predio.llm.mixing.CHUNK_ROWS", 50)
    monkeypatch.setattr("predio.llm.mixing.FAN_IN", 3)
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 37 as int)) as text", "case when id % 3 = 0 then 'hot' else cast(id % 7 as string) end as source")
    rows = mix_sources(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(rows) == 2000 and all(abs(taken[s] - target[s]) <= 37 for s in target)


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    rows = mix_sources(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.taken == 0 for r in rows if r.doc_id in (2, 3, 7))
    assert mix_sources(no_docs).count() == 0
