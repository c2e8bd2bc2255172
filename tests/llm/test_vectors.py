import numpy as np
from pyspark.sql import functions as F

from predio.llm import vectors
from predio.llm.vectors import divide, placed, range_join


def brute(rows, least=0.98):
    ok = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {i: 0 for i, _, _ in rows}
    root = {i: i for i in links}
    for i, x, lx in ok:
        for j, y, ly in ok:
            if i < j and lx == ly and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return {i: (links[i], root[i], root[i] == i) for i in links}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_equals_brute_force_on_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert result(range_join(table)) == brute(rows)


def test_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 12)
    monkeypatch.setattr(vectors, "LEAST_SAMPLE", 4)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 10)
    monkeypatch.setattr(vectors, "STRIP_ROWS", 3)
    rng = np.random.default_rng(0)
    rows = []
    for g in range(30):
        center = rng.normal(size=8)
        for _ in range(8):
            rows.append((len(rows), (center + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.2])).tolist(), g % 2))
    want = brute(rows)
    for kind in ("double", "float"):
        table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
        assert result(range_join(table)) == (want if kind == "double" else brute([(r.vec_id, r.embedding, r.label) for r in table.collect()]))


def test_cells_are_complete_and_follow_the_data(monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 40)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 16))
    x = np.concatenate([centers, *[c + 0.05 * rng.normal(size=(40, 16)) for c in centers]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    radius = float(np.sqrt(2 - 2 * 0.98))
    tree, copies = divide(x, np.ones(len(x), bool), 1.0, radius)
    row, cell, own = placed(x, np.ones(len(x), bool), tree, radius)
    assert copies <= vectors.MOST_COPIES and len(row) <= copies * len(x)
    assert sorted(row[own].tolist()) == list(range(len(x)))
    where = {}
    for r, c in zip(row.tolist(), cell.tolist(), strict=True):
        where.setdefault(r, set()).add(c)
    home = dict(zip(row[own].tolist(), cell[own].tolist(), strict=True))
    a, b = np.nonzero(x @ x.T >= 0.98)
    assert all(home[i] in where[j] for i, j in zip(a.tolist(), b.tolist(), strict=True))
    pairs = sum((own & (cell == c)).sum() * (cell == c).sum() for c in set(cell.tolist()))
    assert pairs < 0.2 * len(x) ** 2  # clusters come apart


def test_a_cloud_stays_one_cell_and_clusters_come_apart_at_any_size(monkeypatch):
    radius = float(np.sqrt(2 - 2 * 0.98))
    rng = np.random.default_rng(2)
    for size in (10**6, 10**8):
        for seed in range(3):
            cloud = np.random.default_rng(seed).normal(size=(4000, 64))
            cloud /= np.linalg.norm(cloud, axis=1, keepdims=True)
            tree, copies = divide(cloud, np.ones(len(cloud), bool), size / len(cloud), radius)
            assert tree.pivots is None and copies == 1
        centers = rng.normal(size=(40, 64))
        x = np.concatenate([c + 0.02 * rng.normal(size=(100, 64)) for c in centers])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        tree, copies = divide(x, np.ones(len(x), bool), size / len(x), radius)
        row, cell, own = placed(x, np.ones(len(x), bool), tree, radius)
        assert copies <= vectors.MOST_COPIES and len(set(cell.tolist())) >= 30


def test_cells_divide_again_in_later_rounds(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    monkeypatch.setattr(vectors, "LEAST_SAMPLE", 4)
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", 64)
    monkeypatch.setattr(vectors, "FAN_OUTS", (2,))
    monkeypatch.setattr(vectors, "MOVE", 0.0)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(16, 8)) * 4
    rows = [(i, (centers[i % 16] + rng.normal(size=8) * 0.1).tolist(), 1) for i in range(640)]
    assert result(range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))) == brute(rows)


def test_odd_rows_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [1.0, float("nan")], 1), (7, [1.0, 0.0], None), (8, [2.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (11, [1.0, 0.0], 2), (12, [float("inf"), 0.0], 1)]
    schema = "vec_id long, embedding array<double>, label int, n string, id string"
    table = spark.createDataFrame([(*r, None, "x") for r in rows], schema)
    assert result(range_join(table)) == brute(rows)
    nulls = range_join(spark.createDataFrame([(None, [1.0], 1, "", "")], schema)).collect()
    assert [tuple(r) for r in nulls] == [(None, 0, None, False)]
    assert range_join(spark.createDataFrame([], schema)).count() == 0
