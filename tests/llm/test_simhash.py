import hashlib

import numpy as np
import pyarrow as pa

from predio.llm import simhash
from predio.llm.queries import op5_simhash_fingerprints
from predio.llm.simhash import fingerprint_edits, fingerprints, near_counts


def brute_edits(rows):
    """rows: (doc_id, text) in descending order."""
    out = {}
    for i, (k, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edit = t[: len(t) - half] + nxt[:half]
        a, b, c = fingerprints(pa.array([t, edit, nxt])).tolist()
        out[k] = (len(t), hashlib.sha256(edit.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", 1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64)
    return out


def test_query_equals_a_plain_loop(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    rows = op5_simhash_fingerprints(spark, sf_dir).collect()
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows}
    assert len(rows) == len(docs) and got == brute_edits(docs)
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.08
    marks = np.array(sorted({int(r.fingerprint, 16) for r in rows}), dtype=np.uint64)
    near = dict(zip(marks.tolist(), ((np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 3).sum(1) - 1).tolist(), strict=True))
    assert all(r.n_near == near[int(r.fingerprint, 16)] for r in rows)


def test_near_copies_have_near_fingerprints():
    rng = np.random.default_rng(2)
    words = [f"w{rng.integers(1000)}" for _ in range(400)]
    changed = [*words[:200], "other", *words[201:]]
    a, b, c = fingerprints(pa.array([" ".join(words), " ".join(changed), " ".join(words[::-1])])).tolist()
    assert (a ^ b).bit_count() <= 6 < (a ^ c).bit_count()


def test_block_tables_find_all_within_the_radius(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(1)
    marks = rng.integers(0, 2**63, 40, dtype=np.uint64)
    for _ in range(260):
        marks = np.append(marks, marks[rng.integers(40)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5)).astype(np.uint64)))
    marks = np.unique(marks)
    table = spark.createDataFrame([(int(m),) for m in marks.view(np.int64)], "fp long")
    got = {np.uint64(r.fp % 2**64): r.n_near for r in near_counts(table.unionAll(table)).collect()}
    want = dict(zip(marks, (np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 3).sum(1) - 1, strict=True))
    assert got == want


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    rows = fingerprint_edits(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.n_chars, r.fingerprint) for r in rows if r.doc_id in (2, 3)} == {(0, "0" * 16)}
    one = odd_docs.where("doc_id = 8")
    assert [(r.near_next, r.n_chars) for r in fingerprint_edits(one).collect()] == [(1.0, 27)]
    assert fingerprint_edits(no_docs).count() == 0


def test_pairs_tell_which_documents_are_near(spark, sf_dir, monkeypatch):
    from predio.llm.queries import op5_simhash_links

    rows = op5_simhash_fingerprints(spark, sf_dir).collect()
    marks = sorted({r.fingerprint for r in rows})
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    want = {(a, b, bits(a, b)) for i, a in enumerate(marks) for b in marks[i + 1 :] if bits(a, b) <= 10}
    links = [tuple(r) for r in op5_simhash_links(spark, sf_dir).collect()]
    assert len(links) == len(want) and set(links) == want
    assert all(r.n_near == sum(r.fingerprint in p[:2] for p in want if p[2] <= 3) for r in rows)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    made = rng.integers(0, 2**63, 20, dtype=np.uint64)
    made = np.unique(np.concatenate([made, *[made ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(63)) for b in range(0, 60, 7)]]))
    table = spark.createDataFrame([(int(m),) for m in made.view(np.int64)], "fp long")
    got = [(r.fp % 2**64, r.other % 2**64, r.distance) for r in simhash.near_pairs(table, 4, 6).collect()]
    near = {(a, b, (a ^ b).bit_count()) for a in made.tolist() for b in made.tolist() if a < b and (a ^ b).bit_count() <= 4}
    assert len(got) == len(near) and set(got) == near
