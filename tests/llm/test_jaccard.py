import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from predio.llm import jaccard
from predio.llm.jaccard import choose_extra, jaccard_components
from predio.llm.textkernel import shingle_sets


def shingle_set(text, width):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(docs, width, percent):
    sets = {k: shingle_set(t, width) for k, t in docs.items()}
    root = {k: k for k in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(k for k in docs if sets[k])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if percent * max(len(sets[a]), len(sets[b])) <= 100 * min(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {k: (len(sets[k]), find(k)) for k in docs}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_equals_brute_force_on_the_table(spark, sf_dir, width, percent):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, width=width, percent=percent).collect()}
    want = brute_components({r.doc_id: r.text for r in docs.collect()}, width, percent)
    assert got == want and any(k != c for k, (_, c) in got.items())


def test_equals_brute_force_on_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTED_AT_ONCE", 500)
    monkeypatch.setattr(jaccard, "PARTNER_ROWS", 3)
    rng = random.Random(5)
    docs, common = {}, "this line stands on very many pages of the corpus and says nothing at all"
    for g in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(60)]
        for c in range(14):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(60)] = f"e{rng.randrange(50)}"
            docs[len(docs)] = " ".join(words) + ("\n" + common if c % 3 else "")
    for t in ("a", "A", "a b", "a b", "A B c", "", "  ", "a b c d", "x y z w"):
        docs[len(docs)] = t
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(table, width=3, percent=70).collect()}
    assert got == brute_components(docs, 3, 70)


def test_costly_prefixes_ask_for_more_matches():
    assert choose_extra(np.ones(20), 100, 11, 4) == 1
    assert choose_extra(np.full(20, 500.0), 100, 11, 4) > 1


def test_shingles_equal_a_plain_count(spark):
    import pyarrow as pa

    texts = [None, "", "A b\tC\x0bd e", "é É ñ", "x" * 3000 + " y", "a b c a b c a b c"]
    sizes = [len(s) for s in shingle_sets(pa.array(texts), 3)]
    assert sizes == [len(shingle_set(t, 3)) for t in texts]


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    rows = jaccard_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 6)} == {1}
    assert {(r.doc_id, r.component_id) for r in rows if not r.n_shingles} == {(2, 2), (3, 3), (7, 7)}
    assert jaccard_components(no_docs).count() == 0
