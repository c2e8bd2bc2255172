import itertools
import random
import re
from collections import Counter

import numpy as np

from predio.llm.filteraudit import audit_filters, difference, place, union

SCHEMA = "doc_id long, text string, source string, mask string, part string, good string"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text))]


def brute(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    docs = [(s or "", i in good, i in toxic, [*fails(t or ""), i is not None and i > first[t or ""]]) for i, t, s in rows]
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in itertools.permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                removed = [d for d in left if d[3][f]]
                left = [d for d in left if not d[3][f]]
                key = part, "".join("ABCDE"[k] for k in order), step
                failing = sum(d[3][f] for d in mine)
                out[key] = [len(left), len(removed), failing - len(removed), sum(d[3][f] and sum(d[3]) == 1 for d in mine), sum(d[1] for d in removed), sum(d[2] for d in removed)]
                shapley[part, f] += len(removed)
    return {(p, o, s): (*v, shapley[p, "ABCDE".index(o[s - 1])]) for (p, o, s), v in out.items()}


def result(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def texts(seed, n):
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        words = [rng.choice("uno dos tres Cuatro CINCO seis# siete ocho".split() if rng.random() < 0.5 else [f"w{rng.randrange(10_000)}"]) for _ in range(rng.choice([0, 1, 150, 199, 200, 260]))]
        made.append(rng.choice(["", " ", "\n"]).join(words) if rng.random() < 0.2 else " ".join(words))
    return [rng.choice(made) if rng.random() < 0.3 else t for t in made]


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice([i, i, i, i - 1, None]), rng.choice([t, t, t, t, None]), rng.choice(["hot", "hot", "s1", "s2", "", None])) for i, t in enumerate(texts(3, 250))]
    rows += rows[:20] + [(9_000_000_000_000_000_001, "x " * 100_000 + "#", "alone"), (9_000_000_000_000_000_000, "x " * 100_000 + "#", "alone")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 250, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9_000_000_000_000_000_001, 1, 0)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(rows, labels)
    assert result(audit_filters(docs, told)) == want
    assert want["alone", "EABCD", 1][1] == 1 and want["alone", "EABCD", 1][4] == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # lists of many small ranges give the same sums
    try:
        assert result(audit_filters(docs, told)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    assert result(audit_filters(odd_docs, labels)) == brute(rows, [])
    assert audit_filters(no_docs, labels).count() == 0


def test_merges_of_sorted_lists():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 40, rng.integers(0, 30))) for _ in "ab")
        assert union(a, b).tolist() == sorted({*a.tolist(), *b.tolist()})
        assert difference(a, b).tolist() == sorted({*a.tolist()} - {*b.tolist()})
        assert place(a, b)[1].tolist() == [x in set(b.tolist()) for x in a.tolist()]
