import random
import re
import zlib
from collections import Counter

import pytest

from predio.llm import spelling
from predio.llm.spelling import PositionIndex, thinned_words, variant_groups


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def brute(counts, ratio=5):
    out, forms = {}, {}
    for w, n in counts.items():
        near = sorted((v for v in counts if one_apart(w, v)), key=lambda v: (-counts[v], v))
        form = near[0] if near and counts[near[0]] >= ratio * n else None
        forms[w] = form
        out[w] = (form, n, len(near), counts[form] if form else None)
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (*out[w], root)
    return out


def result(df):
    rows = df.collect()
    out = {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


def vocabulary(seed, size, letters, lengths):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(size)}
    for word in rng.sample(sorted(words), size // 3):  # variants of variants too
        for _ in range(2):
            if not word:
                break
            i, kind = rng.randrange(len(word)), rng.randrange(3)
            word = word[:i] + ("" if kind == 0 else rng.choice(letters)) + word[i + (kind != 2) :]
            words.add(word)
    return {w: rng.choice([5, 5, 6, 30, 150, 900, 6000]) for w in words if len(w) >= min(lengths)}


@pytest.mark.parametrize("seed", range(5))
def test_index_follows_one_error(seed):
    words = sorted(vocabulary(seed, 60, "abé", range(1, 9)))
    index = PositionIndex(words)
    for word in words:
        found = index.near(word)
        assert [w for i, w in enumerate(words) if found >> i & 1] == [w for w in words if one_apart(word, w)]


@pytest.mark.parametrize("block", [16_384, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)  # 3: groups are dealt out in many pairs of chunks
    counts = vocabulary(9, 150, "abñ", range(6, 9)) | {"abcdef": 5, "abcdefg": 25, "abcdefgh": 125, "abcdefghi": 625, "abcdefghj": 625}
    got = result(variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts)
    assert got["abcdef"][4] == "abcdefghi" and max(v[2] for v in got.values()) > 3


def test_runs_lose_a_letter_by_hash(spark):
    texts = {i: "Größere ÄPFEL kleinere naïveté x" * 3 + " kleinere, Größere" for i in range(1500)}
    want = Counter()
    for i, text in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            want[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.word: r.n for r in thinned_words(docs).collect()} == want
    assert any(len(w) == 7 and w not in ("größere", "naïveté") for w in want)


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    assert thinned_words(odd_docs, least_count=1).count() == 2  # shared and übung's neighbours are too short
    assert thinned_words(no_docs).count() == 0
    assert variant_groups(thinned_words(no_docs)).count() == 0
    rows = [("casita", 10, "x"), ("casita", 20, "y"), ("casitas", 200, None), (None, 7, None), ("perros", None, None), ("", 5, "z"), ("a" * 5000, 9, "long"), ("a" * 4999, 50, "long")]
    got = result(variant_groups(spark.createDataFrame(rows, "word string, n long, form string")))  # clashing column, repeated word
    assert got == brute({"casita": 30, "casitas": 200, "": 5, "a" * 5000: 9, "a" * 4999: 50})
