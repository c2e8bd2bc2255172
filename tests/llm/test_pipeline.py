import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from predio.llm.common import materialize
from predio.llm.mixing import source_targets
from predio.llm.queries import tokenizer_files
from predio.llm.stages import cut_shared_lines, keep_good, keep_one_of_each, repeat_as_mixed
from tests.llm.test_jaccard import brute_components
from tests.llm.test_packing import check_pieces

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    """What every stage returns, reread."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns_of_documents(spark, kept):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(df.columns == columns for df in kept[:4])


def test_quality_keeps_clean_documents(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = rows(kept[0])
    good, bad = [i for i, q in labels.items() if q], [i for i, q in labels.items() if not q]
    assert np.mean([i in got for i in good]) > 0.98 and np.mean([i in got for i in bad]) < 0.2


def test_lines_equal_a_plain_loop(kept):
    before, after = rows(kept[0]), rows(kept[1])
    sites = defaultdict(set)
    for r in before.values():
        for line in (r.text or "").split("\n"):
            sites[line.strip(" ")].add(r.source)
    for i, r in before.items():
        left = [x for x in r.text.split("\n") if not x.strip(" ") or len(sites[x.strip(" ")]) < 8]
        assert after[i].text == "\n".join(left)
        assert after[i].n_chars == (len(after[i].text) if after[i].text != r.text else r.n_chars)


def test_one_of_each_group_stays(kept):
    components = brute_components({i: r.text for i, r in rows(kept[1]).items()}, 5, 80)
    assert set(rows(kept[2])) == {c for _, c in components.values()}


def test_mix_meets_targets_and_repeats_documents(kept):
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in rows(kept[2]).items()}
    source = {i: r.source for i, r in rows(kept[2]).items()}
    own, taken = Counter(), Counter()
    for i, n in words.items():
        own[source[i]] += n
    copies = Counter(r.doc_id for r in kept[3].select("doc_id").collect())
    assert max(copies.values()) <= 2 and set(copies) <= set(words)
    for i, n in copies.items():
        taken[source[i]] += n * words[i]
    for s, target in source_targets(list(own.items())).items():
        assert abs(taken[s] - target) <= max(n for i, n in words.items() if source[i] == s) + 1e-6


def test_packing_holds_every_id_of_every_copy(kept):
    exact = Tokenizer.from_file(tokenizer_files()["tokenizer_json"])
    copies = Counter(r.doc_id for r in kept[3].select("doc_id").collect())
    wanted = {i: [*exact.encode(r.text or "", add_special_tokens=False).ids, 1] for i, r in rows(kept[3]).items()}
    assert check_pieces(kept[4].collect(), wanted, copies) == 0


def test_run_applies_all_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    scored = odd_docs.selectExpr("*", "'x' as quality_score")
    assert {r.quality_score for r in keep_good(scored, labels).collect()} <= {"x"} and keep_good(scored, labels).columns == scored.columns
    assert keep_good(no_docs, labels).count() == 0
    for stage in (cut_shared_lines, keep_one_of_each, repeat_as_mixed):
        assert stage(no_docs).count() == 0 and stage(no_docs).columns == no_docs.columns
        assert stage(odd_docs).columns == odd_docs.columns
    assert Counter(r.doc_id for r in keep_one_of_each(odd_docs).collect()) == Counter({None: 1, 1: 2, 2: 1, 3: 1, 4: 1, 7: 1, 8: 1})
    assert {r.doc_id for r in repeat_as_mixed(odd_docs).collect()} <= {None, 1, 4, 6, 8}


def test_copies_on_many_sites_do_not_empty_each_other(spark):
    body = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(30)]
    docs = [(i, "\n".join(body), f"s{i}") for i in range(10)]  # exact copies on ten sites
    docs += [(10 + i, "\n".join([*(x.replace("w", "v") for x in body), f"own tail {i}"]), f"s{i}") for i in range(10)]  # near copies on ten sites
    docs += [(20 + i, f"shared menu line\nown text {i} of {i * 7}", f"s{i}") for i in range(9)]
    docs += [(None, "\n".join(body), "t1"), (None, "no id here", "t2")]
    out = cut_shared_lines(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    want = [(i, t.replace("shared menu line\n", ""), s) for i, t, s in docs]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    copies = spark.createDataFrame(docs[:20], "doc_id long, text string, source string")
    assert {r.doc_id: r.text for r in keep_one_of_each(cut_shared_lines(copies)).collect()} == {0: docs[0][1], 10: docs[10][1]}


def test_mix_tells_rows_apart_by_all_columns(spark):
    text = "one two three four"
    rows = [(1, text, "en", "s"), (1, text, "de", "s"), (1, text, None, "s"), (2, text, "en", "s"), (2, text, "en", "s"), (2, text, "en", "s"), (3, text, None, "en"), (3, text, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    got = Counter(tuple(r) for r in repeat_as_mixed(docs, share=2.0, cap=2.0).collect())
    assert got == {r: 2 * n for r, n in Counter(rows).items()}
