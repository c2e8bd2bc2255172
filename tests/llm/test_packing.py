import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from predio.llm.packing import make_encoder, pack
from predio.llm.queries import op1_hierarchical_packing, tokenizer_files


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(tokenizer_files()["tokenizer_json"])


def check_pieces(rows, wanted, copies=None):
    """Every id of every document in exactly one piece, sequences without gaps, at most 2048 long."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(wanted)
    for doc_id, ids in wanted.items():
        pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
        n = (copies or {}).get(doc_id, 1)
        assert sum(p.length for p in pieces) == n * len(ids)
        covered = np.zeros(len(ids), int)
        for p in pieces:
            assert p.length > 0 and p.doc_tokens == len(ids)
            covered[p.start : p.start + p.length] += 1
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        assert (covered == n).all()
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_query_packs_every_id(spark, sf_dir, exact):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    wanted = {k: [*exact.encode(t, add_special_tokens=False).ids, 1] for k, t in docs.items()}
    assert check_pieces(op1_hierarchical_packing(spark, sf_dir).collect(), wanted) == 0


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs, exact):
    docs = defaultdict(list)
    for r in odd_docs.collect():
        docs[r.doc_id].append([*exact.encode(r.text or "", add_special_tokens=False).ids, 1])
    rows = pack(odd_docs, **tokenizer_files()).collect()
    assert check_pieces(rows, {k: v[0] for k, v in docs.items()}, {k: len(v) for k, v in docs.items()}) == 0
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert pack(no_docs, **tokenizer_files()).count() == 0


def test_step_groups_hold_equal_tokens_through_all_tasks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)
    rows = pack(docs, **tokenizer_files(), with_ids=False, step_tokens=8192).collect()
    groups = defaultdict(int)
    for r in rows:
        groups[r.window, r.step_group] += r.length
    full = [t for t in groups.values() if t == 8192]
    assert max(groups.values()) == 8192 and len(full) >= len(groups) - len({w for w, _ in groups})
    assert all(len({r.step_group for r in rows if r.sequence_id == s}) == 1 for s in list({r.sequence_id for r in rows})[:50])


def test_fast_encoder_equals_tokenizer(exact):
    texts = ["", " ", "a  b\n\n c", "ÄÖ ß ñandú — «x»", "x'll we've 12,345.67!!", "<|endoftext|> end", "🙂🙂 ok\t\ttabs ", "日本語 text", "é‍ z"]
    f = tokenizer_files()
    for got, text in zip(make_encoder(**f)(texts), texts, strict=True):
        assert got.tolist() == exact.encode(text, add_special_tokens=False).ids
