"""Every opN query over whole small tables against its brute-force version, exact round trip or held-out accuracy."""

from __future__ import annotations

import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute

from tabassay.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_op1(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in Q.op1_url_filters(spark, SF).collect()}
    assert len(got) == len(pages)
    action = {h + p: a for h, p, a in brute.RULES}
    for p in pages:
        host, path, rule = brute.url(p.url)
        assert (got[p.page_id].host, got[p.page_id].path, got[p.page_id].rule) == (host, path, rule)
        assert got[p.page_id].verdict == action[rule] if rule else got[p.page_id].verdict in ("allow", "block")


def test_op2(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.op2_language_id(spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95


def test_op3(spark, docs):
    want = brute.near(docs)
    got = Q.op3_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want and len(got) == len(docs)


def test_op4(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path())
    got = Q.op4_best_fit_packing(spark, SF).collect()
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in got:
        pieces[r.doc_id][r.piece] = r
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for k in range(0, len(ids), Q.CAPACITY):
            part, r = ids[k : k + Q.CAPACITY], pieces[i].pop(k // Q.CAPACITY)
            assert (r.start, r.length, r.ids_crc32) == (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        assert not pieces[i]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= Q.CAPACITY
    assert len(sequences) <= -(-total // Q.CAPACITY) * 1.02 + 1
    assert len(sequences) == brute.sequences([r.length for r in got], Q.CAPACITY)


def test_op5(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = Q.op5_quality_classifier(spark, SF).collect()
    held = [(r.predicted, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    assert np.mean([a == b for a, b in held]) > 0.93
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def test_op6(spark, docs):
    assert rows(Q.op6_substring_dedup(spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substrings(docs)


def test_op7(spark, docs):
    want = brute.unigram(docs)
    got = Q.op7_lm_scoring(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        held, tokens, known, n, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_op8(spark, docs):
    import hashlib

    want = brute.repeated_lines(docs)
    got = Q.op8_line_dedup(spark, SF).collect()
    assert {r.doc_id: r.kept_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert sum(r.n_removed for r in got) > 0


def test_op9(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows(Q.op9_benchmark_decontamination(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.contaminated(docs, items)
    assert any(r[-1] for r in got)


def test_op10(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows(Q.op10_exact_top_k(spark, SF), "query_id", "rank", "vec_id", "score") == brute.top(vectors)
