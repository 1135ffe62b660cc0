"""Nulls, empty and very long texts, ties and repeats, empty tables, clashing extra columns; general paths beside the fast ones."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute

from tabassay.llm import _components, _repeats, decontamination, language_id, line_dedup, lm_scoring, near_dedup, packing, quality, substring_dedup, topk, url_filter
from tabassay.llm import queries as Q
from tabassay.llm._components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, t int, n_removed string, score string, marks string"
PAGES = "page_id long, url string, html string, host string, rule string"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n))


def odd_documents() -> list[tuple]:
    texts = [None, "", " \t\n ", "one", "One two", prose(1, 60), prose(1, 60), prose(1, 58) + " changed end", prose(2, 30_000), "x " * 80, "ÉCOLE été 日本語", prose(3, 70).replace(" ", "\n"), "a\n\n\nb\n\n\nb", "!!! 123", prose(1, 60) + " " + prose(4, 40)]
    rows = [(i, t, "en", None, None, 1, "x", "y", "z") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, prose(1, 60), None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def unique():
    return [(r[0], r[1]) for r in odd_documents()[:15]]


def test_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "d"), (None, "a"), ("x", "y"), ("b", "a")], "a string, b string")
    assert dict(map(tuple, components(edges).collect())) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    path = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r[1] for r in components(path).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_hubs_meet_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(_components, "HUBS_FROM", 0)
    monkeypatch.setattr(_components, "HUB_SHARE", 8)
    edges = spark.range(1, 400).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    parent = list(range(401))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in edges.collect():
        x, y = sorted((find(r["a"]), find(r["b"])))
        parent[y] = x
    assert dict(map(tuple, components(edges).collect())) == {i: find(i) for i in range(1, 401) if i < 400 or find(400) != 400}


def test_aliases_share_decisions(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://bad.net/x", None), (2, "http://copy.com/1", link("http://bad.net/x")), (3, "http://moved.com/", '<meta http-equiv="refresh" content="0; url=//copy.com/1">'), (4, "http://free.com/p", link("http://example.net/en/q")),
        (5, "http://free.com/z", link("/p")), (6, "http://free.com/other", None), (7, None, None), (8, "no scheme", None), (9, "http://copy.com/1?utm_a=1&ref=2#f", None), (1, "http://bad.net/x", None), (10, "x://y.net/en/a", link("http://example.net/en/q")),
    ]
    pages = spark.createDataFrame([(a, b, c, "h", "r") for a, b, c in rows], PAGES)
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in url_filter.judge(pages, spark.createDataFrame(Q.URL_RULES, "host string, path string, action string"), by_form=True).collect()}
    assert got == {1: ("block", "net/"), 2: ("block", None), 3: ("block", None), 4: ("allow", None), 5: ("allow", None), 6: ("allow", None), 7: ("allow", None), 8: ("allow", None), 9: ("block", None), 10: ("block", "net/")}
    none = spark.createDataFrame([], "host string, path string, action string")
    assert {r["verdict"] for r in url_filter.judge(pages, none).collect()} == {"allow"} and url_filter.judge(pages.limit(0), none).count() == 0


def test_long_urls_and_relative_links(spark):
    many = "http://copy.com/1?" + "&".join(f"utm_a={i}" for i in range(20_000))
    link = '<link rel="canonical" href="{}">'.format
    rows = [(1, many, None), (2, "http://bad.net/a/b?x=1&y=2", None), (3, "http://copy.com/1", link("http://bad.net/a/b?x=1&amp;y=2")), (4, "http://q.com/p", link("?z=1")), (5, "http://q.com/p?z=1", link("http://bad.net/a/b?x=1&y=2")), (6, "http://alone.com/p", link("#top")), (7, "http://bad.net/" + "p/" * 500_000, None)]
    pages, rules = spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(Q.URL_RULES, "host string, path string, action string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "block"}
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules, by_form=True).collect()}[1] == "block"


def test_many_rules_take_the_joined_way(spark, monkeypatch):
    urls = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    rules = spark.createDataFrame(Q.URL_RULES, "host string, path string, action string")
    few = sorted(map(tuple, url_filter.match_rules(urls, rules).select("page_id", "rule", "action").collect()))
    monkeypatch.setattr(url_filter, "MAX_LITERAL_RULES", 0)
    assert few == sorted(map(tuple, url_filter.match_rules(urls, rules).select("page_id", "rule", "action").collect()))


def test_language(odd, empty):
    labelled = odd.filter("text IS NOT NULL")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(odd, language_id.train(labelled)).collect() if r["doc_id"] is not None}
    assert all(got[i] == ("und", 0.0) for i in (0, 1, 2, 13)) and got[10][0] == "en"
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.train(empty)).collect()} == {"und"}
    assert language_id.predict(empty, language_id.train(labelled)).count() == 0


def test_cross_parsing_counts_phrases():
    model = language_id.Model(["a", "b"], [b"abcabcabd", b"xyzzyxyz"])
    for text in (b"abcabdxyz", b"zzzz", b"abdabc"):
        want = []
        for t in model.texts:
            n, phrase = 1, b""
            for c in text:
                longer = phrase + bytes([c])
                if longer not in t:
                    n, longer = n + 1, bytes([c]) if bytes([c]) in t else b""
                phrase = longer
            want.append(n)
        got, _ = model.phrases(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert got[0].tolist() == want, text


def test_near_duplicates(odd, empty, unique):
    want = brute.near(unique)
    got = near_dedup.groups(odd).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None) and len(got) == 18
    assert near_dedup.groups(empty).count() == 0


def test_near_duplicates_meet_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    draw, base, rows = random.Random(5), prose(9, 120).split(), []
    for i in range(150):
        w = list(base)
        for j in draw.sample(range(120), draw.randint(0, 9)):
            w[j] = f"n{i}x{j}"
        rows.append((i, " ".join(w)))
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute.near(rows)


def test_sketches_estimate_similarity():
    draw = np.random.default_rng(3)
    both = draw.integers(0, 2**63, 400).astype(np.uint64)
    apart = []
    for shared in (400, 380, 200):
        other = np.sort(np.r_[both[:shared], draw.integers(0, 2**63, 400 - shared).astype(np.uint64)])
        _, _, sketch = near_dedup.signatures(np.r_[np.sort(both), other], np.array([0, 400, 800]))
        apart.append(int(np.bitwise_count(sketch[0] ^ sketch[1]).sum()))
    assert apart[0] == 0 < apart[1] < near_dedup.most_different_bits(0.75) < apart[2]


def test_packing(odd, empty):
    got = packing.pack_documents(odd, Q.tokenizer_path()).collect()
    assert sorted(r["length"] for r in got if r["doc_id"] in (0, 1, 2)) == [1, 1, 1]
    seen = {}
    for r in got:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seen.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(empty, Q.tokenizer_path()).count() == 0


def test_packing_spreads_equal_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 10)
    pieces = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(700).cast("long").alias("length"))
    got = packing.pack(pieces).collect()
    assert len(got) == 500 == len({(r["sequence_id"], r["offset"]) for r in got}) and len({r["sequence_id"] for r in got}) == 250
    with pytest.raises(ValueError):
        packing.pack(pieces.withColumn("length", F.lit(3000)))
    inner = ["first", "lo", "hi", "each", "base", "n", "_lo", "_rank", "_g", "_cell", "_own", "_before", "offset", "_c0"]
    odd = packing.pack(pieces.select("*", *[F.lit("x").alias(c) for c in inner]))
    assert odd.columns == ["doc_id", "piece", "length", *[c for c in inner if c != "offset"], "sequence_id", "offset"]
    assert all(r["lo"] == r["_rank"] == r["_c0"] == "x" for r in odd.collect())


def test_another_tokenizer_reads_whole_texts():
    import public_tokenizers
    from pathlib import Path as P
    from tokenizers import Tokenizer

    texts = ["Don't STOP now: it's 2024!", "École été 日本語", "a  b\n\nc", ""]
    for path in sorted(P(public_tokenizers.path("word_bpe_49k.json")).parent.glob("*.json")):
        try:
            tokenizer = Tokenizer.from_file(str(path))
        except Exception:  # not every file beside it is one
            continue
        got = [np.frombuffer(packing.token_bytes(t, str(path)), "<u4").tolist() for t in texts]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts], path


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_is_near_the_bound(spark, seed):
    draw = random.Random(seed)
    counts = {draw.randint(1, 100): draw.randint(1, 60) for _ in range(40)}
    plan = packing.best_fit(spark.createDataFrame(list(counts.items()), "length long, n long"), 100).collect()
    bins: dict[int, list] = {}
    for length, lo, hi, first, each, base in plan:
        for r in range(lo, hi):
            bins.setdefault(first + (r - lo) // each, []).append((base + (r - lo) % each * length, length))
    assert sum(map(len, bins.values())) == sum(counts.values())
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 100
    gaps: list[int] = []  # plain best fit, longest first
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        at = min((i for i, g in enumerate(gaps) if g >= length), key=lambda i: gaps[i], default=None)
        if at is None:
            gaps.append(100 - length)
        else:
            gaps[at] -= length
    assert len(bins) <= len(gaps) + 1


def test_quality(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1, 0), (11, 0, 0), (9, 0, 1), (14, 1, None), (None, 1, 0), (4, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(odd, quality.train(odd, labels), keep=("source",)).collect()
    assert len(got) == 18 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.score(odd, quality.train(odd, labels.filter("quality = 1"))).collect()} == {0.5}
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def test_substrings(odd, empty):
    rows = odd_documents()
    got = sorted(map(tuple, substring_dedup.dedup(odd, digest=True).collect()), key=repr)
    assert got == sorted(brute.substrings([(r[0] if r[0] is not None else -1, r[1]) for r in rows]) and [(None if i == -1 else i, *x) for i, *x in brute.substrings([(r[0] if r[0] is not None else -1, r[1]) for r in rows])], key=repr)
    assert substring_dedup.dedup(empty).count() == 0
    assert dict(map(lambda r: (r["doc_id"], r["kept"]), substring_dedup.dedup(odd).collect()))[4] == "One two"


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_repetitive_texts(spark, seed):
    draw = random.Random(seed)
    rows = [(i, " ".join(draw.choice(["a", "b"] if i % 3 else ["a", "b", "c", "d"]) for _ in range(draw.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, substring_dedup.dedup(df, size=9, gram=3, digest=True).collect()))
    assert got == brute.substrings(rows, 9)


def test_lines(odd, empty, unique):
    want = brute.repeated_lines([(i, t) for i, t in unique])
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(odd.filter("doc_id IS NOT NULL")).collect()}
    assert {i: t or "" for i, t in got.items()} == want and got[0] is None
    assert line_dedup.dedup(odd).columns == [c for c in odd.columns if c != "n_removed"] + ["n_lines", "n_removed"]
    assert line_dedup.dedup(empty).count() == 0


def test_long_lines_go_by_themselves(spark):
    line = "one two three four five six seven eight"
    rows = [(1, f"a\n{line}\nb"), (2, f"{line}\n{line} nine"), (3, line[:-6]), (4, line[:-6]), (5, f"x y z\n{line}"), (6, f" {line}\n" + line + " nine"), (7, line + "\n" + line)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeated_lines(rows) and got[2] == f"{line} nine" and got[7] == ""
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), long_words=0).collect()}
    assert kept == dict(rows)


def test_marks_of_repeated_rows_are_counted_once(spark):
    rows = [(1, prose(1, 60))] * 2000 + [(None, prose(1, 60))] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = _repeats.repeated(df, _repeats.Shape("words", 35, 5), keep_first=False).collect()
    assert len(marks) == 2 and all(len(r["marks"]) <= 26 for r in marks)
    assert {r["n_removed"] for r in substring_dedup.dedup(df).collect()} == {60}


@pytest.mark.parametrize("seed", range(3))
def test_lines_of_repetitive_texts(spark, seed):
    draw = random.Random(seed)
    rows = [(i, "\n".join(draw.choice("abc") for _ in range(draw.randint(1, 12)))) for i in range(50)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeated_lines(rows)


def test_lm(odd, empty):
    got = lm_scoring.score(odd, odd.filter("doc_id < 9")).collect()
    assert len(got) == 18 and all(np.isfinite([r["score"], r["base_score"]]).all() for r in got)
    want = brute.unigram([(i, t) for i, t in [(r[0], r[1]) for r in odd_documents()[:15]]], 1, 5)
    assert {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"] is not None} == {i: w[1] for i, w in want.items()}
    none = lm_scoring.score(odd, empty).collect()
    assert {r["train_tokens"] for r in none} == {0} and {r["n_known"] for r in none} == {0}
    assert lm_scoring.score(empty, odd).count() == 0


def test_lm_without_a_head_joins_every_token(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD", 3)
    rows = [(i, prose(i % 4, 20 + i)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.unigram(rows, 1, 5)
    for r in lm_scoring.score(df, df).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][1:4] and r["base_score"] == pytest.approx(want[r["doc_id"]][4])


def test_chances_of_symbols_add_up(spark):
    model, _ = lm_scoring.train(spark.createDataFrame([(0, "a b a c b a"), (1, "b a")], "doc_id long, text string"))
    for lo, hi in ((0, len(model.codes.head) + 1), (len(model.codes.head) + 1, len(model.codes.depth))):
        sym = np.arange(lo, hi)
        for context in ((0, 0), (12345, 99)):
            chances = np.exp(model.mixer.log(model.codes, sym, np.tile(np.array(context, np.uint32)[:, None], len(sym))))
            assert chances.sum() == pytest.approx(1, rel=1e-4)


def test_contamination(spark, odd, empty, unique):
    items = [(1, prose(1, 60)), (2, "one"), (3, None), (4, ""), (5, "One two"), (2, "changed end"), (None, "été"), (10, prose(4, 14))]
    bench = spark.createDataFrame([(a, b, "x", 1) for a, b in items], "item_id long, text string, lang string, t int")
    want = {w[0]: w[1:4] + (w[5],) for w in brute.contaminated(unique, [("null" if a is None else a, b) for a, b in items])}
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), r["contaminated"]) for r in decontamination.contamination(odd, bench).collect() if r["doc_id"] is not None}
    assert got == want
    assert decontamination.contamination(empty, bench).count() == 0
    assert {r["n_hit"] for r in decontamination.contamination(odd, bench.limit(0)).collect()} == {0}


def test_an_item_without_id_is_not_the_item_null(spark, odd):
    bench = spark.createDataFrame([(None, "one"), ("null", "One two"), ("", "one")], "item_id string, text string")
    got = {r["doc_id"]: r["items"] for r in decontamination.contamination(odd, bench).collect()}
    assert got[3] == [None, ""] and got[4] == [None, "", "null"] and got[1] == []


def test_contamination_by_shuffle_agrees(spark, odd, monkeypatch):
    bench = spark.createDataFrame([(1, prose(1, 60)), (2, "one"), (5, "One two")], "item_id long, text string")
    few = sorted(map(str, decontamination.contamination(odd, bench).collect()))
    monkeypatch.setattr(decontamination, "MAX_LITERAL_TOKENS", 0)
    assert few == sorted(map(str, decontamination.contamination(odd, bench).collect()))


def test_top_k(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) / 4 for j in range(6)], 0) for i in range(90)]
    rows += [(100, None, 1), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (102, [float("nan")] * 6, 1), (103, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (120, [3.0e9, -2.0e9, 1.0, 0.0, 0.0, 0.5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    vectors = topk.quantised(df)
    got = sorted(map(tuple, topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 7, 4, 16).collect()))
    clean = [(i, v) for i, v, _ in rows if i is not None]
    want = [(q, r, i, min(max(s, -(2**63)), 2**63 - 1)) for q, r, i, s in brute.top(clean, 7)]
    assert got == want
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    assert topk.top_k(vectors.limit(1), vectors.limit(1)).count() == 0


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [2, 1]), (0, [1, 5]), (1, [3, 3]), (1, [3, 3]), (2, [-4, 0]), (3, [1]), (20, [7])]
    df = spark.createDataFrame([(i, v, 9, 9) for i, v in rows], "vec_id long, v array<long>, b int, dims int")
    got = sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 20 = 0"), 3, 4, 2).collect()))
    assert got == [(0, 1, 1, 18), (0, 2, 1, 18), (0, 3, 2, -4), (20, 1, 3, 7)]


def test_top_k_stops_early():
    draw = np.random.default_rng(1)
    block = draw.integers(-3, 4, (400, 6))
    block[:30] *= 20
    places = np.argsort(-block, axis=0, kind="stable")
    lists, queries = np.take_along_axis(block, places, axis=0).T, draw.integers(-5, 6, (9, 6))
    scores = queries @ block.T
    kth = np.sort(scores, axis=1)[:, -5]
    reads = []
    for floor in (np.full(9, -np.inf), kth.astype(float)):
        q, c, s, read = topk.block_top(np.full(9, -1), queries, floor, np.arange(400), lists, places.T, 5)
        reads.append(read)
        for i in range(9):
            want = sorted(((-scores[i, j], j) for j in range(400)))[:5]
            assert [(-int(b), int(a)) for a, b in zip(c[q == i], s[q == i], strict=True)] == want
    # A score known from elsewhere leaves most of the lists unread.
    assert reads[1].sum() < 0.5 * reads[0].sum() and (reads[1] <= reads[0]).all()
    far, *_ = topk.survivors(queries, lists, places.T, np.zeros((9, 400), bool), np.full(9, 1e9), 5)
    assert not far.any()


def test_covered():
    marks = [{"pos": 1, "n": 2, "offsets": None}, {"pos": 5, "n": 3, "offsets": [2]}]
    assert _repeats.covered(10, marks, 2).tolist() == [False, True, True, True, False, False, False, True, True, False]
