"""Operator 12 against a plain count of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tabassay.llm import collocations as C

SCHEMA = "lang string, text string"


def plain(docs, least=30, most=4, percent=80, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for i in range(len(words)):
                for n in range(1, min(most, len(words) - i) + 1):
                    f[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], a)
        rows = []
        for p, a in candidates.items():
            if p in longest and 100 * longest[p] >= percent * a:
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    words = ["a", "B", "b", "Äx", "cc", "dä", " ", "e" * 50, "x\x00y", " "]
    docs = [(rng.choice([None, "en", "de", "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", ";;"]) for _ in range(rng.randrange(60)))) for _ in range(200)]
    docs += [("en", None), ("en", ""), (None, " .,\n"), *docs[:20], ("en", "a b cc " * 5000)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    assert got(C.collocations(df, least=8)) == plain(docs, least=8)
    assert got(C.collocations(df, least=3, max_words=3, percent=50, top=7)) == plain(docs, 3, 3, 50, 7)
    assert got(C.collocations(df, least=5, max_words=2)) == plain(docs, 5, 2)


def test_parts_that_are_not_sent(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(rng.choice(["en", "de"]), " ".join(rng.choices("abcdefgh", k=100)) + rng.choice(["", ".", ", "])) for _ in range(40)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    want = got(C.collocations(df, least=6))
    monkeypatch.setattr(C, "SENT_BYTES", 0)
    assert got(C.collocations(df, least=6)) == want == plain(docs, least=6)


def test_shards_of_any_size_give_the_same_counts(spark):
    docs = [("en", " ".join(random.Random(i).choices("abcdefg", k=300)) + ".") for i in range(30)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    small, large = (C.phrase_counts(df, 5, 4, shard_bytes=s)[0] for s in (100, 1 << 20))
    assert got(small) == got(large) and small.count() > 100


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("en", "a b " * 40, 1, "p", 2)], "lang string, text string, n int, phrase string, shard int")
    assert got(C.collocations(df)) == plain([("en", "a b " * 40)])
    assert got(C.collocations(df.filter("false"))) == []


def test_suffix_array_and_intervals():
    ids = np.random.default_rng(3).integers(0, 3, 500)
    order = C.suffix_array(ids, np.arange(496), 4)
    assert sorted(order) == list(range(496)) and [tuple(ids[i : i + 4]) for i in order] == sorted(tuple(ids[i : i + 4]) for i in range(496))
    for n in (1, 2, 3, 4):
        at, size = C.intervals(ids, order, n)
        assert {tuple(ids[i : i + n]): c for i, c in zip(at, size, strict=True)} == Counter(tuple(ids[i : i + n]) for i in range(496))


def test_phrases_as_numbers_of_words(spark, monkeypatch):
    """Codes give back language, length and words; counts are the same where words are sent and pairs are not."""
    v = C.Vocabulary({"en": pa.array(["a", "b", "cc"]), "de": pa.array(["b", "ä"])})
    phrases = [("en", "a b"), ("de", "ä b ä"), ("en", "cc cc a b"), ("de", "b b b"), ("en", "a a")]
    codes = [v.coded(v.numbers(lang, pa.array(p.split(), pa.large_string()))[None, :]) for lang, p in phrases]
    a, b = (np.concatenate(x) for x in zip(*codes, strict=True))
    lang, n, phrase = (x.to_pylist() for x in v.decoded(a, b))
    assert list(zip(lang, phrase, strict=True)) == phrases and n == [2, 3, 4, 3, 2] and len(set(zip(a, b, strict=True))) == 5
    assert v.numbers("fr", pa.array(["a"])).tolist() == [-1] and v.numbers("de", pa.array(["a", "b"])).tolist() == [-1, 3]
    rng = random.Random(6)
    docs = [(rng.choice(["en", "de", None]), " ".join(rng.choices(["a", "b", "Äx", "x\x00y", "dd"], k=100)) + rng.choice(["", ".", ", "])) for _ in range(40)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    # 15 words and 75 pairs: the first are sent, the second are not.
    monkeypatch.setattr(C, "SENT_BYTES", 500)
    assert got(C.collocations(df, least=6)) == plain(docs, least=6)
