"""Language and quality of every document of a whole table against versions that know neither automata nor arrays."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest

from tabassay.llm import language_id, quality
from tabassay.llm import queries as Q
from tabassay.llm._shared import fold

SF = "/root/testdata/sf0.001"
PIECE = 4096


def folded(text: bytes) -> bytes:
    """Letters of ASCII in lower case, other ASCII a space, spaces in a row one."""
    return re.sub(rb"[\x00-\x7f]+", lambda m: re.sub(rb"[^a-z]+", b" ", m[0].lower()), text).replace(b"  ", b" ")


def phrases(text: bytes, known: bytes) -> int:
    """Phrases of the greedy parse, begun anew every PIECE bytes; a byte that is not known belongs to the next phrase."""
    total = 0
    for i in range(0, len(text), PIECE):
        total, phrase = total + 1, b""
        for k in range(i, min(i + PIECE, len(text))):
            byte = text[k : k + 1]
            if phrase + byte in known:
                phrase += byte
            else:
                total, phrase = total + 1, byte if byte in known else b""
    return total


def prediction(text: str | None, langs: list[str], known: list[bytes]) -> tuple[str, float]:
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0
    own = folded(text.encode())
    entropy = [phrases(own, k) * math.log2(max(2, len(k))) / len(own) for k in known]
    least = min(entropy)
    return langs[entropy.index(least)], 1 / sum(2 ** -((e - least) * min(len(own), 64)) for e in entropy)


def test_language_of_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.filter(fold("doc_id", 5) != 0))
    known = [folded(t) for t in model.texts]
    got = {r.doc_id: (r.lang_pred, r.score) for r in Q.op2_language_id(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        lang, score = prediction(r.text, model.langs, known)
        assert got[r.doc_id][0] == lang and got[r.doc_id][1] == pytest.approx(score, abs=1e-9), r.doc_id


def share(text: bytes, kind: str) -> float:
    return len(re.findall(kind.encode("latin-1"), text)) / max(1, len(text))


def plain_features(text: bytes) -> list[float]:
    kinds = ["[A-Z]", "[a-z]", "[0-9]", r"[.,;:?'\"\-()]", "!", r"[|<>{}\[\]=_~^\\`]", "[#$%&*@+/]", "[\x80-\xff]", "\n"]
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", text)]
    lines = text.split(b"\n")
    n, some = len(words), max(1, len(words))
    x = [share(text, k) for k in kinds]
    x += [min(math.log(1 + n) / 12, 1), min(sum(map(len, words)) / some / 20, 2), min(math.sqrt(sum(len(w) ** 2 for w in words) / some) / 20, 2)]
    x += [sum(a == b for a, b in zip(words, words[1:])) / some, len(set(words)) / some, max(map(words.count, set(words)), default=0) / some]
    x += [sum(not re.search(rb"[a-z\x80-\xff]", w) for w in words) / some, len(set(lines)) / len(lines), min(n / len(lines) / 50, 2)]
    return x + [math.sqrt(v) for v in x]


def test_quality_of_every_document(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: (r.score, r.predicted) for r in Q.op5_quality_classifier(spark, SF).collect()}
    ranker = quality.train(docs, labels.filter(fold("doc_id", 3) != 1))
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        x = plain_features((r.text or "").encode())
        raw = sum(w * (v - c) / s for w, v, c, s in zip(ranker.weights, x, ranker.centre, ranker.spread, strict=True)) - ranker.threshold
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, raw))))
        assert got[r.doc_id][0] == pytest.approx(score, abs=1e-6) and got[r.doc_id][1] == int(got[r.doc_id][0] >= 0.5), r.doc_id


def test_weights_are_the_best_of_their_loss():
    draw = np.random.default_rng(3)
    good, bad = draw.normal(0.4, 1, (300, 5)), draw.normal(0, 1, (260, 5))
    ranker = quality.fit(good, bad, 0.5, pairs=4000)
    same = np.random.Generator(np.random.PCG64(5))
    diff = (good[same.integers(0, 300, 4000)] - bad[same.integers(0, 260, 4000)]) / np.r_[good, bad].std(axis=0)
    loss = lambda w: np.mean(np.log1p(np.exp(-diff @ w))) + 0.5e-3 * w @ w
    for k in range(5):
        for step in (-0.01, 0.01):
            assert loss(ranker.weights) < loss(ranker.weights + step * np.eye(5)[k])
