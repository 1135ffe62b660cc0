"""Language-model scores against a plain version that goes bit by bit through one text, and what the model learns against plain counts."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from tabassay.llm import lm_scoring as L
from tabassay.llm._shared import fold

SF = "/root/testdata/sf0.001"
M64, M32 = 2**64 - 1, 2**32 - 1


def split(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(L.span_hashes(L.prefix_sums(L.BYTE_VALUES[data]), np.array([0]), np.array([len(data)]))[0])


def finished(x: int) -> int:
    return int(L.mix(np.array([x & M64], np.uint64))[0])


class Plain:
    """One text's symbols, contexts and stretches in plain integers."""

    def __init__(self, codes: L.Codes, hashes: dict[str, int]):
        self.codes, self.hashes = codes, hashes
        self.place = {int(h): i for i, h in enumerate(codes.head)}

    def hash(self, word: str) -> int:
        if word not in self.hashes:
            self.hashes[word] = word_hash(word)
        return self.hashes[word]

    def symbols(self, words: list[str]):
        """For each token of (words, end) its symbols as (symbol, context, context)."""
        none = int(L._FIRST_WORD)
        all_hashes = [*map(self.hash, words), int(L._END_HASH)]
        for i, h in enumerate(all_hashes):
            one = all_hashes[i - 1] if i else none + 1 & M64
            two = all_hashes[i - 2] if i > 1 else none + 2 & M64
            context = (one >> 32, (one * 0x9E3779B97F4A7C15 + two * 0xD6E8FEB86659FD93 & M64) >> 32)
            at = self.place.get(h)
            out = [(len(self.place) if at is None else at, *context)]
            if at is None:
                code = [*words[i].encode(), L.CLOSE]
                for j, b in enumerate(code):
                    e = [0, *[code[j - k] + 1 if j >= k else 0 for k in range(1, 5)]]
                    two_bytes = e[1] * 0x01000193 + e[2] * 0x9E3779B1 & M32
                    four_bytes = two_bytes + e[3] * 0x85EBCA77 + e[4] * 0xC2B2AE3D + 1 & M32
                    out.append((b + len(self.place) + 1, two_bytes, four_bytes))
            yield out

    def bits(self, symbol: tuple):
        """(node, bit, slot, slot) along a symbol's path."""
        s, *contexts = symbol
        first = int(self.codes.first[s])
        for step in self.codes.steps[first : first + int(self.codes.depth[s])].tolist():
            slots = []
            for c in contexts:
                x = (c ^ ((step >> 1) * 0x9E3779B1 & M32)) * 0x85EBCA6B & M32
                x = (x ^ x >> 15) * 0xC2B2AE35 & M32
                slots.append(x >> 32 - L.SLOT_BITS)
            yield step >> 1, step & 1, *slots

    def stretches(self, words: list[str]) -> list[tuple[str, ...]]:
        out, now, before = [], [], int(L._FIRST_WORD) + 1
        for w in words:
            now.append(w)
            if finished(self.hash(w) * 3 + before) % L.STRETCH == 0:
                out, now = [*out, tuple(now)], []
            before = self.hash(w)
        return [*out, tuple(now)] if now else out


class PlainScore(Plain):
    def __init__(self, model: L.Model, training: list[str | None]):
        super().__init__(model.codes, {})
        self.model = model
        self.counts = Counter(w for t in training for w in [*split(t), L.END])
        self.stretch_counts = Counter(s for t in training for s in self.stretches(split(t)))

    def log(self, symbol: tuple) -> float:
        m, total = self.model.mixer, 0.0
        for node, bit, *slots in self.bits(symbol):
            gate, stretched = int(node >= self.codes.spelt_from), [float(self.codes.plain[node])]
            for k, slot in enumerate(slots):
                state = int(m.slots[k][slot])
                gate = gate * L.LEVELS + state % L.LEVELS
                stretched.append((state // L.LEVELS) / 512 - 8)
            dot = min(11, max(-11, sum(float(m.weights[k][gate]) * s for k, s in enumerate(stretched))))
            at = (min(7.999, max(-8, dot)) + 8) * (L.BINS - 1) / 16
            lo = int(at)
            low, high = (float(m.refine[gate * L.BINS + lo + i]) for i in (0, 1))
            final = (dot + low + (at - lo) * (high - low)) / 2
            total -= math.log1p(math.exp(-final if bit else final))
        return total

    def score(self, text: str | None) -> float:
        words, m = split(text), self.model
        tokens = list(self.symbols(words))
        members = [None, *L.CACHES]
        totals, at, seen = [0.0] * len(members), 0, Counter()
        stretches, earlier, flags = self.stretches(words), Counter(), []
        for j, stretch in enumerate(stretches):
            inside = [0.0] * len(members)
            for w in stretch:
                log = self.log(tokens[at][0])
                if len(tokens[at]) > 1:
                    spelt = sum(map(self.log, tokens[at][1:]))
                    log += math.log(max(self.counts[w] - m.discount, 0) / max(1, m.rare) + m.rest * math.exp(spelt))
                for k, a in enumerate(members):
                    inside[k] += log if a is None else math.log((seen[w] + a * math.exp(log)) / (at + a))
                seen[w] += 1
                at += 1
            last = bool(flags and flags[-1])
            tried = [f for p, f in zip([False, *flags], flags, strict=False) if p == last]
            gate = (sum(tried) + L.GATE_PRIOR[last] * L.GATE_WORTH) / (len(tried) + L.GATE_WORTH)
            whole = (self.stretch_counts[stretch] / max(1, m.stretches) + earlier[stretch] / max(1, j)) / 2
            totals = [t + np.logaddexp(math.log(gate * whole) if whole else -math.inf, math.log1p(-gate) + x) for t, x in zip(totals, inside, strict=True)]
            flags.append(whole > 0)
            earlier[stretch] += 1
        return float(np.logaddexp.reduce(totals) - math.log(len(members)) + self.log(tokens[-1][0])) / math.log(10)


@pytest.fixture(scope="module")
def small(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    training = documents.filter(fold("doc_id", 7) != 2)
    model, _ = L.train(training)
    return documents, training, model


def test_scores_are_those_of_the_plain_version(small):
    documents, training, model = small
    got = {r["doc_id"]: r["score"] for r in L.score(documents, training).collect()}
    plain = PlainScore(model, [r["text"] for r in training.collect()])
    some = sorted((r for r in documents.collect()), key=lambda r: len(r["text"] or ""))[:120]
    assert len(some) == 120 and len(got) == documents.count()
    for r in some:
        assert got[r["doc_id"]] == pytest.approx(plain.score(r["text"]), rel=2e-6, abs=1e-6)


def test_every_bit_of_the_running_text_is_counted(small):
    _, training, model = small
    plain = Plain(model.codes, {})
    ones, total = np.zeros((2, 2, 1 << L.SLOT_BITS), np.int64)
    for r in training.collect():
        for symbols in plain.symbols(split(r["text"])):
            for symbol in symbols:
                for _, bit, *slots in plain.bits(symbol):
                    for k, slot in enumerate(slots):
                        ones[k, slot] += bit
                        total[k, slot] += 1
    assert (L.packed(ones, total) == model.mixer.slots).all()


def test_mixing_beats_its_predictors(small):
    documents, _, model = small
    held = [r["text"] or "" for r in documents.filter(fold("doc_id", 7) == 2).collect()]
    data = [t.encode() for t in held]
    tokens = L.Tokens.of(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(x) for x in data])])
    sym, ctx, _ = L.symbols(model.codes, tokens, 0, len(tokens.hashes), L.word_contexts(tokens))
    alone = []
    for k in range(3):
        weights = np.zeros_like(model.mixer.weights)
        weights[k] = 1
        alone.append(L.Mixer(model.mixer.slots, weights, L.Mixer.new().refine).log(model.codes, sym, ctx).sum())
    unrefined = L.Mixer(model.mixer.slots, model.mixer.weights, L.Mixer.new().refine).log(model.codes, sym, ctx).sum()
    assert max(alone) < unrefined < model.mixer.log(model.codes, sym, ctx).sum()


def test_paths_are_a_whole_tree():
    weights = [5, 1, 1, 9, 2, 2, 7]
    steps, first, plain = L.paths(weights)
    words = [tuple((steps[a:b] & 1).tolist()) for a, b in zip(first, first[1:], strict=False)]
    assert sum(2.0 ** -len(w) for w in words) == 1 and len(set(words)) == 7 and len(plain) == 6
    assert len(words[3]) == min(map(len, words)) and len(words[1]) == max(map(len, words))


def test_a_known_text_is_told_from_a_new_one(spark):
    prose = lambda seed: " ".join(f"w{(seed * 7919 + i * i * 31 + i * seed) % 900}" for i in range(400))
    training = spark.createDataFrame([(i, prose(i)) for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(1000, prose(5)), (1001, prose(997)), (1002, prose(6).upper())], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in L.score(asked, training).collect()}
    assert got[1000] > 0.5 * got[1001] and got[1002] > 0.5 * got[1001]


def test_a_word_of_five_million_bytes(spark):
    long = spark.createDataFrame([(1, "start " + "xyz" * 1_700_000 + " end"), (2, "start end")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.score(long, long.filter("doc_id = 2")).collect()}
    assert got[1]["n_tokens"] == 4 and got[1]["n_known"] == 3 and np.isfinite(got[1]["score"]) and got[1]["score"] < got[2]["score"] < 0


def test_scores_do_not_depend_on_the_head(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j * j + j) % (11 + i)}x" for j in range(60 + i)) + f" once{i} once{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    base, found = [], []
    for head in (L.HEAD, 3):
        monkeypatch.setattr(L, "HEAD", head)
        got = {r["doc_id"]: r for r in L.score(df, df.filter("doc_id < 9")).collect()}
        base.append({i: (r["base_score"], r["n_known"]) for i, r in got.items()})
        found.append({i: r["score"] for i, r in got.items()})
    for i in range(12):
        assert base[0][i] == pytest.approx(base[1][i], rel=1e-9)
        # A head of three words leaves the others to their counts, not to their spellings.
        assert found[1][i] > 2.5 * found[0][i]


def test_earlier_occurrences_take_one_sort(monkeypatch):
    def twice(*_):
        raise AssertionError("a sort by text and hash where one by hash is enough")

    monkeypatch.setattr(np, "lexsort", twice)
    rng = np.random.default_rng(5)
    row, h = np.sort(rng.integers(0, 7, 500)), rng.integers(0, 20, 500).astype(np.uint64) << np.uint64(59)
    seen: dict[tuple, int] = {}
    want = []
    for key in zip(row.tolist(), h.tolist(), strict=True):
        want.append(seen.get(key, 0))
        seen[key] = want[-1] + 1
    assert L._earlier(row, h).tolist() == want
    assert L._earlier(row[:0], h[:0]).tolist() == []
