"""Language-model scores of whole texts by online logistic mixing of hashed-context bit predictors.

A text is a stream of symbols: frequent words, an escape for every other word, that word's bytes
after the escape, and the end. Each symbol is a path of bits in a Huffman tree. Three predictors
know a bit's chance: its node alone, the node after the last word (or the last two bytes), and the
node after the last two words (or the last four bytes); the latter two hash their context to a slot
of counts. Stretched chances are mixed by weights that are gated by the evidence in both slots, and
an adaptive map refines the mix. Counts, weights and map are learned online, bit by bit in running
text, over every training text: each part of the corpus goes on from what it has read so far, and
the parts' counts are added up, their weights averaged by the bits that each has seen.

Two predictors grow with the corpus and are looked up by joins. Of every word, however rare, the
exact count is known: after the escape a word costs its discounted frequency or its spelling. And of
every stretch of text between two hash-chosen places the count is known: a gate, a bit predictor
that adapts along the document, mixes the chance of a known stretch with that of its words. Caches
of different strength that learn a document's own words are weighted by how well they predict it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm._shared import batched, discard, table
from tabassay.llm._text import LOWER, U64, column_bytes, mix, prefix_sums, slices, span_hashes, words
from tabassay.llm._text import _BYTE_VALUES as BYTE_VALUES

#: The document's end as a token, and the byte that closes a spelling; neither can stand in a word.
END, CLOSE = "\n", 32
#: Most frequent words that have a symbol of their own; every other word is an escape and is looked up by its exact count.
HEAD = 1 << 18
#: log2 of the slots of each of the two hashed contexts, and of those that are added up at a time.
SLOT_BITS, BLOCK_BITS = 20, 16
#: Words of a stretch of text on average, and tokens that the model's chances weigh against a document's own words in each cache.
STRETCH, CACHES = 16, (60.0, 600.0)
#: Text bytes, words and symbols that a task holds at a time, and bits between two looks at its counts.
TEXT_BYTES, WINDOW, SYMBOLS, REFRESH = 1 << 20, 1 << 14, 1 << 11, 16_000_000
#: Text that a task counts before it passes its counts on.
COUNT_BYTES = 16 << 20
LEVELS, BINS, SHELF_BITS = 8, 33, 19
GATES = 2 * LEVELS * LEVELS
LN10 = float(np.log(10))
#: Weights of bytes in the tree of spellings, before anything is read: letters and the close, digits, bytes beyond ASCII, others.
_BYTE_WEIGHTS = [200 if b == CLOSE or 97 <= b <= 122 else 40 if 48 <= b <= 57 else 8 if b >= 128 else 4 for b in range(256)]
_FIRST_WORD = U64(0x632BE59BD9B4E019)
_END_HASH = span_hashes(prefix_sums(BYTE_VALUES[np.frombuffer(END.encode(), np.uint8)]), np.array([0]), np.array([1]))[0]


def huffman(weights: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Parent (node, from the leaves' number on) and bit of every leaf and inner node; the last node is the root. Equal weights merge in order."""
    n = len(weights)
    order = sorted(range(n), key=weights.__getitem__)
    parent, bit = np.zeros(max(1, 2 * n - 1), np.int64), np.zeros(max(1, 2 * n - 1), np.uint8)
    inner: list[int] = []
    a = b = 0
    for node in range(n, 2 * n - 1):
        total = 0
        for side in (0, 1):
            if a < n and (b >= len(inner) or weights[order[a]] <= inner[b]):
                child, w, a = order[a], weights[order[a]], a + 1
            else:
                child, w, b = n + b, inner[b], b + 1
            parent[child], bit[child], total = node, side, total + w
        inner.append(total)
    return parent, bit


def paths(weights: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps (2 * node + bit) of every leaf's path from the root, where each path begins, and the stretched chance of a 1 at each node."""
    n = len(weights)
    parent, bit = huffman(weights)
    weight = np.zeros(2 * n - 1)
    weight[:n] = weights
    ones = np.zeros(2 * n - 1)
    at, steps = np.arange(n), []
    live = np.arange(n) if n > 1 else np.arange(0)
    while len(live):
        steps.append((live, parent[at[live]], bit[at[live]]))
        np.add.at(weight, parent[at[live]], weight[live])
        np.add.at(ones, parent[at[live]], np.where(bit[at[live]] == 1, weight[live], 0))
        at[live] = parent[at[live]]
        live = live[at[live] != 2 * n - 2]
    depth = np.zeros(n, np.int64)
    for leaf, _, _ in steps:
        depth[leaf] += 1
    first = np.r_[0, np.cumsum(depth)]
    taken = np.zeros(first[-1], np.int32)
    for k, (leaf, node, b) in enumerate(steps):
        taken[first[leaf + 1] - 1 - k] = 2 * (node - n) + b
    p, total = ones[n:], weight[n:]
    return taken, first, np.log((p + 0.4) / (total - p + 0.4)).astype(np.float32)


@dataclass
class Codes:
    """Frequent words (hashes in order, counts) and every symbol's path; symbols are those words, the escape, and 256 bytes."""

    head: np.ndarray
    head_c: np.ndarray
    steps: np.ndarray
    first: np.ndarray
    plain: np.ndarray
    spelt_from: int
    shelf: np.ndarray
    depth: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the head, or any other place if it is not there."""
        at = np.minimum(self.shelf[(h >> U64(64 - SHELF_BITS)).astype(np.int64)], len(self.head) - 1).astype(np.int64)
        last = len(self.head) - 1
        behind = np.flatnonzero((self.head[at] < h) & (at < last))
        while len(behind):
            at[behind] += 1
            behind = behind[(self.head[at[behind]] < h[behind]) & (at[behind] < last)]
        return at

    @classmethod
    def of(cls, head: np.ndarray, head_c: np.ndarray, rest: int) -> Codes:
        order = np.argsort(head)
        head, head_c = head[order], head_c[order]
        word, byte = paths([*np.maximum(head_c, 1).tolist(), max(1, rest)]), paths(_BYTE_WEIGHTS)
        inner = len(head)  # one less than the leaves
        shelf = np.searchsorted(head, np.arange(1 << SHELF_BITS, dtype=U64) << U64(64 - SHELF_BITS)).astype(np.int32)
        first = np.r_[word[1], byte[1][1:] + word[1][-1]]
        return cls(head, head_c, np.r_[word[0], byte[0] + 2 * inner].astype(np.int32), first[:-1], np.r_[word[2], byte[2]].astype(np.float32), inner, shelf, np.diff(first))


@dataclass
class Tokens:
    """Words of some texts and each text's end, in order: hashes, places in data, text of each, first token of each text."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Tokens:
        u, rows = words(data, offsets), len(offsets) - 1
        first = u.first + np.arange(rows + 1)
        at = np.arange(len(u.row)) + u.row
        out = cls(data, np.full(first[-1], _END_HASH), np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64), np.repeat(np.arange(rows), np.diff(first)), first)
        out.hashes[at], out.starts[at], out.ends[at] = u.hashes(lower=True), u.starts, u.ends
        return out

    def before(self, back: int) -> np.ndarray:
        """Hash of the token so many places earlier in the text."""
        out = np.full(len(self.hashes), _FIRST_WORD)
        out[back:] = self.hashes[:-back] if back < len(out) else out[back:]
        place = np.arange(len(out)) - self.first[self.row]
        out[place < back] = _FIRST_WORD + U64(back)
        return out

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """Each token's stretch (-1 for ends) and each stretch's key: a stretch ends where the last two words' hash says so, or with the text."""
        is_end = np.zeros(len(self.hashes), bool)
        is_end[self.first[1:] - 1] = True
        marks = mix(self.hashes * U64(3) + self.before(1))
        closing = (marks % U64(STRETCH) == 0) & ~is_end
        last = np.zeros(len(is_end), bool)
        last[:-1] = is_end[1:] & ~is_end[:-1]
        inside = np.flatnonzero(~is_end)
        stop = (closing | last)[inside]
        which = np.full(len(is_end), -1, np.int64)
        which[inside] = np.r_[0, np.cumsum(stop)[:-1]] if len(inside) else 0
        ends = np.flatnonzero(stop) + 1
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        keys = span_hashes(prefix_sums(self.hashes[inside]), starts, ends)
        return which, mix(keys ^ U64(0xA0761D6478BD642F))


def spelling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (A-Z lower-cased) and closes of the words at starts:ends, the word and place of each, and both contexts."""
    size = ends - starts + 1
    bounds = np.r_[0, np.cumsum(size)]
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(bounds[-1]) - bounds[word]
    code = LOWER[data[np.minimum(starts[word] + place, max(0, len(data) - 1))]] if len(data) else np.zeros(0, np.uint8)
    code[bounds[1:] - 1] = CLOSE
    earlier = np.zeros((5, len(code)), np.uint32)
    for back in range(1, 5):
        earlier[back, back:] = code[:-back].astype(np.uint32) + np.uint32(1) if back < len(code) else 0
        earlier[back, place < back] = 0
    two = earlier[1] * np.uint32(0x01000193) + earlier[2] * np.uint32(0x9E3779B1)
    four = two + earlier[3] * np.uint32(0x85EBCA77) + earlier[4] * np.uint32(0xC2B2AE3D) + np.uint32(1)
    return code, word, place, np.stack([two, four])


def symbols(codes: Codes, tokens: Tokens, lo: int, hi: int, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of tokens lo:hi, both contexts of each, and where each token's symbols begin. contexts: both of every token."""
    h = tokens.hashes[lo:hi]
    at = codes.find(h)
    rare = np.flatnonzero(codes.head[at] != h)
    escape = len(codes.head)
    at[rare] = escape
    size = np.ones(len(h), np.int64)
    starts, ends = tokens.starts[lo:hi][rare], tokens.ends[lo:hi][rare]
    size[rare] += ends - starts + 1
    first = np.r_[0, np.cumsum(size)]
    if not len(rare):
        return at, contexts[:, lo:hi], first
    sym, ctx = np.empty(first[-1], np.int64), np.empty((2, first[-1]), np.uint32)
    sym[first[:-1]], ctx[:, first[:-1]] = at, contexts[:, lo:hi]
    code, word, place, inside = spelling(tokens.data, starts, ends)
    where = first[:-1][rare][word] + 1 + place
    sym[where], ctx[:, where] = code.astype(np.int64) + escape + 1, inside
    return sym, ctx, first


def word_contexts(tokens: Tokens) -> np.ndarray:
    """Both hashed contexts of every token: the last word, and the last two."""
    one, two = tokens.before(1), tokens.before(2)
    return np.stack([(one >> U64(32)).astype(np.uint32), ((one * U64(0x9E3779B97F4A7C15) + two * U64(0xD6E8FEB86659FD93)) >> U64(32)).astype(np.uint32)])


def packed(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A slot's counts in 16 bits: the stretched chance of a 1 in steps of 1/512 from -8, and the level of evidence."""
    out = np.full(total.shape, 4096 << 3, np.uint16)
    full = np.flatnonzero(total)
    n, one = total.ravel()[full].astype(np.float32), ones.ravel()[full].astype(np.float32)
    stretch = np.log((one + np.float32(0.3)) / (n - one + np.float32(0.3)))
    level = (1 + (n > 1) + 2 * (n > 3) + 2 * (n > 15) + ((n > 1) & ((one == 0) | (one == n)))).astype(np.uint16)
    out.ravel()[full] = (np.clip(np.rint((stretch + 8) * 512), 0, 8191).astype(np.uint16) << np.uint16(3)) | level
    return out


@dataclass
class Mixer:
    """Packed slots of both hashed contexts, weights (predictor x gate) and the map's logits (gate x bin)."""

    slots: np.ndarray
    weights: np.ndarray
    refine: np.ndarray

    @classmethod
    def new(cls) -> Mixer:
        weights = np.tile(np.array([[0.6], [0.3], [0.3]], np.float32), (1, GATES))
        return cls(packed(*np.zeros((2, 2, 1 << SLOT_BITS), np.uint8)), weights, np.tile(np.linspace(-8, 8, BINS), GATES).astype(np.float32))

    def mixed(self, codes: Codes, sym: np.ndarray, ctx: np.ndarray) -> tuple:
        """Of every bit of the symbols: where each symbol's begin, the bit, both slots, gate, the three stretched chances and their mix."""
        depth, begin = codes.depth[sym], codes.first[sym]
        bounds = np.zeros(len(sym) + 1, np.int64)
        np.cumsum(depth, out=bounds[1:])
        begin -= bounds[:-1]
        index = np.repeat(begin, depth)
        index += np.arange(bounds[-1])
        step = codes.steps[index]
        bit, node = step & 1, (step >> 1).astype(np.int64)
        salt = step.view(np.uint32) >> np.uint32(1)
        salt *= np.uint32(0x9E3779B1)
        gate = (step >= 2 * codes.spelt_from).astype(np.uint16)
        stretched, slots = [codes.plain.take(node, mode="clip")], []
        for k in range(2):
            slot = np.repeat(ctx[k], depth)
            slot ^= salt
            slot *= np.uint32(0x85EBCA6B)
            slot ^= slot >> np.uint32(15)
            slot *= np.uint32(0xC2B2AE35)
            slot >>= np.uint32(32 - SLOT_BITS)
            slot = slot.astype(np.int64)
            state = self.slots[k].take(slot, mode="clip")
            gate *= np.uint16(LEVELS)
            gate |= state & np.uint16(LEVELS - 1)
            s = (state >> np.uint16(3)).astype(np.float32)
            s *= np.float32(1 / 512)
            s -= np.float32(8)
            stretched.append(s)
            slots.append(slot)
        gate = gate.astype(np.int64)
        dot = self.weights[0].take(gate, mode="clip")
        dot *= stretched[0]
        for k in (1, 2):
            part = self.weights[k].take(gate, mode="clip")
            part *= stretched[k]
            dot += part
        return bounds, bit, slots, gate, stretched, np.clip(dot, -11, 11, out=dot)

    def log(self, codes: Codes, sym: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Natural logarithm of each symbol's chance."""
        out = np.zeros(len(sym))
        for a in range(0, len(sym), SYMBOLS):
            bounds, bit, _, gate, _, dot = self.mixed(codes, sym[a : a + SYMBOLS], ctx[:, a : a + SYMBOLS])
            place = np.clip(dot, np.float32(-8), np.float32(7.999))
            place += np.float32(8)
            place *= np.float32((BINS - 1) / 16)
            lo = place.astype(np.int32)
            place -= lo
            gate *= BINS
            gate += lo
            final = self.refine.take(gate, mode="clip")
            gate += 1
            above = self.refine.take(gate, mode="clip")
            above -= final
            place *= above
            final += place
            final += dot
            final *= np.float32(0.5) - bit.astype(np.float32)
            log = np.log1p(np.exp(final, out=final), out=final)
            out[a : a + SYMBOLS] = -np.add.reduceat(log, bounds[:-1])
        return out


class Learner:
    """What one part of the corpus has taught so far: counts of both contexts' slots, weights, and the map's hits."""

    def __init__(self, codes: Codes):
        self.codes, self.mixer = codes, Mixer.new()
        self.counts = np.zeros((2, 1 << SLOT_BITS), np.int64)  # of all bits, times 2**32, and of ones
        self.slow, self.fast = np.zeros((3, GATES)), np.zeros((3, GATES))
        self.hit, self.seen = np.zeros(GATES * BINS), np.zeros(GATES * BINS)
        self.step, self.since, self.read = 0, 0, 0

    def learn(self, sym: np.ndarray, ctx: np.ndarray) -> None:
        """Reads the symbols in order: each run is predicted by what was read before it, then corrects the weights and enters the counts."""
        for a in range(0, len(sym), SYMBOLS):
            bounds, bit, slots, gate, stretched, dot = self.mixer.mixed(self.codes, sym[a : a + SYMBOLS], ctx[:, a : a + SYMBOLS])
            near = np.rint((np.clip(dot, -8, 8) + np.float32(8)) * np.float32((BINS - 1) / 16)).astype(np.int64) + gate * BINS
            error = bit.astype(np.float32)
            both = np.bincount(near, weights=bit + float(1 << 24), minlength=len(self.seen))
            seen = np.floor(both * 2.0**-24)
            self.seen += seen
            self.hit += both - seen * 2.0**24
            error -= 1 / (1 + np.exp(-dot))
            slope = np.stack([np.bincount(gate, weights=error * s, minlength=GATES) for s in stretched]) / len(bit)
            self.step += 1
            self.slow, self.fast = 0.9 * self.slow + 0.1 * slope, 0.99 * self.fast + 0.01 * slope**2
            rate = 0.02 / (1 + self.step / 100)
            self.mixer.weights += (rate * (self.slow / (1 - 0.9**self.step)) / (np.sqrt(self.fast / (1 - 0.99**self.step)) + 1e-9)).astype(np.float32)
            one = bit.astype(np.int64)
            one += 1 << 32
            for k in range(2):
                np.add.at(self.counts[k], slots[k], one)
            self.read, self.since = self.read + len(bit), self.since + len(bit)
            if self.since >= min(REFRESH, max(1 << 18, self.read // 2)):
                self.mixer.slots, self.since = packed(self.counts & 0xFFFFFFFF, self.counts >> 32), 0

    def read_texts(self, data: np.ndarray, offsets: np.ndarray) -> None:
        for lo, hi in slices(offsets, TEXT_BYTES):
            tokens = Tokens.of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            contexts = word_contexts(tokens)
            for a in range(0, len(tokens.hashes), WINDOW):
                sym, ctx, _ = symbols(self.codes, tokens, a, min(a + WINDOW, len(tokens.hashes)), contexts)
                self.learn(sym, ctx)


_LEARNED = "block int, ones binary, total binary"


def _learn(batches: Iterable[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """A part's counts in blocks of slots; block -1 has its weights and the map's hits."""
    learner = Learner(shared.value)
    for batch in batches:
        learner.read_texts(*column_bytes(batch.column(0)))
    if not learner.read:
        return
    step, counts = 1 << BLOCK_BITS, learner.counts.ravel()
    for i in range(0, len(counts), step):
        if (own := counts[i : i + step]).any():
            yield _blocks(i // step, (own & 0xFFFFFFFF).astype(np.uint32).tobytes(), (own >> 32).astype(np.uint32).tobytes())
    yield _blocks(-1, np.r_[learner.mixer.weights.astype(float).ravel(), learner.hit].tobytes(), learner.seen.tobytes())


def _blocks(block: int, ones: bytes, total: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ones], pa.binary()), pa.array([total], pa.binary())], names=["block", "ones", "total"])


def _add_blocks(group: pa.Table) -> pa.Table:
    """Sums one block over all parts and packs it; of block -1, weights come to their mean by the bits seen through each gate."""
    block = group.column("block")[0].as_py()
    kind = float if block < 0 else np.uint32
    ones, total = ([np.frombuffer(x, kind) for x in group.column(c).to_pylist()] for c in ("ones", "total"))
    if block < 0:
        own = np.array([t.reshape(GATES, BINS).sum(axis=1) + 1e-9 for t in total])
        # In the order of their sizes, so that sums do not depend on which part came first.
        order = sorted(range(len(own)), key=lambda i: (own[i].sum(), ones[i].tobytes()))
        weights = sum(ones[i][: 3 * GATES].reshape(3, GATES) * own[i] for i in order) / sum(own[i] for i in order)
        hit, seen = sum(ones[i][3 * GATES :] for i in order), sum(total[i] for i in order)
        out = np.r_[weights.ravel(), hit, seen].tobytes()
    else:
        out = packed(np.sum(ones, axis=0, dtype=np.int64), np.sum(total, axis=0, dtype=np.int64)).tobytes()
    return pa.table({"block": pa.array([block], pa.int32()), "packed": pa.array([out], pa.binary())})


def learned(texts: DataFrame, codes: Codes) -> Mixer:
    """Mixer learned online over every row of texts (text). Parts grow in number with the input, what each sends is of fixed size."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(codes)
    parts = max(2 * spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // 8)
    sums = texts.select("text").coalesce(parts).transform(batched, partial(_learn, shared=shared), _LEARNED).groupBy("block").applyInArrow(_add_blocks, "block int, packed binary")
    mixer, slots = Mixer.new(), None
    slots, step = mixer.slots.ravel(), 1 << BLOCK_BITS
    for r in sums.toLocalIterator():
        if r["block"] >= 0:
            slots[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["packed"], np.uint16)
            continue
        found = np.frombuffer(r["packed"])
        weights, hit, seen = found[: 3 * GATES], *found[3 * GATES :].reshape(2, -1)
        centres = np.tile(np.linspace(-8, 8, BINS), GATES)
        prior = 20 / (1 + np.exp(-centres))
        mixer.weights, mixer.refine = weights.reshape(3, GATES).astype(np.float32), np.log((hit + prior) / (seen - hit + 20 - prior)).astype(np.float32)
    shared.unpersist()
    return mixer


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of every token (w = 1) and stretch (w = 0), summed over at most COUNT_BYTES of text at a time."""
    for batch in batches:
        every, bounds = column_bytes(batch.column(0))
        for start, stop in slices(bounds, COUNT_BYTES):
            data, offsets = every[bounds[start] : bounds[stop]], bounds[start : stop + 1] - bounds[start]
            keys: tuple[list, list] = ([], [])
            for lo, hi in slices(offsets, TEXT_BYTES):
                tokens = Tokens.of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                keys[1].append(tokens.hashes)
                keys[0].append(tokens.stretches()[1])
            for w in (0, 1):
                k, c = np.unique(np.concatenate(keys[w]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.full(len(k), w, np.int8)), pa.array(c)], names=["k", "w", "c"])


def counted(texts: DataFrame) -> DataFrame:
    """Written (k, w, c): the count of every token (w = 1) and of every stretch (w = 0) of texts, by its hash."""
    rows = texts.select("text").transform(batched, _count, "k long, w byte, c long")
    return table(rows.groupBy("k", "w").agg(F.sum("c").alias("c")), "counts")


@dataclass
class Model:
    """Codes, mixer, and what counts leave for words behind the escape: rare tokens, discount, the share of spellings; stretches; N and V."""

    codes: Codes
    mixer: Mixer
    rare: int
    discount: float
    rest: float
    stretches: int
    n: int
    v: int

    def behind_escape(self, c: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """Natural logarithm of the chance, behind the escape, of words of these counts and spelling logarithms."""
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(np.maximum(c - self.discount, 0) / max(1, self.rare)), np.log(self.rest) + spelt)


def train(texts: DataFrame) -> tuple[Model, DataFrame]:
    """Model of texts (text), and the written counts (k, w, c). Every text counts; what reaches the driver is of fixed size."""
    counts = counted(texts)
    tokens = counts.filter("w = 1").select("k", "c")
    once = lambda n: F.count(F.when(F.col("c") == n, 1))
    n, v, n1, n2 = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), once(1), once(2)).first()
    stretches = counts.filter("w = 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    # The head is all tokens from a count on, the least count from 2 that leaves at most HEAD of them; a histogram of counts
    # finds it. Tokens that occur once teach the escape and spellings.
    running, cut = 0, (1 << 20) + 1
    for r in tokens.groupBy(F.least("c", F.lit(1 << 20)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect():
        running += r["n"]
        if running > HEAD or r["c"] < 2:
            break
        cut = r["c"]
    end = int(_END_HASH.view(np.int64))
    head = tokens.filter((F.col("c") >= cut) & (F.col("k") != end)).toArrow()
    found = tokens.filter(F.col("k") == end).first()
    h, c = (np.r_[head.column(x).to_numpy(), extra] for x, extra in (("k", end), ("c", found["c"] if found else 0)))
    rare, kinds = n - int(c.sum()), v - len(h) + (not found)
    discount = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    codes = Codes.of(h.astype(np.int64).view(U64), c.astype(np.int64), rare)
    return Model(codes, learned(texts, codes), rare, discount, discount * kinds / rare if rare else 1.0, stretches, n, v), counts


_SCORED = (
    "rid long, doc_id long, n_bytes long, n_tokens long, head_base double, head_known long, end_log double, keys array<long>, logs array<double>, "
    "rare array<long>, stretch array<int>, place array<int>, before array<int>, escape array<float>, spelt array<float>"
)


def _earlier(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How often each hash stood earlier in its row; rows ascend, so that one stable sort keeps those of a hash in order."""
    order = np.argsort(h, kind="stable")
    r, x = row[order], h[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])] if len(r) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    out = np.empty(len(r), np.int64)
    out[order] = np.arange(len(r)) - np.repeat(heads, np.diff(np.r_[heads, len(r)]))
    return out


def cached(log: np.ndarray, before: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Logarithms of the chances of words without a cache and with each of CACHES, from the model's, earlier occurrences and earlier tokens."""
    out, again = [log], np.flatnonzero(before)
    for a in CACHES:
        x = log + np.log(a / (place + a))
        x[again] = np.logaddexp(x[again], np.log(before[again] / (place[again] + a)))
        out.append(x)
    return out


def _score(batches: Iterable[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Of each text what is known without a join: by stretch its key and its words' chances; of rare words key, stretch and spelling."""
    model: Model = shared.value
    context = TaskContext.get()
    rid, per = (context.partitionId() if context else 0) << 40, np.log10(model.n + model.v + 1)
    codes, escape = model.codes, len(model.codes.head)
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for lo, hi in slices(offsets, TEXT_BYTES):
            rows, size = hi - lo, np.diff(offsets[lo : hi + 1])
            tokens = Tokens.of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            contexts, (which, keys) = word_contexts(tokens), tokens.stretches()
            n = len(tokens.hashes)
            log, spelt, c = np.zeros(n), np.zeros(n), np.full(n, -1, np.int64)
            for a in range(0, n, WINDOW):
                b = min(a + WINDOW, n)
                sym, ctx, first = symbols(codes, tokens, a, b, contexts)
                each = model.mixer.log(codes, sym, ctx)
                own = sym[first[:-1]]
                log[a:b] = each[first[:-1]]
                total = np.r_[0, np.cumsum(each)]
                spelt[a:b] = total[first[1:]] - total[first[:-1] + 1]
                c[a:b] = np.where(own < escape, codes.head_c[np.minimum(own, escape - 1)], -1)
            rare, end = np.flatnonzero(c < 0), tokens.first[1:] - 1
            place, before = np.arange(n) - tokens.first[tokens.row], _earlier(tokens.row, tokens.hashes)
            known = np.where(c >= 0, np.log10(np.maximum(c, 0) + 1) - per, 0)
            inner, head = np.flatnonzero(which >= 0), np.flatnonzero((which >= 0) & (c >= 0))
            sums = [np.bincount(which[head], weights=x, minlength=len(keys)).astype(float) for x in cached(log[head], before[head], place[head])]
            stretch_row = np.zeros(len(keys), np.int64)
            stretch_row[which[inner]] = tokens.row[inner]
            first_stretch = np.searchsorted(stretch_row, np.arange(rows + 1))
            first_rare = np.searchsorted(tokens.row[rare], np.arange(rows + 1))
            listed = lambda first, x: pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x))
            columns = {
                "rid": pa.array(rid + np.arange(rows)), "doc_id": batch.column(0).slice(lo, rows), "n_bytes": pa.array(size), "n_tokens": pa.array(np.diff(tokens.first)),
                "head_base": pa.array(np.bincount(tokens.row, weights=known, minlength=rows)), "head_known": pa.array(np.bincount(tokens.row[c > 0], minlength=rows)), "end_log": pa.array(log[end]),
                "keys": listed(first_stretch, keys.view(np.int64)), "logs": listed(first_stretch * len(sums), np.stack(sums, axis=1).ravel()),
                "rare": listed(first_rare, tokens.hashes[rare].view(np.int64)), "stretch": listed(first_rare, (which[rare] - first_stretch[tokens.row[rare]]).astype(np.int32)), "place": listed(first_rare, place[rare].astype(np.int32)),
                "before": listed(first_rare, before[rare].astype(np.int32)), "escape": listed(first_rare, log[rare].astype(np.float32)), "spelt": listed(first_rare, spelt[rare].astype(np.float32)),
            }
            rid += rows
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


#: The gate before anything of a document is read: chance of a known stretch after an unknown and after a known one, each worth so many stretches.
GATE_PRIOR, GATE_WORTH = (0.02, 0.9), 2.0


def gates(known: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Chance that each stretch is a known one, from those before it in its text: by the last one's kind, as often as that kind went on so."""
    n = len(known)
    place = np.arange(n) - first[row]
    last = np.zeros(n, np.int64)
    last[1:] = known[:-1]
    last[place == 0] = 0
    out = np.zeros(n)
    for kind in (0, 1):
        of = last == kind
        tried, went = np.r_[0, np.cumsum(of)], np.r_[0, np.cumsum(of & known)]
        a = first[row]
        p = (went[np.arange(n)] - went[a] + GATE_PRIOR[kind] * GATE_WORTH) / (tried[np.arange(n)] - tried[a] + GATE_WORTH)
        out[of] = p[of]
    return out


_FINISHED = "doc_id long, n_bytes long, n_tokens long, n_known long, base_score double, score double"


def _finish(batches: Iterable[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Both scores from _score's rows and the counts found for their stretches and rare words."""
    model: Model = shared.value
    per = np.log10(model.n + model.v + 1)
    for batch in batches:
        rows = batch.num_rows
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        value = lambda name: column(name).to_numpy(zero_copy_only=False)
        flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
        lengths = lambda x: np.r_[0, np.cumsum(np.diff(x.offsets.to_numpy()) if rows else [])].astype(np.int64)
        first, first_rare = lengths(column("keys")), lengths(column("rare"))
        row, rare_row = np.repeat(np.arange(rows), np.diff(first)), np.repeat(np.arange(rows), np.diff(first_rare))
        logs, keys, spelt = flat(column("logs")).astype(float).reshape(-1, 1 + len(CACHES)).T.copy(), flat(column("keys")), flat(column("spelt")).astype(float)
        counts = (np.zeros(len(keys), np.int64), np.zeros(len(spelt), np.int64))
        found = column("found").fill_null([]) if column("found").null_count else column("found")
        found_row = np.repeat(np.arange(rows), np.diff(lengths(found)))
        if len(found_row):
            w, at, c = (flat_part.to_numpy(zero_copy_only=False) for flat_part in found.flatten().flatten())
            for kind, starts in ((0, first), (1, first_rare)):
                of = w == kind
                counts[kind][starts[found_row[of]] + at[of]] = c[of]
        stretch = first[rare_row] + flat(column("stretch"))
        for k, x in enumerate(cached(flat(column("escape")) + model.behind_escape(counts[1], spelt), flat(column("before")), flat(column("place")))):
            logs[k] += np.bincount(stretch, weights=x, minlength=len(keys))
        # A stretch is known by its count in training or from earlier in its own text, half of the chance each.
        again, earlier = _earlier(row, keys), np.arange(len(keys)) - first[row]
        gate = gates((counts[0] > 0) | (again > 0), row, first)
        with np.errstate(divide="ignore"):
            whole = np.log(gate) + np.log((counts[0] / max(1, model.stretches) + again / np.maximum(1, earlier)) / 2)
            members = np.stack([np.bincount(row, weights=np.logaddexp(whole, np.log1p(-gate) + x), minlength=rows) for x in logs])
        score = (np.logaddexp.reduce(members, axis=0) - np.log(len(members)) + value("end_log")) / LN10
        base = value("head_base") + np.bincount(rare_row, weights=np.log10(counts[1] + 1) - per, minlength=rows)
        n_known = value("head_known") + np.bincount(rare_row, weights=counts[1] > 0, minlength=rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([column("doc_id"), column("n_bytes"), column("n_tokens"), pa.array(n_known), pa.array(base), pa.array(score)], names=["doc_id", "n_bytes", "n_tokens", "n_known", "base_score", "score"])


def score(documents: DataFrame, training: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Tokens are lower-cased (A-Z) words and one end. base_score is the add-one unigram log10
    probability from the exact counts of training (text); score is the mixer's. A null text is an
    empty one: its end is its only token. Repeated rows score alike. With no training rows every
    count is 0 and words are spelled. Very long texts and words are read whole, in pieces. Columns
    other than doc_id and text are not read. Frequent words travel with the model, of a fixed size;
    all others, and stretches, are joined by their 64-bit hashes, one row for each that a text holds.
    """
    model, counts = train(training)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = table(documents.select(F.col("doc_id").cast("long"), "text").transform(batched, partial(_score, shared=shared), _SCORED), "scored")
    asked = lambda column, w: rows.select("rid", F.lit(w).cast("byte").alias("w"), F.posexplode(column).alias("at", "k"))
    found = asked("keys", 0).union(asked("rare", 1)).join(counts.hint("merge"), ["k", "w"]).groupBy("rid").agg(F.collect_list(F.struct("w", "at", "c")).alias("found"))
    bits = -F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))
    out = rows.join(found, "rid", "left").transform(batched, partial(_finish, shared=shared), _FINISHED)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
