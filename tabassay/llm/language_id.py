"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text recognises every substring of it. Parsing a document greedily
into the longest phrases that occur in a language's text needs few phrases if the document is
written in that language; phrases times log2 of the training length, per byte, estimates the cross
entropy, and the least one wins. Automata are small dense tables, so thousands of document pieces
are parsed in step by array lookups.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm._shared import batched
from tabassay.llm._text import LOWER, column_bytes, slices

#: Bounds of the labelled sample that the automata are built from, for each language: rows, characters of a row that is taken first, bytes.
SAMPLE_DOCS, SAMPLE_TEXT, SAMPLE_BYTES = 40, 4000, 40_000
#: Languages at most; each costs a worker about 20 MB.
MAX_LANGUAGES = 64
#: Bytes that are parsed in one go, and those that are parsed in step. A phrase also ends where a piece does, in every language alike.
PIECE, STEP_BYTES = 4096, 4 << 20
UNDETERMINED = "und"

_FOLDED = LOWER.copy()  # ASCII letters in lower case, every other ASCII byte a space, the rest as it is
_FOLDED[[b for b in range(128) if not chr(b).isalpha()]] = 32
_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def folded(data: np.ndarray) -> np.ndarray:
    return _FOLDED[data]


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of codes; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@dataclass
class Model:
    """Languages in order, their training texts, and, built on first use in each process, the tables."""

    langs: list[str]
    texts: list[bytes]
    _built: tuple = field(default=(), repr=False)

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "texts": self.texts, "_built": ()}

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class of each byte, flat transitions (times the class count; ~next where a phrase ends first), roots, log2 lengths."""
        if not self._built:
            codes = [folded(np.frombuffer(t, np.uint8)) for t in self.texts]
            codes = [c[~((c == 32) & (np.r_[0, c[:-1]] == 32))] for c in codes]
            seen = np.unique(np.concatenate([np.array([32], np.uint8), *codes]))
            classes = np.full(256, len(seen), np.int32)
            classes[seen] = np.arange(len(seen))
            width, flat, roots = len(seen) + 1, [], []
            for c in codes:
                states = automaton(classes[c].tolist())
                root = sum(map(len, flat))
                step = np.full((len(states), width), -1, np.int64)
                for i, s in enumerate(states):
                    step[i, list(s)] = list(s.values())
                again = np.where(step[0] < 0, 0, step[0])  # a byte the language lacks is a phrase of its own
                step = np.where(step >= 0, step * width + root, ~(again * width + root))
                step[0, step[0] < 0] = ~root
                flat.append(step.astype(np.int32).ravel())
                roots.append(root)
            sizes = np.log2([max(2, len(c)) for c in codes])
            self._built = classes, np.concatenate(flat), np.array(roots, np.int32), sizes
        return self._built

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that each row needs in each language (rows x languages), and each row's folded length.

        Rows are parsed in pieces of PIECE bytes, in step. A phrase is closed by every byte that
        does not continue it, and by the piece's end in every language alike.
        """
        classes, flat, roots, _ = self.tables()
        rows = len(offsets) - 1
        codes = folded(data)
        blank = codes == 32
        keep = np.ones(len(codes), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        keep[offsets[:-1][offsets[:-1] < len(codes)]] = True
        bounds = np.r_[0, np.cumsum(keep)][offsets]
        codes = classes[codes[keep]]
        lengths = np.diff(bounds)
        parts = -(-lengths // PIECE)
        row = np.repeat(np.arange(rows), parts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = bounds[row] + nth * PIECE
        size = np.minimum(PIECE, bounds[row + 1] - starts)
        order = np.argsort(-size, kind="stable")
        starts, size, row = starts[order], size[order], row[order]
        state = np.repeat(roots[:, None], len(row), axis=1)
        count = np.ones(state.shape, np.int32)
        active = np.searchsorted(-size, -np.arange(PIECE), side="left")
        for t in range(int(size[0]) if len(size) else 0):
            m = active[t]
            v = flat.take(state[:, :m] + codes[starts[:m] + t])
            sign = v >> 31
            count[:, :m] -= sign
            state[:, :m] = v ^ sign
        return np.stack([np.bincount(row, weights=c, minlength=rows) for c in count], axis=1), lengths


def train(labelled: DataFrame, docs: int = SAMPLE_DOCS, text: int = SAMPLE_TEXT, size: int = SAMPLE_BYTES) -> Model:
    """Model of (doc_id, text, lang): for each lang a sample of at most docs short texts, then long ones, to size bytes, by hash."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND text != ''")
    short = F.length("text") <= text
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_if(short).alias("n")).collect()}
    langs = sorted(found)
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages are more than {MAX_LANGUAGES}")
    # One pass for all languages: each has its own share of the hashes, a little over what is wanted.
    span, most = 1 << 30, F.lit(0)
    for lang, n in found.items():
        most = F.when(F.col("lang") == lang, min(span, span * (docs + 4 * math.isqrt(docs) + 16) // max(1, n))).otherwise(most)
    picked = rows.filter(short & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(span)) < most)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).collect()
    sample = {lang: sorted((r for r in picked if r["lang"] == lang), key=lambda r: (r["h"], r["text"]))[:docs] for lang in langs}
    for lang in [x for x in langs if sum(len(r["text"].encode()) + 1 for r in sample[x]) <= size]:  # short texts do not reach size: long ones fill it
        sample[lang] += rows.filter((F.col("lang") == lang) & ~short).orderBy(F.xxhash64("doc_id", "text"), "text").limit(-(-size // text)).select(F.substring("text", 1, size).alias("text")).collect()
    whole = {lang: b"\n".join(r["text"].encode() for r in sample[lang])[:size] for lang in langs}
    return Model(langs, [whole[lang].decode("utf-8", "ignore").encode() for lang in langs])


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letters = np.r_[0, np.cumsum(_ASCII_LETTER[data])]
    found = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for r in np.flatnonzero(~found & (offsets[1:] > offsets[:-1])):
        found[r] = any(map(str.isalpha, data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")))
    return found


def _predict(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.langs, UNDETERMINED], object)
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        best, score = np.full(batch.num_rows, len(model.langs)), np.zeros(batch.num_rows)
        for lo, hi in slices(offsets, STEP_BYTES) if model.langs else ():
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            phrases, lengths = model.phrases(part, at)
            entropy = phrases * model.tables()[3] / np.maximum(lengths, 1)[:, None]
            first = entropy.argmin(axis=1)
            margin = (entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(lengths, 64)[:, None]
            known = _has_letter(part, at)
            best[lo:hi] = np.where(known, first, len(model.langs))
            score[lo:hi] = np.where(known, 1 / np.exp2(-margin).sum(axis=1), 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """One row for each row of documents (doc_id, text): doc_id, lang_pred, score.

    Texts that are null or hold no letter are 'und' with score 0, as is every text if nothing was
    learned. Equal entropies go to the language that sorts first. Whole texts are parsed, whatever
    their length; repeated rows are predicted alike; other columns are not read. score is the
    softmax share of the winner over bits, of 64 bytes at most.
    """
    return documents.select(F.col("doc_id").cast("long"), "text").transform(batched, partial(_predict, model=model), "doc_id long, lang_pred string, score double")
