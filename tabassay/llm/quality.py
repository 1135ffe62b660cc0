"""Quality scores learned from preference pairs (Bradley-Terry) over surface features of whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm._shared import batched, hashed_sample
from tabassay.llm._text import column_bytes, lines, slices, words

#: Labelled rows of each class that the model is fitted on at most, and the pairs drawn from them.
SAMPLE_ROWS, PAIRS = 3000, 30_000

_KINDS = {
    "upper": np.array([65 <= b <= 90 for b in range(256)]),
    "lower": np.array([97 <= b <= 122 for b in range(256)]),
    "digit": np.array([48 <= b <= 57 for b in range(256)]),
    "stop": np.array([chr(b) in ".,;:?'\"-()" for b in range(256)]),
    "shout": np.array([chr(b) == "!" for b in range(256)]),
    "bar": np.array([chr(b) in "|<>{}[]=_~^\\`" for b in range(256)]),
    "symbol": np.array([chr(b) in "#$%&*@+/" for b in range(256)]),
    "wide": np.array([b >= 128 for b in range(256)]),
    "feed": np.array([b == 10 for b in range(256)]),
}
N_FEATURES = 2 * (len(_KINDS) + 9)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x N_FEATURES: shares of byte kinds, word and line statistics, repetition; each also as its square root."""
    rows, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    per_row = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][offsets])
    columns = [per_row(kind[data]) / size for kind in _KINDS.values()]
    u, l = words(data, offsets), lines(data, offsets)  # noqa: E741
    n = np.diff(u.first)
    some = np.maximum(n, 1)
    long, hashes = u.ends - u.starts, u.hashes(lower=True)
    by_row = lambda values, row: np.bincount(row, weights=values, minlength=rows)
    again = np.r_[False, (hashes[1:] == hashes[:-1]) & (u.row[1:] == u.row[:-1])] if len(hashes) else np.zeros(0, bool)
    order = np.lexsort((hashes, u.row))
    sorted_row, sorted_hash = u.row[order], hashes[order]
    new = np.r_[True, (sorted_hash[1:] != sorted_hash[:-1]) | (sorted_row[1:] != sorted_row[:-1])] if len(order) else np.zeros(0, bool)
    runs = np.diff(np.r_[np.flatnonzero(new), len(new)])
    most = np.zeros(rows)
    np.maximum.at(most, sorted_row[new], runs)
    lone = ~(_KINDS["lower"] | _KINDS["upper"] | _KINDS["wide"])
    letters = np.r_[0, np.cumsum(~lone[data])]
    line_hash = l.hashes()
    lorder = np.lexsort((line_hash, l.row))
    lnew = np.r_[True, (line_hash[lorder][1:] != line_hash[lorder][:-1]) | (l.row[lorder][1:] != l.row[lorder][:-1])] if len(lorder) else np.zeros(0, bool)
    n_lines = np.maximum(np.diff(l.first), 1)
    columns += [
        np.minimum(np.log1p(n) / 12, 1), np.minimum(by_row(long, u.row) / some / 20, 2), np.minimum(np.sqrt(by_row(long.astype(float) ** 2, u.row) / some) / 20, 2),
        by_row(again, u.row) / some, by_row(new, sorted_row) / some, most / some, by_row(letters[u.ends] == letters[u.starts], u.row) / some,
        by_row(lnew, l.row[lorder]) / n_lines, np.minimum(n / n_lines / 50, 2),
    ]
    x = np.stack(columns, axis=1)
    return np.concatenate([x, np.sqrt(x)], axis=1)


@dataclass
class Ranker:
    """score = 1 / (1 + exp(-(weights . (x - centre) / spread - threshold)))."""

    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -30, 30)))


def fit(good: np.ndarray, bad: np.ndarray, bad_share: float, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 25) -> Ranker:
    """Bradley-Terry scores: logistic loss on feature differences of (good, bad) pairs, by Newton steps.

    The threshold is a quantile of the sample's scores, weighted to the classes' true shares: the
    one at which both kinds of rank errors cost least within the share of bad documents.
    """
    if not len(good) or not len(bad):
        return Ranker(np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.0)
    both = np.concatenate([good, bad])
    centre, spread = both.mean(axis=0), both.std(axis=0)
    spread[spread < 1e-9] = 1
    draw = np.random.Generator(np.random.PCG64(5))
    diff = (good[draw.integers(0, len(good), pairs)] - bad[draw.integers(0, len(bad), pairs)]) / spread
    w = np.zeros(diff.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        slope = diff.T @ (1 - p) / len(diff) - ridge * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w += move * min(1, 4 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    ranker = Ranker(w, centre, spread, 0.0)
    scores, weight = np.r_[ranker.raw(good), ranker.raw(bad)], np.r_[np.full(len(good), (1 - bad_share) / len(good)), np.full(len(bad), bad_share / len(bad))]
    order = np.argsort(scores, kind="stable")
    is_bad = np.r_[np.zeros(len(good), bool), np.ones(len(bad), bool)][order]
    wrong = bad_share + np.cumsum(np.where(is_bad, -weight[order], weight[order]))  # if all up to here are rejected
    at = int(wrong.argmin())
    s = scores[order]
    ranker.threshold = float((s[at] + s[min(at + 1, len(s) - 1)]) / 2) if wrong[at] < bad_share else float(s[0] - 1)
    return ranker


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        x = [features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
        flat = np.concatenate(x).ravel() if x else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(flat), N_FEATURES).cast(pa.list_(pa.float64()))], names=["quality", "x"])


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, pairs: int = PAIRS) -> Ranker:
    """Ranker from documents (doc_id, text) and labels (doc_id, quality 0 or 1): at most rows labels of each class, by hash.

    Of several texts of one doc_id the least is learned from. Null ids, other labels and labels without a document teach
    nothing; without both classes every score is 0.5.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    some = [hashed_sample(known.filter(F.col("quality") == q), rows, share.get(q, 0), "doc_id") for q in (0, 1)]
    sample = documents.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = sample.select("quality", "text").transform(batched, _features, "quality int, x array<double>").collect()
    x, y = np.array([r["x"] for r in got]).reshape(-1, N_FEATURES), np.array([r["quality"] for r in got])
    return fit(x[y == 1], x[y == 0], share.get(0, 0) / max(1, sum(share.values())), pairs)


def _score(batches: Iterable[pa.RecordBatch], ranker: Ranker) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        parts = [ranker.score(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in slices(offsets)]
        score = np.concatenate(parts) if parts else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(score)], names=[*batch.schema.names[:1], *batch.schema.names[2:], "score"])


def score(documents: DataFrame, ranker: Ranker, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep, and score (0 to 1) of each row's whole text.

    A null text is an empty one; empty texts are scored by their features like any other. Repeated
    rows score alike. If only one class was labelled, every score is 0.5.
    """
    out = documents.select("doc_id", "text", *keep)
    kinds = ", ".join(f"`{c}` {t}" for c, t in out.dtypes if c == "doc_id" or c in keep)
    if "text" in keep:
        out = documents.select("doc_id", F.col("text").alias("_t"), *keep)
        kinds = ", ".join(f"`{c}` {t}" for c, t in out.dtypes if c != "_t")
    return out.transform(batched, partial(_score, ranker=ranker), f"{kinds}, score double")
