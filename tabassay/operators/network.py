"""Small neural classifiers for several overlapping training sets at once, on one stored matrix.

An epoch is one pass: every block starts from the shared weights, takes mini-batch Adam steps over its
own rows for each model that trains on them, and the results are averaged by rows. Tables of one
block are thus trained by plain Adam, larger ones by averaging over blocks after every epoch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.operators.boost import Matrix, _matrix, chance
from tabassay.operators.encode import quoted

#: Rows of a step, its size, weight of the squared weights, and when to stop: epochs without this gain of the mean loss.
BATCH, RATE, DECAY, PATIENCE, GAIN = 200, 1e-3, 1e-4, 10, 1e-4


def _shapes(layers: tuple[int, ...]) -> list[tuple[int, ...]]:
    return [s for a, b in zip(layers, layers[1:], strict=False) for s in ((a, b), (b,))]


def _split(flat: np.ndarray, layers: tuple[int, ...]) -> list[np.ndarray]:
    out, at = [], 0
    for s in _shapes(layers):
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def initial(layers: tuple[int, ...], seed: int) -> np.ndarray:
    """Weights uniform within the root of 6 over inputs and outputs, biases likewise."""
    rng = np.random.default_rng(seed)
    bound = [np.sqrt(6 / (a + b)) for a, b in zip(layers, layers[1:], strict=False)]
    return np.concatenate([rng.uniform(-bound[i // 2], bound[i // 2], int(np.prod(s))) for i, s in enumerate(_shapes(layers))])


def margins(x: np.ndarray, weights: np.ndarray, layers: tuple[int, ...]) -> np.ndarray:
    """Log odds of label 1."""
    parts = _split(weights, layers)
    for i in range(0, len(parts), 2):
        x = x @ parts[i] + parts[i + 1]
        if i + 2 < len(parts):
            x = np.maximum(x, 0)
    return x[:, 0]


def gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, layers: tuple[int, ...]) -> tuple[np.ndarray, float]:
    """Of the mean log loss plus half of DECAY times the squared weights over the rows; and the summed log loss."""
    parts, kept = _split(weights, layers), [x]
    for i in range(0, len(parts), 2):
        x = x @ parts[i] + parts[i + 1]
        if i + 2 < len(parts):
            x = np.maximum(x, 0)
            kept.append(x)
    f = x[:, 0]
    loss = float(np.logaddexp(0, f).sum() - f[y == 1].sum())
    d = ((chance(f) - y) / len(y))[:, None]
    out: list[np.ndarray] = []
    for i in range(len(parts) - 2, -1, -2):
        own = kept[i // 2]
        out = [(own.T @ d + DECAY / len(y) * parts[i]).ravel(), d.sum(axis=0), *out]
        if i:
            d = (d @ parts[i].T) * (own > 0)
    return np.concatenate(out), loss


def _epoch(x: np.ndarray, y: np.ndarray, use: np.ndarray, _: np.ndarray, count: np.ndarray, state: list[np.ndarray], layers: tuple[int, ...], epoch: int, seed: int, done: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """For each model still in training its weights and moments after this block, times its rows, with loss and rows."""
    for m, s in enumerate(state):
        rows = np.flatnonzero((use >> m) & 1)
        if done[m] or not len(rows):
            continue
        w, first, second = (v.copy() for v in s[:-1].reshape(3, -1))
        t, total = int(s[-1]), 0.0
        rows = np.random.default_rng([seed, epoch, m]).permutation(rows)
        for lo in range(0, len(rows), BATCH):
            some = rows[lo : lo + BATCH]
            g, loss = gradient(x[some], y[some], w, layers)
            total += loss
            t += 1
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            w -= RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * first / (np.sqrt(second) + 1e-8)
        yield str(m), np.concatenate([np.concatenate([w, first, second, [t]]) * len(rows), [total, len(rows)]])


def train(matrix: Matrix, hidden: tuple[int, ...], epochs: int = 500, seed: int = 42) -> tuple[np.ndarray, tuple[int, ...]]:
    """Weights of every model (a row each), and the layers' widths."""
    layers = (matrix.width, *hidden, 1)
    start = initial(layers, seed)
    state = [np.concatenate([start, np.zeros(2 * len(start) + 1)]) for _ in range(matrix.models)]
    best, idle, done = np.full(matrix.models, np.inf), np.zeros(matrix.models, int), np.zeros(matrix.models, bool)
    for epoch in range(epochs):
        found = matrix.summed(partial(_epoch, state=state, layers=layers, epoch=epoch, seed=seed, done=done))
        for m in range(matrix.models):
            if done[m]:
                continue
            if (s := found.get(str(m))) is None:
                done[m] = True
                continue
            loss, n = s[-2] / s[-1], s[-1]
            state[m] = s[:-2] / n
            idle[m] = idle[m] + 1 if loss > best[m] - GAIN else 0
            best[m] = min(best[m], loss)
            done[m] = idle[m] >= PATIENCE
        if done.all():
            break
    return np.stack([s[: len(start)] for s in state]), layers


@dataclass
class Networks:
    """Margins of several networks on plain features."""

    weights: np.ndarray
    layers: tuple[int, ...]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.stack([margins(x, w, self.layers) for w in self.weights], axis=1)


def _predict(batches: Iterable[pa.RecordBatch], model: Networks, keep: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p = chance(model(_matrix(b, keep, model.layers[0])))[:, 0]
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(keep)], pa.array(p)], names=[*(f"k{i}" for i in range(keep)), "score"])


def predict(model: Networks, df: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """(keep..., score) of the first network."""
    rows = df.select(*[quoted(c) for c in keep], *[quoted(c).cast("double") for c in names])
    kinds = [f"k{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = rows.toDF(*[f"k{i}" for i in range(len(keep))], *[f"f{i}" for i in range(len(names))]).mapInArrow(partial(_predict, model=model, keep=len(keep)), ", ".join([*kinds, "score double"]))
    return out.toDF(*keep, "score")


def fit(rows: DataFrame, names: list[str], hidden: tuple[int, ...], seed: int = 42) -> Networks:
    """One network on all rows (label, names...)."""
    matrix = Matrix(rows, names, "label", F.lit(1), 1)
    weights, layers = train(matrix, hidden, seed=seed)
    matrix.close()
    return Networks(weights, layers)
