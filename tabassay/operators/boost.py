"""Boosted trees and logistic regressions for several overlapping training sets at once, on one stored matrix.

Rows are stored as blocks of a binned (or plain) matrix with the set of models that train on each row; binned
rows that are equal in every bin, label, set and kept column are one row with a count.
One pass over the blocks serves every model: boosting adds up the histograms of all models' open nodes,
Newton's method their gradients and Hessians. A pass is one job whose tasks each return sums of the
models' own size; where the tasks are many, the sums are added up by key before they are collected.
Passes read the blocks as a persisted RDD of arrays: a model takes hundreds of them, and a plan for each costs more
than the pass. Scores of boosting so far are kept beside the blocks and renewed every few trees.
Binned tables of few different rows, however many rows they count, are boosted in one job: a task for each model
takes its counted rows and grows the same trees from the same sums.
"""

from __future__ import annotations

import operator
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tabassay.operators.encode import quoted
from tabassay.operators.ranking import cut_values, value_counts
from tabassay.session import shared_folder

#: Bins of a feature, rows of a block, trees between two renewals of the stored scores, and tasks whose sums the driver adds up itself.
BINS, BLOCK_ROWS, CUT, FEW_TASKS = 256, 8192, 20, 64
#: Rows of a task that are added up before they are shuffled.
COUNT_ROWS = 100_000
#: Rows that a task of a pass has at least; a pass over fewer is mostly the starting of tasks.
TASK_ROWS = 25_000
#: Bins of all different rows up to which a model is boosted in one task; a pass over them takes less than the job around it.
SMALL_CELLS = 2_000_000
RATE = 0.1

_BLOCK = "n int, x binary, y binary, use binary, c binary, keep binary"


@dataclass
class Tree:
    """Nodes in heap order: feature (-1: leaf), last bin that goes left, value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        """Node that each row of codes ends in."""
        at = np.zeros(len(codes), np.int64)
        while True:
            f = self.feature[at]
            go = np.flatnonzero(f >= 0)
            if not len(go):
                return at
            at[go] = 2 * at[go] + 1 + (codes[go, f[go]] > self.cut[at[go]])


@dataclass
class Boosted:
    """One fitted model: prior log odds, trees over binned features, and what each feature has gained."""

    names: list[str]
    cuts: list[np.ndarray]
    prior: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    gains: list[np.ndarray] = field(default_factory=list)

    def margins(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.prior)
        for t in self.trees:
            out += t.value[t.leaf(codes)]
        return out

    def importance(self) -> dict[str, float]:
        """Share of the loss reduced by each feature, averaged over trees, in falling order."""
        parts = [g / g.sum() for g in self.gains if g.sum() > 0]
        share = sum(parts) / len(parts) if parts else np.zeros(len(self.names))
        total = share.sum() or 1.0
        return dict(sorted(zip(self.names, (share / total).tolist(), strict=True), key=lambda x: -x[1]))


@dataclass
class Forest:
    """Margins of several boosted models on binned rows."""

    models: list[Boosted]

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([m.margins(codes) for m in self.models], axis=1)


def cut_points(df: DataFrame, names: list[str]) -> list[np.ndarray]:
    """Bounds between the bins of each feature: midpoints of up to BINS distinct values, else quantiles."""
    if not names:
        return []
    few = value_counts(df, names, int(0.8 * BINS))
    out = []
    for c in names:
        v = np.unique(np.array(list(few[c]) if c in few else cut_values(df, c, BINS), np.float64))
        out.append((v[1:] + v[:-1]) / 2 if c in few else v)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: how many bounds lie below it."""
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8) if cuts else np.zeros((len(x), 0), np.uint8)


def _matrix(batch: pa.RecordBatch, first: int, width: int) -> np.ndarray:
    return np.stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1).astype(np.float64) if width else np.zeros((len(batch), 0))


def _coded(batches: Iterable[pa.RecordBatch], width: int, cuts: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """From (y, use, keep, features...) rows (y, use, keep, x, c); x has the row's bins, of which equal ones that stand near are counted, or its plain numbers."""
    rows = _plain(batches, width, cuts)
    if cuts is None:
        yield from rows
        return
    kept: list[pa.RecordBatch] = []
    for b in rows:
        kept.append(b)
        if sum(map(len, kept)) >= COUNT_ROWS:
            yield from _added(kept)
            kept.clear()
    yield from _added(kept) if kept else ()


def _added(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    rows = pa.Table.from_batches(parts)
    return rows.group_by(["y", "use", "keep", "x"], use_threads=False).aggregate([("c", "sum")]).rename_columns(rows.column_names).combine_chunks().to_batches()


def _plain(batches: Iterable[pa.RecordBatch], width: int, cuts: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """From (y, use, keep, features...) rows (y, use, keep, x, c) one for one."""
    for b in batches:
        x = _matrix(b, 3, width)
        x = np.ascontiguousarray(x if cuts is None else binned(x, cuts))
        step = width * x.itemsize
        bytes_ = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(np.arange(len(b) + 1, dtype=np.int32) * np.int32(step)), pa.py_buffer(x.tobytes())])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), bytes_, pa.array(np.ones(len(b), np.int64))], names=["y", "use", "keep", "x", "c"])


def _store(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """From (y, use, keep, x, c) blocks of _BLOCK."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            b = batch.slice(lo, rows)
            y, use, keep, c = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            parts = [b"".join(b.column(3).to_pylist()), y.astype(np.int8).tobytes(), use.astype(np.int64).tobytes(), c.astype(np.int64).tobytes(), pickle.dumps(keep)]
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int32()), *[pa.array([p], pa.binary()) for p in parts]], names=["n", "x", "y", "use", "c", "keep"])


def _arrays(n: int, x: bytes, y: bytes, use: bytes, c: bytes, width: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(x, kind).reshape(n, width), np.frombuffer(y, np.int8), np.frombuffer(use, np.int64), np.frombuffer(c, np.int64)


def _opened(row: Row, width: int, models: int, kind: type) -> tuple[np.ndarray, ...]:
    """A block for passes: x, y, use, margins (none yet), count."""
    x, y, use, c = _arrays(row.n, row.x, row.y, row.use, row.c, width, kind)
    return x, y, use, np.zeros((row.n, models)), c


class Matrix:
    """Stored blocks of a DataFrame's features, label (0 or 1), use (bit m: model m trains on the row) and one more column to keep.

    With cuts the rows are binned, and equal ones are stored once with their count.
    """

    def __init__(self, df: DataFrame, names: list[str], label: str, use: Column, models: int, keep: str | None = None, cuts: list[np.ndarray] | None = None):
        self.names, self.models, self.cuts = names, models, cuts
        self.kind, self.width = (np.uint8 if cuts is not None else np.float64), len(names)
        self.fitted: Callable[[np.ndarray], np.ndarray] | None = None
        rows = df.select(F.col(label).cast("int"), use.cast("long"), F.col(keep) if keep else F.lit(0).alias("keep"), *[quoted(c).cast("double") for c in names]).toDF("y", "use", "keep", *[f"f{i}" for i in range(len(names))])
        self.keep_type = rows.schema["keep"].dataType.simpleString()
        coded = rows.mapInArrow(partial(_coded, width=self.width, cuts=cuts), f"y int, use long, keep {self.keep_type}, x binary, c long")
        counted = coded if cuts is None else coded.groupBy("y", "use", "keep", "x").agg(F.sum("c").alias("c"))
        self.blocks = self._written(counted.mapInArrow(partial(_store, rows=min(BLOCK_ROWS, TASK_ROWS)), _BLOCK))
        found = self.blocks.agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).first()
        self.rows = found["n"] or 0
        self.tasks = max(1, min(found["blocks"], self.rows // TASK_ROWS, 3 * df.sparkSession.sparkContext.defaultParallelism))
        self.held: RDD | None = None

    @property
    def stored(self) -> RDD:
        """The blocks as passes read them, persisted by the first."""
        if self.held is None:
            self.held = self._kept(self.blocks.repartition(self.tasks).rdd.map(partial(_opened, width=self.width, models=self.models, kind=self.kind)))
        return self.held

    def _written(self, df: DataFrame) -> DataFrame:
        """df at rest: in the checkpoint folder, or in memory where a local session has none."""
        path = shared_folder(df.sparkSession)
        if not path:
            return df.cache()
        self.path = f"{path}/blocks-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        return df.sparkSession.read.schema(_BLOCK).parquet(self.path)

    def _kept(self, rdd: RDD) -> RDD:
        """rdd persisted, in place of what passes read before."""
        out, old = rdd.persist(StorageLevel.MEMORY_AND_DISK), self.held
        out.count()
        if old is not None:
            old.unpersist()
        return out

    def close(self) -> None:
        if self.held is not None:
            self.held.unpersist()
        self.blocks.unpersist()
        if path := getattr(self, "path", None):
            spark = self.blocks.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    def summed(self, work: Callable) -> dict[object, np.ndarray]:
        """Arrays by key, added up over all blocks; work(x, y, use, margins, count) yields (key, array) for a task's blocks."""
        parts = self.stored.mapPartitions(partial(_partial, work=work))
        if self.tasks > FEW_TASKS:
            parts = parts.reduceByKey(operator.add, FEW_TASKS)
        out: dict[object, np.ndarray] = {}
        for key, part in parts.collect():  # a task's sums are as large as the models, not the rows
            out[key] = out[key] + part if key in out else part
        return out

    def advance(self, trees: list[list[Tree]], priors: np.ndarray | None = None) -> None:
        """Adds trees (a list for each model) to the stored margins; priors set them first."""
        self.held = self._kept(self.stored.map(partial(_advanced, trees=trees, priors=priors)))

    def scored(self, of: Callable[[np.ndarray], np.ndarray] | None = None, counted: bool = False) -> DataFrame:
        """(label, keep, use, score array of every model's chance of label 1), a row for each row of the table; margins are of(x), or the boosted models'.

        Counted, equal rows stay one row with their number n.
        """
        kinds = f"label int, keep {self.keep_type}, use long, score array<double>" + ", n long" * counted
        return self.blocks.mapInArrow(partial(_scored, width=self.width, models=self.models, kind=self.kind, of=of or self.fitted, counted=counted), kinds)


def _partial(blocks: Iterable[tuple[np.ndarray, ...]], work: Callable) -> Iterable[tuple[str, np.ndarray]]:
    sums: dict[str, np.ndarray] = {}
    for block in blocks:
        for key, part in work(*block):
            sums[key] = sums[key] + part if key in sums else part
    return sums.items()


def _advanced(block: tuple[np.ndarray, ...], trees: list[list[Tree]], priors: np.ndarray | None) -> tuple[np.ndarray, ...]:
    x, y, use, margins, count = block
    margins = margins.copy() if priors is None else np.tile(priors, (len(x), 1))
    for m, own in enumerate(trees):
        for t in own:
            margins[:, m] += t.value[t.leaf(x)]
    return x, y, use, margins, count


def _scored(batches: Iterable[pa.RecordBatch], width: int, models: int, kind: type, of: Callable | None, counted: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            x, y, use, count = _arrays(*(row[k] for k in ("n", "x", "y", "use", "c")), width, kind)
            p = chance(np.zeros((len(x), models)) if of is None else of(x))
            keep = pickle.loads(row["keep"])
            scores = lambda at: pa.FixedSizeListArray.from_arrays(pa.array(p[at].ravel()), models).cast(pa.list_(pa.float64()))  # noqa: B023, E731
            if counted:
                yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(keep), pa.array(use), scores(slice(None)), pa.array(count)], names=["label", "keep", "use", "score", "n"])
                continue
            # Many equal rows go out some at a time.
            ends = np.cumsum(count)
            for lo in range(0, int(ends[-1]) if len(ends) else 0, BLOCK_ROWS):
                at = np.searchsorted(ends, np.arange(lo, min(lo + BLOCK_ROWS, int(ends[-1]))), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(y[at].astype(np.int32)), pa.array(keep[at]), pa.array(use[at]), scores(at)], names=["label", "keep", "use", "score"])


def chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _priors(x: np.ndarray, y: np.ndarray, use: np.ndarray, margins: np.ndarray, count: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    for m in range(margins.shape[1]):
        on = np.where((use >> m) & 1 == 1, count, 0)
        yield str(m), np.array([on.sum(), (on * y).sum()], np.float64)


def histograms(x: np.ndarray, y: np.ndarray, use: np.ndarray, margins: np.ndarray, count: np.ndarray, recent: list[list[Tree]], open_: list[Tree], nodes: list[list[int]], sizes: list[int]) -> Iterator[tuple[str, np.ndarray]]:
    """For each model's open nodes, by feature and bin: residuals, their variances p(1-p), rows."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    bins = int(ends[-1])
    for m, wanted in enumerate(nodes):
        if not wanted:
            continue
        rows = np.flatnonzero((use >> m) & 1)
        codes, f = x[rows], margins[rows, m].copy()
        for t in recent[m]:
            f += t.value[t.leaf(codes)]
        p = chance(f)
        stats = np.stack([y[rows] - p, p * (1 - p), np.ones(len(rows))]) * count[rows]
        at = open_[m].leaf(codes) if len(open_[m].feature) else np.zeros(len(rows), np.int64)
        slots = np.full(max(len(open_[m].feature), 1), -1)
        slots[wanted] = np.arange(len(wanted))
        here = np.flatnonzero(slots[at] >= 0)
        key = (codes[here].astype(np.int64) + ends[:-1] + slots[at[here]][:, None] * bins).ravel()
        part = np.stack([np.bincount(key, np.repeat(s[here], x.shape[1]), minlength=bins * len(wanted)) for s in stats])
        for i, node in enumerate(wanted):
            yield f"{m} {node}", part[:, i * bins : (i + 1) * bins]


def best_split(h: np.ndarray, sizes: list[int]) -> tuple[float, int, int] | None:
    """(gain, feature, last bin to the left) with the greatest drop of squared residuals; the first of equals. None if no cut drops them."""
    best, at = None, 0
    for f, size in enumerate(sizes):
        r, _, n = h[:, at : at + size]
        at += size
        left_r, left_n = np.cumsum(r)[:-1], np.cumsum(n)[:-1]
        right_r, right_n = r.sum() - left_r, n.sum() - left_n
        ok = (left_n > 0) & (right_n > 0)
        if not ok.any():
            continue
        diff = left_r / np.maximum(left_n, 1) - right_r / np.maximum(right_n, 1)
        gain = np.where(ok, left_n * right_n / np.maximum(left_n + right_n, 1) * diff * diff, -1.0)
        k = int(gain.argmax())
        if gain[k] > 1e-12 and (best is None or gain[k] > best[0] * (1 + 1e-9)):
            best = (float(gain[k]), f, k)
    return best


class Counted:
    """One model's different binned rows with their counts, in a task: what boosting asks of a Matrix."""

    models = 1

    def __init__(self, names: list[str], cuts: list[np.ndarray], x: np.ndarray, y: np.ndarray, count: np.ndarray):
        self.names, self.cuts = names, cuts
        self.block = x, y, np.ones(len(x), np.int64), np.zeros((len(x), 1)), count

    def summed(self, work: Callable) -> dict[str, np.ndarray]:
        return dict(work(*self.block))

    def advance(self, trees: list[list[Tree]], priors: np.ndarray | None = None) -> None:
        self.block = _advanced(self.block, trees, priors)


def _dealt(block: tuple[np.ndarray, ...], models: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The rows of a block that each model trains on."""
    x, y, use, _, count = block
    for m in range(models):
        rows = np.flatnonzero((use >> m) & 1)
        yield m, (x[rows], y[rows], count[rows])


def _fitted(parts: Iterable[tuple[int, tuple[np.ndarray, ...]]], names: list[str], cuts: list[np.ndarray], trees: int, depth: int, rate: float) -> Iterator[tuple[int, Boosted]]:
    """Boosts each model that a task holds. Rows that differ in what is kept alone are added up; their order does not depend on the blocks'."""
    found: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for m, part in parts:
        found.setdefault(m, []).append(part)
    for m, own in found.items():
        x, y, count = (np.concatenate(a) for a in zip(*own, strict=True))
        rows, at = np.unique(np.c_[x, y.astype(np.uint8)], axis=0, return_inverse=True)
        total = np.zeros(len(rows), np.int64)
        np.add.at(total, at.ravel(), count)
        yield m, boosted(Counted(names, cuts, np.ascontiguousarray(rows[:, :-1]), rows[:, -1].astype(np.int8), total), trees, depth, rate, 1)[0]


def boost(matrix: Matrix, trees: int = 100, depth: int = 3, rate: float = RATE) -> list[Boosted]:
    """Gradient boosting of every model: trees on the residuals of the log loss, leaves by one Newton step times rate. matrix keeps the models.

    Up to SMALL_CELLS different rows times features, whatever they count, models are boosted side by side, each in a task; beyond, by passes over the blocks.
    """
    if 0 < matrix.rows * matrix.width <= SMALL_CELLS:
        opened = matrix.blocks.rdd.map(partial(_opened, width=matrix.width, models=matrix.models, kind=matrix.kind))
        dealt = opened.flatMap(partial(_dealt, models=matrix.models)).partitionBy(matrix.models, int)
        found = dict(dealt.mapPartitions(partial(_fitted, names=matrix.names, cuts=matrix.cuts, trees=trees, depth=depth, rate=rate)).collect())
        models = [found[m] for m in range(matrix.models)]
    else:
        models = boosted(matrix, trees, depth, rate, CUT)
    matrix.fitted = Forest(models)
    return models


def boosted(matrix: Matrix | Counted, trees: int, depth: int, rate: float, every: int) -> list[Boosted]:
    """boost() by sums over matrix, whose scores are renewed after `every` trees."""
    models = [Boosted(matrix.names, matrix.cuts) for _ in range(matrix.models)]
    sizes = [len(c) + 1 for c in matrix.cuts]
    found = matrix.summed(_priors)
    for m, model in enumerate(models):
        n, ones = found.get(str(m), np.zeros(2))
        p = min(max(ones / n if n else 0.5, 1e-12), 1 - 1e-12)
        model.prior = float(np.log(p / (1 - p)))
    matrix.advance([[] for _ in models], np.array([m.prior for m in models]))
    recent: list[list[Tree]] = [[] for _ in models]
    width = 2 ** (depth + 1) - 1
    for t in range(trees):
        grown = [Tree(np.full(width, -1, np.int32), np.zeros(width, np.int32), np.zeros(width)) for _ in models]
        gains = [np.zeros(len(sizes)) for _ in models]
        nodes = [[0] if sizes else [] for _ in models]
        for level in range(depth):
            if not any(nodes):
                break
            sums = matrix.summed(partial(histograms, recent=recent, open_=grown, nodes=nodes, sizes=sizes))
            later: list[list[int]] = [[] for _ in models]
            for m, wanted in enumerate(nodes):
                for node in wanted:
                    if (h := sums.get(f"{m} {node}")) is None:
                        continue
                    r, v, n = h[:, : sizes[0]].sum(axis=1)
                    grown[m].value[node] = rate * r / v if abs(v) > 1e-150 else 0.0
                    if not (split := best_split(h, sizes)):
                        continue
                    gain, f, k = split
                    gains[m][f] += gain
                    grown[m].feature[node], grown[m].cut[node] = f, k
                    lo = sum(sizes[:f])
                    left = h[:, lo : lo + k + 1].sum(axis=1)
                    for child, (cr, cv, cn) in ((2 * node + 1, left), (2 * node + 2, np.array([r, v, n]) - left)):
                        grown[m].value[child] = rate * cr / cv if abs(cv) > 1e-150 else 0.0
                        if cn > 1:
                            later[m].append(child)
            nodes = later
        for m, model in enumerate(models):
            model.trees.append(grown[m])
            model.gains.append(gains[m])
            recent[m].append(grown[m])
        if len(recent[0]) == every and t < trees - 1:
            matrix.advance(recent)
            recent = [[] for _ in models]
    return models


def _predict(batches: Iterable[pa.RecordBatch], models: list[Boosted], keep: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = binned(_matrix(b, keep, len(models[0].names)), models[0].cuts)
        columns = [b.column(i) for i in range(keep)]
        for m in models:
            columns.append(pa.array(chance(m.margins(codes))))
        yield pa.RecordBatch.from_arrays(columns, names=[*(f"k{i}" for i in range(keep)), *(f"s{i}" for i in range(len(models)))])


def predict(models: list[Boosted], df: DataFrame, *keep: str) -> DataFrame:
    """(keep..., score of one model, or score0, score1 ... of several), by trees fitted on the same bins."""
    names = models[0].names
    rows = df.select(*[quoted(c) for c in keep], *[quoted(c).cast("double") for c in names])
    kinds = [f"k{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = rows.toDF(*[f"k{i}" for i in range(len(keep))], *[f"f{i}" for i in range(len(names))]).mapInArrow(partial(_predict, models=models, keep=len(keep)), ", ".join([*kinds, *[f"s{i} double" for i in range(len(models))]]))
    return out.toDF(*keep, *(["score"] if len(models) == 1 else [f"score{i}" for i in range(len(models))]))


def _newton(x: np.ndarray, y: np.ndarray, use: np.ndarray, margins: np.ndarray, count: np.ndarray, weights: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """For each model the gradient and Hessian of the log loss at its weights, with the loss; the intercept comes last."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    for m, w in enumerate(weights):
        on = (use >> m) & 1 == 1
        own, target = x[on], y[on]
        f = own @ w
        p = chance(f)
        loss = np.logaddexp(0, f).sum() - f[target == 1].sum()
        hessian = (own * (p * (1 - p))[:, None]).T @ own
        yield str(m), np.concatenate([hessian.ravel(), own.T @ (p - target), [loss]])


def logistic(matrix: Matrix, strength: float = 1.0, tolerance: float = 1e-10, steps: int = 100) -> np.ndarray:
    """Weights (a row for each model, the intercept last) that minimise the summed log loss + |w|^2 / (2 strength), the intercept free; damped Newton steps, one pass each for all models."""
    k = matrix.width + 1
    ridge = np.r_[np.full(k - 1, 1 / strength), 0.0]
    weights = np.zeros((matrix.models, k))
    best, step = np.full(matrix.models, np.inf), np.zeros_like(weights)
    share = np.ones(matrix.models)
    done = np.zeros(matrix.models, bool)
    for _ in range(steps):
        found = matrix.summed(partial(_newton, weights=weights + share[:, None] * step))
        for m in range(matrix.models):
            if done[m]:
                continue
            if (s := found.get(str(m))) is None:
                done[m] = True
                continue
            at = weights[m] + share[m] * step[m]
            total = s[-1] + (ridge * at * at).sum() / 2
            if total > best[m] + 1e-12 * abs(best[m]) and share[m] > 1e-6:
                share[m] /= 2  # the step went too far
                continue
            weights[m], best[m] = at, total
            gradient = s[k * k : -1] + ridge * at
            hessian = s[: k * k].reshape(k, k) + np.diag(ridge) + np.diag(np.r_[np.zeros(k - 1), 1e-12])
            step[m], share[m] = -np.linalg.lstsq(hessian, gradient, rcond=None)[0], 1.0
            if np.abs(step[m]).max() < tolerance:
                done[m], step[m] = True, 0.0
        if done.all():
            break
    return weights


@dataclass
class Linear:
    """Margins of several logistic models on plain features."""

    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:, :-1].T + self.weights[:, -1]


def _linear(batches: Iterable[pa.RecordBatch], weights: np.ndarray, keep: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p = chance(Linear(weights)(_matrix(b, keep, weights.shape[1] - 1)))[:, 0]
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(keep)], pa.array(p)], names=[*(f"k{i}" for i in range(keep)), "score"])


def predict_linear(weights: np.ndarray, df: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """(keep..., score) of one logistic model, given as a row of logistic()."""
    rows = df.select(*[quoted(c) for c in keep], *[quoted(c).cast("double") for c in names])
    kinds = [f"k{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = rows.toDF(*[f"k{i}" for i in range(len(keep))], *[f"f{i}" for i in range(len(names))]).mapInArrow(partial(_linear, weights=weights.reshape(1, -1), keep=len(keep)), ", ".join([*kinds, "score double"]))
    return out.toDF(*keep, "score")
