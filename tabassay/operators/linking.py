"""Nearest records: distance to the closest record, and pairwise distances of a bounded sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.functions.rng import order_key
from tabassay.operators.encode import quoted
from tabassay.operators.ranking import quantiles
from tabassay.session import cut

#: Reference rows that are broadcast at most, and only while rows times features stay below the second bound.
BROADCAST_ROWS, BROADCAST_CELLS = 20_000, 2_000_000
#: Feature count up to which the distance is written out as column arithmetic.
FLAT_FEATURES = 96
#: Pivots and blocks of train rows at most, rows of a block in a task, rows bounded and copies made at a time.
MAX_PIVOTS, MAX_BLOCKS, BLOCK_ROWS, MAPPED_ROWS, COPIED_ROWS = 2048, 65_536, 4096, 64, 8192
_METRICS = {"manhattan": "cityblock", "cityblock": "cityblock", "euclidean": "euclidean", "cosine": "cosine"}


def metric_name(metric: str) -> str:
    if metric not in _METRICS:
        raise ValueError(f"unknown metric {metric}; known: {sorted(_METRICS)}")
    return _METRICS[metric]


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0)


def flat_distance(features: list[str], metric: str, left: str = "s", right: str = "t") -> Column:
    """Distance of two aliased rows before the square root (euclidean), as flat arithmetic inside generated code."""
    pairs = [(F.col(f"{left}.`{c}`"), F.col(f"{right}.`{c}`")) for c in features]
    if metric == "euclidean":
        return _sum([(a - b) * (a - b) for a, b in pairs])
    if metric == "cityblock":
        return _sum([F.abs(a - b) for a, b in pairs])
    norms = F.sqrt(_sum([a * a for a, _ in pairs])) * F.sqrt(_sum([b * b for _, b in pairs]))
    return F.lit(1.0) - _sum([a * b for a, b in pairs]) / F.nullif(norms, F.lit(0.0))


def finish(metric: str, value: Column) -> Column:
    return F.sqrt(value) if metric == "euclidean" else value


def nearest(synthetic: DataFrame, train: DataFrame, features: list[str], metric: str = "euclidean", row_id: str = "row_id") -> DataFrame:
    """(row_id, dcr, closest) for each synthetic row: distance and id of its nearest train row, ties to the smaller id.

    A small train side is broadcast and the minimum is kept while pairs stream by. A larger one is
    met block by block, where the triangle inequality leaves a block in question (PivotedNearest).
    """
    metric = metric_name(metric)
    s = synthetic.select(row_id, *[quoted(c) for c in features])
    t = train.select(F.col(row_id).alias("_t"), *[quoted(c) for c in features])
    fits = len(features) <= FLAT_FEATURES and t.limit(BROADCAST_ROWS + 1).count() <= min(BROADCAST_ROWS, BROADCAST_CELLS // max(1, len(features)))
    if fits:
        spread = s.repartition(max(1, s.sparkSession.sparkContext.defaultParallelism * 2), row_id)
        pairs = spread.alias("s").crossJoin(F.broadcast(t.alias("t"))).select(F.col(f"s.{row_id}").alias(row_id), F.col("t._t").alias("_t"), flat_distance(features, metric).alias("_d"))
        best = pairs.filter("_d IS NOT NULL").groupBy(row_id).agg(F.min("_d").alias("_d"), F.min(F.struct("_d", "_t")).alias("_b"))
        return best.select(row_id, finish(metric, F.col("_d")).alias("dcr"), F.col("_b._t").alias("closest"))
    return blocked_nearest(s, t, features, metric, row_id)


def blocked_nearest(s: DataFrame, t: DataFrame, features: list[str], metric: str, row_id: str = "row_id", block: int = BLOCK_ROWS) -> DataFrame:
    """nearest() by blocks around pivots, for train rows (_t, features) of any number."""
    found = PivotedNearest(s, t, features, metric, row_id, block).rows()
    return found.select(row_id, finish(metric, F.col("_d")).alias("dcr"), F.col("_t").alias("closest"))


def _block_minimum(metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if metric == "cityblock":
            # Some rows of b at a time and in place, so that the sums stay in the processor's cache.
            out = np.zeros((len(a), len(b)))
            for lo in range(0, len(b), 64):
                total, columns = np.zeros((len(a), len(b[lo : lo + 64]))), np.ascontiguousarray(b[lo : lo + 64].T)
                step = np.empty_like(total)
                for i in range(a.shape[1]):
                    np.abs(np.subtract(a[:, [i]], columns[i], out=step), out=step)
                    total += step
                out[:, lo : lo + 64] = total
            return out
        if metric == "euclidean":
            return sum((a[:, [i]] - b[:, i]) ** 2 for i in range(a.shape[1]))
        with np.errstate(all="ignore"):
            return 1 - (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])

    return distances


def _finite(df: DataFrame, features: list[str], metric: str) -> DataFrame:
    """Rows that have a distance: every feature known and finite, and for cosine not all zero."""
    good = reduce(lambda a, b: a & b, [F.abs(quoted(c)) < F.lit(float("inf")) for c in features])
    return df.filter(good & (reduce(lambda a, b: a | b, [quoted(c) != 0 for c in features]) if metric == "cosine" else F.lit(True)))


def _points(rows: np.ndarray, metric: str) -> np.ndarray:
    """Rows as points of a space in which the triangle inequality holds: cosine distance is half the squared distance of unit vectors."""
    return rows / np.linalg.norm(rows, axis=1)[:, None] if metric == "cosine" else rows


def _to_pivots(points: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    """True distances of points to pivots, by the coordinate: products of rows lose the digits that bounds need."""
    total = np.zeros((len(points), len(pivots)))
    for i in range(points.shape[1]):
        step = points[:, [i]] - pivots[:, i]
        total += np.abs(step) if metric == "cityblock" else step * step
    return total if metric == "cityblock" else np.sqrt(total)


def _radius(metric: str, d: np.ndarray) -> np.ndarray:
    """The distance between points that a value before finish() stands for."""
    return d if metric == "cityblock" else np.sqrt(d) if metric == "euclidean" else np.sqrt(np.maximum(2 * d, 0))


@dataclass
class Blocks:
    """The stored blocks of the train rows: which pivot, distances to it from lo to hi, and in how many parts a block is held.

    There are MAX_PIVOTS + MAX_BLOCKS of them at most, whatever the number of rows.
    """

    metric: str
    pivots: np.ndarray
    keys: np.ndarray
    pivot: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    parts: np.ndarray

    def home(self, points: np.ndarray) -> np.ndarray:
        """Number of the block that most likely holds a point's nearest row: of its nearest pivot, the ring it would lie in."""
        d = _to_pivots(points, self.pivots, self.metric)
        own = d[:, self.pivot]
        gap = np.maximum(0, np.maximum(self.lo - own, own - self.hi))
        return np.where(self.pivot == d.argmin(axis=1)[:, None], gap, np.inf).argmin(axis=1)

    def open(self, points: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """(point, block): whether a row of the block can be as near as reach, by the triangle inequality; rounding is allowed for."""
        d = _to_pivots(points, self.pivots, self.metric)
        own = d[:, self.pivot]
        least = np.maximum(np.maximum(own - self.hi, self.lo - own), (own - d.min(axis=1)[:, None]) / 2)
        return least <= reach[:, None] + 1e-7 * (1 + own)


def _nearer(metric: str, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value before finish() and position of the first nearest row of b for each row of a; no row of b is missing."""
    best, at = np.full(len(a), np.inf), np.zeros(len(a), np.int64)
    for i in range(0, len(a), 512):
        some = a[i : i + 512]
        if metric == "euclidean":
            # A matrix product finds the rows within rounding of the least; those alone are measured by the coordinate.
            rough = (some * some).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (some @ b.T)
            slack = 1e-9 * ((some * some).sum(axis=1) + (b * b).sum(axis=1).max())
            r, c = np.nonzero(rough <= (rough.min(axis=1) + slack)[:, None])
            d = np.zeros(len(r))
            for k in range(a.shape[1]):
                d += (some[r, k] - b[c, k]) ** 2
            order = np.lexsort((c, d, r))
            first = order[np.r_[True, r[order][1:] != r[order][:-1]]]
            best[i : i + 512], at[i : i + 512] = d[first], c[first]
            continue
        d = _block_minimum(metric)(some, b)
        at[i : i + 512] = d.argmin(axis=1)
        best[i : i + 512] = d[np.arange(len(some)), at[i : i + 512]]
    return best, at


def _undecided(frame: pd.DataFrame, names: list[str], blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """Row and block numbers that are still to meet: the home block only where it is held in more parts than one."""
    d = frame["_d"].to_numpy(float)
    left = blocks.open(_points(frame[names].to_numpy(float), blocks.metric), _radius(blocks.metric, d))
    left &= (frame["_b"].to_numpy()[:, None] != blocks.keys) | (blocks.parts > 1) | ~np.isfinite(d)[:, None]
    return np.nonzero(left)


class PivotedNearest:
    """Exact nearest rows of train sides of any size: blocks around pivots, most of which the triangle inequality rules out.

    Equal train rows are one. A bounded number of pivots splits them into cells and rings of about
    BLOCK_ROWS rows. A synthetic row first meets the block it would lie in; the distance found there
    rules out every block that cannot hold a nearer or equally near row, and only copies for the
    others are shuffled, in tasks of BLOCK_ROWS rows of either side at most about. How many are left depends on the
    data: few where rows cluster, nearly all for independent coordinates in many dimensions (see tried()).
    Rows with null or not finite features, for cosine also zero rows, have no distance: they are left out on both sides.
    """

    def __init__(self, s: DataFrame, t: DataFrame, features: list[str], metric: str, row_id: str, block: int = BLOCK_ROWS):
        self.features, self.metric, self.row_id, self.block, self.spark = features, metric, row_id, block, s.sparkSession
        self.names = [f"_f{i}" for i in range(len(features))]
        plain = [quoted(c).cast("double").alias(n) for c, n in zip(features, self.names, strict=True)]
        known = _finite(t.select("_t", *plain), self.names, metric).groupBy(*self.names).agg(F.min("_t").alias("_t"))
        self.t = cut(known)
        self.s = _finite(s.select(row_id, *plain), self.names, metric).withColumn("_r", F.pmod(F.xxhash64(row_id), F.lit(1 << 30)))
        self.types = ", ".join(f"{n} double" for n in self.names)
        self.id_type, self.t_type = dict(s.dtypes)[row_id], dict(t.dtypes)["_t"]
        self.n = self.t.count()
        if self.n:
            self._arrange()

    def _mapped(self, df: DataFrame, kinds: str, each: Callable[[pd.DataFrame], Iterator[pd.DataFrame]]) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for i in range(0, len(frame), MAPPED_ROWS):
                    yield from each(frame.iloc[i : i + MAPPED_ROWS])

        return df.mapInPandas(run, kinds)

    def _arrange(self) -> None:
        names, metric, block = self.names, self.metric, self.block
        many = int(min(MAX_PIVOTS, max(1, BROADCAST_CELLS // len(names)), -(-4 * self.n // block)))
        chosen = self.t.orderBy(order_key(F.col("_t"), "pivots"), "_t").limit(many).toPandas()  # a bounded number of rows
        pivots = _points(chosen[names].to_numpy(float), metric)
        shared = self.spark.sparkContext.broadcast(pivots)

        def assign(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            d = _to_pivots(_points(frame[names].to_numpy(float), metric), shared.value, metric)
            yield frame.assign(_c=d.argmin(axis=1), _p=d.min(axis=1))

        near = cut(self._mapped(self.t, f"{self.types}, _t {self.t_type}, _c long, _p double", assign))
        ring_rows = max(block, -(-self.n // MAX_BLOCKS))
        cells = near.groupBy("_c").agg(F.ceil(F.count("*") / ring_rows).alias("_k"), F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
        ring = F.coalesce(F.least(F.col("_k") - 1, F.floor(F.try_divide(F.col("_p") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * F.col("_k"))), F.lit(0))
        ringed = near.join(F.broadcast(cells), "_c").withColumn("_b", F.col("_c") * F.lit(1 << 20) + ring).drop("_k", "_lo", "_hi")
        # One row for each block, of which there are MAX_PIVOTS + MAX_BLOCKS at most.
        table = ringed.groupBy("_b").agg(F.count("*").alias("n"), F.min("_p").alias("lo"), F.max("_p").alias("hi")).toPandas().sort_values("_b")
        keys = table["_b"].to_numpy(np.int64)
        self.blocks = Blocks(metric, pivots, keys, keys >> 20, table["lo"].to_numpy(), table["hi"].to_numpy(), -(-table["n"].to_numpy(np.int64) // block))
        self.shared = self.spark.sparkContext.broadcast(self.blocks)
        parts = self._by_block({"_m": self.blocks.parts})
        self.stored = ringed.join(F.broadcast(parts), "_b").withColumn("_h", F.pmod(F.xxhash64("_t", F.lit(1)), F.col("_m"))).select("_b", "_h", "_t", *names)

    def _by_block(self, columns: dict[str, np.ndarray]) -> DataFrame:
        return self.spark.createDataFrame(pd.DataFrame({"_b": self.blocks.keys, **{k: v.astype(np.int64) for k, v in columns.items()}}))

    def _meet(self, copies: DataFrame, splits: np.ndarray) -> DataFrame:
        """The best of one part of a block for each copy (.., _b, _h, _x); a part goes to as many tasks as its copies need."""
        names, metric, row_id = self.names, self.metric, self.row_id
        wanted = F.broadcast(self._by_block({"_n": splits}).filter("_n > 0"))
        parts = self.stored.join(wanted, "_b").withColumn("_x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")

        def meet(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            out = ours[[row_id, *names]].assign(_r=ours["_r"], _b=ours["_b"], _d=np.inf)
            if not len(ours) or not len(theirs):
                return out.assign(_t=None)
            theirs = theirs.sort_values("_t")
            out["_d"], at = _nearer(metric, ours[names].to_numpy(float), theirs[names].to_numpy(float))
            return out.assign(_t=theirs["_t"].to_numpy()[at])

        kinds = f"{row_id} {self.id_type}, {self.types}, _r long, _b long, _d double, _t {self.t_type}"
        return copies.groupBy("_b", "_h", "_x").cogroup(parts.groupBy("_b", "_h", "_x")).applyInPandas(meet, kinds)

    def _splits(self, counts: DataFrame) -> np.ndarray:
        """In how many tasks a block's copies are taken; counts (_b, n) has one row for each block."""
        found = dict(counts.groupBy("_b").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False, name=None))
        return np.array([-(-int(found.get(k, 0)) // self.block) for k in self.blocks.keys], np.int64)

    def first(self) -> DataFrame:
        """Every synthetic row with the best of its home block (_d infinite where that part is empty), stored."""
        names, metric, row_id, shared = self.names, self.metric, self.row_id, self.shared
        kinds = f"{row_id} {self.id_type}, {self.types}, _r long, _b long, _h long"

        def home(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            at = shared.value.home(_points(frame[names].to_numpy(float), metric))
            yield frame[[row_id, *names, "_r"]].assign(_b=shared.value.keys[at], _h=frame["_r"].to_numpy() % shared.value.parts[at])

        placed = cut(self._mapped(self.s, kinds, home))
        splits = self._splits(placed.groupBy("_b").agg(F.count("*").alias("n")))
        spread = placed.join(F.broadcast(self._by_block({"_n": splits})), "_b").withColumn("_x", F.pmod(F.xxhash64("_r", F.lit(2)), F.col("_n"))).drop("_n")
        return cut(self._meet(spread, splits))

    def _counted(self, first: DataFrame) -> DataFrame:
        shared, names = self.shared, self.names

        def count(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            numbers, n = np.unique(_undecided(frame, names, shared.value)[1], return_counts=True)
            yield pd.DataFrame({"_b": shared.value.keys[numbers], "n": n})

        return self._mapped(first, "_b long, n long", count)

    def tried(self) -> tuple[int, int]:
        """Pairs of a synthetic row and a block that are left after the home blocks, and how many there are in all."""
        if not self.n:
            return 0, 0
        first = self.first()
        return int(self._counted(first).agg(F.sum("n")).first()[0] or 0), first.count() * len(self.blocks.keys)

    def rows(self) -> DataFrame:
        """(row_id, _d, _t) of the nearest train row, ties to the smaller id."""
        names, row_id = self.names, self.row_id
        if not self.n:
            return self.spark.createDataFrame([], f"{row_id} {self.id_type}, _d double, _t {self.t_type}")
        first, shared = self.first(), self.shared
        splits = self._splits(self._counted(first))
        dealt = self.spark.sparkContext.broadcast(splits)
        kinds = f"{row_id} {self.id_type}, {self.types}, _r long, _b long, _h long, _x long"

        def copy(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            r, b = _undecided(frame, names, shared.value)
            parts = shared.value.parts[b]
            r, b, h = np.repeat(r, parts), np.repeat(b, parts), np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            for i in range(0, len(r), COPIED_ROWS):
                some = frame.iloc[r[i : i + COPIED_ROWS]][[row_id, *names, "_r"]]
                at = b[i : i + COPIED_ROWS]
                yield some.assign(_b=shared.value.keys[at], _h=h[i : i + COPIED_ROWS], _x=some["_r"].to_numpy() % dealt.value[at])

        later = self._meet(self._mapped(first, kinds, copy), splits)
        both = first.select(row_id, "_d", "_t").union(later.select(row_id, "_d", "_t")).filter(F.col("_t").isNotNull())
        return both.groupBy(row_id).agg(F.min(F.struct("_d", "_t")).alias("_b")).select(row_id, "_b._d", "_b._t")


def pairwise_sample(train: DataFrame, features: list[str], metric: str = "euclidean", n: int = 1000, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """(a, b, d) for all pairs a < b of the n train rows that come first in hash order; n bounds the broadcast."""
    metric = metric_name(metric)
    some = train.select(row_id, *[quoted(c) for c in features]).orderBy(order_key(F.col(row_id), "pairs", seed), row_id).limit(n)
    a, b = some.alias("s"), F.broadcast(some.alias("t"))
    pairs = a.join(b, F.col(f"s.{row_id}") < F.col(f"t.{row_id}"))
    return pairs.select(F.col(f"s.{row_id}").alias("a"), F.col(f"t.{row_id}").alias("b"), finish(metric, flat_distance(features, metric)).alias("d"))


def dcr_summary(distances: DataFrame, percentile: float = 5) -> DataFrame:
    """One row over distances (dcr): percentile, mean, median, min, population deviation, close matches below min + deviation."""
    kept = distances.select("dcr").cache()
    low, middle = (quantiles(kept, ["dcr"], p)["dcr"] for p in (percentile / 100, 0.5))
    mean, least, spread, n = kept.agg(F.avg("dcr"), F.min("dcr"), F.stddev_pop("dcr"), F.count("dcr")).first()
    close = kept.filter(F.col("dcr") < F.lit(least) + F.lit(spread)).count() if n else 0
    kept.unpersist()
    row = (low, mean, middle, least, spread, n, close, close * 100.0 / n if n else None)
    names = "dcr_percentile double, dcr_mean double, dcr_median double, dcr_min double, dcr_std double, n long, n_close_matches long, pct_close_matches double"
    return distances.sparkSession.createDataFrame([row], names)
