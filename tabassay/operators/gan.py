"""Conditional generative adversarial network for tables, trained by all of a barrier stage's tasks together.

Numbers are normalised by modes: a Gaussian mixture is fitted to each column's histogram, whose integer
counts come from one grouped pass, and a value becomes a mode and a place within it. Generator and
critic see a condition (one category of one column), drawn by the logarithm of its frequency, and real
rows that meet it. Rows are dealt into fixed units; a step adds the units' gradients up in
order, so the model does not depend on the number of tasks. Every task keeps a replica of the model.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.operators.encode import levels, quoted
from tabassay.operators.generators import CATEGORY_THRESHOLD, value_column_types
from tabassay.operators.ranking import histograms

#: Modes of a number, cells of its histogram, rounds of the mixture fit, and the least weight of a mode.
MODES, CELLS, ROUNDS, LEAST_WEIGHT = 10, 4096, 100, 0.005
#: Rows whose random numbers are drawn together when sampling.
BLOCK = 1024

_F = np.float32


@dataclass
class Column:
    """A column's encoding: categories (text, null among them), or modes of a number with an extra one for null."""

    name: str
    categories: list[str | None] | None
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    low: float = 0.0
    high: float = 0.0

    @property
    def width(self) -> int:
        """Numbers that the networks see of it."""
        return len(self.categories) if self.categories is not None else 2 + len(self.mean)


def mixture(centres: np.ndarray, counts: np.ndarray, modes: int = MODES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and weights of a Gaussian mixture over counted values, by expectation maximisation from even quantiles."""
    total = counts.sum()
    step = max(float(np.ptp(centres)) / CELLS, 1e-9)
    share = np.cumsum(counts) / total
    mean = np.unique(centres[np.minimum(np.searchsorted(share, (np.arange(modes) + 0.5) / modes), len(centres) - 1)])
    scale = np.full(len(mean), max(float(np.sqrt(np.average((centres - np.average(centres, weights=counts)) ** 2, weights=counts))) / len(mean), step))
    weight = np.full(len(mean), 1 / len(mean))
    for _ in range(rounds):
        r = responsibilities(centres, mean, scale, weight) * counts[:, None]
        n = r.sum(axis=0)
        keep = n > LEAST_WEIGHT * total
        r, n = r[:, keep], n[keep]
        mean = (r * centres[:, None]).sum(axis=0) / n
        scale = np.maximum(np.sqrt((r * (centres[:, None] - mean) ** 2).sum(axis=0) / n), step)
        weight = n / n.sum()
    return mean, scale, weight


def responsibilities(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray) -> np.ndarray:
    log = np.log(weight) - np.log(scale) - 0.5 * ((x[:, None] - mean) / scale) ** 2
    r = np.exp(log - log.max(axis=1, keepdims=True))
    return r / r.sum(axis=1, keepdims=True)


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the id alone."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def encode_column(c: Column, values: pa.Array, ids: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(category or mode, place within the mode) of each value; the mode is drawn by its responsibility."""
    if c.categories is not None:
        code = {v: i for i, v in enumerate(c.categories)}
        return np.array([code[v] for v in values.to_pylist()], np.int32), np.zeros(len(values), _F)
    x = values.to_numpy(zero_copy_only=False).astype(np.float64)
    known = np.isfinite(x)
    mode, place = np.full(len(x), len(c.mean), np.int32), np.zeros(len(x), _F)
    if known.any() and len(c.mean):
        run = np.cumsum(responsibilities(x[known], c.mean, c.scale, c.weight), axis=1)
        mode[known] = np.minimum((run < _uniform(ids[known], salt)[:, None]).sum(axis=1), len(c.mean) - 1)
        place[known] = np.clip((x[known] - c.mean[mode[known]]) / (4 * c.scale[mode[known]]), -0.99, 0.99)
    return mode, place


@dataclass
class Layout:
    """Where columns stand in a row of the networks, and the conditions with their chances."""

    columns: list[Column]
    counts: list[np.ndarray]  # of the categories of each categorical column, in order

    def __post_init__(self) -> None:
        at = 0
        self.blocks: list[tuple[int, int]] = []  # one-hot parts, one for each column
        self.places: list[int] = []
        for c in self.columns:
            if c.categories is None:
                self.places.append(at)
                at += 1
            size = c.width - (c.categories is None)
            self.blocks.append((at, at + size))
            at += size
        self.width = at
        self.discrete = [i for i, c in enumerate(self.columns) if c.categories is not None]
        sizes = [len(n) for n in self.counts]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        self.conditions = int(self.starts[-1])
        self.log_chance = [np.log1p(n) / np.log1p(n).sum() for n in self.counts]
        self.chance = [n / n.sum() for n in self.counts]

    def rows(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.width), _F)
        k = 0
        for i, (lo, _) in enumerate(self.blocks):
            out[np.arange(len(codes)), lo + codes[:, i]] = 1
            if self.columns[i].categories is None:
                out[:, self.places[k]] = places[:, k]
                k += 1
        return out

    def draw(self, rng: np.random.Generator, n: int, chances: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Column (by its place among the categorical ones) and category of n conditions."""
        which = rng.integers(len(self.discrete), size=n)
        u = rng.random(n)
        category = np.zeros(n, np.int64)
        for d, p in enumerate(chances):
            mine = which == d
            category[mine] = np.minimum(np.searchsorted(np.cumsum(p), u[mine], side="right"), len(p) - 1)
        return which, category


class Network:
    """Generator and critic as plain matrices, with gradients."""

    LEAK, TAU, PENALTY = 0.2, 0.2, 10.0

    def __init__(self, layout: Layout, hidden: int, noise: int, seed: int):
        self.layout, self.hidden, self.noise = layout, hidden, noise
        rng = np.random.default_rng([seed, 1])
        dense = lambda a, b: (rng.uniform(-1, 1, (a, b)) / np.sqrt(max(1, a))).astype(_F)
        inner, k = layout.width + layout.conditions, noise + layout.conditions
        self.critic = [dense(inner, hidden), np.zeros(hidden, _F), dense(hidden, hidden), np.zeros(hidden, _F), dense(hidden, 1), np.zeros(1, _F)]
        self.generator = [dense(k, hidden), np.zeros(hidden, _F), dense(k + hidden, hidden), np.zeros(hidden, _F), dense(k + 2 * hidden, layout.width), np.zeros(layout.width, _F)]

    def raw(self, z: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, tuple]:
        w1, b1, w2, b2, w3, b3 = self.generator
        h0 = np.concatenate([z, c], axis=1)
        r1 = np.maximum(h0 @ w1 + b1, 0)
        h1 = np.concatenate([r1, h0], axis=1)
        r2 = np.maximum(h1 @ w2 + b2, 0)
        h2 = np.concatenate([r2, h1], axis=1)
        return h2 @ w3 + b3, (h0, r1, h1, r2, h2)

    def active(self, o: np.ndarray, gumbel: np.ndarray) -> np.ndarray:
        y = np.empty_like(o)
        for p in self.layout.places:
            y[:, p] = np.tanh(o[:, p])
        for lo, hi in self.layout.blocks:
            y[:, lo:hi] = _softmax((o[:, lo:hi] + gumbel[:, lo:hi]) / self.TAU)
        return y

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        w1, b1, w2, b2, w3, b3 = self.critic
        a1 = x @ w1 + b1
        m1 = np.where(a1 > 0, _F(1), _F(self.LEAK))
        r1 = a1 * m1
        a2 = r1 @ w2 + b2
        m2 = np.where(a2 > 0, _F(1), _F(self.LEAK))
        r2 = a2 * m2
        return (r2 @ w3 + b3)[:, 0], (x, m1, r1, m2, r2)

    def slope(self, kept: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradient of the judgement by its input, and the parts it is made of."""
        _, m1, _, m2, _ = kept
        s2 = m2 * self.critic[4][:, 0]
        s1 = m1 * (s2 @ self.critic[2].T)
        return s1 @ self.critic[0].T, s1, s2

    def critic_gradient(self, real: np.ndarray, fake: np.ndarray, mix: np.ndarray, total: int) -> list[np.ndarray]:
        """Of mean(fake) - mean(real) + PENALTY * (|slope| - 1)^2, as this unit's share of a batch of total rows."""
        out = [np.zeros_like(p) for p in self.critic]
        for x, sign in ((fake, 1.0), (real, -1.0)):
            _, (x, m1, r1, m2, r2) = self.judge(x)
            d = np.full((len(x), 1), sign / total, _F)
            d2 = (d @ self.critic[4].T) * m2
            d1 = (d2 @ self.critic[2].T) * m1
            for i, g in enumerate((x.T @ d1, d1.sum(axis=0), r1.T @ d2, d2.sum(axis=0), r2.T @ d, d.sum(axis=0))):
                out[i] += g
        between = mix * real + (1 - mix) * fake
        _, kept = self.judge(between)
        g, s1, s2 = self.slope(kept)
        norm = np.sqrt((g * g).sum(axis=1, keepdims=True)) + _F(1e-8)
        dg = (2 * self.PENALTY / total * (norm - 1) / norm * g).astype(_F)
        # The masks are constant almost everywhere, so the slope is a product of matrices.
        out[0] += dg.T @ s1
        d1 = (dg @ self.critic[0]) * kept[1]
        out[2] += d1.T @ s2
        out[4] += ((d1 @ self.critic[2]) * kept[3]).sum(axis=0)[:, None]
        return out

    def generator_gradient(self, z: np.ndarray, c: np.ndarray, gumbel: np.ndarray, which: np.ndarray, category: np.ndarray, total: int) -> list[np.ndarray]:
        """Of -mean(judgement) + cross entropy of the asked category, as this unit's share."""
        o, (h0, r1, h1, r2, h2) = self.raw(z, c)
        y = self.active(o, gumbel)
        _, kept = self.judge(np.concatenate([y, c], axis=1))
        dy = -self.slope(kept)[0][:, : self.layout.width] / total
        do = np.empty_like(o)
        for p in self.layout.places:
            do[:, p] = dy[:, p] * (1 - y[:, p] ** 2)
        for lo, hi in self.layout.blocks:
            v = y[:, lo:hi]
            do[:, lo:hi] = v * (dy[:, lo:hi] - (dy[:, lo:hi] * v).sum(axis=1, keepdims=True)) / self.TAU
        for d, i in enumerate(self.layout.discrete):
            lo, hi = self.layout.blocks[i]
            mine = np.flatnonzero(which == d)
            p = _softmax(o[mine, lo:hi])
            p[np.arange(len(mine)), category[mine]] -= 1
            do[mine, lo:hi] += p / total
        w2, w3 = self.generator[2], self.generator[4]
        d2 = do @ w3.T
        da2 = d2[:, : self.hidden] * (r2 > 0)
        d1 = d2[:, self.hidden :] + da2 @ w2.T
        da1 = d1[:, : self.hidden] * (r1 > 0)
        return [h0.T @ da1, da1.sum(axis=0), h1.T @ da2, da2.sum(axis=0), h2.T @ do, do.sum(axis=0)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Adam:
    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.parameters, self.rate, self.t = parameters, rate, 0
        self.m, self.v = ([np.zeros_like(p) for p in parameters] for _ in range(2))

    def step(self, gradient: list[np.ndarray]) -> None:
        self.t += 1
        for p, m, v, g in zip(self.parameters, self.m, self.v, gradient, strict=True):
            m += (1 - _F(0.5)) * (g - m)
            v += (1 - _F(0.9)) * (g * g - v)
            p -= (self.rate * (m / (1 - 0.5**self.t)) / (np.sqrt(v / (1 - 0.9**self.t)) + 1e-8)).astype(_F)


class Unit:
    """Encoded rows of one unit in the order of their ids, and where each category stands."""

    def __init__(self, layout: Layout, ids: np.ndarray, codes: np.ndarray, places: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.layout, self.codes, self.places = layout, codes[order], places[order]
        self.where = []
        for i in layout.discrete:
            by = np.argsort(self.codes[:, i], kind="stable")
            self.where.append((by, np.searchsorted(self.codes[by, i], np.arange(len(layout.columns[i].categories) + 1))))

    def real(self, rng: np.random.Generator, which: np.ndarray, category: np.ndarray) -> np.ndarray:
        """For each condition a row that meets it, or any row if none does; which is -1 without conditions."""
        u = rng.random(len(which))
        at = (u * len(self.codes)).astype(np.int64)
        for d, (by, edge) in enumerate(self.where):
            mine = which == d
            lo, hi = edge[category[mine]], edge[category[mine] + 1]
            found = by[np.minimum(lo + (u[mine] * (hi - lo)).astype(np.int64), len(by) - 1)]
            at[mine] = np.where(hi > lo, found, at[mine])
        return self.layout.rows(self.codes[at], self.places[at])


def _pack(parts: dict[int, list[np.ndarray]]) -> str:
    return base64.b64encode(pickle.dumps({u: np.concatenate([g.ravel() for g in gs]).astype(_F) for u, gs in parts.items()})).decode()


def _averaged(messages: Iterable[str], like: list[np.ndarray]) -> list[np.ndarray]:
    """Mean of the units' parameters, added up in the order of units; like, if there is no unit."""
    every = {u: g for m in messages for u, g in pickle.loads(base64.b64decode(m)).items()}
    if not every:
        return like
    flat = np.zeros(sum(p.size for p in like), np.float64)
    for u in sorted(every):
        flat += every[u]
    flat = (flat / len(every)).astype(_F)
    out, at = [], 0
    for p in like:
        out.append(flat[at : at + p.size].reshape(p.shape))
        at += p.size
    return out


def _noise(net: Network, rng: np.random.Generator, n: int, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z, gumbel = rng.standard_normal((n, net.noise)).astype(_F), rng.gumbel(size=(n, net.layout.width)).astype(_F)
    return net.raw(z, c)[0], gumbel


def _train(batches: Iterable[pa.RecordBatch], layout: Layout, rounds: int, steps: int, batch: int, hidden: int, noise: int, rate: float, seed: int) -> Iterator[pa.RecordBatch]:
    """Trains on the rows (unit, row id, columns) of this task, together with the stage's other tasks; the first yields the generator."""
    context = BarrierTaskContext.get()
    got: dict[str, list[np.ndarray]] = {"unit": [], "id": [], "code": [], "place": []}
    for b in batches:
        ids = b.column(1).to_numpy(zero_copy_only=False)
        pairs = [encode_column(c, b.column(2 + i), ids, i + 1) for i, c in enumerate(layout.columns)]
        got["unit"].append(b.column(0).to_numpy(zero_copy_only=False))
        got["id"].append(ids)
        got["code"].append(np.stack([p[0] for p in pairs], axis=1))
        got["place"].append(np.stack([p[1] for p, c in zip(pairs, layout.columns, strict=True) if c.categories is None] or [np.zeros(len(ids), _F)], axis=1))
    mine: dict[int, Unit] = {}
    if got["unit"]:
        unit, ids, codes, places = (np.concatenate(got[k]) for k in ("unit", "id", "code", "place"))
        mine = {int(u): Unit(layout, ids[unit == u], codes[unit == u], places[unit == u]) for u in np.unique(unit)}
    nets = {u: Network(layout, hidden, noise, seed) for u in mine}
    made = {u: (Adam(n.critic, rate), Adam(n.generator, rate)) for u, n in nets.items()}
    start = Network(layout, hidden, noise, seed)
    shared = [*start.critic, *start.generator]
    for r in range(rounds):
        for u, net in nets.items():
            rng = np.random.default_rng([seed, 2, r, u])
            for _ in range(steps):
                c, which, category = conditions(layout, rng, batch, layout.log_chance)
                fake = net.active(*_noise(net, rng, batch, c))
                real = mine[u].real(rng, which, category)
                made[u][0].step(net.critic_gradient(np.concatenate([real, c], axis=1), np.concatenate([fake, c], axis=1), rng.random((batch, 1)).astype(_F), batch))
                z, gumbel = rng.standard_normal((batch, noise)).astype(_F), rng.gumbel(size=(batch, layout.width)).astype(_F)
                made[u][1].step(net.generator_gradient(z, c, gumbel, which, category, batch))
        shared = _averaged(context.allGather(_pack({u: [*n.critic, *n.generator] for u, n in nets.items()})), shared)
        for net in nets.values():
            for p, q in zip([*net.critic, *net.generator], shared, strict=True):
                p[...] = q
    if context.partitionId() == 0:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(shared[len(start.critic) :])], pa.binary())], names=["model"])


def conditions(layout: Layout, rng: np.random.Generator, n: int, chances: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n condition vectors, their columns and categories."""
    c = np.zeros((n, layout.conditions), _F)
    if not layout.discrete:
        return c, np.full(n, -1), np.zeros(n, np.int64)
    which, category = layout.draw(rng, n, chances)
    c[np.arange(n), layout.starts[which] + category] = 1
    return c, which, category


def _draw(batches: Iterable[pa.RecordBatch], net: Network, seed: int, kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    layout = net.layout
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        rows = np.empty((len(ids), layout.width), _F)
        for block in np.unique(ids // BLOCK):
            rng = np.random.default_rng([seed, 3, int(block)])
            c, _, _ = conditions(layout, rng, BLOCK, layout.chance)
            z, gumbel = rng.standard_normal((BLOCK, net.noise)).astype(_F), rng.gumbel(size=(BLOCK, layout.width)).astype(_F)
            here = ids // BLOCK == block
            at = ids[here] % BLOCK
            rows[here] = net.active(net.raw(z[at], c[at])[0], gumbel[at])
        out, k = [b.column(0)], 0
        for col, (lo, hi), kind in zip(layout.columns, layout.blocks, kinds, strict=True):
            best = rows[:, lo:hi].argmax(axis=1)
            if col.categories is not None:
                out.append(pa.array([col.categories[i] for i in best], pa.string()))
                continue
            known = best < len(col.mean)
            place = rows[:, layout.places[k]].astype(np.float64)
            k += 1
            x = np.zeros(len(best))
            x[known] = np.clip(col.mean[best[known]] + 4 * col.scale[best[known]] * place[known], col.low, col.high)
            out.append(pa.array(np.round(x) if pa.types.is_integer(kind) else x, mask=~known))
        yield pa.RecordBatch.from_arrays(out, names=["row_id", *[f"c{i}" for i in range(len(layout.columns))]])


class ConditionalGAN:
    """Mode-specific normalisation, conditions drawn by log frequency, critic with gradient penalty; samples depend on seed and row number alone.

    Text, dates, booleans and numbers of at most CATEGORY_THRESHOLD values are categories (up to
    encode.MAX_LEVELS of them, more are refused), null among them; other numbers have modes and
    one for null. Each of `tasks` barrier tasks holds its rows in coded form (six bytes a value); per
    round, the parameters of `units` replicas pass through the barrier, whatever the table's size. There is
    no batch normalisation and no packing of rows. An empty table cannot be fitted.
    """

    def __init__(self, rounds: int = 40, steps: int = 50, batch_size: int = 128, hidden: int = 64, noise: int = 32, rate: float = 1e-3, random_state: int = 42, units: int = 8, tasks: int | None = None):
        self.rounds, self.steps, self.batch, self.hidden, self.noise, self.rate, self.seed, self.units, self.tasks = rounds, steps, batch_size, hidden, noise, rate, random_state, units, tasks

    def fit(self, df: DataFrame) -> ConditionalGAN:
        self.schema = df.schema
        kinds = value_column_types(df, CATEGORY_THRESHOLD)
        self.columns = list(kinds)
        text = [c for c in self.columns if kinds[c]]
        wide = [c for c in self.columns if not kinds[c]]
        plain = df.select("row_id", *[quoted(c).cast("string" if kinds[c] else "double").alias(f"c{i}") for i, c in enumerate(self.columns)])
        index = {c: f"c{i}" for i, c in enumerate(self.columns)}
        known = levels(plain, [index[c] for c in text])
        columns = []
        counted = histograms(plain, [index[c] for c in wide], CELLS)
        for c in self.columns:
            if kinds[c]:
                columns.append(Column(c, [None, *known[index[c]]]))
            else:
                columns.append(self._modes(c, counted[index[c]]))
        counts = []
        for c in columns:
            if c.categories is not None:
                n = {r["v"]: r["n"] for r in plain.groupBy(F.col(index[c.name]).alias("v")).agg(F.count("*").alias("n")).collect()}
                c.categories = [v for v in c.categories if v in n]
                counts.append(np.array([n[v] for v in c.categories], np.float64))
        self.layout = Layout(columns, counts)
        tasks = self.tasks or max(1, min(self.units, df.sparkSession.sparkContext.defaultParallelism // 2))
        dealt = plain.select(F.pmod(F.xxhash64("row_id"), F.lit(self.units)).cast("int").alias("unit"), F.col("row_id").cast("long"), *index.values())
        work = partial(_train, layout=self.layout, rounds=self.rounds, steps=self.steps, batch=self.batch, hidden=self.hidden, noise=self.noise, rate=self.rate, seed=self.seed)
        # One number of partitions, whatever adaptive planning would make of it: a barrier stage is all of its tasks.
        model = dealt.repartition(tasks, "unit").mapInArrow(work, "model binary", barrier=True).collect()[0]["model"]
        self.net = Network(self.layout, self.hidden, self.noise, self.seed)
        self.net.generator = pickle.loads(model)
        return self

    @staticmethod
    def _modes(name: str, histogram: tuple[float, float, dict[int, int]]) -> Column:
        lo, hi, counts = histogram
        if not counts:
            return Column(name, None)
        at = np.array(sorted(counts))
        mean, scale, weight = mixture(lo + (at + 0.5) * (hi - lo) / CELLS, np.array([counts[k] for k in at], np.float64))
        return Column(name, None, mean, scale, weight, lo, hi)

    def sample(self, n: int) -> DataFrame:
        spark = _session()
        kinds = [pa.int64() if isinstance(self.schema[c].dataType, T.IntegralType) else pa.float64() for c in self.columns]
        types = ["string" if c.categories is not None else "double" for c in self.layout.columns]
        drawn = spark.range(n).mapInArrow(partial(_draw, net=self.net, seed=self.seed, kinds=kinds), ", ".join(["row_id long", *[f"c{i} {t}" for i, t in enumerate(types)]]))
        return drawn.select("row_id", *[F.col(f"c{i}").cast(self.schema[c].dataType).alias(c) for i, c in enumerate(self.columns)])

    def fit_sample(self, df: DataFrame, n: int) -> DataFrame:
        return self.fit(df).sample(n)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def generate_ctgan(df: DataFrame, n: int, random_state: int = 42, **settings) -> DataFrame:
    return ConditionalGAN(random_state=random_state, **settings).fit_sample(df, n)
