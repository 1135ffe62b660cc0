"""Exact ranks of large tables: in buckets that follow the order, shifted by what stands before a bucket."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256
#: Rows among which a rank is looked up in a single task at most.
EDGE_ROWS = 200_000
#: Distinct values of a column up to which they are counted, and the bytes of numbers that a task counts at once.
FEW, COUNTED_BYTES = 256, 1 << 22


@dataclass
class _Sought:
    """A rank that is looked for: between the ends, both left out (None: no end), lie n values, and rank counts from there."""

    column: str
    rank: int
    n: int
    low: object = None
    high: object = None
    found: object = None

    def inside(self) -> Column:
        """The column's value where it lies between the ends, else null."""
        v = F.col(f"`{self.column}`")
        known = v.isNotNull()
        for end, keep in ((self.low, v > F.lit(self.low)), (self.high, v < F.lit(self.high))):
            known = known & keep if end is not None else known
        return F.when(known, v)

    def narrowed(self, a: object, b: object, below: int, at_a: int, between: int, at_b: int) -> None:
        """Goes on with the part that holds the rank; ties with either end are counted out, so that every step gets on."""
        bounds = [below, below + at_a, below + at_a + between, below + at_a + between + at_b]
        part = sum(self.rank >= x for x in bounds)
        if part in (1, 3):
            self.found = a if part == 1 else b
            return
        start, stop = {0: (0, bounds[0]), 2: (bounds[1], bounds[2]), 4: (bounds[3], self.n)}[part]
        self.low, self.high = {0: (self.low, a), 2: (a, b), 4: (b, self.high)}[part]
        self.rank, self.n = self.rank - start, stop - start


def values_at(df: DataFrame, sought: list[tuple[str, int, int]]) -> list[object]:
    """The values of (column, 0-based rank, n): rank among the n rows of df whose numeric column is known and no NaN.

    All ranks are looked up together: one pass takes approximate quantiles around each, the next counts
    what lies below, between and at them, and the search goes on strictly between. When EDGE_ROWS values
    or fewer are left of every rank, one pass more sorts those.
    """
    ranks = [_Sought(*x) for x in sought]
    while wide := [r for r in ranks if r.found is None and r.n > EDGE_ROWS]:
        near = [[min(1.0, max(0.0, (r.rank + 0.5) / r.n + d)) for d in (-0.002, 0.002)] for r in wide]
        ends = df.agg(*[F.percentile_approx(r.inside(), F.array(*map(F.lit, q)), F.lit(2000)).alias(f"q{i}") for i, (r, q) in enumerate(zip(wide, near, strict=True))]).first()
        counts = []
        for i, r in enumerate(wide):
            v, (a, b) = r.inside(), ends[f"q{i}"]
            parts = [v < a, v == a, (v > a) & (v < b), (v == b) & F.lit(a != b)]
            counts += [F.count_if(F.coalesce(p, F.lit(False))).alias(f"n{i}_{k}") for k, p in enumerate(parts)]
        row = df.agg(*counts).first()
        for i, r in enumerate(wide):
            r.narrowed(*ends[f"q{i}"], *[row[f"n{i}_{k}"] for k in range(4)])
    if rest := [i for i, r in enumerate(ranks) if r.found is None]:
        kinds = {df.schema[ranks[i].column].dataType for i in rest}
        value = lambda i: ranks[i].inside() if len(kinds) == 1 else ranks[i].inside().cast("double")
        each = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), value(i).alias("v")) for i in rest])).alias("x")).select("x.i", "x.v").filter("v IS NOT NULL")
        wanted = F.element_at(F.create_map(*[F.lit(y) for i in rest for y in (i, ranks[i].rank + 1)]), F.col("i"))
        numbered = each.withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy("v")))
        for r in numbered.filter(F.col("n") == wanted).collect():  # one row for each rank
            ranks[r["i"]].found = r["v"]
    return [r.found for r in ranks]


def value_at(df: DataFrame, column: str, rank: int, n: int) -> object:
    """values_at() of one rank."""
    return values_at(df, [(column, rank, n)])[0]


def _counted(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of a task's rows (i, v, n): how often column i has the value v; one row without v if its values are more than most."""
    counts: dict[int, dict[float, int] | None] = {}
    kept, size = [], 0

    def work() -> None:
        for i, column in enumerate(pa.Table.from_batches(kept).columns):
            if counts.setdefault(i, {}) is not None:
                # NaN is one value: it has one object.
                for v, n in zip(*np.unique(column.drop_null().to_numpy(), return_counts=True), strict=True):
                    key = math.nan if v != v else float(v)
                    counts[i][key] = counts[i].get(key, 0) + int(n)
                if len(counts[i]) > most:
                    counts[i] = None
        kept.clear()

    for b in batches:
        kept.append(b)
        size += b.nbytes
        if size > COUNTED_BYTES:
            work()
            size = 0
    if kept:
        work()
    rows = [row for i, found in counts.items() for row in ([(i, None, 0)] if found is None else [(i, v, n) for v, n in found.items()])]
    i, v, n = zip(*rows, strict=True) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(v, pa.float64()), pa.array(n, pa.int64())], names=["i", "v", "n"])


def value_counts(df: DataFrame, columns: list[str], most: int = FEW) -> dict[str, dict[float, int]]:
    """How often each numeric column has each of its values, as doubles in rising order, for columns of at most `most` (null left out, NaN the last); others are not in the result.

    One pass, in which a task sends no more than `most` values of a column.
    """
    if not columns:
        return {}
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(columns)])
    parts = rows.mapInArrow(partial(_counted, most=most), "i int, v double, n long").groupBy("i", "v").agg(F.sum("n").alias("n"))
    # A value more than `most` tells as well as all of them that there are too many.
    each = parts.withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy("v"))).filter(F.col("k") <= most + 1)
    found: dict[int, dict[float | None, int]] = {i: {} for i in range(len(columns))}
    for r in each.orderBy("i", "v").collect():  # most + 1 rows a column at most
        found[r["i"]][r["v"]] = r["n"]
    return {c: found[i] for i, c in enumerate(columns) if None not in found[i] and len(found[i]) <= most}


def _ranked_value(counts: dict[float, int], rank: int) -> float:
    """The value at a 0-based rank."""
    values = list(counts)
    return values[int(np.searchsorted(np.cumsum(list(counts.values())), rank, side="right"))]


def quantiles(df: DataFrame, columns: list[str], share: float) -> dict[str, float | None]:
    """Exact quantile of each column, linear between ranks. Small tables take one aggregation; in large ones columns of few values are counted, others take bounded lookups together."""
    name = lambda c: F.col(f"`{c}`")
    sizes = df.agg(*[F.count(name(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    if max(sizes, default=0) <= EDGE_ROWS:
        row = df.agg(*[F.percentile(name(c), F.lit(share)).alias(f"q{i}") for i, c in enumerate(columns)]).first()
        return {c: row[f"q{i}"] for i, c in enumerate(columns)}
    known = {c: sizes[f"n{i}"] for i, c in enumerate(columns) if sizes[f"n{i}"]}
    places = {c: (n - 1) * share for c, n in known.items()}
    sought = [(c, r, known[c]) for c, at in places.items() for r in sorted({math.floor(at), math.ceil(at)})]
    few = {c: n for c, n in value_counts(df, list(known)).items() if not any(map(math.isnan, n))}
    found = {(c, r): _ranked_value(few[c], r) for c, r, _ in sought if c in few}
    wide = [x for x in sought if x[0] not in few]
    found |= {(c, r): float(v) for (c, r, _), v in zip(wide, values_at(df, wide), strict=True)}
    ends = {c: (found[c, math.floor(at)], found[c, math.ceil(at)]) for c, at in places.items()}
    return {c: ends[c][0] + (places[c] % 1) * (ends[c][1] - ends[c][0]) if c in ends else None for c in columns}


def range_bucket(df: DataFrame, column: str, buckets: int = BUCKETS) -> Column:
    """Number of approximate quantiles of df's numeric column below a value: a bucket that never falls as the value grows."""
    row = df.agg(F.percentile_approx(column, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(10 * buckets)).alias("q")).first()
    cuts = sorted(set(row["q"] or []))
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(column)))


def shifted(df: DataFrame, by: list[str], weight: Column, name: str) -> DataFrame:
    """Adds to rows with a bucket _b the sum of weight over their group's earlier buckets; a group has few buckets."""
    narrow = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_b").alias("_kb"), weight.alias("_v"))
    each = narrow.groupBy(*[f"_k{i}" for i in range(len(by))], "_kb").agg(F.sum("_v").alias("_w"))
    keys = [f"_k{i}" for i in range(len(by))]
    earlier = Window.partitionBy(*keys).orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.partitionBy(F.lit(1)).orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn(name, F.coalesce(F.sum("_w").over(earlier), F.lit(0))).drop("_w")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)], F.col("_b").eqNullSafe(F.col("_kb")))
    return df.join(each, same).drop(*keys, "_kb")


def ranked(df: DataFrame, by: list[str], bucket: Column, order: list[Column], name: str = "_rank") -> DataFrame:
    """Adds the 1-based rank of each row among its group in order, without a group in one task; bucket must follow the order."""
    rows = df.withColumn("_b", bucket)
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)))
    out = shifted(own, by, F.lit(1), "_before")
    return out.withColumn(name, F.col("_own") + F.col("_before")).drop("_b", "_own", "_before")


def cut_values(df: DataFrame, column: str, parts: int) -> list[float]:
    """The values at the ranks ceil(k n / parts), k from 1 to parts - 1, among the n known values of a numeric column, in rising order and each once.

    Exact, so partitions do not show. Equal values are counted together; their running count is taken in ranges and shifted.
    """
    counted = df.select(F.col(f"`{column}`").cast("double").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n")).cache()
    own = F.sum("n").over(Window.partitionBy("_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    run = shifted(counted.withColumn("_b", range_bucket(counted, "v")).withColumn("_own", own), [], F.col("n"), "_before")
    n = F.lit(counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    upto = F.col("_own") + F.col("_before")
    share = lambda c: F.least(F.floor(c * F.lit(parts) / n), F.lit(parts - 1))
    found = run.filter(share(upto) > share(upto - F.col("n"))).select("v").orderBy("v").collect()  # parts - 1 rows at most
    counted.unpersist()
    return [r["v"] for r in found]


def histograms(df: DataFrame, columns: list[str], cells: int) -> dict[str, tuple[float, float, dict[int, int]]]:
    """Ends and counts of equal cells of each numeric column, nulls and what is not finite left out: integers, so that partitions do not show."""
    if not columns:
        return {}
    name = lambda c: F.col(f"`{c}`").cast("double")
    clean = {c: F.when(~F.isnan(name(c)) & (F.abs(name(c)) < float("inf")), name(c)) for c in columns}
    row = df.agg(*[f(clean[c]).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    ends = {c: tuple(0.0 if row[f"{k}{i}"] is None else row[f"{k}{i}"] for k in ("lo", "hi")) for i, c in enumerate(columns)}
    cell = {c: F.least(F.lit(cells - 1), F.floor((clean[c] - F.lit(lo)) / F.lit((hi - lo) or 1.0) * cells)).cast("int") for c, (lo, hi) in ends.items()}
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), cell[c].alias("k")) for c in columns])).alias("x"))
    out = {c: (*ends[c], {}) for c in columns}
    for r in each.filter("x.k IS NOT NULL").groupBy("x.c", "x.k").agg(F.count("*").alias("n")).collect():  # `cells` rows a column at most
        out[r["c"]][2][r["k"]] = r["n"]
    return out
