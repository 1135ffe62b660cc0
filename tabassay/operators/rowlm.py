"""Row language model: a row is a sentence of one token a column, continued from backed-off contexts.

Columns are read in order. A token's contexts are the tokens of the earlier columns that tell most about
it, from `order` of them down to none; how often each was seen, and with how many different values, decides how
far a row backs off (Witten-Bell). The value is that of a random source row with the same
context, so only values of the source come out, in their types. Its rank is looked up: counts of the contexts' hash
buckets tell the bucket, and only rows of such buckets are ranked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabassay.functions.rng import order_key, uniform
from tabassay.operators.encode import quoted
from tabassay.operators.generators import BUCKET_ROWS, CATEGORY_THRESHOLD, LEAST_BUCKETS
from tabassay.session import cut as cut_lineage
from tabassay.operators.generators import value_column_types
from tabassay.operators.ranking import histograms

#: Different values up to which a text column's values are tokens of contexts; columns of more give none.
TOKENS = 200
#: Equal cells of a number's histogram, from which its cells of equal counts are made.
CELLS = 4096
#: Drawn rows up to which they are broadcast to the source rows.
NEAR_ROWS = 100_000


class RowLanguageModel:
    """Fit counts on any table with row_id; sample depends on the seed and the row number alone.

    Numbers of many values enter contexts by quantile cell (`cells` of them), others by value; null is a
    token. A context of n rows and k different values is used with chance n / (n + k), else the
    next shorter one; no context, all rows, always is. Equal rows count as often as they occur.
    """

    def __init__(self, order: int = 3, cells: int = 16, random_state: int = 42):
        self.order, self.cells, self.seed = order, cells, random_state

    def fit(self, df: DataFrame) -> RowLanguageModel:
        self.kinds = value_column_types(df, CATEGORY_THRESHOLD)
        self.columns = list(self.kinds)
        tokens = self._tokens(df)
        rows = df.select("row_id", *[quoted(c).alias(f"v{i}") for i, c in enumerate(self.columns)], *[t.alias(f"t{i}") for i, t in enumerate(tokens)])
        self.rows = cut_lineage(rows)
        self.total = self.rows.count()
        self.contexts = self._contexts()
        return self

    def _tokens(self, df: DataFrame) -> list[Column]:
        wide = [c for c, categorical in self.kinds.items() if not categorical]
        counted = histograms(df, wide, CELLS)
        row = df.agg(*[F.approx_count_distinct(quoted(c)).alias(f"d{i}") for i, c in enumerate(self.columns)]).first()
        out = []
        for i, c in enumerate(self.columns):
            if c in wide:
                cuts = self._cuts(*counted[c])
                cell = reduce(lambda a, b: a + b, [(quoted(c).cast("double") > F.lit(x)).cast("int") for x in cuts], F.lit(0))
                out.append(F.when(quoted(c).isNotNull(), cell).cast("string"))
            else:
                out.append(quoted(c).cast("string") if row[f"d{i}"] <= TOKENS else F.lit(None).cast("string"))
        return out

    def _cuts(self, low: float, high: float, counts: dict[int, int]) -> list[float]:
        """Bounds between cells of about equal counts."""
        total, seen, out = sum(counts.values()), 0, []
        for k in sorted(counts):
            seen += counts[k]
            if seen * self.cells >= (len(out) + 1) * total and seen < total:
                out.append(low + (k + 1) * (high - low) / CELLS)
        return out

    def _contexts(self) -> list[list[int]]:
        """For each column the earlier ones by falling mutual information with it, `order` at most; all pairs in one job."""
        d = len(self.columns)
        pairs = [F.struct(F.lit(b).alias("b"), F.lit(a).alias("a"), F.col(f"t{b}").alias("y"), F.col(f"t{a}").alias("x")) for b in range(d) for a in range(b)]
        if not pairs:
            return [[] for _ in range(d)]
        joint = self.rows.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.b", "p.a", "p.y", "p.x").agg(F.count("*").alias("n"))
        sums = {"ny": Window.partitionBy("b", "a", "y"), "nx": Window.partitionBy("b", "a", "x"), "t": Window.partitionBy("b", "a")}
        both = joint.withColumns({k: F.sum("n").over(w) for k, w in sums.items()})
        found = both.groupBy("b", "a").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi")).collect()
        out: list[list[int]] = [[] for _ in range(d)]
        for r in sorted(found, key=lambda r: (-round(r["mi"], 9), r["a"])):  # one number for each pair of columns
            if r["mi"] > 1e-9 and len(out[r["b"]]) < self.order:
                out[r["b"]].append(r["a"])
        return out

    @staticmethod
    def _key(level: int, context: list[int]) -> Column:
        return F.xxhash64(F.lit(level), *[x for a in context[:level] for x in (F.col(f"t{a}").isNull(), F.coalesce(F.col(f"t{a}"), F.lit("")))])

    def sample(self, n: int) -> DataFrame:
        out = self.rows.sparkSession.range(n).withColumnRenamed("id", "row_id")
        for i, c in enumerate(self.columns):
            context = self.contexts[i]
            levels = range(len(context) + 1)
            order = [order_key(F.col("row_id"), c, self.seed), F.col("row_id")]
            buckets = max(LEAST_BUCKETS, self.total * len(levels) // BUCKET_ROWS)
            kept = self.rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
            source = kept.select(F.explode(F.array(*[self._key(j, context) for j in levels])).alias("key"), "_b", "row_id", F.col(f"v{i}").alias("v"), F.col(f"t{i}").alias("t"))
            sizes = cut_lineage(source.groupBy("key").agg(F.count("*").alias("n"), (F.approx_count_distinct("v") + F.max(F.col("v").isNull().cast("int"))).alias("k")))
            at = out.withColumn("_at", F.lit(None).cast("struct<key:bigint,n:bigint>"))
            for j in reversed(levels):
                # The longest context that was seen and that the draw accepts; none at all is always accepted.
                named = sizes.select(F.col("key").alias("_key"), F.col("n").alias("_n"), F.col("k").alias("_k"))
                at = at.withColumn("_want", self._key(j, context)).join(named, F.col("_want") == F.col("_key"), "left")
                taken = F.col("_n").isNotNull() & (F.lit(j == 0) | (uniform(F.col("row_id"), c, "level", j, self.seed) * (F.col("_n") + F.col("_k")) < F.col("_n")))
                at = at.withColumn("_at", F.coalesce("_at", F.when(taken, F.struct(F.col("_want").alias("key"), F.col("_n").alias("n"))))).drop("_want", "_key", "_n", "_k")
            drawn = at.withColumn("_r", (F.floor(uniform(F.col("row_id"), c, "rank", self.seed) * F.col("_at.n")) + 1).cast("long")).withColumn("key", F.col("_at.key")).drop("_at")
            out = cut_lineage(_picked(source, drawn, order, n <= NEAR_ROWS).withColumnsRenamed({"v": f"v{i}", "t": f"t{i}"}))
        return out.select("row_id", *[F.col(f"v{i}").alias(c) for i, c in enumerate(self.columns)])

    def fit_sample(self, df: DataFrame, n: int) -> DataFrame:
        return self.fit(df).sample(n)


def _picked(source: DataFrame, drawn: DataFrame, order: list[Column], near: bool) -> DataFrame:
    """drawn (..., key, _r) with v and t of source's row of that key and rank, key and _r dropped; a key's rows stand by bucket _b, then in order.

    With near, drawn is small enough to be broadcast.
    """
    sent = F.broadcast if near else lambda df: df
    counts = source.join(sent(drawn.select("key").distinct()), "key", "left_semi").groupBy("key", "_b").agg(F.count("*").alias("_c"))
    earlier = Window.partitionBy("key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    run = counts.withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    # A key has some hundred buckets; the one that holds the rank is found by its count.
    found = drawn.join(run, "key").filter((F.col("_r") > F.col("_before")) & (F.col("_r") <= F.col("_before") + F.col("_c")))
    place = cut_lineage(found.withColumn("_i", F.col("_r") - F.col("_before")).drop("_r", "_before", "_c"))
    edge = source.join(sent(place.select("key", "_b").distinct()), ["key", "_b"], "left_semi")
    numbered = edge.withColumn("_i", F.row_number().over(Window.partitionBy("key", "_b").orderBy(*order)).cast("long")).drop("row_id")
    # Rows at a sought rank alone go on to the draws.
    return place.join(numbered, ["key", "_b", "_i"]).drop("key", "_b", "_i")


def generate_row_lm(df: DataFrame, n: int, random_state: int = 42, **settings) -> DataFrame:
    return RowLanguageModel(random_state=random_state, **settings).fit_sample(df, n)
