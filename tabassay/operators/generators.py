"""Synthetic-table generators as DataFrame plans; the seed and row number alone decide every draw."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.functions.rng import order_key, uniform
from tabassay.operators.encode import is_text, quoted
from tabassay.operators.ranking import ranked, shifted
from tabassay.session import cut
from tabassay.sources.io import read_external, restore_types

#: Distinct values up to which a numeric column is drawn like a category.
CATEGORY_THRESHOLD = 20
#: Distinct values of a category up to which their intervals are sent to the rows that are drawn; more are joined by a shuffle.
SENT_VALUES = 5000


class Generator(Protocol):
    def fit(self, df: DataFrame) -> Generator: ...
    def sample(self, n: int) -> DataFrame: ...


def _numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def distinct_values(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    """Number of distinct values of each column, in one pass."""
    columns = [c for c in df.columns if c != "row_id"] if columns is None else columns
    if not columns:
        return {}
    row = df.agg(*[F.count_distinct(quoted(c)).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def value_column_types(df: DataFrame, threshold: int = CATEGORY_THRESHOLD, counts: dict[str, int] | None = None) -> dict[str, bool]:
    """Whether each column is categorical: not numeric, or at most threshold distinct values."""
    columns = [c for c in df.columns if c != "row_id"]
    numbers = [c for c in columns if _numeric(df, c)]
    few = {c: n <= threshold for c, n in counts.items()} if counts is not None else few_values(df, numbers, threshold)
    return {c: not _numeric(df, c) or few[c] for c in columns}


def few_values(df: DataFrame, columns: list[str], most: int) -> dict[str, bool]:
    """Whether each column has at most `most` distinct values, null left out. A sketch tells clear cases, near ones are counted exactly."""
    if not columns:
        return {}
    about = df.agg(*[F.approx_count_distinct(quoted(c), 0.02).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    near = [c for i, c in enumerate(columns) if about[f"n{i}"] <= 2 * most]
    exact = distinct_values(df, near)
    return {c: c in exact and exact[c] <= most for c in columns}


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value, p, lo, hi): share of each value, null included, and its interval in value order.

    The running sum over many text values is taken by their first letters and shifted.
    """
    counted = df.groupBy(quoted(column).alias("value")).agg(F.count("*").alias("n"))
    letters = F.coalesce(F.substring("value", 1, 2), F.lit("")) if is_text(df, column) else F.lit("")
    own = F.sum("n").over(Window.partitionBy("_b").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    run = shifted(counted.withColumn("_b", letters).withColumn("_own", own), [], F.col("n"), "_before").withColumn("_run", F.col("_own") + F.col("_before"))
    spread = run.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("_all"))))
    return spread.select("value", (F.col("n") / F.col("_all")).alias("p"), ((F.col("_run") - F.col("n")) / F.col("_all")).alias("lo"), (F.col("_run") / F.col("_all")).alias("hi"))


#: Rows of a hash bucket in which ranks are taken, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 64


def indexed(df: DataFrame, order: list[Column], keys: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Adds i = 1..n in each key's rows; ranks are taken in hash buckets, as many as the rows need, so no key fills one task."""
    buckets = buckets or max(LEAST_BUCKETS, df.count() // BUCKET_ROWS)
    return ranked(df, keys or [], F.pmod(F.xxhash64(*order), F.lit(buckets)), order, "i")


class IndependentMarginals:
    """Every column drawn on its own: categories by frequency (null is one), other numbers by bootstrap of the values there are."""

    def __init__(self, random_state: int = 42):
        self.seed = random_state

    def fit(self, df: DataFrame) -> IndependentMarginals:
        self.df, self.kinds = df, value_column_types(df)
        categories = [c for c, categorical in self.kinds.items() if categorical]
        row = df.agg(F.count("*"), *[F.approx_count_distinct(quoted(c)) for c in categories]).first()
        self.counts = dict(zip(categories, row[1:], strict=True))
        return self

    def sample(self, n: int) -> DataFrame:
        spark = self.df.sparkSession
        out = spark.range(n).withColumnRenamed("id", "row_id")
        for c, categorical in self.kinds.items():
            # Never null, and said to be so: a join would draw it again to drop nulls.
            u = F.coalesce(uniform(F.col("row_id"), c, self.seed), F.lit(0.0))
            if categorical:
                table = frequencies(self.df, c).select(F.col("value").alias(f"_{c}"), "lo", "hi")
                # Any draw lies in one interval; both sides meet in the cells of a grid finer than the values are many.
                grid = 1 << max(10, (4 * self.counts[c]).bit_length())
                cells = table.withColumn("_g", F.explode(F.sequence(F.floor(F.col("lo") * grid), F.ceil(F.col("hi") * grid) - 1)))
                drawn = out.withColumn("_u", u).withColumn("_g", F.floor(F.col("_u") * grid))
                out = drawn.join(F.broadcast(cells) if self.counts[c] <= SENT_VALUES else cells, "_g").filter("_u >= lo AND _u < hi").drop("_g", "_u", "lo", "hi").withColumnRenamed(f"_{c}", c)
            else:
                values = self.df.filter(quoted(c).isNotNull()).select(quoted(c).alias(c), "row_id")
                ranked = indexed(values, [F.col(c), F.col("row_id")]).select(c, "i")
                size = ranked.agg(F.coalesce(F.max("i"), F.lit(0)).alias("_m"))
                drawn = out.crossJoin(F.broadcast(size)).withColumn("i", (F.floor(u * F.col("_m")) + 1).cast("long"))
                out = drawn.join(ranked.withColumn("i", F.col("i").cast("long")), "i").drop("i", "_m")
        return out.select("row_id", *[quoted(c) for c in self.kinds])

    def fit_sample(self, df: DataFrame, n: int) -> DataFrame:
        return self.fit(df).sample(n)


def generate_independent_marginals(df: DataFrame, n: int, random_state: int = 42) -> DataFrame:
    return IndependentMarginals(random_state).fit_sample(df, n)


def mutual_information(df: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """One row (mi): mutual information in nats of the joint values of columns a and of columns b; nulls are values."""
    joint = df.groupBy(*[quoted(c).alias(f"_a{i}") for i, c in enumerate(a)], *[quoted(c).alias(f"_b{i}") for i, c in enumerate(b)]).agg(F.count("*").alias("n"))
    ka, kb = [f"_a{i}" for i in range(len(a))], [f"_b{i}" for i in range(len(b))]
    # The table of counts is as small as the domains are; the sums over it need no join.
    whole = F.broadcast(df.agg(F.count("*").alias("t")))
    both = joint.withColumns({"na": F.sum("n").over(Window.partitionBy(*ka)), "nb": F.sum("n").over(Window.partitionBy(*kb))}).crossJoin(whole)
    return both.agg(F.coalesce(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))), F.lit(0.0)).alias("mi"))


#: Sets of columns that are counted in one job.
SETS_A_JOB = 200


def entropies(df: DataFrame, sets: list[frozenset[str]]) -> dict[frozenset[str], float]:
    """Entropy in nats of the joint values of each set of columns; nulls are values. All sets are counted in one pass by grouping sets.

    A set comes back as its number; the driver sees one row for each, the counts stay where they are.
    """
    if long := [c for c in df.columns if c == "_set"]:
        raise ValueError(f"the name is taken: {long}")
    out: dict[frozenset[str], float] = {}
    for start in range(0, len(sets), SETS_A_JOB):
        some = sets[start : start + SETS_A_JOB]
        used = sorted(set().union(*some))
        # Bit i of grouping_id, from the left, is set where column i is not in the set.
        number = {sum(1 << (len(used) - 1 - i) for i, c in enumerate(used) if c not in s): s for s in some}
        counts = df.groupingSets([[quoted(c) for c in sorted(s)] for s in some], *[quoted(c) for c in used]).agg(F.grouping_id().alias("_set"), F.count("*").cast("double").alias("n"))
        sums = counts.groupBy("_set").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("l"))
        out |= {number[r["_set"]]: math.log(r["t"]) - r["l"] / r["t"] for r in sums.collect()}
    return out


#: Values of a column of a network at most.
MAX_VALUES = 5000


class DPBayesianNetwork:
    """PrivBayes: a noisy greedy network of at most `degree` parents, noisy conditional tables, ancestral sampling.

    Half of epsilon chooses parents by the exponential mechanism over mutual information, half
    adds Laplace noise to the joint counts. Numeric columns with many values become `bins` equal
    intervals; their ends are the data's own, which the budget does not cover.
    """

    def __init__(self, epsilon: float = 1.0, degree: int = 2, category_threshold: int = CATEGORY_THRESHOLD, bins: int = 20, random_state: int = 42):
        self.epsilon, self.degree, self.threshold, self.bins, self.seed = epsilon, degree, category_threshold, bins, random_state

    def _laplace(self, scale: float, *parts: Column | str | int) -> Column:
        u = uniform(*parts, self.seed) - F.lit(0.5)
        return F.lit(-scale) * F.signum(u) * F.ln(F.greatest(F.lit(1.0) - F.lit(2.0) * F.abs(u), F.lit(1e-12)))

    def fit(self, df: DataFrame) -> DPBayesianNetwork:
        self.schema, self.kinds = df.schema, value_column_types(df, self.threshold)
        self.columns = list(self.kinds)
        wide = [c for c, categorical in self.kinds.items() if not categorical]
        ends = df.agg(*[f(quoted(c)).cast("double").alias(f"{k}{i}") for i, c in enumerate(wide) for k, f in (("lo", F.min), ("hi", F.max))]).first() if wide else {}
        self.ranges = {c: (ends[f"lo{i}"] or 0.0, max(ends[f"hi{i}"] or 0.0, (ends[f"lo{i}"] or 0.0) + 1e-9)) for i, c in enumerate(wide)}
        self.coded = df.select(*[self._code(c).alias(c) for c in self.columns]).cache()
        # Conditional tables hold every combination of values, so columns of very many values are refused.
        known = self.coded.agg(F.count("*").alias("_n"), *[F.approx_count_distinct(quoted(c)).alias(c) for c in self.columns]).first()
        if long := [c for c in self.columns if known[c] > MAX_VALUES]:
            raise ValueError(f"too many values for a conditional table: {long}")
        n = known["_n"]
        self.parents = self._network(max(1, n))
        self.tables = [self._table(c, p) for c, p in self.parents]
        return self

    def _code(self, c: str) -> Column:
        if c not in self.ranges:
            return quoted(c).cast("string")
        lo, hi = self.ranges[c]
        return F.least(F.lit(self.bins - 1), F.floor((quoted(c).cast("double") - F.lit(lo)) / F.lit(hi - lo) * self.bins)).cast("int").cast("string")

    def _network(self, n: int) -> list[tuple[str, tuple[str, ...]]]:
        import numpy as np

        draw = np.random.Generator(np.random.PCG64(self.seed))
        order = [self.columns[int(draw.integers(len(self.columns)))]]
        out: list[tuple[str, tuple[str, ...]]] = [(order[0], ())]
        known: dict[frozenset[str], float] = {}
        steps = max(1, len(self.columns) - 1)
        sensitivity = (2 / n) * math.log((n + 1) / 2) + ((n - 1) / n) * math.log((n + 1) / max(1, n - 1)) if n > 1 else 1.0
        scale = 2 * sensitivity * steps / (self.epsilon / 2)
        while len(order) < len(self.columns):
            choices = [(c, p) for c in self.columns if c not in order for p in combinations(order, min(self.degree, len(order)))]
            # Only sets with the column that came last are new; what earlier steps counted is kept.
            wanted = {s for c, p in choices for s in (frozenset([c]), frozenset(p), frozenset([c, *p]))}
            known |= entropies(self.coded, sorted(wanted - known.keys(), key=sorted))
            score = np.array([max(0.0, known[frozenset([c])] + known[frozenset(p)] - known[frozenset([c, *p])]) for c, p in choices]) / scale
            p = np.exp(score - score.max())
            c, parents = choices[int(draw.choice(len(choices), p=p / p.sum()))]
            order.append(c)
            out.append((c, parents))
        return out

    def _table(self, c: str, parents: tuple[str, ...]) -> DataFrame:
        keys = [*parents]
        every = [*keys, c]
        domain = self.coded.select(quoted(c)).distinct()
        cells = domain.crossJoin(self.coded.select(*[quoted(k) for k in keys]).distinct()) if keys else domain
        counts = self.coded.groupBy(*[quoted(k).alias(f"_k{i}") for i, k in enumerate(every)]).agg(F.count("*").alias("n"))
        same = F.lit(True)
        for i, k in enumerate(every):
            same = same & quoted(k).eqNullSafe(F.col(f"_k{i}"))
        both = cells.join(counts, same, "left").select(*[quoted(k) for k in every], F.coalesce("n", F.lit(0)).alias("n"))
        scale = 2 * len(self.columns) / (self.epsilon / 2)
        noisy = both.withColumn("n", F.greatest(F.lit(0.0), F.col("n") + self._laplace(scale, F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("")) for k in [*keys, c]]), c)) + F.lit(1e-9))
        w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
        run = F.sum("n").over(w.orderBy(F.col(c).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
        total = F.sum("n").over(w)
        return noisy.select(*keys, c, ((run - F.col("n")) / total).alias("lo"), (run / total).alias("hi"))

    def sample(self, n: int) -> DataFrame:
        spark = self.coded.sparkSession
        out = spark.range(n).withColumnRenamed("id", "row_id")
        for (c, parents), table in zip(self.parents, self.tables, strict=True):
            t = table.select(*[quoted(p).alias(f"_p{i}") for i, p in enumerate(parents)], quoted(c).alias("_v"), "lo", "hi")
            drawn = out.withColumn("_u", uniform(F.col("row_id"), c, self.seed))
            match = (F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi"))
            for i, p in enumerate(parents):
                match = match & quoted(p).eqNullSafe(F.col(f"_p{i}"))
            out = drawn.join(t, match, "left").select(*[quoted(x) for x in out.columns], F.col("_v").alias(c))
        return out.select("row_id", *[self._decoded(c).alias(c) for c in self.columns])

    def _decoded(self, c: str) -> Column:
        kind = self.schema[c].dataType
        if c not in self.ranges:
            return quoted(c).cast(kind)
        lo, hi = self.ranges[c]
        value = F.lit(lo) + (quoted(c).cast("double") + uniform(F.col("row_id"), c, "within", self.seed)) * F.lit((hi - lo) / self.bins)
        return (F.round(value) if isinstance(kind, T.IntegralType) else value).cast(kind)

    def fit_sample(self, df: DataFrame, n: int) -> DataFrame:
        return self.fit(df).sample(n)


class SequentialCART:
    """Column by column: a tree on the columns so far, and a random donor from the leaf that a synthetic row falls in."""

    def __init__(self, minbucket: int = 5, max_depth: int = 10, random_state: int = 42):
        self.minbucket, self.depth, self.seed = minbucket, max_depth, random_state

    def fit(self, df: DataFrame) -> SequentialCART:
        self.df = df
        return self

    def sample(self, n: int) -> DataFrame:
        from pyspark.ml.feature import StringIndexer, VectorAssembler
        from pyspark.ml.classification import DecisionTreeClassifier
        from pyspark.ml.regression import DecisionTreeRegressor

        df, spark = self.df, self.df.sparkSession
        columns = [c for c in df.columns if c != "row_id"]
        first = columns[0]
        donors = indexed(df.select(quoted(first), "row_id"), [F.col("row_id")]).select(quoted(first), F.col("i").cast("long").alias("i"))
        size = donors.count()
        start = spark.range(n).withColumnRenamed("id", "row_id").withColumn("i", (F.floor(uniform(F.col("row_id"), first, self.seed) * size) + 1).cast("long"))
        out = start.join(donors, "i").drop("i")
        codes: dict[str, Callable[[DataFrame], DataFrame]] = {}
        ready, kinds = df, value_column_types(df)
        for k, c in enumerate(columns):
            if k:
                inputs = [f"_x{j}" for j in range(k)]
                assembler = VectorAssembler(inputCols=inputs, outputCol="features")
                fitted = ready
                if kinds[c]:
                    target = StringIndexer(inputCol="_y", outputCol="_l", handleInvalid="keep").fit(fitted.select(F.coalesce(quoted(c).cast("string"), F.lit("\u0000")).alias("_y")))
                    labelled = target.transform(fitted.withColumn("_y", F.coalesce(quoted(c).cast("string"), F.lit("\u0000"))))
                    tree = DecisionTreeClassifier(labelCol="_l", minInstancesPerNode=self.minbucket, maxDepth=self.depth, leafCol="leaf", seed=self.seed)
                else:
                    labelled = fitted.withColumn("_l", F.coalesce(quoted(c).cast("double"), F.lit(0.0)))
                    tree = DecisionTreeRegressor(labelCol="_l", minInstancesPerNode=self.minbucket, maxDepth=self.depth, leafCol="leaf", seed=self.seed)
                model = tree.fit(assembler.transform(labelled))
                leaves = model.transform(assembler.transform(fitted)).select(F.col("leaf").cast("long").alias("leaf"), quoted(c).alias("_v"), "row_id")
                ranked = indexed(leaves, [order_key(F.col("row_id"), c, self.seed), F.col("row_id")], ["leaf"]).select("leaf", "_v", F.col("i").cast("long").alias("i"))
                sizes = ranked.groupBy("leaf").agg(F.max("i").alias("_m"))
                at = model.transform(assembler.transform(out)).select(*out.columns, F.col("leaf").cast("long").alias("leaf")).join(F.broadcast(sizes), "leaf")
                picked = at.withColumn("i", (F.floor(uniform(F.col("row_id"), c, self.seed) * F.col("_m")) + 1).cast("long"))
                out = picked.join(ranked, ["leaf", "i"]).drop("leaf", "i", "_m").withColumnRenamed("_v", c)
            coder = self._coder(df, c)
            ready, out = (x.withColumn(f"_x{k}", coder(x)) for x in (ready, out))
            codes[c] = coder
            out = cut(out)
        return out.select("row_id", *[quoted(c) for c in columns])

    def _coder(self, df: DataFrame, c: str) -> Callable[[DataFrame], Column]:
        """Numbers as they are; text by the rank of its value, in a map of the distinct values."""
        if _numeric(df, c):
            return lambda _: F.coalesce(quoted(c).cast("double"), F.lit(-1.0))
        from tabassay.operators.encode import levels

        known = levels(df, [c])[c]
        table = F.create_map(*[x for i, v in enumerate(known) for x in (F.lit(v), F.lit(float(i)))]) if known else None
        return lambda _: F.coalesce(F.element_at(table, quoted(c)) if known else F.lit(None).cast("double"), F.lit(-1.0))

    def fit_sample(self, df: DataFrame, n: int) -> DataFrame:
        return self.fit(df).sample(n)


def generate_synthpop(df: DataFrame, n: int, minbucket: int = 5, random_state: int = 42) -> DataFrame:
    return SequentialCART(minbucket, random_state=random_state).fit_sample(df, n)


def generate_dp_bayesian_network(df: DataFrame, n: int, epsilon: float = 1.0, degree: int = 2, random_state: int = 42) -> DataFrame:
    return DPBayesianNetwork(epsilon, degree, random_state=random_state).fit_sample(df, n)


class External:
    """Tables that a tool outside Spark has made (neural or language-model generators), read from a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def fit(self, df: DataFrame) -> External:
        self.like = df
        return self

    def sample(self, n: int) -> DataFrame:
        found = read_external(self.spark, self.path, None)
        if found is None:
            raise FileNotFoundError(f"no synthetic table at {self.path}; make it elsewhere and put it there")
        if "row_id" not in found.columns:
            found = found.withColumn("row_id", F.monotonically_increasing_id())
        return restore_types(found, self.like).orderBy(order_key(F.col("row_id"), "external")).limit(n)


def _conditional_gan(seed: int) -> Generator:
    from tabassay.operators.gan import ConditionalGAN

    return ConditionalGAN(random_state=seed)


def _row_language_model(seed: int) -> Generator:
    from tabassay.operators.rowlm import RowLanguageModel

    return RowLanguageModel(random_state=seed)


REGISTRY: dict[str, Callable[[int], Generator]] = {
    "independent_marginals": lambda seed: IndependentMarginals(seed),
    "dpbn": lambda seed: DPBayesianNetwork(epsilon=1.0, random_state=seed),
    "synthpop": lambda seed: SequentialCART(random_state=seed),
    "ctgan": _conditional_gan,
    "great": _row_language_model,
}
