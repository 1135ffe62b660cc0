"""Exact, reproducible samples, splits and folds, by hash order of a unique row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabassay.functions.rng import order_key
from tabassay.operators.ranking import range_bucket, ranked, value_at


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Adds an id where there is none; write the result before using it twice, as the ids follow the input's partitions."""
    return df if name in df.columns else df.withColumn(name, F.monotonically_increasing_id())


#: Rows of one hash prefix that are ranked in a single task at most, unless keys repeat.
EDGE_ROWS = 100_000
_DIGITS = 3


def _cut(df: DataFrame, n: int, key: Column) -> tuple[str, int]:
    """The hash prefix in which the n-th row falls (beyond every key if there are no more than n rows), and the rows before it."""
    prefix, before = "", 0
    while len(prefix) < 30:
        own = df.filter(key.startswith(prefix)) if prefix else df
        counts = {r["p"]: r["n"] for r in own.groupBy(F.substring(key, 1, len(prefix) + _DIGITS).alias("p")).agg(F.count("*").alias("n")).collect()}
        for p in sorted(counts):
            if before + counts[p] > n:
                prefix = p
                break
            before += counts[p]
        else:
            return "g", before
        if counts[prefix] <= EDGE_ROWS:
            break
    return prefix, before


def first_by_hash(df: DataFrame, n: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """df with a boolean column _first: whether a row is among the n first in hash order.

    Histograms of hash prefixes, each of 4096 counts, narrow down where the cut falls until few
    rows share the prefix; only those are ranked, so no task ever sorts the table.
    """
    key = order_key(F.col(row_id), "shuffle", seed)
    at, before = _cut(df, n, key)
    prefix = F.substring(key, 1, len(at))
    edge = df.filter(prefix == at).select(row_id, key.alias("_k")).withColumn("_n", F.row_number().over(Window.orderBy("_k", row_id)))
    edge = edge.filter(F.col("_n") <= n - before).select(F.col(row_id).alias("_edge"))
    return df.join(edge, df[row_id] == edge["_edge"], "left").withColumn("_first", (prefix < at) | F.col("_edge").isNotNull()).drop("_edge")


def sample_exact(df: DataFrame, n: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Exactly n rows without replacement, or all rows if there are no more."""
    return first_by_hash(df, n, seed, row_id).filter("_first").drop("_first")


def train_test_split(df: DataFrame, fraction: float = 0.7, seed: int = 42, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Disjoint (train, test) with exactly floor(rows * fraction) rows in train."""
    marked = first_by_hash(df, int(df.count() * fraction), seed, row_id)
    return marked.filter("_first").drop("_first"), marked.filter("NOT _first").drop("_first")


def stratified_folds(df: DataFrame, label: str, k: int, seed: int = 42, row_id: str = "row_id", shuffle: bool = True) -> DataFrame:
    """Adds fold (0..k-1): rows of each label dealt in hash order, or in blocks of numeric row order if not shuffled."""
    if shuffle:
        key = order_key(F.col(row_id), "fold", seed)
        dealt = ranked(df, [label], F.substring(key, 1, _DIGITS), [key, F.col(row_id)])
        return dealt.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")
    dealt = ranked(df, [label], range_bucket(df, row_id), [F.col(row_id)])
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    dealt = dealt.join(F.broadcast(sizes), dealt[label].eqNullSafe(F.col("_l"))).drop("_l")  # a label has few values
    small, longer = F.floor(F.col("_n") / k), F.col("_n") % k
    at = F.col("_rank") - 1
    beyond = F.floor((at - longer * (small + 1)) / F.nullif(small, F.lit(0))) + longer
    fold = F.when(at < longer * (small + 1), F.floor(at / (small + 1))).otherwise(beyond)
    return dealt.withColumn("fold", fold.cast("int")).drop("_rank", "_n")


def halves(df: DataFrame, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Rows before and from floor(n / 2) in row order, cut at an exact rank of the numeric id.

    Null ids stand last, all in the second half. Rows of the id at the cut stay together, in the second half.
    """
    n, known = df.agg(F.count("*"), F.count(row_id)).first()
    if n < 2 or not known:
        return df.limit(0), df
    if n // 2 >= known:
        return df.filter(F.col(row_id).isNotNull()), df.filter(F.col(row_id).isNull())
    first = F.coalesce(F.col(row_id) < value_at(df, row_id, n // 2, known), F.lit(False))
    return df.filter(first), df.filter(~first)
