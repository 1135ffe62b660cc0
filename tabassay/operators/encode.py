"""Feature encoding as flat column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.operators.ranking import quantiles

#: Distinct values of a text column beyond which one-hot columns are refused.
MAX_LEVELS = 1000


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def levels(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted distinct values of each column, in one aggregation; columns of too many are refused before their values are gathered."""
    if not columns:
        return {}
    about = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    if long := [c for c in columns if about[c] > 1.3 * MAX_LEVELS]:
        raise ValueError(f"too many levels to encode: {long}")
    row = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns]).first()
    if long := [c for c in columns if len(row[c]) > MAX_LEVELS]:
        raise ValueError(f"too many levels to encode: {long}")
    return {c: list(row[c]) for c in columns}


def one_hot(column: str, values: list[str], drop_first: bool = True) -> dict[str, Column]:
    """Columns <column>_<value> of 0.0 and 1.0; null and unknown values are 0.0 in all of them."""
    return {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values[1 if drop_first else 0 :]}


def encoded(df: DataFrame, columns: list[str], known: dict[str, list[str]] | None = None, drop_first: bool = True) -> dict[str, Column]:
    """Encoded features of columns in order: text one-hot, everything else as double."""
    known = known if known is not None else levels(df, [c for c in columns if is_text(df, c)])
    out: dict[str, Column] = {}
    for c in columns:
        out |= one_hot(c, known.get(c, []), drop_first) if is_text(df, c) else {c: F.col(c).cast("double")}
    return out


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median of each column; 0 for a column of nulls."""
    return {c: 0.0 if v is None else float(v) for c, v in quantiles(df, columns, 0.5).items()} if columns else {}


def fill(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(quoted(c), F.lit(float(v))) for c, v in values.items()})


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; a deviation of 0 counts as 1."""
    aggs = [f(quoted(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = df.agg(*aggs).first() if columns else {}
    return {c: (float(row[f"m{i}"] or 0.0), float(row[f"s{i}"] or 0.0) or 1.0) for i, c in enumerate(columns)}


def scaled(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (quoted(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})
