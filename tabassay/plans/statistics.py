"""Tests and correlations over replicated results, in long form."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabassay.constants import CORE_METRICS, EXPECTED_CORRELATIONS
from tabassay.functions import dist
from tabassay.plans.decision import long_form


def core(results: DataFrame) -> DataFrame:
    return long_form(results, [m for m in CORE_METRICS if m in results.columns])


def method_order(names: Iterable[str] | None) -> Column:
    """Sort key of methods: their place in names, or their name."""
    if names is None:
        return F.lit(0)
    out = F.lit(len(list(names)))
    for i, n in enumerate(names):
        out = F.when(F.col("method") == n, i).otherwise(out)
    return out


def descriptive(results: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(method, metric, n, mean, std, ci_lower, ci_upper, min, max); a single replicate has no interval."""
    out = core(results).groupBy("method", "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    half = dist.t_critical(F.lit((1 + confidence) / 2), (F.col("n") - 1).cast("double")) * F.col("std") / F.sqrt("n")
    out = out.withColumn("_h", half)
    return out.select("method", "metric", "n", "mean", "std", (F.col("mean") - F.col("_h")).alias("ci_lower"), (F.col("mean") + F.col("_h")).alias("ci_upper"), "min", "max")


def normality(results: DataFrame) -> DataFrame:
    """(method, metric, statistic, p_value, normal): Shapiro-Wilk for samples of 3 or more replicates."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = dist.shapiro_wilk(pdf["value"].to_numpy())
        return pd.DataFrame({"method": pdf["method"][:1], "metric": pdf["metric"][:1], "statistic": [w], "p_value": [p], "normal": [p > 0.05]})

    long = core(results)
    fit = long.groupBy("method", "metric").agg(F.count("*").alias("n")).filter("n >= 3").drop("n")
    return long.join(F.broadcast(fit), ["method", "metric"]).groupBy("method", "metric").applyInPandas(test, "method string, metric string, statistic double, p_value double, normal boolean")


def _between(long: DataFrame, value: str = "value") -> DataFrame:
    """(metric, k, n, ssb, ssw): groups, rows, and sums of squares between and within methods."""
    each = long.groupBy("metric", "method").agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    w = Window.partitionBy("metric")
    grand = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    return each.withColumn("g", grand).groupBy("metric").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw")
    )


def _f(ss: DataFrame) -> Column:
    return F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / F.nullif(F.col("n") - F.col("k"), F.lit(0)))


def levene(results: DataFrame) -> DataFrame:
    """(metric, statistic, p_value, equal_variance): spread around group medians compared by an F ratio."""
    long = core(results)
    middle = long.groupBy("metric", "method").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    ss = _between(long.join(middle, ["metric", "method"]).withColumn("value", F.abs(F.col("value") - F.col("m")))).filter("k >= 2")
    out = ss.withColumn("statistic", _f(ss)).withColumn("p_value", dist.p_f("statistic", (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")))
    return out.select("metric", "statistic", "p_value", (F.col("p_value") > 0.05).alias("equal_variance"))


def ranked(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Adds r, the mean rank among equal values, and t, how many there are."""
    w = Window.partitionBy(*by)
    same = F.count("*").over(Window.partitionBy(*by, value))
    return long.withColumn("t", same).withColumn("r", F.rank().over(w.orderBy(value)) + (F.col("t") - 1) / F.lit(2.0))


def kruskal(long: DataFrame) -> DataFrame:
    """(metric, h, k): Kruskal-Wallis statistic with tie correction."""
    r = ranked(long, ["metric"])
    ties = r.groupBy("metric").agg(F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("ties"), F.count("*").alias("n"))
    each = r.groupBy("metric", "method").agg(F.sum("r").alias("rs"), F.count("*").alias("c")).groupBy("metric").agg(F.sum(F.col("rs") * F.col("rs") / F.col("c")).alias("q"), F.count("*").alias("k"))
    n = F.col("n").cast("double")
    h = F.lit(12.0) / (n * (n + 1)) * F.col("q") - F.lit(3.0) * (n + 1)
    correction = F.lit(1.0) - F.try_divide(F.col("ties"), n * n * n - n)
    return each.join(ties, "metric").select("metric", F.try_divide(h, correction).alias("h"), "k")


def effect_label(x: Column, steps: tuple[float, float, float]) -> Column:
    return F.when(x < steps[0], "negligible").when(x < steps[1], "small").when(x < steps[2], "medium").otherwise("large")


def omnibus(results: DataFrame) -> DataFrame:
    """(metric, anova_f, anova_p, kruskal_h, kruskal_p, eta_squared, effect, n_groups) for metrics with at least two methods."""
    long = core(results)
    ss = _between(long).filter("k >= 2")
    a = ss.withColumn("anova_f", _f(ss)).withColumn("eta_squared", F.coalesce(F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")), F.lit(0.0)))
    a = a.withColumn("anova_p", dist.p_f("anova_f", (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")))
    h = kruskal(long).withColumn("kruskal_p", dist.p_chi2("h", (F.col("k") - 1).cast("double"))).drop("k")
    return a.join(h, "metric").select("metric", "anova_f", "anova_p", F.col("h").alias("kruskal_h"), "kruskal_p", "eta_squared", effect_label(F.col("eta_squared"), (0.01, 0.06, 0.14)).alias("effect"), F.col("k").alias("n_groups"))


def pair_table(long: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(metric, method_1, method_2, n, mean and variance of both) for every two methods, the first earlier in order."""
    each = long.groupBy("metric", "method").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var")).withColumn("o", method_order(order))
    a, b = each.alias("a"), F.broadcast(each.alias("b"))
    earlier = (F.col("a.metric") == F.col("b.metric")) & (F.struct("a.o", "a.method") < F.struct("b.o", "b.method"))
    named = [F.col(f"{s}.{c}").alias(f"{n}_{k}") for k, s in ((1, "a"), (2, "b")) for c, n in (("method", "method"), ("n", "n"), ("mean", "mean"), ("var", "var"))]
    return a.join(b, earlier).select(F.col("a.metric").alias("metric"), *named)


def mann_whitney(long: DataFrame, pairs: DataFrame) -> DataFrame:
    """(metric, method_1, method_2, u, ties): U of the first sample, and the sum of t**3 - t, for pairs of methods."""
    p = F.broadcast(pairs.select("metric", "method_1", "method_2"))
    both = long.join(p, "metric").filter((F.col("method") == F.col("method_1")) | (F.col("method") == F.col("method_2")))
    r = ranked(both, ["metric", "method_1", "method_2"])
    first = F.col("method") == F.col("method_1")
    n1 = F.count_if(first)
    u = F.sum(F.when(first, F.col("r")).otherwise(0.0)) - n1 * (n1 + 1) / F.lit(2.0)
    return r.groupBy("metric", "method_1", "method_2").agg(u.alias("u"), F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("ties"))


def pairwise(results: DataFrame, alpha: float = 0.05, order: list[str] | None = None, methods: list[str] | None = None) -> DataFrame:
    """Student t, Mann-Whitney U and Cohen's d of every two methods (of methods, if given), with Bonferroni-adjusted significance.

    Samples need two values each. A pooled deviation of 0 gives d 0 and no t.
    """
    long = core(results if methods is None else results.filter(F.col("method").isin(methods)))
    n_methods = len(methods) if methods is not None else results.select("method").distinct().count()
    adjusted = alpha / max(1, n_methods * (n_methods - 1) // 2)
    pairs = pair_table(long, order).filter("n_1 >= 2 AND n_2 >= 2")
    n1, n2 = F.col("n_1"), F.col("n_2")
    pooled = ((n1 - 1) * F.col("var_1") + (n2 - 1) * F.col("var_2")) / (n1 + n2 - 2)
    diff = F.col("mean_1") - F.col("mean_2")
    t = F.try_divide(diff, F.sqrt(pooled * (F.lit(1.0) / n1 + F.lit(1.0) / n2)))
    out = pairs.join(mann_whitney(long, pairs), ["metric", "method_1", "method_2"]).withColumns({"mean_diff": diff, "t": t, "cohens_d": F.coalesce(F.try_divide(diff, F.sqrt(pooled)), F.lit(0.0))})
    out = out.withColumns({"t_p": dist.p_t("t", (n1 + n2 - 2).cast("double")), "mw_p": dist.p_mann_whitney("u", n1.cast("double"), n2.cast("double"), "ties")})
    return out.select(
        "metric", "method_1", "method_2", "n_1", "n_2", "mean_1", "mean_2", "mean_diff", "t", "t_p", (F.col("t_p") < adjusted).alias("t_significant"),
        "u", "mw_p", (F.col("mw_p") < adjusted).alias("mw_significant"), "cohens_d", effect_label(F.abs("cohens_d"), (0.2, 0.5, 0.8)).alias("effect"), F.lit(adjusted).alias("adjusted_alpha"),
    )


def middle_tier(results: DataFrame, methods: tuple[str, ...] = ("ctgan", "dpbn", "great"), alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """pairwise() of a few methods with their own correction, and (metric, n_significant_t, n_significant_mw, any_significant)."""
    pairs = pairwise(results, alpha, list(methods), list(methods))
    counts = pairs.groupBy("metric").agg(F.count_if("t_significant").alias("n_significant_t"), F.count_if("mw_significant").alias("n_significant_mw"))
    return pairs, counts.withColumn("any_significant", (F.col("n_significant_t") > 0) | (F.col("n_significant_mw") > 0))


def _metric_pairs(df: DataFrame) -> list[tuple[str, str]]:
    return list(combinations([m for m in CORE_METRICS if m in df.columns], 2))


def correlations(points: DataFrame, least: int = 3) -> DataFrame:
    """(metric_1, metric_2, n, pearson, pearson_p, spearman, spearman_p) over the rows where both metrics are known."""
    pairs = _metric_pairs(points)
    both = F.array(*[F.struct(F.lit(a).alias("metric_1"), F.lit(b).alias("metric_2"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])
    long = points.select(F.inline(both)).filter("x IS NOT NULL AND y IS NOT NULL")
    keys = ["metric_1", "metric_2"]
    r = ranked(ranked(long, keys, "x").withColumnRenamed("r", "rx").drop("t"), keys, "y")
    out = r.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "r").alias("spearman")).filter(F.col("n") >= least)
    t = lambda c: F.when(F.abs(c) < 1, F.col(c) * F.sqrt((F.col("n") - 2) / F.nullif(F.lit(1.0) - F.col(c) * F.col(c), F.lit(0.0))))
    df = (F.col("n") - 2).cast("double")
    p = lambda c: F.when(F.abs(c) >= 1, 0.0).otherwise(dist.p_t(t(c), df))
    return out.select(*keys, "n", "pearson", p("pearson").alias("pearson_p"), "spearman", p("spearman").alias("spearman_p"))


def mean_correlations(results: DataFrame) -> DataFrame:
    """correlations() of the method means, with the range that was expected and whether |spearman| > 0.85 warns of dependence."""
    means = results.groupBy("method").agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in CORE_METRICS])
    low = high = F.lit(None).cast("double")
    for (a, b), (lo, hi) in EXPECTED_CORRELATIONS.items():
        is_pair = (F.col("metric_1") == a) & (F.col("metric_2") == b)
        low, high = F.when(is_pair, lo).otherwise(low), F.when(is_pair, hi).otherwise(high)
    out = correlations(means, 2).withColumns({"expected_low": low, "expected_high": high})
    return out.withColumns({"within_expected": F.col("spearman").between(F.col("expected_low"), F.col("expected_high")), "high_correlation": F.abs("spearman") > 0.85})


def replicate_correlations(results: DataFrame) -> DataFrame:
    return correlations(results)


def quality_issues(results: DataFrame) -> DataFrame:
    """(type, method, column_name, count): metrics constant within a method, and columns with missing values."""
    constant = core(results).groupBy("method", "metric").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).filter("n > 1 AND lo = hi")
    constant = constant.select(F.lit("constant_values").alias("type"), "method", F.col("metric").alias("column_name"), F.col("n").alias("count"))
    missing = results.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in results.columns]).unpivot([], [F.col(f"`{c}`") for c in results.columns], "column_name", "count").filter("count > 0")
    return constant.union(missing.select(F.lit("missing_values").alias("type"), F.lit(None).cast("string").alias("method"), "column_name", "count"))
