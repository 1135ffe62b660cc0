"""The data behind every figure, one DataFrame each; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabassay.constants import CORE_METRICS, HIGHER_IS_BETTER, PROFILES
from tabassay.functions.rng import uniform
from tabassay.plans import decision as D
from tabassay.plans import statistics as S


def method_bars(results: DataFrame) -> DataFrame:
    """(method, metric, mean, std, is_best)."""
    scores = D.method_scores(results, efficiency=False)
    w = Window.partitionBy("metric")
    up = F.col("metric").isin([m for m, u in HIGHER_IS_BETTER.items() if u])
    best = F.when(up, F.max("mean").over(w)).otherwise(F.min("mean").over(w))
    return scores.select("method", "metric", "mean", "std", (F.col("mean") == best).alias("is_best"))


def tradeoffs(results: DataFrame) -> DataFrame:
    """(x_metric, y_metric, method, x, x_std, y, y_std) for three pairs of metrics."""
    s = D.method_scores(results, efficiency=False)
    pairs = [("fidelity_auc", "utility_tstr"), ("privacy_dcr", "utility_tstr"), ("privacy_dcr", "fidelity_auc")]
    wanted = results.sparkSession.createDataFrame(pairs, "x_metric string, y_metric string")
    x = s.select(F.col("metric").alias("x_metric"), "method", F.col("mean").alias("x"), F.col("std").alias("x_std"))
    y = s.select(F.col("metric").alias("y_metric"), "method", F.col("mean").alias("y"), F.col("std").alias("y_std"))
    return x.join(F.broadcast(wanted), "x_metric").join(y, ["y_metric", "method"]).select("x_metric", "y_metric", "method", "x", "x_std", "y", "y_std")


def boxes(results: DataFrame) -> DataFrame:
    """(method, metric, min, q1, median, q3, max)."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = S.core(results).groupBy("method", "metric").agg(F.min("value").alias("min"), q.alias("q"), F.max("value").alias("max"))
    return out.select("method", "metric", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def box_points(results: DataFrame, seed: int = 42) -> DataFrame:
    """(method, replicate, metric, value, jitter): single values with a horizontal shift below 0.1 either way."""
    long = D.long_form(results, list(CORE_METRICS), ("method", "replicate"))
    return long.withColumn("jitter", (uniform("jitter", F.col("method"), F.col("replicate"), F.col("metric"), seed) - F.lit(0.5)) * F.lit(0.2))


def heatmap(results: DataFrame) -> DataFrame:
    """(metric_1, metric_2, rho): the full square of rank correlations of method means."""
    half = S.mean_correlations(results).select("metric_1", "metric_2", F.col("spearman").alias("rho"))
    own = results.sparkSession.createDataFrame([(m, m, 1.0) for m in CORE_METRICS], "metric_1 string, metric_2 string, rho double")
    return half.union(half.select("metric_2", "metric_1", "rho")).union(own)


def radar(results: DataFrame, legacy: bool = False) -> DataFrame:
    """(method, metric, value): min-max of the means, higher better; legacy turns only fairness round."""
    means = D.method_scores(results, efficiency=False)
    if not legacy:
        return D.normalize(means).select("method", "metric", "value")
    w = Window.partitionBy("metric")
    v = D.minmax(F.col("mean"), F.min("mean").over(w), F.max("mean").over(w), F.col("metric") != "fairness_gap")
    return means.select("method", "metric", v.alias("value"))


def profile_comparison(results: DataFrame, normalization: str = "minmax") -> DataFrame:
    """(profile, method, score, rank, is_best)."""
    ranked = D.rank_methods(D.profile_scores(D.value_scores(results, normalization)))
    first = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("score"), "method"))
    return ranked.withColumn("is_best", first == 1)


def contributions(results: DataFrame, profile: str = "balanced") -> DataFrame:
    """(method, objective, contribution): what each objective adds to the weighted score."""
    weights = D.profile_table(results.sparkSession, {profile: PROFILES[profile]}).drop("profile")
    normal = D.normalize(D.method_scores(results))
    return normal.join(F.broadcast(weights), "objective").select("method", "objective", (F.col("value") * F.col("weight")).alias("contribution"))


def profile_sensitivity(results: DataFrame, profile: str = "balanced") -> DataFrame:
    """(attribute, weight_at, method, score) for every objective's weight from 0 to 0.8."""
    base = PROFILES[profile]
    points = [0.8 * i / 19 for i in range(20)]
    return D.grid_scores(D.normalize(D.method_scores(results)), D.weight_grid(results.sparkSession, base, list(base), points))


def all_figures(results: DataFrame, value_refs: dict | str | None = None) -> dict[str, DataFrame]:
    """Every figure's data by name; value_refs: None for min-max values, 'auto', or reference points."""
    how, refs = ("minmax", None) if value_refs is None else ("auto", None) if value_refs == "auto" else ("reference", value_refs)
    values = D.value_scores(results, how, refs)
    return {
        "method_comparison": method_bars(results), "tradeoffs": tradeoffs(results), "box_plots": boxes(results), "box_points": box_points(results), "correlation_heatmap": heatmap(results),
        "radar": radar(results), "pareto_fidelity_utility": D.pareto_fidelity_utility(results), "pareto_privacy_fidelity": D.pareto_privacy_fidelity(results),
        "mada_profile_comparison": D.rank_methods(D.profile_scores(values)), "tornado": D.tornado(values), "contributions": contributions(results), "sensitivity": profile_sensitivity(results),
    }
