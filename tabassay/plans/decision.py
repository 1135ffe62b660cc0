"""Multi-attribute decision analysis over results, in long form: (method, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabassay.constants import CORE_METRICS, EFFICIENCY_TABLE, HIGHER_IS_BETTER, OBJECTIVES, PROFILES, RUNTIME_MINUTES
from tabassay.functions import values as V
from tabassay.operators.ranking import range_bucket

#: Points of one bucket of frontier(), and its buckets at most.
BUCKET_POINTS, MAX_BUCKETS = 100_000, 4096


def lookup(table: dict, key: Column, default: float | None = None) -> Column:
    """table[key] as a CASE of a few literals, default where the key is unknown."""
    out = F.lit(default).cast("double")
    for k, v in table.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def profile_table(spark: SparkSession, profiles: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(profile, objective, weight): as many rows as weights are given."""
    rows = [(p, o, float(w)) for p, ws in (profiles or PROFILES).items() for o, w in ws.items()]
    return spark.createDataFrame(rows, "profile string, objective string, weight double")


def check_weights(weights: dict[str, float]) -> None:
    if abs(sum(weights.values()) - 1.0) > 0.01:
        raise ValueError(f"weights must sum to 1, not {sum(weights.values()):g}")


def add_efficiency(results: DataFrame) -> DataFrame:
    """efficiency_time in minutes: as it stands, from minutes, from seconds, or by method from the default runtimes."""
    have = results.columns
    if "efficiency_time" in have:
        return results
    if "generation_time_min" in have:
        return results.withColumn("efficiency_time", F.col("generation_time_min").cast("double"))
    if "generation_time_sec" in have:
        return results.withColumn("efficiency_time", F.col("generation_time_sec") / F.lit(60.0))
    return results.withColumn("efficiency_time", lookup(RUNTIME_MINUTES, F.col("method")))


def metric_columns(results: DataFrame, efficiency: bool = True) -> list[str]:
    return [m for m in OBJECTIVES if m in results.columns and (efficiency or m != "efficiency_time")]


def long_form(results: DataFrame, metrics: list[str] | None = None, keep: tuple[str, ...] = ("method",)) -> DataFrame:
    """(keep..., metric, value) without nulls."""
    metrics = metrics or metric_columns(results)
    cast = results.select(*keep, *[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot(list(keep), metrics, "metric", "value").filter("value IS NOT NULL")


def method_scores(results: DataFrame, efficiency: bool = True) -> DataFrame:
    """(method, metric, mean, std, n) over replicates, nulls skipped; std is null for a single replicate."""
    df = add_efficiency(results) if efficiency else results
    return long_form(df, metric_columns(df, efficiency)).groupBy("method", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))


def _higher(metric: Column) -> Column:
    return metric.isin([m for m, up in HIGHER_IS_BETTER.items() if up])


def minmax(x: Column, lo: Column, hi: Column, higher: Column) -> Column:
    """Share of the range, one half for a range of nothing, turned round where lower is better."""
    v = F.when(hi > lo, (x - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(F.lit(0.5))
    return F.when(higher, v).otherwise(F.lit(1.0) - v)


def normalize(scores: DataFrame, method: str = "minmax") -> DataFrame:
    """(method, metric, objective, value) with value in [0, 1], higher better: min-max, or z-score through a logistic curve."""
    w = Window.partitionBy("metric")
    if method == "minmax":
        value = minmax(F.col("mean"), F.min("mean").over(w), F.max("mean").over(w), _higher(F.col("metric")))
    elif method == "zscore":
        spread = F.stddev_samp("mean").over(w)
        z = (F.col("mean") - F.avg("mean").over(w)) / F.nullif(spread, F.lit(0.0))
        v = F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), F.lit(0.5))
        value = F.when(_higher(F.col("metric")), v).otherwise(F.lit(1.0) - v)
    else:
        raise ValueError(f"unknown normalization {method}")
    objective = F.lit(None).cast("string")
    for m, o in OBJECTIVES.items():
        objective = F.when(F.col("metric") == m, o).otherwise(objective)
    return scores.select("method", "metric", objective.alias("objective"), value.alias("value"))


def weighted(normal: DataFrame, weights: DataFrame) -> DataFrame:
    """(profile, method, score): sum of value * weight; an objective without a weight counts 0. weights: (profile, objective, weight)."""
    joined = normal.select("method", "objective", "value").join(F.broadcast(weights), "objective")
    return joined.groupBy("profile", "method").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))


def average_rank(order: list[Column], by: list[str]) -> Column:
    """Rank from 1 with ties at their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(*order)) + (F.count("*").over(Window.partitionBy(*by, F.col("score"))) - 1) / F.lit(2.0)


def rank_methods(scores: DataFrame) -> DataFrame:
    """Adds rank (integer part of the mean rank among ties) by descending score in each profile."""
    return scores.withColumn("rank", F.floor(average_rank([F.desc("score")], ["profile"])).cast("int"))


def recommend(results: DataFrame, profiles: dict[str, dict[str, float]] | None = None, normalization: str = "minmax") -> DataFrame:
    """(profile, method, score, rank) from raw results."""
    for w in (profiles or PROFILES).values():
        check_weights(w)
    return rank_methods(weighted(normalize(method_scores(results), normalization), profile_table(results.sparkSession, profiles)))


def leaders(ranked: DataFrame) -> DataFrame:
    """(profile, leader, second, advantage): the two best methods, equal scores in method order."""
    w = Window.partitionBy("profile").orderBy(F.desc("score"), "method")
    top = ranked.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("method").over(w)).withColumn("advantage", F.col("score") - F.lead("score").over(w))
    return top.filter("n = 1").select("profile", F.col("method").alias("leader"), "second", "advantage")


def reweighted(weights: DataFrame, attribute: Column, w: Column) -> Column:
    """Weight of objective when attribute's weight becomes w and the others keep their proportions (equal shares if they had none)."""
    others = Window.partitionBy("attribute", "weight_at")
    rest = F.sum(F.when(F.col("objective") != attribute, F.col("weight")).otherwise(0.0)).over(others)
    count = F.count("*").over(others) - 1
    share = F.when(rest > 0, F.col("weight") / F.nullif(rest, F.lit(0.0))).otherwise(F.lit(1.0) / F.nullif(count, F.lit(0)))
    return F.when(F.col("objective") == attribute, w).otherwise(share * (F.lit(1.0) - w))


def weight_grid(spark: SparkSession, base: dict[str, float], attributes: list[str], points: list[float]) -> DataFrame:
    """(attribute, weight_at, objective, weight) for each attribute at each point."""
    rows = [(a, float(p), o, float(w)) for a in attributes for p in points for o, w in base.items()]
    grid = spark.createDataFrame(rows, "attribute string, weight_at double, objective string, weight double")
    return grid.withColumn("weight", reweighted(grid, F.col("attribute"), F.col("weight_at")))


def grid_scores(values: DataFrame, grid: DataFrame) -> DataFrame:
    """(attribute, weight_at, method, score) of values (method, objective, value) under every row of the grid."""
    return values.select("method", "objective", "value").join(F.broadcast(grid), "objective").groupBy("attribute", "weight_at", "method").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))


def sensitivity(values: DataFrame, base: dict[str, float], attribute: str, low: float = 0.0, high: float = 0.8, steps: int = 20) -> DataFrame:
    """(attribute, weight_at, method, score) while one weight runs from low to high in equal steps."""
    points = [low + (high - low) * i / max(1, steps - 1) for i in range(steps)]
    return grid_scores(values, weight_grid(values.sparkSession, base, [attribute], points))


def value_form_sensitivity(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(method, form, score, rank) under five forms of the value function."""
    spark = results.sparkSession
    forms = spark.createDataFrame([(f,) for f in V.VALUE_FORMS], "form string")
    shaped = normalize(method_scores(results)).crossJoin(F.broadcast(forms)).withColumn("value", V.value_form(F.col("form"), F.col("value")))
    table = profile_table(spark, {"p": weights}).drop("profile")
    scores = shaped.join(F.broadcast(table), "objective").groupBy("form", "method").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
    return scores.withColumn("rank", F.floor(average_rank([F.desc("score")], ["form"])).cast("int"))


def wide_means(results: DataFrame) -> DataFrame:
    """(method, one mean for each core metric)."""
    return results.groupBy("method").agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in CORE_METRICS])


def value_scores(results: DataFrame, normalization: str = "reference", refs: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(method, objective, value) by value functions at reference points, at points from the data ('auto'), or by min-max."""
    means, refs = wide_means(results), refs or {}
    every = Window.partitionBy(F.lit(1))
    given = {o: {k: F.lit(float(v)) for k, v in r.items()} for o, r in refs.items()}
    if normalization == "auto":
        given = {
            "fidelity": {"x_worst": F.max("fidelity_auc").over(every)}, "privacy": {"x_worst": F.min("privacy_dcr").over(every), "x_best": F.max("privacy_dcr").over(every)},
            "utility": {"x_worst": F.min("utility_tstr").over(every)}, "fairness": {"x_worst": F.max("fairness_gap").over(every)},
        }
    minutes = lookup(RUNTIME_MINUTES, F.col("method"), 1.0)
    if normalization == "minmax":
        core = {OBJECTIVES[m]: minmax(F.col(m), F.min(m).over(every), F.max(m).over(every), F.lit(HIGHER_IS_BETTER[m])) for m in CORE_METRICS}
    elif normalization in ("reference", "auto"):
        make = {"fidelity": V.v_fidelity, "privacy": V.v_privacy, "utility": V.v_utility, "fairness": V.v_fairness}
        core = {OBJECTIVES[m]: make[OBJECTIVES[m]](F.col(m), **given.get(OBJECTIVES[m], {})) for m in CORE_METRICS}
    else:
        raise ValueError(f"unknown normalization {normalization}")
    wide = means.select("method", *[v.alias(o) for o, v in core.items()], V.v_efficiency(minutes, **{k: v for k, v in refs.get("efficiency", {}).items()}).alias("efficiency"))
    return wide.unpivot(["method"], [*core, "efficiency"], "objective", "value")


def profile_scores(values: DataFrame, profiles: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(profile, method, score) of value_scores()."""
    return weighted(values, profile_table(values.sparkSession, profiles))


def tornado(values: DataFrame, base: dict[str, float] | None = None, low: float = 0.05, high: float = 0.50) -> DataFrame:
    """(objective, lo, hi, range): the best reachable score with an objective's weight at low and at high."""
    base = base or PROFILES["balanced"]
    top = grid_scores(values, weight_grid(values.sparkSession, base, list(base), [low, high])).groupBy("attribute", "weight_at").agg(F.max("score").alias("top"))
    out = top.groupBy(F.col("attribute").alias("objective")).agg(F.min("top").alias("lo"), F.max("top").alias("hi"))
    return out.withColumn("range", F.col("hi") - F.col("lo"))


def collapsed(values: DataFrame) -> DataFrame:
    """value_scores() with fidelity and privacy as one objective, data_similarity, their mean."""
    name = F.when(F.col("objective").isin("fidelity", "privacy"), "data_similarity").otherwise(F.col("objective"))
    return values.groupBy("method", name.alias("objective")).agg(F.avg("value").alias("value"))


def collapsed_profiles(profiles: dict[str, dict[str, float]] | None = None) -> dict[str, dict[str, float]]:
    return {p: {"data_similarity": w["fidelity"] + w["privacy"], **{o: w[o] for o in ("utility", "fairness", "efficiency")}} for p, w in (profiles or PROFILES).items()}


def breakeven(values: DataFrame, method: str = "dpbn", percents: range = range(5, 85)) -> DataFrame:
    """One row (breakeven): the least data_similarity weight at which method leads the collapsed balanced profile, or null."""
    base = collapsed_profiles()["balanced"]
    scores = grid_scores(collapsed(values), weight_grid(values.sparkSession, base, ["data_similarity"], [p / 100 for p in percents]))
    ranked = scores.withColumn("n", F.row_number().over(Window.partitionBy("weight_at").orderBy(F.desc("score"), "method")))
    return ranked.filter((F.col("n") == 1) & (F.col("method") == method)).agg(F.min("weight_at").alias("breakeven"))


def correlation_adjusted(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked profile scores over the collapsed objectives, and breakeven()."""
    return rank_methods(profile_scores(collapsed(values), collapsed_profiles())), breakeven(values)


def frontier(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Adds optimal to points: no other is at least as good in both columns and better in one. A point with a null is optimal.

    Points of one x are dominated by their greatest y, and by the greatest y of any greater x: a running
    maximum inside range buckets of x, shifted by the maxima of the buckets above. Nothing is broadcast but
    one row for each bucket.
    """
    known = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    best = known.groupBy(F.col(x).alias("_x")).agg(F.max(y).alias("_y"))
    bucket = range_bucket(best, "_x", max(2, min(MAX_BUCKETS, best.count() // BUCKET_POINTS)))
    own = best.withColumn("_b", bucket).withColumn("_in", F.max("_y").over(Window.partitionBy("_b").orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, -1)))
    tops = own.groupBy("_b").agg(F.max("_y").alias("_top"))
    above = tops.withColumn("_over", F.max("_top").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    leading = own.join(F.broadcast(above), "_b").filter(F.coalesce(F.col("_y") > F.greatest("_in", "_over"), F.lit(True))).select("_x", "_y")
    joined = points.join(leading, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left")
    return joined.withColumn("optimal", F.col("_x").isNotNull() | F.col(x).isNull() | F.col(y).isNull()).drop("_x", "_y")


def pareto(means: DataFrame, x: Column, y: Column) -> DataFrame:
    """(method, x, y, optimal): frontier() of the methods."""
    return frontier(means.select("method", x.alias("x"), y.alias("y")))


def pareto_privacy_fidelity(results: DataFrame) -> DataFrame:
    return pareto(wide_means(results), F.col("privacy_dcr"), F.lit(1.0) - F.col("fidelity_auc"))


def pareto_fidelity_utility(results: DataFrame, legacy: bool = False) -> DataFrame:
    """legacy takes a higher AUC for better, as the old figure did."""
    return pareto(wide_means(results), F.col("fidelity_auc") if legacy else F.lit(1.0) - F.col("fidelity_auc"), F.col("utility_tstr"))


def table_efficiency(method: Column) -> Column:
    return lookup(EFFICIENCY_TABLE, method, 0.0)
