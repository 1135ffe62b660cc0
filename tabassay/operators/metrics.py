"""Exact classifier metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabassay.operators.ranking import range_bucket, shifted


def auc(scored: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None, count: str | None = None) -> DataFrame:
    """(by..., auc): exact ROC AUC by average ranks; null if a class is missing. count names a column of how many rows a row stands for.

    Equal scores are counted together first. The running count of negatives below a score is taken
    in ranges of scores and shifted by the ranges before, so no task orders all scores.
    """
    by = by or []
    times = F.col(count) if count else F.lit(1)
    tied = scored.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(label).cast("long") * times).alias("p"), F.sum((1 - F.col(label)).cast("long") * times).alias("n"))
    rows = tied.withColumn("_b", range_bucket(scored, score))
    below = Window.partitionBy(*by, "_b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    counted = shifted(rows.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0))), by, F.col("n"), "_before")
    wins = F.sum(F.col("p") * (F.col("below") + F.col("_before") + F.col("n") / F.lit(2.0)))
    return counted.groupBy(*by).agg(F.try_divide(wins, F.sum("p") * F.sum("n")).alias("auc"))


def f1(prediction: Column, label: Column) -> Column:
    """F1 of class 1 as an aggregate; 0 where nothing is predicted or true."""
    tp = F.count_if((prediction == 1) & (label == 1))
    return F.coalesce(F.try_divide(F.lit(2.0) * tp, F.count_if(prediction == 1) + F.count_if(label == 1)), F.lit(0.0))


def by_subgroup(predicted: DataFrame, subgroup: str, minimum: int, label: str = "label") -> DataFrame:
    """(subgroup, n, f1_real, f1_synth, f1_ratio, kept) from predictions pred_real, pred_synth; ratio 0 where the real model's F1 is 0."""
    each = predicted.groupBy(F.col(subgroup).cast("string").alias("subgroup")).agg(
        F.count("*").alias("n"), f1(F.col("pred_real"), F.col(label)).alias("f1_real"), f1(F.col("pred_synth"), F.col(label)).alias("f1_synth")
    )
    ratio = F.when(F.col("f1_real") > 0, F.col("f1_synth") / F.nullif(F.col("f1_real"), F.lit(0.0))).otherwise(0.0)
    return each.withColumn("f1_ratio", ratio).withColumn("kept", F.col("n") >= minimum)


def gaps(subgroups: DataFrame, overall: Column) -> DataFrame:
    """One row: max_gap, mean_gap, worst_subgroup, fairness_score over kept subgroups; 0, 0, null, 1 without any."""
    kept = subgroups.filter("kept").withColumn("gap", F.abs(F.col("f1_ratio") - overall))
    worst = F.max(F.struct("gap", "subgroup"))
    out = kept.agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_gap"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_gap"), worst["subgroup"].alias("worst_subgroup"))
    return out.withColumn("fairness_score", F.greatest(F.lit(0.0), F.lit(1.0) - F.col("max_gap") / F.lit(0.5)))


def membership_rates(scored: DataFrame, probability: str = "p") -> Column:
    """Share of rows whose membership probability is above one half."""
    return F.avg((F.col(probability) > 0.5).cast("double"))
