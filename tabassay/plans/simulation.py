"""Monte-Carlo optimality and value of information: every draw is one row, no loop runs on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabassay.constants import CORE_METRICS, EFFICIENCY_TABLE, HEURISTIC, HEURISTIC_INFORMED, HIGHER_IS_BETTER, OBJECTIVES, PROFILES, RUNTIME_MINUTES
from tabassay.functions.rng import normal
from tabassay.plans.decision import average_rank, lookup, minmax, profile_table


def performance(results: DataFrame) -> DataFrame:
    """(method, m_<metric>, s_<metric>): mean and sample deviation of each core metric."""
    aggs = [f(F.col(m).cast("double")).alias(f"{k}_{m}") for m in CORE_METRICS for k, f in (("m", F.avg), ("s", F.stddev_samp))]
    return results.groupBy("method").agg(*aggs)


def _draws(stats: DataFrame, n: int) -> DataFrame:
    """Every method in every simulation; the few methods are the broadcast side."""
    return stats.sparkSession.range(n).withColumnRenamed("id", "sim").crossJoin(F.broadcast(stats))


def _scores(values: dict[str, Column], profiles: dict[str, dict[str, float]]) -> Column:
    """Array of (profile, score) for value columns by objective."""
    total = lambda w: sum((values[o] * F.lit(float(x)) for o, x in w.items() if o in values), F.lit(0.0))
    return F.array(*[F.struct(F.lit(p).alias("profile"), total(w).alias("score")) for p, w in profiles.items()])


def monte_carlo_optimality(results: DataFrame, profiles: dict[str, dict[str, float]] | None = None, n_simulations: int = 10_000, seed: int = 42, keep_efficiency: bool = False) -> DataFrame:
    """(profile, method, p_optimal, mean_rank, rank_ci_low, rank_ci_high) over normal draws, min-max scaled in each draw.

    Efficiency comes from the default runtimes unless keep_efficiency is set and results have it.
    One shuffle deals rows by simulation; scaling, ranking and choice happen within it.
    """
    stats = performance(results)
    if keep_efficiency and "efficiency_time" in results.columns:
        stats = stats.join(results.groupBy("method").agg(F.avg("efficiency_time").alias("minutes")), "method")
    else:
        stats = stats.withColumn("minutes", lookup(RUNTIME_MINUTES, F.col("method"), 1.0))
    drawn = _draws(stats, n_simulations).select("sim", "method", "minutes", *[(F.col(f"m_{m}") + F.coalesce(F.col(f"s_{m}"), F.lit(0.0)) * normal("mc", F.col("sim"), F.col("method"), m, seed)).alias(m) for m in CORE_METRICS])
    w = Window.partitionBy("sim")
    values = {OBJECTIVES[m]: minmax(F.col(m), F.min(m).over(w), F.max(m).over(w), F.lit(HIGHER_IS_BETTER[m])) for m in CORE_METRICS}
    values["efficiency"] = minmax(F.col("minutes"), F.min("minutes").over(w), F.max("minutes").over(w), F.lit(False))
    scored = drawn.select("sim", "method", *[v.alias(o) for o, v in values.items()])
    each = scored.select("sim", "method", F.inline(_scores({o: F.col(o) for o in values}, profiles or PROFILES)))
    best = F.row_number().over(Window.partitionBy("sim", "profile").orderBy(F.desc("score"), "method"))
    ranked = each.withColumn("rank", average_rank([F.desc("score")], ["sim", "profile"])).withColumn("best", best)
    return ranked.groupBy("profile", "method").agg(
        F.avg((F.col("best") == 1).cast("double")).alias("p_optimal"), F.avg("rank").alias("mean_rank"),
        F.floor(F.percentile("rank", F.lit(0.025))).cast("int").alias("rank_ci_low"), F.floor(F.percentile("rank", F.lit(0.975))).cast("int").alias("rank_ci_high"),
    )


def method_values(results: DataFrame, profiles: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(profile, method, value): min-max of means, weighted, with efficiency from the fixed table (0 for a method it lacks)."""
    w = Window.partitionBy(F.lit(1))
    stats = performance(results)
    values = {OBJECTIVES[m]: minmax(F.col(f"m_{m}"), F.min(f"m_{m}").over(w), F.max(f"m_{m}").over(w), F.lit(HIGHER_IS_BETTER[m])) for m in CORE_METRICS}
    values["efficiency"] = lookup(EFFICIENCY_TABLE, F.col("method"), 0.0)
    scored = stats.select("method", *[v.alias(o) for o, v in values.items()])
    return scored.select("method", F.inline(_scores({o: F.col(o) for o in values}, profiles or PROFILES))).select("profile", "method", F.col("score").alias("value"))


def _choice(table: dict[str, str]) -> Column:
    out = F.lit("synthpop")
    for p, m in table.items():
        out = F.when(F.col("profile") == p, m).otherwise(out)
    return out


def strategies(values: DataFrame) -> DataFrame:
    """(profile, s1_random, s2_heuristic, s2_informed, s4_benchmark); a rule of thumb whose method is absent is a random choice."""
    pick = lambda t: F.max(F.when(F.col("method") == _choice(t), F.col("value")))
    return values.groupBy("profile").agg(
        F.avg("value").alias("s1_random"), F.coalesce(pick(HEURISTIC), F.avg("value")).alias("s2_heuristic"),
        F.coalesce(pick(HEURISTIC_INFORMED), F.avg("value")).alias("s2_informed"), F.max("value").alias("s4_benchmark"),
    )


def rough_estimates(values: DataFrame, n_simulations: int = 50_000, prior_noise: float = 0.15, seed: int = 42) -> DataFrame:
    """(profile, s3_rough): mean true value of the method whose noisy value is highest."""
    noisy = _draws(values, n_simulations).withColumn("noisy", F.col("value") + F.lit(prior_noise) * normal("s3", F.col("sim"), F.col("method"), seed))
    chosen = noisy.groupBy("profile", "sim").agg(F.max_by("value", "noisy").alias("value"))
    return chosen.groupBy("profile").agg(F.avg("value").alias("s3_rough"))


def oracle_values(results: DataFrame, profiles: dict[str, dict[str, float]] | None = None, n_simulations: int = 50_000, inflation: float = 1.5, seed: int = 42) -> DataFrame:
    """(profile, oracle_raw): mean best value over draws with inflated deviations, on the scale fixed by the means, not clamped."""
    w = Window.partitionBy(F.lit(1))
    stats = performance(results).select("*", *[f(f"m_{m}").over(w).alias(f"{k}_{m}") for m in CORE_METRICS for k, f in (("lo", F.min), ("hi", F.max))])
    drawn = lambda m: F.col(f"m_{m}") + F.lit(inflation) * F.col(f"s_{m}") * normal("oracle", F.col("sim"), F.col("method"), m, seed)
    values = {OBJECTIVES[m]: minmax(drawn(m), F.col(f"lo_{m}"), F.col(f"hi_{m}"), F.lit(HIGHER_IS_BETTER[m])) for m in CORE_METRICS}
    values["efficiency"] = lookup(EFFICIENCY_TABLE, F.col("method"), 0.0)
    scored = _draws(stats, n_simulations).select("sim", "method", *[v.alias(o) for o, v in values.items()])
    each = scored.select("sim", F.inline(_scores({o: F.col(o) for o in values}, profiles or PROFILES)))
    return each.groupBy("profile", "sim").agg(F.max("score").alias("top")).groupBy("profile").agg(F.avg("top").alias("oracle_raw"))


def value_of_information(results: DataFrame, n_simulations: int = 50_000, prior_noise: float = 0.15, inflation: float = 1.5, seed: int = 42, profiles: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """One row for each profile: the strategies' values, the oracle's, and how much ordering and information contribute."""
    values = method_values(results, profiles)
    joined = strategies(values).join(rough_estimates(values, n_simulations, prior_noise, seed), "profile").join(oracle_values(results, profiles, n_simulations, inflation, seed), "profile")
    total = F.col("s4_benchmark") - F.col("s1_random")
    share = lambda part: F.when(total > 0.001, part / F.nullif(total, F.lit(0.0)) * 100).otherwise(50.0)
    prior, info = F.col("s3_rough") - F.col("s1_random"), F.col("s4_benchmark") - F.col("s3_rough")
    return joined.select(
        F.col("profile").alias("archetype"), "s1_random", "s2_heuristic", "s2_informed", "s3_rough", "s4_benchmark", F.greatest("oracle_raw", "s4_benchmark").alias("oracle"),
        prior.alias("value_of_prioritization"), info.alias("value_of_information"), total.alias("total_improvement"), share(prior).alias("pct_from_prioritization"), share(info).alias("pct_from_information"),
    )


def inflation_sensitivity(results: DataFrame, factors: tuple[float, ...] = (1.0, 1.25, 1.5, 1.75, 2.0), n_simulations: int = 10_000, seed: int = 42) -> DataFrame:
    """(factor, mean shares, mean oracle, mean S4, mean gap); the shares do not depend on the factor, by construction."""
    out = None
    for f in factors:
        each = value_of_information(results, n_simulations, inflation=f, seed=seed).agg(
            F.avg("pct_from_prioritization").alias("mean_pct_prioritization"), F.avg("pct_from_information").alias("mean_pct_information"),
            F.avg("oracle").alias("mean_oracle"), F.avg("s4_benchmark").alias("mean_s4"), F.avg(F.col("oracle") - F.col("s4_benchmark")).alias("mean_evpi_gap"),
        ).select(F.lit(float(f)).alias("factor"), "*")
        out = each if out is None else out.union(each)
    return out


#: Fixed value: the share in percent above which ordering methods accounts for most of the value.
MAJORITY = 50.0


def inflation_verdict(sensitivity: DataFrame) -> DataFrame:
    """One row over inflation_sensitivity(): ends of the factors and of the mean share of prioritization, and whether it is robust.

    It is 'robust' if the share is a majority at every factor, else 'sensitive'; no factors: no verdict.
    """
    pct = F.col("mean_pct_prioritization")
    ends = sensitivity.agg(F.min("factor").alias("least_factor"), F.max("factor").alias("greatest_factor"), F.min(pct).alias("least_pct"), F.max(pct).alias("greatest_pct"))
    word = F.when(F.col("least_pct") > MAJORITY, "robust").when(F.col("least_pct").isNotNull(), "sensitive")
    return ends.withColumn("verdict", word)
