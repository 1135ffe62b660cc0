from __future__ import annotations

import pytest
from golden import COLUMNS, rows
from pyspark.sql import functions as F

from tabassay.constants import METHODS, PROFILES
from tabassay.functions import values as V
from tabassay.plans import decision as D
from tabassay.plans import plotdata, report
from tabassay.plans import simulation as M


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(rows(), COLUMNS).cache()


def table(df, key, value):
    return {tuple(r[k] for k in key): r[value] for r in df.collect()}


MINMAX = {
    "fidelity": (0, 0.192402, 0.077376, 1, 0.382132), "privacy": (1, 0.540604, 0.768378, 0, 0.338061), "utility": (0, 0.939345, 0.913951, 1, 0.882918),
    "fairness": (0, 0.401530, 0.342961, 1, 0.065809), "efficiency": (1, 0.994413, 1, 1, 0),
}


def test_normalized_values_are_the_published_ones(results):
    got = table(D.normalize(D.method_scores(results)), ("objective", "method"), "value")
    for objective, want in MINMAX.items():
        assert [got[objective, m] for m in METHODS] == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize(("profile", "want"), [("privacy_first", (0.5, 0.5221, 0.5865, 0.55, 0.3867)), ("utility_first", (0.2, 0.6271, 0.5999, 0.9, 0.5082)), ("balanced", (0.35, 0.5778, 0.5914, 0.75, 0.4106))])
def test_weighted_scores_and_ranks(results, profile, want):
    ranked = D.recommend(results, {profile: PROFILES[profile]}).collect()
    assert [next(r["score"] for r in ranked if r["method"] == m) for m in METHODS] == pytest.approx(want, abs=1e-4)
    assert sorted(r["rank"] for r in ranked) == [1, 2, 3, 4, 5]
    assert max(ranked, key=lambda r: r["score"])["rank"] == 1


def test_reference_anchored_scores(results):
    got = table(D.profile_scores(D.value_scores(results, "reference")), ("profile", "method"), "score")
    assert [got["balanced", m] for m in METHODS] == pytest.approx((0.3492, 0.5492, 0.5739, 0.6993, 0.4351), abs=1e-4)


def test_table_efficiency_scores(results):
    got = table(M.method_values(results), ("profile", "method"), "value")
    assert [got["utility_first", m] for m in METHODS] == pytest.approx((0.2, 0.6177, 0.5999, 0.9, 0.5322), abs=1e-4)


def test_value_of_information_agrees_with_the_published_table(results):
    got = {r["archetype"]: r for r in M.value_of_information(results, 20_000).collect()}
    want = {"privacy_first": (0.511, 0.587, 0.587, 0.541, 0.587, 0.624), "utility_first": (0.570, 0.618, 0.900, 0.850, 0.900, 0.900), "balanced": (0.539, 0.435, 0.750, 0.685, 0.750, 0.761)}
    for p, w in want.items():
        r = got[p]
        assert [r[c] for c in ("s1_random", "s2_heuristic", "s2_informed", "s3_rough", "s4_benchmark", "oracle")] == pytest.approx(w, abs=0.004)
        assert r["value_of_prioritization"] + r["value_of_information"] == pytest.approx(r["total_improvement"])
        assert r["oracle"] >= r["s4_benchmark"]


def test_monte_carlo_is_a_distribution_and_reproducible(results):
    a = M.monte_carlo_optimality(results, {"balanced": PROFILES["balanced"]}, 500).orderBy("method").collect()
    assert a == M.monte_carlo_optimality(results.repartition(7), {"balanced": PROFILES["balanced"]}, 500).orderBy("method").collect()
    assert sum(r["p_optimal"] for r in a) == pytest.approx(1) and sum(r["mean_rank"] for r in a) == pytest.approx(15)


@pytest.mark.parametrize(("make", "points"), [
    (V.v_fidelity, [(0.5, 1), (0.88, 0), (0.95, 0), (0.4, 1)]), (V.v_privacy, [(0.14, 1), (0.007, 0), (0, 0), (0.2, 1)]), (V.v_utility, [(1, 1), (0.037, 0), (0, 0), (1.1, 1)]),
    (V.v_fairness, [(0, 1), (0.08, 0), (0.1, 0), (-0.01, 1)]), (V.v_efficiency, [(0.3, 1), (480, 0), (1000, 0)]),
])
def test_value_functions(spark, make, points):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
    assert all(r["v"] == pytest.approx(r["y"]) for r in df.withColumn("v", make(F.col("x"))).collect())


def test_efficiency_sources_in_order(results):
    minutes = results.withColumn("generation_time_min", F.lit(5.0)).withColumn("generation_time_sec", F.lit(120.0))
    assert D.add_efficiency(results.withColumn("efficiency_time", F.lit(99.0))).first()["efficiency_time"] == 99
    assert D.add_efficiency(minutes).first()["efficiency_time"] == 5
    assert D.add_efficiency(minutes.drop("generation_time_min")).first()["efficiency_time"] == 2
    assert D.add_efficiency(results.filter("method = 'great'")).first()["efficiency_time"] == 90


def test_constant_metric_is_one_half(results):
    got = D.normalize(D.method_scores(results.withColumn("utility_tstr", F.lit(0.3)))).filter("metric = 'utility_tstr'").collect()
    assert {r["value"] for r in got} == {0.5}


def test_weights_must_sum_to_one(results):
    with pytest.raises(ValueError, match="sum to 1"):
        D.recommend(results, {"p": {"fidelity": 0.5}})


def test_sensitivity_keeps_proportions(spark):
    grid = D.weight_grid(spark, PROFILES["balanced"], ["privacy"], [0.0, 0.4, 0.8]).groupBy("weight_at").agg(F.sum("weight").alias("s")).collect()
    assert [r["s"] for r in grid] == pytest.approx([1, 1, 1])


def test_pareto_keeps_only_undominated(results):
    got = {r["method"]: r["optimal"] for r in D.pareto_privacy_fidelity(results).collect()}
    assert got["synthpop"] and got["independent_marginals"]


def test_figures_and_reports(results):
    for name, df in plotdata.all_figures(results, "auto").items():
        assert df.count() > 0, name
    text = report.recommendation(results, PROFILES["balanced"], "Balanced")
    assert "RECOMMENDATION" in text and "Synthpop" in text
    assert "PASS" in report.verification(results) and "MIDDLE-TIER" in report.statistics(results)
    assert r"\begin{tabular}" in report.voi_latex(results, 200) and "Oracle" in report.value_of_information(results, 200)
    one = results.filter("method = 'ctgan'")
    assert "RECOMMENDATION" in report.recommendation(one, PROFILES["balanced"])
    assert "SKIPPED" in report.verification(one)
    assert "NORMALISED" in report.overview(results) and "Strong in" not in text and "strong in" in text


def test_verdict_on_inflation(spark, results):
    sweep = lambda *pct: spark.createDataFrame([(1.0 + i / 4, p) for i, p in enumerate(pct)], "factor double, mean_pct_prioritization double")
    assert tuple(M.inflation_verdict(sweep(51.0, 60.0)).first()) == (1.0, 1.25, 51.0, 60.0, "robust")
    assert M.inflation_verdict(sweep(50.0, 60.0)).first()["verdict"] == "sensitive" and M.inflation_verdict(sweep()).first()["verdict"] is None
    assert "to the factor" in report.inflation(results, 50)
