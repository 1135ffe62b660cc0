from __future__ import annotations

import numpy as np
import pytest
from golden import COLUMNS, rows

from tabassay.functions import dist
from tabassay.plans import statistics as S


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(rows(), COLUMNS).cache()


def by_metric(df, column):
    return [next(r[column] for r in df.collect() if r["metric"] == m) for m in ("fidelity_auc", "privacy_dcr", "utility_tstr", "fairness_gap")]


def test_omnibus_is_the_published_one(results):
    df = S.omnibus(results).cache()
    assert by_metric(df, "anova_f") == pytest.approx((1597.774, 1380.503, 1128.251, 4.104), abs=1e-3)
    # The published H of the second metric ties values that differ in their last digits; read exactly, three of them do not tie.
    assert by_metric(df, "kruskal_h") == pytest.approx((23.077, 23.0947, 19.857, 10.907), abs=1e-3)
    assert by_metric(df, "kruskal_h")[1] == pytest.approx(23.121, abs=0.03)
    assert by_metric(df, "eta_squared") == pytest.approx((0.9969, 0.9964, 0.9956, 0.4508), abs=1e-4)


def test_levene(results):
    assert by_metric(S.levene(results), "statistic") == pytest.approx((1.930, 3.291, 1.672, 1.226), abs=1e-3)


def test_correlations(results):
    got = {(r["metric_1"], r["metric_2"]): r["spearman"] for r in S.replicate_correlations(results).collect()}
    assert got["fidelity_auc", "privacy_dcr"] == pytest.approx(0.9779, abs=2e-3)
    assert got["utility_tstr", "fairness_gap"] == pytest.approx(-0.6762, abs=1e-4)
    means = {(r["metric_1"], r["metric_2"]): r for r in S.mean_correlations(results).collect()}
    assert means["fidelity_auc", "privacy_dcr"]["spearman"] == pytest.approx(1) and means["fidelity_auc", "privacy_dcr"]["high_correlation"]


def test_pairwise_counts_and_correction(results):
    got = S.pairwise(results).collect()
    assert len(got) == 40 and all(r["adjusted_alpha"] == pytest.approx(0.005) for r in got)
    assert len(S.middle_tier(results)[0].collect()) == 12


def test_interval_is_students(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 0.0, 0.0, 0.0), ("a", 2, 2.0, 0.0, 0.0, 0.0), ("a", 3, 4.0, 0.0, 0.0, 0.0)], COLUMNS)
    r = S.descriptive(df).filter("metric = 'fidelity_auc'").first()
    half = 4.302652729749464 * np.std([1, 2, 4], ddof=1) / np.sqrt(3)
    assert (r["ci_lower"], r["ci_upper"]) == pytest.approx((7 / 3 - half, 7 / 3 + half))
    assert S.descriptive(df.limit(1)).first()["ci_lower"] is None


def test_quality_issues(spark):
    df = spark.createDataFrame([("a", i, 0.5, float(i), None, 0.1 * i) for i in range(1, 4)], COLUMNS)
    got = {(r["type"], r["column_name"]): r["count"] for r in S.quality_issues(df).collect()}
    assert got == {("constant_values", "fidelity_auc"): 3, ("missing_values", "utility_tstr"): 3}


def test_distribution_functions():
    assert dist.t_quantile(0.975, 4) == pytest.approx(2.7764451051977987, abs=1e-9)
    assert float(dist.t_two_sided(2.7764451051977987, 4)) == pytest.approx(0.05, abs=1e-10)
    assert float(dist.f_upper(4.0, 2, 10)) == pytest.approx(1.8**-5, abs=1e-9)
    assert float(dist.chi2_upper(9.487729036781154, 4)) == pytest.approx(0.05, abs=1e-9)
    assert dist.mann_whitney_p(0, 5, 5, 0) == pytest.approx(2 / 252)
    assert dist.mann_whitney_p(12.5, 5, 5, 0) == 1


def test_shapiro():
    w, p = dist.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=0.01) and p == pytest.approx(0.0067, abs=0.001)
    assert dist.shapiro_wilk(np.array([1.0, 1, 1])) == (1.0, 1.0)
