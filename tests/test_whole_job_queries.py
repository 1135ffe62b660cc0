"""Registered queries do the whole job: all rows and the operators' default settings."""

from __future__ import annotations

from collections import defaultdict

from conftest import SF

from tabassay import queries


def test_learned_measures_see_every_order_and_default_trees(spark, monkeypatch):
    train, test, synthetic = queries._tables(spark, SF)
    whole = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert train.count() + test.count() == whole and synthetic.count() == train.count()
    given = {}
    for name in ("propensity_auc", "propensity_auc_holdout", "propensity_auc_no_cv", "tstr_utility", "tstr_utility_per_subgroup", "compare_fairness_across_methods"):
        monkeypatch.setattr(queries.measures, name, lambda *a, _name=name, **b: given.setdefault(_name, []).append(b) or defaultdict(lambda: None))
    monkeypatch.setattr(queries, "_row", lambda *a: None)
    names = ("propensity_gbt", "propensity_holdout", "propensity_no_cv", "tstr_gbt", "tstr_per_subgroup", "fairness_gbt")
    for name in names:
        queries.QUERIES[name](spark, SF)
    assert len(given) == len(names) and not any("n_estimators" in b for calls in given.values() for b in calls)
