from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import pytest
from golden import COLUMNS, rows
from pyspark.sql import functions as F

from tabassay import cli
from tabassay.config import DatasetConfig
from tabassay.functions.rng import uniform
from tabassay.operators import gan, generators, linking, measures, metrics, sampling
from tabassay.plans import experiment
from tabassay.sources import io
from tabassay.streaming import results as stream


@pytest.fixture(scope="module")
def people(spark):
    i = F.col("row_id")
    df = spark.range(200).withColumnRenamed("id", "row_id")
    df = df.select("row_id", (F.floor(uniform(i, "age") * 62) + 18).alias("age"), F.floor(-F.ln(1 - uniform(i, "inc")) * 40000).alias("income"), (F.floor(uniform(i, "sex") * 2) + 1).alias("sex"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.floor(uniform(i, "race") * 3) + 1).cast("int")).alias("race"))
    return df.withColumn("target", (F.col("income") > 25_000).cast("int")).drop("income").cache()


@pytest.fixture(scope="module")
def parts(people):
    train, test = sampling.train_test_split(people, 0.7, 42)
    return train.cache(), test.cache(), generators.IndependentMarginals(42).fit_sample(train, 140).cache()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", list(generators.REGISTRY))
def test_generators(people, name):
    make = generators.REGISTRY[name] if name != "ctgan" else lambda seed: gan.ConditionalGAN(2, 10, random_state=seed)
    got = make(42).fit(people).sample(60)
    assert got.columns == people.columns and got.count() == 60
    assert {r[0] for r in got.select("race").distinct().collect()} <= {"a", "b", "c"}
    assert dict(got.dtypes)["sex"] == dict(people.dtypes)["sex"]


def test_same_seed_same_rows(people):
    a, b = (generators.IndependentMarginals(7).fit_sample(people.repartition(n), 50) for n in (2, 5))
    assert rows_of(a) == rows_of(b)


def test_entropies_of_all_sets_in_one_pass(spark):
    df = spark.range(500).select(F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("a b"), (F.col("id") % 4).alias("c"), F.when(F.col("id") % 5 > 1, F.lit("x")).alias("d"))
    sets = [frozenset(s) for s in (["a b"], ["c"], ["d"], ["a b", "c"], ["a b", "d"], ["c", "d"], ["a b", "c", "d"])]
    h = generators.entropies(df, sets)
    assert set(h) == set(sets)
    for a, b in ((["a b"], ["c"]), (["c"], ["a b", "d"]), (["d"], ["c"])):
        want = generators.mutual_information(df, a, b).first()["mi"]
        assert h[frozenset(a)] + h[frozenset(b)] - h[frozenset(a + b)] == pytest.approx(want, abs=1e-9)


def test_kinds_of_columns_by_few_values(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 20).alias("twenty"), (F.col("id") % 21).alias("more"), F.col("id").alias("all"), F.lit(None).cast("int").alias("none"), F.col("id").cast("string").alias("text"))
    assert generators.value_column_types(df) == {"twenty": True, "more": False, "all": False, "none": True, "text": True}


def test_marginals_keep_nulls_and_constant_columns(spark):
    df = spark.createDataFrame([(i, "x", None if i % 2 else "y") for i in range(40)], "row_id int, c string, n string")
    got = generators.IndependentMarginals().fit_sample(df, 80)
    assert got.filter("c != 'x' OR c IS NULL").count() == 0 and 10 < got.filter("n IS NULL").count() < 70


def test_copies_are_at_distance_zero(parts):
    train, _, _ = parts
    r = measures.dcr_privacy(train, train).first()
    assert r["dcr_percentile"] < 0.01 and 0 <= r["privacy_score"] <= 1


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "cosine"])
def test_blocked_distances_agree(parts, metric):
    train, _, synthetic = parts
    t, s, names = measures.distance_features(train, synthetic)
    flat = {r["row_id"]: (round(r["dcr"], 9)) for r in linking.nearest(s, t, names, metric).collect()}
    blocks = {r["row_id"]: (round(r["dcr"], 9)) for r in linking.blocked_nearest(s, t.withColumnRenamed("row_id", "_t"), names, metric, "row_id", block=32).collect()}
    assert flat == blocks and len(flat) == 140


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.1), (1, 0.9), (0, 0.5)], "label int, score double")
    assert metrics.auc(df).first()["auc"] == pytest.approx(0.625)
    assert metrics.auc(df.filter("label = 1")).first()["auc"] is None


def test_measures_are_in_range(parts):
    train, test, synthetic = parts
    p = measures.propensity_auc(train, synthetic, n_estimators=3)
    assert 0 <= p["auc"] <= 1 and len(p["fold_aucs"]) == 3 and p["feature_importance"]
    assert 0 <= measures.propensity_auc_holdout(train, test, synthetic, n_estimators=3)["auc"] <= 1
    m = measures.membership_inference_privacy(train, test, synthetic)
    assert 0 <= m["attack_success_rate"] <= 1 and (m["privacy_score"] is None) == (not m["attack_valid"])
    u = measures.tstr_utility(train, train, test, "target", n_estimators=3)
    assert u["utility_score"] >= 0.8
    f = measures.fairness_gap(train, synthetic, test, "target", "race", 5, n_estimators=3)
    assert f["max_gap"] >= 0 and 0 <= f["fairness_score"] <= 1


def test_run_is_resumable(spark, people, tmp_path):
    people.drop("row_id").coalesce(1).write.option("header", True).csv(str(tmp_path / "data.csv"))
    config = DatasetConfig("d", str(tmp_path / "data.csv"), "target", "race", ["sex", "race"], ["age"])
    out = tmp_path / "out"
    generated = experiment.run(spark, config, out, ["independent_marginals", "unknown_tool"], 1, 50, skip_measures=True, trees=2, min_subgroup_size=5)
    assert generated.count() == 0 and json.loads((out / "checkpoint.json").read_text())["generated"] == ["independent_marginals_rep1"]
    measured = experiment.run(spark, config, out, ["independent_marginals"], 1, 50, trees=2, min_subgroup_size=5).collect()
    assert len(measured) == 1 and measured[0]["fidelity_auc"] is not None and measured[0]["utility_tstr"] is not None
    again = experiment.run(spark, config, out, ["independent_marginals"], 1, 50, trees=2, min_subgroup_size=5).collect()
    assert again[0]["timestamp"] == measured[0]["timestamp"]
    assert io.read_results(spark, str(out / "all_results.csv")).count() == 1


def test_streamed_means(spark, tmp_path):
    io.write_results([{"method": m, "replicate": r, "fidelity_auc": f, "privacy_dcr": p, "utility_tstr": u, "fairness_gap": g} for m, r, f, p, u, g in rows()], tmp_path / "in" / "r.csv")
    query = stream.running_means(stream.stream_results(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["method"]: r for r in spark.table("means").collect()}
    assert got["synthpop"]["n"] == 5 and got["synthpop"]["fidelity_auc"] == pytest.approx(0.4839, abs=1e-4)


def test_command_line(spark, tmp_path, capsys):
    io.write_results([{"method": m, "replicate": r, "fidelity_auc": f, "privacy_dcr": p, "utility_tstr": u, "fairness_gap": g} for m, r, f, p, u, g in rows()], tmp_path / "r.csv")
    path = str(tmp_path / "r.csv")
    assert cli.main(["recommend", "--results", path, "--profile", "privacy_first"]) == 0 and "DP-BN" in capsys.readouterr().out
    assert cli.main(["recommend", "--results", path, "--weights", '{"fidelity": 0.5, "utility": 0.5}']) == 0
    assert cli.main(["recommend", "--results", path, "--profile", "none"]) == 1
    assert cli.main(["verify", "--results", str(tmp_path / "absent.csv")]) == 1
    assert cli.main(["verify", "--results", path]) == 0
    assert cli.main(["analyze", "--results", path, "--output-dir", str(tmp_path / "fig")]) == 0 and (tmp_path / "fig" / "tornado").exists()
    assert cli.main([]) == 0


def test_module_runs():
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-m", "tabassay.cli"], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and "recommend" in done.stdout
    assert COLUMNS
