from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabassay.config import DatasetConfig, default_config_path, load_config
from tabassay.functions import recode
from tabassay.operators import encode, sampling
from tabassay.plans import experiment
from tabassay.sources import io


def one(spark, kinds, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, kinds).select(column).collect()]


def test_race(spark):
    rows = [(1, 1), (2, 1), (6, 1), (1, 2), (3, 1), (7, 1), (9, 1), (None, 1), (1, None), (2, 24)]
    assert one(spark, "r int, h int", rows, recode.race_ethnicity(F.col("r"), F.col("h"))) == [1, 2, 3, 4, 5, 5, 5, 5, 1, 4]


def test_education(spark):
    rows = [(x,) for x in (5, 16, 19, 21, 23, 1, 15, 17, 18, 20, 22, 24, 25, None)]
    assert one(spark, "s double", [(None if x is None else float(x),) for (x,) in rows], recode.education(F.col("s"))) == [1, 2, 3, 4, 5, 1, 1, 2, 3, 3, 5, 5, 1, None]


def test_birthplace(spark):
    rows = [(x,) for x in (6, 1, 56, 57, 99, 100, 199, 200, 299, 300, 303, 399, 400, 599, None)]
    assert one(spark, "p int", rows, recode.birthplace(F.col("p"))) == [1, 2, 2, 7, 7, 4, 4, 5, 5, 6, 3, 6, 7, 7, 7]


def test_binarize_treats_missing_as_zero(spark):
    assert one(spark, "x double", [(50000.0,), (50001.0,), (None,), (float("nan"),)], recode.binarize(F.col("x"), 50000)) == [0, 1, 0, 0]


@pytest.mark.parametrize("n", [0, 1, 10, 257, 1000])
def test_split_is_exact_disjoint_and_stable(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    train, test = sampling.train_test_split(df, 0.7, 42)
    a, b = ({r[0] for r in x.collect()} for x in (train, test))
    assert len(a) == int(n * 0.7) and not a & b and len(a | b) == n
    assert a == {r[0] for r in sampling.train_test_split(df.repartition(5), 0.7, 42)[0].collect()}


def test_cut_narrows_down(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "row_id")
    whole = sorted(r[0] for r in sampling.sample_exact(df, 1234).collect())
    monkeypatch.setattr(sampling, "EDGE_ROWS", 1)
    monkeypatch.setattr(sampling, "_DIGITS", 1)
    assert sorted(r[0] for r in sampling.sample_exact(df, 1234).collect()) == whole and len(whole) == 1234


def test_sample_size(spark):
    df = spark.range(300).withColumnRenamed("id", "row_id")
    assert sampling.sample_exact(df, 77).count() == 77 and sampling.sample_exact(df, 1000).count() == 300


def test_folds_are_stratified(spark):
    df = spark.range(90).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = sampling.stratified_folds(df, "y", 3).groupBy("fold", "y").count().collect()
    assert {(r["y"], r["count"]) for r in got} == {(1, 10), (0, 20)}


def test_encoding(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", None), (None, 3.0), ("c", 5.0)], "k string, x double")
    names = encode.encoded(df, ["k", "x"])
    assert list(names) == ["k_b", "k_c", "x"]
    got = [tuple(r) for r in df.select(*[e.alias(n) for n, e in names.items()]).collect()]
    assert got == [(1.0, 0.0, 1.0), (0.0, 0.0, None), (0.0, 0.0, 3.0), (0.0, 1.0, 5.0)]
    assert encode.medians(df, ["x"]) == {"x": 3.0}
    assert encode.moments(df.withColumn("x", F.lit(2.0)), ["x"]) == {"x": (2.0, 1.0)}


def config(**change):
    base = {"name": "d", "data_path": "x", "target_variable": "t", "subgroup_column": "g", "categorical_columns": ["g"], "continuous_columns": ["x"]}
    return DatasetConfig(**(base | change))


@pytest.mark.parametrize("change", [{"categorical_columns": [], "continuous_columns": []}, {"train_fraction": 1.5}, {"target_binarize": {"source_column": "x"}}])
def test_bad_configs(change):
    with pytest.raises(ValueError):
        config(**change).validate()


def test_configs(spark):
    assert load_config(default_config_path()).target_binarize == {"source_column": "PINCP", "threshold": 50000}
    df = spark.createDataFrame([(1, "a")], "x int, g string")
    config(target_binarize={"source_column": "x", "threshold": 0}).validate_against_data(df)
    with pytest.raises(ValueError, match="Available"):
        config().validate_against_data(df)


def test_acs_preparation(spark, tmp_path):
    lines = [",".join(io.ACS_COLUMNS)] + [f"{17 + i % 40},{'' if i % 10 == 0 else 30000 + 1000 * i},{i % 2 + 1},{i % 5 + 1},{'' if i % 7 == 0 else i % 6},{i},{i % 9 + 1},{i % 3},{i % 25},{i * 7 % 500}" for i in range(200)]
    (tmp_path / "p.csv").write_text("\n".join(lines))
    train, test = experiment.preprocess_acs(io.read_acs(spark, str(tmp_path / "p.csv")), 100, 0.7, 42)
    assert (train.count(), test.count()) == (70, 30)
    assert train.columns == ["row_id", "AGEP", "PINCP", "SEX", "RACETH", "SCHL_RECODED", "MAR", "ESR", "POBP_RECODED", "PWGTP"]
    assert train.filter("AGEP < 18 OR PINCP IS NULL").count() == 0


def test_results_round_trip(spark, tmp_path):
    rows = [{"method": "a", "replicate": 1, "fidelity_auc": 0.5, "privacy_dcr": None}]
    io.write_results(rows, tmp_path / "r.csv")
    r = io.read_results(spark, str(tmp_path / "r.csv")).first()
    assert (r["method"], r["replicate"], r["fidelity_auc"], r["privacy_dcr"]) == ("a", 1, 0.5, None)
    io.write_summary(experiment.summary(spark.createDataFrame([("a", 0.1, 0.2, 0.3, 0.4)], "method string, fidelity_auc double, privacy_dcr double, utility_tstr double, fairness_gap double")), tmp_path / "s.csv")
    assert (tmp_path / "s.csv").read_text().splitlines()[3].startswith("a,0.1,,0.2")
