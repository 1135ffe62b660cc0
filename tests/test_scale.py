"""Ranks and quantiles of large tables come from bounded lookups and equal those of one sort; storage that cannot be shared is refused."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabassay.config import DatasetConfig
from tabassay.operators import encode, generators, measures, ranking, sampling
from tabassay.plans import decision


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(ranking, "EDGE_ROWS", 50)


def test_ranks_are_exact(spark, narrow):
    df = spark.range(3000).select(((F.col("id") * 7919) % 1009).cast("double").alias("x"), F.col("id").alias("row_id"))
    want = sorted(r["x"] for r in df.collect())
    for rank in (0, 1, 749, 1500, 2998, 2999):
        assert ranking.value_at(df, "x", rank, 3000) == want[rank]
    assert ranking.value_at(df.select(F.lit(4.0).alias("x")), "x", 1234, 3000) == 4.0


def test_quantiles_of_large_and_small_tables_agree(spark, monkeypatch):
    df = spark.range(2001).select(F.when(F.col("id") % 10 != 0, (F.col("id") * 31 % 977).cast("double")).alias("a"), (F.col("id") * F.col("id")).cast("double").alias("b"), F.lit(None).cast("double").alias("c"))
    small = [ranking.quantiles(df, ["a", "b", "c"], p) for p in (0.0, 0.05, 0.5, 1.0)]
    monkeypatch.setattr(ranking, "EDGE_ROWS", 50)
    large = [ranking.quantiles(df, ["a", "b", "c"], p) for p in (0.0, 0.05, 0.5, 1.0)]
    for one, other in zip(small, large, strict=True):
        assert one["c"] is None and other["c"] is None and one == pytest.approx(other)


def test_halves(spark, narrow):
    df = spark.range(1001).select((F.col("id") * 3).alias("row_id"))
    first, second = sampling.halves(df)
    assert first.count() == 500 and second.count() == 501 and first.agg(F.max("row_id")).first()[0] < second.agg(F.min("row_id")).first()[0]


def test_halves_of_null_and_repeated_ids(spark):
    ids = lambda *x: [sorted(r["row_id"] or -1 for r in h.collect()) for h in sampling.halves(spark.createDataFrame([(i,) for i in x], "row_id long"))]
    assert ids(1, 2, 3, None) == [[1, 2], [-1, 3]] and ids(1, None, None, None) == [[1], [-1, -1, -1]]
    assert ids(None, None) == [[], [-1, -1]] and ids(1, 2, 2, 2) == [[1], [2, 2, 2]]


def test_columns_of_too_many_values_are_refused(spark):
    df = spark.range(20_000).select(F.col("id").alias("row_id"), F.concat(F.lit("v"), "id").alias("name"))
    with pytest.raises(ValueError):
        encode.levels(df, ["name"])
    with pytest.raises(ValueError):
        generators.DPBayesianNetwork(1.0).fit(df)


def test_union_by_name(spark):
    both = measures.labelled(spark.range(2).select("id", F.lit(1).alias("x")), spark.range(3).select("id"), "label")
    assert sorted(map(str, both.collect())) == sorted(["Row(id=0, x=1, label=0)", "Row(id=1, x=1, label=0)", *[f"Row(id={i}, x=None, label=1)" for i in range(3)]])


def test_quantiles_of_columns_of_two_values(spark):
    df = spark.range(10_000_000).select((F.col("id") % 2).cast("double").alias("half"), F.when(F.col("id") % 10 < 4, 0.0).when(F.col("id") % 10 < 8, 1.0).otherwise(F.col("id") / 1e7).alias("edges"))
    assert ranking.quantiles(df, ["half", "edges"], 0.5) == {"half": 0.5, "edges": pytest.approx(0.5, abs=1e-6)}
    assert ranking.values_at(df, [("half", 4_999_999, 10_000_000), ("half", 5_000_000, 10_000_000), ("edges", 9_999_999, 10_000_000), ("edges", 0, 10_000_000)]) == [0.0, 1.0, 1.0, 0.0]


def test_frontier_of_many_points(spark, monkeypatch):
    monkeypatch.setattr(decision, "BUCKET_POINTS", 20)
    draw = [(float(i * 7919 % 211), float(i * 104729 % 197)) for i in range(1500)] + [(205.0, None), (None, None), (210.0, 3.0), (210.0, 3.0)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(draw)], "id int, x double, y double")
    got = {r["id"]: r["optimal"] for r in decision.frontier(df).collect()}
    beaten = lambda x, y: any(a is not None and b is not None and a >= x and b >= y and (a > x or b > y) for a, b in draw)
    assert got == {i: x is None or y is None or not beaten(x, y) for i, (x, y) in enumerate(draw)}


def test_settings_are_faulted_together():
    with pytest.raises(ValueError, match="train_fraction.*no categorical.*sample_size"):
        DatasetConfig("n", "p", "y", "g", [], [], train_fraction=1.0, sample_size=0).validate()


def test_quantiles_of_few_values_are_counted(spark, monkeypatch):
    monkeypatch.setattr(ranking, "EDGE_ROWS", 10)
    df = spark.range(1001).selectExpr("IF(id % 3 = 0, NULL, id % 5) AS a", "CAST(NULL AS DOUBLE) AS b", "IF(id = 7, DOUBLE('NaN'), id % 4D) AS c", "id * 1.5D AS d", "IF(id < 500, 0D, 1D) AS e").repartition(9)
    counts = ranking.value_counts(df, ["a", "b", "c", "d"])
    assert counts["a"] == dict(df.filter("a IS NOT NULL").groupBy("a").count().collect()) and counts["b"] == {} and len(counts["c"]) == 5 and "d" not in counts
    asked = []
    monkeypatch.setattr(ranking, "values_at", lambda df, sought, f=ranking.values_at: asked.extend(sought) or f(df, sought))
    assert ranking.quantiles(df, ["a", "b", "d", "e"], 0.5) == {"a": 2.0, "b": None, "d": 750.0, "e": 1.0}
    assert ranking.quantiles(df.filter("d != 1500"), ["e"], 0.5) == {"e": 0.5} and {c for c, _, _ in asked} == {"d"}
