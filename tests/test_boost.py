"""Trees and logistic weights for several training sets at once equal plain ones fitted one by one."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabassay.operators import boost, measures, metrics, network


def plain_boost(x, y, trees, depth, rate=0.1):
    """Gradient boosting by brute force over every cut; returns the chances of the training rows."""
    p = y.mean()
    f = np.full(len(y), np.log(p / (1 - p)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        r, v = y - p, p * (1 - p)

        def grow(rows, level, r=r, v=v):
            out = np.zeros(len(y))
            out[rows] = rate * r[rows].sum() / v[rows].sum()
            if level == depth or len(rows) < 2:
                return out
            best = None
            for j in range(x.shape[1]):
                values = np.unique(x[rows, j])
                for cut in (values[1:] + values[:-1]) / 2:
                    left = x[rows, j] <= cut
                    a, b = r[rows[left]], r[rows[~left]]
                    gain = len(a) * len(b) / len(rows) * (a.mean() - b.mean()) ** 2
                    if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = gain, j, cut
            if best is None:
                return out
            left = x[rows, best[1]] <= best[2]
            return np.where(np.isin(np.arange(len(y)), rows[left]), grow(rows[left], level + 1), np.where(np.isin(np.arange(len(y)), rows[~left]), grow(rows[~left], level + 1), 0))

        f = f + grow(np.arange(len(y)), 0)
    return 1 / (1 + np.exp(-f))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(200, 3)), 1)
    x[:, 2] = rng.integers(0, 2, 200)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 - x[:, 2] + rng.normal(size=200) > 0).astype(int)
    fold = np.arange(200) % 3
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i]), int(fold[i])) for i in range(200)], "row_id long, a double, b double, `c x` double, label int, fold int")
    return x, y, fold, df.repartition(4)


def use():
    """Models 0 to 2 leave a fold out, model 3 takes all rows."""
    return sum((F.when(F.col("fold") != k, F.lit(1 << k)).otherwise(0) for k in range(3)), F.lit(8))


def test_boosting_of_all_folds_equals_plain(spark, data):
    x, y, fold, df = data
    names = ["a", "b", "c x"]
    matrix = boost.Matrix(df, names, "label", use(), 4, "row_id", boost.cut_points(df, names))
    models = boost.boost(matrix, trees=25, depth=3)
    scored = {r["keep"]: r["score"] for r in matrix.scored().collect()}
    matrix.close()
    for m in range(4):
        on = np.flatnonzero(fold != m) if m < 3 else np.arange(200)
        want = plain_boost(x[on], y[on], 25, 3)
        assert [scored[i][m] for i in on] == pytest.approx(want, abs=1e-9)
    again = {r["row_id"]: (r["score0"], r["score3"]) for r in boost.predict(models, df, "row_id").collect()}
    assert all(again[i] == pytest.approx((scored[i][0], scored[i][3])) for i in range(200))
    assert list(models[3].importance())[0] == "a" and sum(models[3].importance().values()) == pytest.approx(1)


def test_logistic_of_all_folds_equals_plain(spark, data):
    x, y, fold, df = data
    matrix = boost.Matrix(df, ["a", "b", "c x"], "label", use(), 4)
    got = boost.logistic(matrix)
    matrix.close()
    for m in range(4):
        on = fold != m if m < 3 else np.ones(200, bool)
        a, w = np.c_[x[on], np.ones(on.sum())], np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-a @ w))
            w = w - np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag([1, 1, 1, 0]), a.T @ (p - y[on]) + np.r_[w[:3], 0])
        assert got[m] == pytest.approx(w, abs=1e-8)


def test_many_tasks_are_added_up_by_key(spark, data, monkeypatch):
    x, y, fold, df = data
    names = ["a", "b", "c x"]
    cuts = boost.cut_points(df, names)
    out = []
    monkeypatch.setattr(boost, "TASK_ROWS", 10)
    for few in (64, 1):
        monkeypatch.setattr(boost, "FEW_TASKS", few)
        matrix = boost.Matrix(df, names, "label", use(), 4, "row_id", cuts)
        boost.boost(matrix, trees=3, depth=2)
        out.append({r["keep"]: r["score"] for r in matrix.scored().collect()})
        matrix.close()
    assert all(out[0][i] == pytest.approx(out[1][i]) for i in range(200))


def test_degenerate_tables(spark, data):
    df = data[3]
    one = df.filter("label = 1")
    matrix = boost.Matrix(one, ["a"], "label", F.lit(1), 1, "row_id", boost.cut_points(one, ["a"]))
    boost.boost(matrix, trees=2)
    assert all(r["score"][0] > 0.999 for r in matrix.scored().collect())
    matrix.close()
    matrix = boost.Matrix(df.filter("false"), ["a"], "label", F.lit(1), 1, "row_id", [np.array([0.5])])
    assert boost.boost(matrix, trees=2)[0].prior == 0 and matrix.scored().count() == 0
    matrix.close()


def test_bins_of_many_values(spark):
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    wide, narrow = boost.cut_points(df, ["x", "y"])
    assert 200 < len(wide) <= 255 and narrow.tolist() == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5]
    assert boost.binned(np.array([[0.0, 0.0], [4999.0, 6.0]]), [wide, narrow]).tolist() == [[0, 0], [len(wide), 6]]


def test_network_gradient_equals_differences():
    rng = np.random.default_rng(3)
    layers = (3, 4, 2, 1)
    w, x, y = network.initial(layers, 1), rng.normal(size=(9, 3)), rng.integers(0, 2, 9)

    def loss(w):
        f = network.margins(x, w, layers)
        squares = sum((p * p).sum() for p in network._split(w, layers)[::2])
        return (np.logaddexp(0, f) - y * f).mean() + network.DECAY / len(y) * squares / 2

    g, _ = network.gradient(x, y, w, layers)
    for i in rng.integers(0, len(w), 12):
        step = np.zeros(len(w))
        step[i] = 1e-6
        assert g[i] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, abs=1e-6)


def test_networks_of_all_folds_learn(spark, data):
    x, y, fold, df = data
    matrix = boost.Matrix(df, ["a", "b", "c x"], "label", use(), 4, "row_id")
    weights, layers = network.train(matrix, (16, 8), epochs=150)
    scored = {r["keep"]: r["score"] for r in matrix.scored(network.Networks(weights, layers)).collect()}
    matrix.close()
    for m in range(3):
        held = np.flatnonzero(fold == m)
        assert np.mean([(scored[i][m] > 0.5) == y[i] for i in held]) > 0.65
    assert weights.shape[0] == 4 and np.mean([(scored[i][3] > 0.5) == y[i] for i in range(200)]) > 0.75


def test_equal_binned_rows_are_stored_once(spark):
    x = np.array([[i % 4, i // 4 % 3] for i in range(240)], float)
    y = np.array([int(i % 4 > 1) ^ int(i % 7 == 0) for i in range(240)])
    df = spark.createDataFrame([(*map(float, x[i]), int(y[i])) for i in range(240)], "a double, b double, label int").repartition(4)
    matrix = boost.Matrix(df, ["a", "b"], "label", F.lit(1), 1, cuts=boost.cut_points(df, ["a", "b"]))
    assert matrix.blocks.agg(F.sum("n")).first()[0] == 24
    boost.boost(matrix, trees=6, depth=2)
    got = sorted((r["label"], r["score"][0]) for r in matrix.scored().collect())
    matrix.close()
    want = sorted(zip(y.tolist(), plain_boost(x, y, 6, 2), strict=True))
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)


def test_few_different_rows_are_boosted_in_one_job(spark, data, monkeypatch):
    """Trees of tasks and of passes are the same, and no pass is made for few different rows."""
    df, names = data[3], ["a", "b", "c x"]
    cuts, out = boost.cut_points(df, names), []
    for cells in (boost.SMALL_CELLS, 0):
        monkeypatch.setattr(boost, "SMALL_CELLS", cells)
        matrix = boost.Matrix(df, names, "label", use(), 4, "fold", cuts)
        models = boost.boost(matrix, trees=12, depth=3)
        assert (matrix.held is None) == (cells > 0)
        scored = matrix.scored(counted=True).collect()
        assert sum(r["n"] for r in scored) == 200
        out.append((models, sorted((r["label"], r["keep"], r["n"], [round(s, 9) for s in r["score"]]) for r in scored)))
        matrix.close()
    (one, ours), (other, theirs) = out
    assert ours == theirs
    for a, b in zip(one, other, strict=True):
        assert a.prior == pytest.approx(b.prior) and a.importance() == pytest.approx(b.importance())
        assert all(x.feature.tolist() == y.feature.tolist() and x.cut.tolist() == y.cut.tolist() and x.value == pytest.approx(y.value) for x, y in zip(a.trees, b.trees, strict=True))


def test_auc_of_counted_rows(spark):
    rows = [(1, 0.5, 3), (0, 0.5, 2), (1, 0.9, 4), (0, 0.1, 5)]
    df = spark.createDataFrame(rows, "label int, score double, n long")
    long = spark.createDataFrame([(y, s) for y, s, n in rows for _ in range(n)], "label int, score double")
    assert metrics.auc(df, count="n").first()["auc"] == pytest.approx(metrics.auc(long).first()["auc"])


def test_rows_not_trained_on_are_scored_by_their_bins(spark, data):
    df, names = data[3], ["a", "b", "c x"]
    train, held = df.filter("fold = 0"), df.filter("fold > 0")
    matrix = boost.Matrix(train, names, "label", F.lit(1), 1, cuts=boost.cut_points(train, names))
    (model,) = boost.boost(matrix, trees=5, depth=2)
    matrix.close()
    want = metrics.auc(boost.predict([model], held, "label")).first()["auc"]
    assert 0.5 < want < 1 and measures._judged(model, held, names) == pytest.approx(want, abs=1e-12)


def test_cut_points_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 1000, 40_000), 2)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "few": x % 7 // 1, "all": 1.0})).repartition(3)
    cuts = [boost.cut_points(df.repartition(k), ["x", "few", "all"]) for k in (1, 60)]
    assert all((a == b).all() for a, b in zip(*cuts, strict=True))
    wanted = np.unique(np.sort(x)[[-(-k * len(x) // 256) - 1 for k in range(1, 256)]])
    assert (cuts[0][0] == wanted).all() and list(cuts[0][1]) == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5] and not len(cuts[0][2])


def test_equal_rows_of_a_task_are_added_up(spark):
    rows = spark.range(30_000).selectExpr("id % 3 AS a", "CAST(id % 2 AS INT) AS label").coalesce(2)
    cuts = boost.cut_points(rows, ["a"])
    plain = rows.selectExpr("label", "2L AS use", "0 AS keep", "CAST(a AS DOUBLE) AS f0")
    batches = plain.mapInArrow(partial(boost._coded, width=1, cuts=cuts), "y int, use long, keep int, x binary, c long")
    assert batches.count() == 12 and batches.agg({"c": "sum"}).first()[0] == 30_000
