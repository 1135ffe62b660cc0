"""The conditional network and the row language model: dependences, determinism, values and types of the source."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabassay.functions.rng import normal, uniform
from tabassay.functions.rng import order_key
from tabassay.operators import gan, generators, measures, rowlm




@pytest.fixture(scope="module")
def linked(spark):
    """kind decides the mode of x and, mostly, colour; y follows x; z and some x are missing."""
    u = uniform(F.col("row_id"), "kind")
    df = spark.range(1500).withColumnRenamed("id", "row_id").withColumn("kind", F.when(u < 0.6, "a").when(u < 0.9, "b").otherwise("c"))
    centre = F.when(F.col("kind") == "a", 0.0).when(F.col("kind") == "b", 60.0).otherwise(-50.0)
    df = df.withColumn("x", F.when(uniform(F.col("row_id"), "gone") > 0.05, centre + 5 * normal(F.col("row_id"), "x")))
    colour = F.when(uniform(F.col("row_id"), "same") < 0.9, F.translate("kind", "abc", "rgb")).otherwise("w")
    return df.select("row_id", "kind", "x", colour.alias("colour"), F.round(F.coalesce("x", F.lit(0.0)) * 2 + 3 * normal(F.col("row_id"), "y")).cast("int").alias("y"), F.lit(None).cast("date").alias("z")).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_mixture_finds_modes():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 6000), rng.normal(50, 2, 3000)])
    counts, edges = np.histogram(x, 4096)
    mean, scale, weight = gan.mixture((edges[1:] + edges[:-1]) / 2, counts.astype(float))
    assert weight.sum() == pytest.approx(1) and weight[mean > 25].sum() == pytest.approx(1 / 3, abs=0.01)
    assert (np.abs(mean[mean > 25] - 50) < 6).all() and (scale > 0).all()
    one = gan.mixture(np.array([7.0]), np.array([5.0]))
    assert one[0].tolist() == [7.0]


def test_network_gradients_equal_differences():
    layout = gan.Layout([gan.Column("x", None, np.zeros(2), np.ones(2), np.ones(2) / 2), gan.Column("c", ["a", "b"])], [np.array([3.0, 1.0])])
    net, rng = gan.Network(layout, 5, 3, 1), np.random.default_rng(2)
    net.critic, net.generator = ([p.astype(np.float64) for p in ps] for ps in (net.critic, net.generator))
    c, which, category = gan.conditions(layout, rng, 6, layout.log_chance)
    real, fake, mix = rng.random((6, layout.width + 2)), rng.random((6, layout.width + 2)), rng.random((6, 1))
    z, gumbel = rng.standard_normal((6, 3)), rng.gumbel(size=(6, layout.width))

    def critic_loss():
        g = net.slope(net.judge(mix * real + (1 - mix) * fake)[1])[0]
        return net.judge(fake)[0].mean() - net.judge(real)[0].mean() + net.PENALTY * ((np.sqrt((g * g).sum(axis=1)) - 1) ** 2).mean()

    def generator_loss():
        o = net.raw(z, c)[0]
        lo, hi = layout.blocks[1]
        p = gan._softmax(o[:, lo:hi])[np.arange(6), category]
        return -net.judge(np.concatenate([net.active(o, gumbel), c], axis=1))[0].mean() - np.log(p).mean()

    for loss, parameters, gradient in ((critic_loss, net.critic, net.critic_gradient(real, fake, mix, 6)), (generator_loss, net.generator, net.generator_gradient(z, c, gumbel, which, category, 6))):
        for p, g in zip(parameters, gradient, strict=True):
            at = tuple(rng.integers(s) for s in p.shape)
            old, h = p[at], 1e-6
            p[at] = old + h
            up = loss()
            p[at] = old - h
            down = loss()
            p[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * h), abs=2e-3, rel=2e-3)


def test_gan_does_not_depend_on_tasks(spark, linked):
    one, four = (gan.ConditionalGAN(2, 5, 32, tasks=k, units=4).fit(linked.repartition(k)).sample(40) for k in (1, 4))
    assert rows(one) == rows(four) and one.dtypes == linked.dtypes


def test_gan_is_closer_than_marginals(linked):
    found = {}
    for name, maker in (("gan", gan.ConditionalGAN(30, 50, 128)), ("marginals", generators.IndependentMarginals(42))):
        synthetic = maker.fit(linked).sample(1500).cache()
        found[name] = measures.propensity_auc(linked.drop("z"), synthetic.drop("z"), n_estimators=20, importance=False)["auc"]
        if name == "gan":
            kinds = {r["kind"]: r["n"] for r in synthetic.groupBy("kind").agg(F.count("*").alias("n")).collect()}
            assert set(kinds) == {"a", "b", "c"} and synthetic.filter("z IS NOT NULL").count() == 0
            assert synthetic.filter("x IS NULL").count() > 0
    assert found["gan"] < found["marginals"]


def test_row_model_keeps_values_and_shares(spark, linked):
    model = rowlm.RowLanguageModel().fit(linked)
    got = model.sample(3000).cache()
    assert got.columns == linked.columns and got.dtypes == linked.dtypes and got.count() == 3000
    for c in ("kind", "x", "colour", "y", "z"):
        assert got.select(c).exceptAll(got.select(c).join(linked.select(c).distinct(), got[c].eqNullSafe(linked[c]), "left_semi").select(got[c])).count() == 0
    # Colours of each kind against the source's shares, widened by what backing off mixes in.
    share = {(r["kind"], r["colour"]): r["n"] for r in linked.groupBy("kind", "colour").agg(F.count("*").alias("n")).collect()}
    have = {(r["kind"], r["colour"]): r["n"] for r in got.groupBy("kind", "colour").agg(F.count("*").alias("n")).collect()}
    for kind, colour, limit in (("a", "r", 15.1), ("b", "g", 15.1)):
        n, m = sum(v for (k, _), v in share.items() if k == kind), sum(v for (k, _), v in have.items() if k == kind)
        p = share[kind, colour] / n
        own = have.get((kind, colour), 0)
        assert (own - m * p) ** 2 / (m * p) + (own - m * p) ** 2 / (m * (1 - p)) < limit + m * 0.02
    auc = lambda df: measures.propensity_auc(linked.drop("z"), df.drop("z"), n_estimators=20, importance=False)["auc"]
    assert auc(got.limit(1500)) < auc(generators.IndependentMarginals(42).fit(linked).sample(1500))


def test_row_model_does_not_depend_on_partitions(spark, linked):
    a, b = (rowlm.RowLanguageModel(random_state=3).fit(linked.repartition(k)).sample(50) for k in (1, 5))
    assert rows(a) == rows(b)


def test_rows_at_ranks_are_those_of_a_full_ranking(spark):
    """A looked-up rank gives the row that ranking every row gives, broadcast or not."""
    order = [order_key(F.col("row_id"), "c", 1), F.col("row_id")]
    source = spark.range(6000).select((F.col("id") % 3).alias("key"), F.pmod(F.xxhash64(order_key(F.col("id"), "c", 1), "id"), F.lit(64)).alias("_b"), F.col("id").alias("row_id"), (F.col("id") * 7).alias("v"), F.lit("x").alias("t"))
    drawn = spark.createDataFrame([(i, i % 3, 1 + i * 661 % 2000) for i in range(9)] + [(9, 0, 2000), (10, 1, 1), (11, 1, 1)], "row_id long, key long, _r long")
    ranked = generators.indexed(source.drop("_b"), order, ["key"], 64)
    want = drawn.join(ranked.select("key", F.col("i").cast("long").alias("_r"), "v", "t"), ["key", "_r"]).select("row_id", "v", "t")
    for near in (True, False):
        got = rowlm._picked(source, drawn, order, near)
        assert sorted(map(tuple, got.select("row_id", "v", "t").collect())) == sorted(map(tuple, want.collect()))
