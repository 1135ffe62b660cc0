"""The library's operators as queries over the driver tables; oracle.py has their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabassay.constants import METHODS, PROFILES

from tabassay.functions.rng import uniform
from tabassay.operators import encode, gan, generators, linking, measures, metrics, rowlm, sampling
from tabassay.plans import decision as D
from tabassay.plans import experiment, plotdata
from tabassay.plans import simulation as V
from tabassay.plans import statistics as S
from tabassay.sources import io
from tabassay.streaming.results import running_means

Query = Callable[[SparkSession, str], DataFrame]
#: Order priorities stand for the five methods, in their order.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so that the order of summation does not show; minus zero is zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 rows in the shape of an experiment: orders and their lines by priority (method) and order key (replicate)."""
    method = F.lit(None).cast("string")
    for p, m in zip(PRIORITIES, METHODS, strict=True):
        method = F.when(F.col("o_orderpriority") == p, m).otherwise(method)
    both = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    returned = F.avg((F.col("l_returnflag") == "R").cast("double"))
    return both.groupBy(method.alias("method"), ((F.col("o_orderkey") % 5).cast("int") + 1).alias("replicate")).agg(
        (F.avg("l_discount") * 10).alias("fidelity_auc"), F.avg("l_tax").alias("privacy_dcr"), (F.avg("l_quantity") / 50).alias("utility_tstr"), F.abs(returned - F.lit(1.0) / 3).alias("fairness_gap")
    )


def flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """results() with missing gaps in replicate 2 and a constant utility of one method."""
    return results(spark, sf_dir).withColumns({"fairness_gap": F.when(F.col("replicate") != 2, F.col("fairness_gap")), "utility_tstr": F.when(F.col("method") == "dpbn", 0.5).otherwise(F.col("utility_tstr"))})


def micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-level microdata: row_id, price, age (part size like), segment, status, target."""
    orders, customer = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"), F.coalesce("c_mktsegment", F.lit("NONE")).alias("segment"),
        F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 50).alias("age"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person records in the census shape, spread over every branch of the recodes."""
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        k.alias("row_id"), (F.col("p_size") + 2).cast("int").alias("AGEP"), F.when(k % 11 != 0, F.col("p_retailprice") * 40).alias("PINCP"), (k % 2 + 1).cast("int").alias("SEX"), (k % 5 + 1).cast("int").alias("MAR"),
        F.when(k % 6 != 0, (k % 6).cast("double")).alias("ESR"), (k % 90 + 1).cast("int").alias("PWGTP"), F.when(k % 13 != 0, (k % 9 + 1).cast("int")).alias("RAC1P"),
        F.when(k % 17 != 0, F.when(k % 4 == 0, 2).otherwise(1)).alias("HISP"), F.when(k % 19 != 0, (k % 26).cast("double")).alias("SCHL"), F.when(k % 23 != 0, (k % 600).cast("int")).alias("POBP"),
    )


def vectors(spark: SparkSession, sf_dir: str, n: int = 64) -> tuple[DataFrame, DataFrame, list[str]]:
    """(train, synthetic, features): even and odd vectors on all their components."""
    names = [f"f{i}" for i in range(n)]
    flat = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    return flat.filter("row_id % 2 = 0"), flat.filter("row_id % 2 = 1"), names


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-level label, score and two predictions from fixed expressions, with the ship mode's stand-in as subgroup."""
    line = load(spark, sf_dir, "lineitem")
    return line.select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_discount") * 10).alias("score"), F.col("l_linestatus").alias("group"),
        (F.col("l_quantity") > 25).cast("int").alias("pred_real"), (F.col("l_tax") > 0.035).cast("int").alias("pred_synth"), F.concat("l_linestatus", F.lit("-"), (F.col("l_suppkey") % 4).cast("string")).alias("subgroup"),
    )


def _res(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: r6(make(results(spark, d)))


def _nearest(metric: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        train, synthetic, names = vectors(spark, d)
        return r6(linking.nearest(synthetic, train, names, metric))

    return query


def _pivoted(spark: SparkSession, d: str) -> DataFrame:
    train, synthetic, names = vectors(spark, d)
    return r6(linking.blocked_nearest(synthetic, train.withColumnRenamed("row_id", "_t"), names, "euclidean"))


def _dcr_summary(spark: SparkSession, d: str) -> DataFrame:
    train, synthetic, names = vectors(spark, d)
    return r6(linking.dcr_summary(linking.nearest(synthetic, train, names)))


def _typical(spark: SparkSession, d: str) -> DataFrame:
    train, _, names = vectors(spark, d)
    return r6(linking.pairwise_sample(train, names).agg(F.count("*").alias("pairs"), F.percentile("d", F.lit(0.5)).alias("typical_distance")))


def _dcr_privacy(spark: SparkSession, d: str) -> DataFrame:
    train, synthetic, _ = vectors(spark, d)
    return r6(measures.dcr_privacy(train, synthetic).select("dcr_percentile", "dcr_mean", "typical_distance", "privacy_score"))


def _one_hot(spark: SparkSession, d: str) -> DataFrame:
    df = micro(spark, d)
    return df.select("row_id", *[e.alias(n.replace(" ", "_")) for n, e in encode.encoded(df, ["segment", "status"]).items()])


def _median_fill(spark: SparkSession, d: str) -> DataFrame:
    df = micro(spark, d).select("row_id", "age", "price")
    return r6(encode.fill(df, encode.medians(df, ["age", "price"])).select("row_id", F.col("age").cast("double").alias("age"), "price"))


def _zscore(spark: SparkSession, d: str) -> DataFrame:
    df = micro(spark, d).select("row_id", "price", "age")
    return r6(encode.scaled(df, encode.moments(df, ["price", "age"])))


def _sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_exact(micro(spark, d).select("row_id", "segment"), 500, 42)


def _split(spark: SparkSession, d: str) -> DataFrame:
    train, test = sampling.train_test_split(micro(spark, d).select("row_id", "segment"), 0.7, 42)
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))


def _folds(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_folds(micro(spark, d).select("row_id", "status"), "status", 3, 42)


def _ordered_folds(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_folds(micro(spark, d).select("row_id", "status"), "status", 5, shuffle=False)


def _halves(spark: SparkSession, d: str) -> DataFrame:
    a, b = sampling.halves(micro(spark, d).select("row_id"))
    return a.withColumn("half", F.lit(1)).union(b.withColumn("half", F.lit(2)))


def _recoded(spark: SparkSession, d: str) -> DataFrame:
    return experiment.select_and_recode(records(spark, d))


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return experiment.select_and_recode(experiment.filter_valid_income(experiment.filter_adults(records(spark, d))))


def _preprocess(spark: SparkSession, d: str) -> DataFrame:
    train, test = experiment.preprocess_acs(records(spark, d), 900, 0.7, 42)
    return train.select("row_id", F.lit("train").alias("part")).union(test.select("row_id", F.lit("test").alias("part")))


def _binarized(spark: SparkSession, d: str) -> DataFrame:
    return measures.with_target(micro(spark, d).select("row_id", "age"), "target", {"source_column": "age", "threshold": 25})


def _marginals_fit(spark: SparkSession, d: str) -> DataFrame:
    df = micro(spark, d)
    out = [generators.frequencies(df.withColumn(c, F.col(c).cast("string")), c).withColumn("column_name", F.lit(c)) for c in ("segment", "status")]
    return r6(out[0].union(out[1]))


def _marginals_sample(spark: SparkSession, d: str) -> DataFrame:
    return generators.IndependentMarginals(42).fit_sample(micro(spark, d).select("row_id", "segment", "status"), 1000)


def _marginals_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return generators.IndependentMarginals(42).fit_sample(micro(spark, d).select("row_id", "price", "age"), 1000)


def _mutual_information(spark: SparkSession, d: str) -> DataFrame:
    df = micro(spark, d)
    return r6(generators.mutual_information(df, ["segment"], ["status"]))


def _privbayes(spark: SparkSession, d: str) -> DataFrame:
    return generators.DPBayesianNetwork(1.0, 2, random_state=42).fit_sample(micro(spark, d).select("row_id", "segment", "status", "price", "age"), 500)


def _cart(spark: SparkSession, d: str) -> DataFrame:
    return generators.SequentialCART(5).fit_sample(micro(spark, d).select("row_id", "segment", "status", "price"), 500)


def _conditional_gan(spark: SparkSession, d: str) -> DataFrame:
    return gan.ConditionalGAN(random_state=42).fit_sample(micro(spark, d), 500)


def _row_language_model(spark: SparkSession, d: str) -> DataFrame:
    return rowlm.RowLanguageModel(random_state=42).fit_sample(micro(spark, d), 500)


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, synthetic) with a target; the synthetic table, as long as train, is drawn from the marginals."""
    df = micro(spark, d).select("row_id", "segment", "status", "balance", (F.col("price") > 250_000).cast("int").alias("target"))
    train, test = (part.cache() for part in sampling.train_test_split(df, 0.7, 42))
    return train, test, generators.IndependentMarginals(42).fit_sample(train, train.count()).cache()


def _row(spark: SparkSession, found: dict, *names: str) -> DataFrame:
    return spark.createDataFrame([tuple(None if found[n] is None else float(found[n]) for n in names)], ", ".join(f"{n} double" for n in names))


def _propensity(spark: SparkSession, d: str) -> DataFrame:
    train, _, synthetic = _tables(spark, d)
    return _row(spark, measures.propensity_auc(train, synthetic), "auc", "auc_fidelity")


def _propensity_robust(spark: SparkSession, d: str) -> DataFrame:
    train, _, synthetic = _tables(spark, d)
    return _row(spark, measures.propensity_auc_robustness(train, synthetic), "gbt_auc", "lr_auc", "mlp_auc")


def _propensity_holdout(spark: SparkSession, d: str) -> DataFrame:
    train, test, synthetic = _tables(spark, d)
    return _row(spark, measures.propensity_auc_holdout(train, test, synthetic), "auc", "auc_fidelity")


def _propensity_linear(spark: SparkSession, d: str) -> DataFrame:
    train, _, synthetic = _tables(spark, d)
    return _row(spark, measures.propensity_auc(train, synthetic, kind="lr"), "auc", "auc_fidelity")


def _membership(spark: SparkSession, d: str) -> DataFrame:
    found = measures.membership_inference_privacy(*_tables(spark, d))
    return _row(spark, found, "attack_success_rate", "attack_auc", "mean_membership_confidence")


def _membership_records(spark: SparkSession, d: str) -> DataFrame:
    return measures.membership_inference_per_record(*_tables(spark, d))


def _utility(kind: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        train, test, synthetic = _tables(spark, d)
        return _row(spark, measures.tstr_utility(train, synthetic, test, "target", kind), "f1_real", "f1_synthetic", "f1_ratio", "auc_real", "auc_synthetic", "utility_score")

    return query


def _fairness(spark: SparkSession, d: str) -> DataFrame:
    train, test, synthetic = _tables(spark, d)
    return measures.compare_fairness_across_methods(train, {"independent_marginals": synthetic}, test, "target", "segment", 20)


def _propensity_training(spark: SparkSession, d: str) -> DataFrame:
    train, _, synthetic = _tables(spark, d)
    return _row(spark, measures.propensity_auc_no_cv(train, synthetic), "auc", "auc_fidelity")


def _subgroup_utility(spark: SparkSession, d: str) -> DataFrame:
    train, test, synthetic = _tables(spark, d)
    return measures.tstr_utility_per_subgroup(train, synthetic, test, "target", "segment", 20)["table"]


def _compared_dcr(spark: SparkSession, d: str) -> DataFrame:
    train, synthetic, names = vectors(spark, d)
    tables = {"odd": synthetic, "copies": train.withColumn(names[0], F.col(names[0]) + F.lit(0.0))}
    return r6(measures.compare_dcr_distributions(train, tables).select("method", "dcr_percentile", "dcr_mean", "dcr_min", "n_synthetic", "typical_distance", "privacy_score"))


def _dcr_records(spark: SparkSession, d: str) -> DataFrame:
    train, synthetic, _ = vectors(spark, d)
    return r6(measures.dcr_privacy_per_record(train, synthetic, normalize=False).select("row_id", "dcr", "closest_train_id"))


def _appended(spark: SparkSession, d: str) -> DataFrame:
    """Real and synthetic rows by column name, labelled; a column that one side lacks is null."""
    df = micro(spark, d)
    return measures.labelled(df.select("row_id", "segment", "age"), df.select("segment", "row_id"), "label")


def _auc(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.auc(classified(spark, d)))


def _auc_by(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.auc(classified(spark, d), by=["group"]))


def _subgroups(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.by_subgroup(classified(spark, d), "subgroup", 7500))


def _fairness_rows(spark: SparkSession, d: str) -> DataFrame:
    df = classified(spark, d)
    whole = df.agg(metrics.f1(F.col("pred_real"), F.col("label")).alias("r"), metrics.f1(F.col("pred_synth"), F.col("label")).alias("s")).select((F.col("s") / F.col("r")).alias("overall"))
    table = metrics.by_subgroup(df, "subgroup", 100).crossJoin(F.broadcast(whole))
    return r6(metrics.gaps(table, F.col("overall")))


def _membership_rates(spark: SparkSession, d: str) -> DataFrame:
    df = classified(spark, d).withColumn("p", F.col("score"))
    return r6(df.groupBy("group").agg(metrics.membership_rates(df).alias("rate")).withColumn("privacy_score", F.lit(1.0) - F.lit(2.0) * F.abs(F.col("rate") - 0.5)))


def _efficiency(column: str, expression: Callable[[], object]) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        df = results(spark, d)
        return r6(D.method_scores(df.withColumn(column, expression()) if column else df).filter("metric = 'efficiency_time'").select("method", "mean"))

    return query


def _pending(spark: SparkSession, d: str) -> DataFrame:
    runs = results(spark, d).select(F.concat("method", F.lit("_rep"), F.col("replicate").cast("string")).alias("run_id"), "replicate")
    return io.pending_runs(runs, runs.filter("replicate <= 3").select("run_id"))


def _pairs(df: DataFrame) -> DataFrame:
    return S.pairwise(df).select("metric", "method_1", "method_2", "n_1", "n_2", "mean_diff", "t", "u", "cohens_d", "effect")


def _p_values(df: DataFrame) -> DataFrame:
    return S.pairwise(df).select("metric", "method_1", "method_2", "t_p", "t_significant", "mw_p", "mw_significant", "adjusted_alpha")


def _uniforms(spark: SparkSession, d: str) -> DataFrame:
    return r6(load(spark, d, "orders").select("o_orderkey", uniform(F.col("o_orderkey"), "salt", 42).alias("u")))


def _value_scores(how: str) -> Query:
    return _res(lambda df: D.value_scores(df, how))


QUERIES: dict[str, Query] = {
    "method_means": _res(D.wide_means),
    "method_means_std": _res(lambda df: D.method_scores(df, False)),
    "summary_rounded": lambda s, d: experiment.summary(results(s, d)),
    "descriptive_ci": _res(S.descriptive),
    "quality_issues": lambda s, d: S.quality_issues(flawed(s, d)),
    "means_with_missing": lambda s, d: r6(D.wide_means(flawed(s, d))),
    "efficiency_default": _efficiency("", lambda: None),
    "efficiency_minutes": _efficiency("generation_time_min", lambda: F.col("replicate") * F.lit(2.0)),
    "efficiency_seconds": _efficiency("generation_time_sec", lambda: F.col("replicate") * F.lit(90.0)),
    "efficiency_given": _efficiency("efficiency_time", lambda: F.col("replicate") + F.lit(0.5)),
    "normalize_minmax": _res(lambda df: D.normalize(D.method_scores(df))),
    "normalize_zscore": _res(lambda df: D.normalize(D.method_scores(df), "zscore")),
    "weighted_scores": _res(lambda df: D.weighted(D.normalize(D.method_scores(df)), D.profile_table(df.sparkSession))),
    "rank_balanced": _res(lambda df: D.recommend(df, {"balanced": PROFILES["balanced"]})),
    "rank_all_profiles": _res(D.recommend),
    "rank_zscore": _res(lambda df: D.recommend(df, normalization="zscore")),
    "top2_advantage": _res(lambda df: D.leaders(D.recommend(df))),
    "sensitivity_sweep": _res(lambda df: D.sensitivity(D.normalize(D.method_scores(df)), PROFILES["balanced"], "privacy")),
    "value_functions_reference": _value_scores("reference"),
    "value_functions_auto": _value_scores("auto"),
    "value_functions_minmax": _value_scores("minmax"),
    "value_profile_scores": _res(lambda df: D.rank_methods(D.profile_scores(D.value_scores(df, "minmax")))),
    "value_form_sensitivity": _res(lambda df: D.value_form_sensitivity(df, PROFILES["balanced"])),
    "tornado": _res(lambda df: D.tornado(D.value_scores(df, "minmax"))),
    "collapsed_profiles": _res(lambda df: D.correlation_adjusted(D.value_scores(df, "minmax"))[0]),
    "breakeven_collapsed": _res(lambda df: D.breakeven(D.value_scores(df, "minmax"))),
    "pareto_privacy_fidelity": _res(D.pareto_privacy_fidelity),
    "pareto_fidelity_utility": _res(D.pareto_fidelity_utility),
    "pareto_fidelity_utility_legacy": _res(lambda df: D.pareto_fidelity_utility(df, legacy=True)),
    "mc_optimality": _res(lambda df: V.monte_carlo_optimality(df)),
    "voi_method_values": _res(V.method_values),
    "voi_strategies": _res(lambda df: V.strategies(V.method_values(df))),
    "voi_s3_mc": _res(lambda df: V.rough_estimates(V.method_values(df))),
    "voi_oracle_mc": _res(lambda df: V.oracle_values(df)),
    "voi_decomposition": _res(lambda df: V.value_of_information(df)),
    "inflation_sensitivity": _res(lambda df: V.inflation_sensitivity(df)),
    "inflation_verdict": _res(lambda df: V.inflation_verdict(V.inflation_sensitivity(df))),
    "anova_kruskal": _res(lambda df: S.omnibus(df).select("metric", "anova_f", "kruskal_h", "eta_squared", "effect", "n_groups")),
    "omnibus_p_values": _res(lambda df: S.omnibus(df).select("metric", "anova_p", "kruskal_p")),
    "levene_w": _res(lambda df: S.levene(df).select("metric", "statistic")),
    "pairwise_t_u_d": _res(_pairs),
    "pairwise_p_values": _res(_p_values),
    "middle_tier_pairs": _res(lambda df: S.middle_tier(df)[0].select("metric", "method_1", "method_2", "mean_1", "mean_2", "t", "u", "cohens_d", "adjusted_alpha")),
    "middle_tier_counts": _res(lambda df: S.middle_tier(df)[1]),
    "correlation_means": _res(lambda df: S.mean_correlations(df).select("metric_1", "metric_2", "n", "pearson", "spearman", "expected_low", "expected_high", "within_expected", "high_correlation")),
    "correlation_replicates": _res(lambda df: S.replicate_correlations(df).select("metric_1", "metric_2", "n", "pearson", "spearman")),
    "correlation_with_missing": lambda s, d: r6(S.replicate_correlations(flawed(s, d)).select("metric_1", "metric_2", "n", "pearson", "spearman")),
    "shapiro": _res(S.normality),
    "recode_case_ladder": _recoded,
    "prepared_records": _prepared,
    "preprocess_sample_split": _preprocess,
    "distinct_counts": lambda s, d: experiment.distinct_counts(_recoded(s, d)),
    "binarize_target": _binarized,
    "sample_exact": _sample,
    "train_test_split": _split,
    "stratified_kfold": _folds,
    "ordered_kfold": _ordered_folds,
    "position_halves": _halves,
    "one_hot_drop_first": _one_hot,
    "median_fill": _median_fill,
    "zscore_scale": _zscore,
    "uniform_draws": _uniforms,
    "marginals_fit": _marginals_fit,
    "marginals_sample": _marginals_sample,
    "marginals_bootstrap": _marginals_bootstrap,
    "mutual_information": _mutual_information,
    "privbayes_sample": _privbayes,
    "cart_sample": _cart, "gan_sample": _conditional_gan, "row_lm_sample": _row_language_model,
    "dcr_nn_per_record": _nearest("euclidean"),
    "dcr_cityblock": _nearest("manhattan"),
    "dcr_cosine": _nearest("cosine"),
    "dcr_pivoted": _pivoted,
    "dcr_summary": _dcr_summary,
    "typical_distance": _typical,
    "dcr_privacy": _dcr_privacy,
    "dcr_compared": _compared_dcr,
    "dcr_per_record_measure": _dcr_records,
    "union_by_name": _appended,
    "running_means": _res(running_means),
    "auc_exact_ranks": _auc,
    "auc_by_group": _auc_by,
    "f1_by_subgroup": _subgroups,
    "fairness_gap_from_predictions": _fairness_rows,
    "mi_rates_from_scores": _membership_rates,
    "pending_runs": _pending,
    "plot_method_bars": _res(plotdata.method_bars),
    "plot_tradeoffs": _res(plotdata.tradeoffs),
    "plot_boxes": _res(plotdata.boxes),
    "plot_box_points": _res(plotdata.box_points),
    "plot_heatmap": _res(plotdata.heatmap),
    "plot_radar": _res(plotdata.radar),
    "plot_radar_legacy": _res(lambda df: plotdata.radar(df, legacy=True)),
    "plot_contributions": _res(plotdata.contributions),
    "plot_profile_sensitivity": _res(plotdata.profile_sensitivity),
    "plot_profile_comparison": _res(plotdata.profile_comparison),
    "propensity_gbt": _propensity,
    "propensity_holdout": _propensity_holdout,
    "propensity_lr": _propensity_linear,
    "propensity_no_cv": _propensity_training,
    "propensity_robustness": _propensity_robust,
    "tstr_per_subgroup": _subgroup_utility,
    "mi_lr": _membership,
    "mi_per_record": _membership_records,
    "tstr_gbt": _utility("gbt"),
    "tstr_mlp": _utility("mlp"),
    "fairness_gbt": _fairness,
}
