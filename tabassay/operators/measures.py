"""Quality measures of a synthetic table: fidelity, privacy, utility, fairness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.functions.recode import binarize
from tabassay.operators import boost, encode, linking, metrics, network, sampling


def labelled(real: DataFrame, synthetic: DataFrame, label: str) -> DataFrame:
    """Real rows (label 0) and synthetic ones (1) by column name; a column that one side lacks is null."""
    return real.withColumn(label, F.lit(0)).unionByName(synthetic.withColumn(label, F.lit(1)), allowMissingColumns=True)


def _union(real: DataFrame, synthetic: DataFrame, label: str) -> DataFrame:
    return labelled(real, synthetic, label).withColumn("row_id", F.xxhash64(label, "row_id"))


def _columns(*frames: DataFrame) -> list[str]:
    return [c for c in frames[0].columns if c != "row_id"]


def _prepared(df: DataFrame, columns: list[str], *keep: str) -> tuple[DataFrame, list[str]]:
    """Encoded and median-filled features over the pooled rows, and their names."""
    features = encode.encoded(df, columns)
    # Sketches of all parts are merged in one task, which takes as long as the parts are many.
    flat = df.select(*keep, *[e.alias(n) for n, e in features.items()]).coalesce(3 * df.sparkSession.sparkContext.defaultParallelism)
    return encode.fill(flat, encode.medians(flat, list(features))), list(features)


def _auc(scored: DataFrame, label: str = "label", count: str | None = None) -> float | None:
    return metrics.auc(scored, label, count=count).first()["auc"]


def _without(fold: str, k: int, more: int = 0) -> Column:
    """Bit m of model m: models 0 to k - 1 leave out the fold of their number, `more` further ones take every row."""
    return sum((F.when(F.col(fold) != i, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(k)), F.lit((1 << (k + more)) - (1 << k)))


def _by_fold(scored: DataFrame, k: int) -> list[float | None]:
    """AUC of each fold's rows under the model that has not seen them, in one job."""
    held = scored.select("label", F.col("keep").alias("fold"), F.element_at("score", F.col("keep") + 1).alias("score"), "n")
    found = {r["fold"]: r["auc"] for r in metrics.auc(held, by=["fold"], count="n").collect()}
    return [found.get(i) for i in range(k)]


def _folded(real: DataFrame, synthetic: DataFrame, n_splits: int, seed: int) -> tuple[DataFrame, list[str]]:
    """Encoded rows of both tables with label and fold, in memory, and the features' names."""
    df = _union(real, synthetic, "label")
    flat, names = _prepared(df, _columns(real, synthetic), "row_id", "label")
    return sampling.stratified_folds(flat, "label", n_splits, seed).select("row_id", "label", F.col("fold").cast("int").alias("fold"), *[encode.quoted(n) for n in names]).cache(), names


def _boosted_folds(folded: DataFrame, names: list[str], k: int, trees: int, depth: int, whole: bool) -> tuple[list[float | None], dict[str, float]]:
    """AUCs of trees boosted for all folds at once, and the feature importance of one more model on all rows."""
    matrix = boost.Matrix(folded, names, "label", _without("fold", k, int(whole)), k + int(whole), "fold", boost.cut_points(folded, names))
    models = boost.boost(matrix, trees, depth)
    aucs = _by_fold(matrix.scored(counted=True), k)
    matrix.close()
    return aucs, models[k].importance() if whole else {}


def _linear_folds(folded: DataFrame, names: list[str], k: int) -> list[float | None]:
    """AUCs of logistic regressions on scaled features, all folds at once."""
    matrix = boost.Matrix(encode.scaled(folded, encode.moments(folded, names)), names, "label", _without("fold", k), k, "fold")
    aucs = _by_fold(matrix.scored(boost.Linear(boost.logistic(matrix)), True), k)
    matrix.close()
    return aucs


def _network_folds(folded: DataFrame, names: list[str], k: int, seed: int) -> list[float | None]:
    """AUCs of networks of 64 and 32 units on scaled features, all folds at once."""
    matrix = boost.Matrix(encode.scaled(folded, encode.moments(folded, names)), names, "label", _without("fold", k), k, "fold")
    aucs = _by_fold(matrix.scored(network.Networks(*network.train(matrix, (64, 32), seed=seed)), True), k)
    matrix.close()
    return aucs


def propensity_auc(real: DataFrame, synthetic: DataFrame, n_estimators: int = 100, max_depth: int = 3, n_splits: int = 3, random_state: int = 42, kind: str = "gbt", importance: bool = True) -> dict:
    """Cross-validated AUC of telling real rows from synthetic ones; 0.5 is perfect fidelity. Both frames have row_id; kind is gbt, lr or mlp."""
    folded, names = _folded(real, synthetic, n_splits, random_state)
    found: dict[str, float] = {}
    if kind == "gbt":
        fold_aucs, found = _boosted_folds(folded, names, n_splits, n_estimators, max_depth, importance)
    elif kind == "lr":
        fold_aucs = _linear_folds(folded, names, n_splits)
    elif kind == "mlp":
        fold_aucs = _network_folds(folded, names, n_splits, random_state)
    else:
        raise ValueError(f"unknown classifier {kind}")
    folded.unpersist()
    mean = sum(fold_aucs) / len(fold_aucs)
    return {"auc": mean, "auc_fidelity": 1 - 2 * abs(mean - 0.5), "fold_aucs": fold_aucs, "feature_importance": found}


def propensity_auc_robustness(real: DataFrame, synthetic: DataFrame, n_splits: int = 3, random_state: int = 42, n_estimators: int = 100) -> dict:
    """Mean and fold AUCs of three classifier families on the same encoded rows and folds."""
    folded, names = _folded(real, synthetic, n_splits, random_state)
    found = {"gbt": _boosted_folds(folded, names, n_splits, n_estimators, 3, False)[0], "lr": _linear_folds(folded, names, n_splits), "mlp": _network_folds(folded, names, n_splits, random_state)}
    folded.unpersist()
    return {k: v for kind, aucs in found.items() for k, v in ((f"{kind}_auc", sum(aucs) / len(aucs)), (f"{kind}_fold_aucs", aucs))}


def _boosted(rows: DataFrame, names: list[str], trees: int, depth: int, judged: bool = False) -> tuple[boost.Boosted, float | None]:
    """Trees boosted on all rows (label, names...), and if judged their AUC on those rows."""
    matrix = boost.Matrix(rows, names, "label", F.lit(1), 1, cuts=boost.cut_points(rows, names))
    (model,) = boost.boost(matrix, trees, depth)
    auc = _auc(matrix.scored(counted=True).select("label", F.col("score")[0].alias("score"), "n"), count="n") if judged else None
    matrix.close()
    return model, auc


def _judged(model: boost.Boosted, rows: DataFrame, names: list[str]) -> float | None:
    """AUC of a model on rows (label, names...) it has not seen; rows of equal bins are scored once."""
    matrix = boost.Matrix(rows, names, "label", F.lit(1), 1, cuts=model.cuts)
    auc = _auc(matrix.scored(boost.Forest([model]), True).select("label", F.col("score")[0].alias("score"), "n"), count="n")
    matrix.close()
    return auc


def propensity_auc_no_cv(real: DataFrame, synthetic: DataFrame, n_estimators: int = 100, max_depth: int = 3, random_state: int = 42) -> dict:
    """Training AUC, biased upward; kept for comparison with older results."""
    flat, names = _prepared(_union(real, synthetic, "label"), _columns(real, synthetic), "label")
    rows = flat.cache()
    model, auc = _boosted(rows, names, n_estimators, max_depth, True)
    rows.unpersist()
    return {"auc": auc, "auc_fidelity": 1 - 2 * abs(auc - 0.5), "feature_importance": model.importance()}


def propensity_auc_holdout(real_train: DataFrame, real_holdout: DataFrame, synthetic: DataFrame, n_estimators: int = 100, max_depth: int = 3, random_state: int = 42) -> dict:
    """AUC on rows not trained on: held-out real rows and the second half of the synthetic ones; levels and medians are the training side's."""
    first, second = sampling.halves(synthetic)
    train, test = _union(real_train, first, "label"), _union(real_holdout, second, "label")
    columns = _columns(real_train)
    known = encode.levels(train, [c for c in columns if encode.is_text(train, c)])
    features = encode.encoded(train, columns, known)
    names = list(features)
    flat = train.select("label", *[e.alias(n) for n, e in features.items()]).cache()
    middle = encode.medians(flat, names)
    other = test.select("label", *[e.alias(n) for n, e in encode.encoded(test, [c for c in columns if c in test.columns], known).items()])
    held = encode.fill(other.select("label", *[encode.quoted(n) if n in other.columns else F.lit(0.0).alias(n) for n in names]), middle)
    model, _ = _boosted(encode.fill(flat, middle), names, n_estimators, max_depth)
    auc = _judged(model, held, names)
    flat.unpersist()
    return {"auc": auc, "auc_fidelity": 1 - 2 * abs(auc - 0.5), "n_train": train.count(), "n_holdout": test.count()}


def distance_features(train: DataFrame, synthetic: DataFrame, normalize: bool = True) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables on the features they share, encoded separately, filled with train medians and scaled by train moments."""
    columns = [c for c in train.columns if c != "row_id" and c in synthetic.columns]
    ours, theirs = encode.encoded(train, columns), encode.encoded(synthetic, columns)
    names = [n for n in ours if n in theirs]
    t, s = (df.select("row_id", *[f[n].alias(n) for n in names]) for df, f in ((train, ours), (synthetic, theirs)))
    middle = encode.medians(t, names)
    t, s = encode.fill(t, middle), encode.fill(s, middle)
    if normalize:
        stats = encode.moments(t, names)
        t, s = encode.scaled(t, stats), encode.scaled(s, stats)
    return t, s, names


def dcr_privacy(train: DataFrame, synthetic: DataFrame, metric: str = "euclidean", percentile: float = 5, normalize: bool = True, random_state: int = 42, distances: DataFrame | None = None) -> DataFrame:
    """One row of distance-to-closest-record statistics and privacy_score = min(1, percentile / (2 * typical train distance))."""
    t, s, names = distance_features(train, synthetic, normalize)
    found = linking.nearest(s, t, names, metric) if distances is None else distances
    typical = linking.pairwise_sample(t, names, metric, seed=random_state).agg(F.percentile("d", F.lit(0.5)).alias("typical_distance"))
    out = linking.dcr_summary(found, percentile).crossJoin(typical)
    score = F.least(F.lit(1.0), F.try_divide(F.col("dcr_percentile"), F.col("typical_distance") * F.lit(2.0)))
    return out.withColumns({"privacy_score": score, "percentile_used": F.lit(percentile), "metric_used": F.lit(metric)}).withColumnRenamed("n_close_matches", "num_close_matches").withColumnRenamed("n", "n_synthetic")


def dcr_privacy_per_record(train: DataFrame, synthetic: DataFrame, metric: str = "euclidean", normalize: bool = True) -> DataFrame:
    """synthetic with dcr and closest_train_id, the id of its nearest train row."""
    t, s, names = distance_features(train, synthetic, normalize)
    return synthetic.join(linking.nearest(s, t, names, metric).withColumnRenamed("closest", "closest_train_id"), "row_id", "left")


def compare_dcr_distributions(train: DataFrame, tables: dict[str, DataFrame], metric: str = "euclidean") -> DataFrame:
    """One row of dcr_privacy() for each named synthetic table."""
    rows = [dcr_privacy(train, df, metric).withColumn("method", F.lit(name)) for name, df in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _membership(train: DataFrame, test: DataFrame) -> tuple[DataFrame, list[str], dict, dict]:
    df = train.withColumn("label", F.lit(1)).unionByName(test.withColumn("label", F.lit(0)), allowMissingColumns=True)
    columns = _columns(train)
    known = encode.levels(df, [c for c in columns if encode.is_text(df, c)])
    features = encode.encoded(df, columns, known)
    flat = df.select("row_id", "label", *[e.alias(n) for n, e in features.items()])
    middle = encode.medians(flat, list(features))
    return encode.fill(flat, middle), list(features), known, middle


def _attacked(synthetic: DataFrame, weights, columns: list[str], names: list[str], known: dict, middle: dict) -> DataFrame:
    have = encode.encoded(synthetic, [c for c in columns if c in synthetic.columns], known)
    flat = synthetic.select("row_id", *[(have[n] if n in have else F.lit(0.0)).alias(n) for n in names])
    return boost.predict_linear(weights, encode.fill(flat, middle), names, "row_id")


def membership_inference_privacy(train: DataFrame, test: DataFrame, synthetic: DataFrame, random_state: int = 42, min_attack_auc: float = 0.6) -> dict:
    """Attack that tells training members from others, applied to synthetic rows; valid only if its own pooled AUC reaches min_attack_auc."""
    flat, names, known, middle = _membership(train, test)
    rows = sampling.stratified_folds(flat, "label", 5, shuffle=False).withColumn("fold", F.col("fold").cast("int"))
    matrix = boost.Matrix(rows, names, "label", _without("fold", 5, 1), 6, "fold")
    weights = boost.logistic(matrix)
    auc = _auc(matrix.scored(boost.Linear(weights)).select("label", F.element_at("score", F.col("keep") + 1).alias("score")))
    matrix.close()
    hit = _attacked(synthetic, weights[5], _columns(train), names, known, middle).agg(metrics.membership_rates(None, "score").alias("rate"), F.avg("score").alias("mean")).first()
    valid = auc is not None and auc >= min_attack_auc
    return {
        "attack_success_rate": hit["rate"], "attack_auc": auc, "attack_valid": valid, "mean_membership_confidence": hit["mean"],
        "privacy_score": 1 - 2 * abs(hit["rate"] - 0.5) if valid else None,
        "warning": None if valid else f"the attack's own AUC is below {min_attack_auc}: it cannot tell members from others, so the score means nothing",
    }


def membership_inference_per_record(train: DataFrame, test: DataFrame, synthetic: DataFrame) -> DataFrame:
    """synthetic with membership_prob and is_likely_member."""
    flat, names, known, middle = _membership(train, test)
    matrix = boost.Matrix(flat, names, "label", F.lit(1), 1)
    weights = boost.logistic(matrix)[0]
    matrix.close()
    scored = _attacked(synthetic, weights, _columns(train), names, known, middle)
    return synthetic.join(scored.select("row_id", F.col("score").alias("membership_prob"), (F.col("score") > 0.5).cast("int").alias("is_likely_member")), "row_id", "left")


class Utility:
    """Train on real or synthetic, test on real; everything fitted on real rows only is kept for the next synthetic table."""

    def __init__(self, train: DataFrame, test: DataFrame, target: str, evaluator: str = "gbt", n_estimators: int = 100, max_depth: int = 5, random_state: int = 42, exclude: tuple[str, ...] = ()):
        self.target, self.columns = target, [c for c in train.columns if c not in ("row_id", target, *exclude)]
        self.known = encode.levels(train, [c for c in self.columns if encode.is_text(train, c)])
        features = encode.encoded(train, self.columns, self.known, drop_first=False)
        self.names = list(features)
        flat = self._flat(train).cache()
        self.middle = encode.medians(flat, self.names)
        self.stats = encode.moments(encode.fill(flat, self.middle), self.names)
        self.evaluator, self.trees, self.depth, self.seed = evaluator, n_estimators, max_depth, random_state
        self.test = self._ready(test).cache()
        self.real = self._fitted(train)
        flat.unpersist()

    def _fitted(self, df: DataFrame):
        ready = self._ready(df)
        if self.evaluator == "mlp":
            return network.fit(ready, self.names, (100, 50), self.seed)
        if self.evaluator != "gbt":
            raise ValueError(f"unknown classifier {self.evaluator}")
        return _boosted(ready, self.names, self.trees, self.depth)[0]

    def _scores(self, model) -> DataFrame:
        """(row_id, label, score, pred) of the test rows."""
        scored = network.predict(model, self.test, self.names, "row_id", "label") if self.evaluator == "mlp" else boost.predict([model], self.test, "row_id", "label")
        return scored.withColumn("pred", (F.col("score") > 0.5).cast("int"))

    def close(self) -> None:
        """Releases the encoded test rows."""
        self.test.unpersist()

    def _flat(self, df: DataFrame) -> DataFrame:
        have = encode.encoded(df, [c for c in self.columns if c in df.columns], self.known, drop_first=False)
        return df.select("row_id", F.col(self.target).cast("int").alias("label"), *[(have[n] if n in have else F.lit(0.0)).alias(n) for n in self.names])

    def _ready(self, df: DataFrame) -> DataFrame:
        return encode.scaled(encode.fill(self._flat(df), self.middle), self.stats)

    def predictions(self, synthetic: DataFrame) -> DataFrame:
        """(row_id, label, score_real, pred_real, score_synth, pred_synth) of the test rows."""
        a, b = self._scores(self.real), self._scores(self._fitted(synthetic))
        return a.select("row_id", "label", F.col("score").alias("score_real"), F.col("pred").alias("pred_real")).join(b.select("row_id", F.col("score").alias("score_synth"), F.col("pred").alias("pred_synth")), "row_id")


def _single_class(df: DataFrame, target: str) -> bool:
    return df.select(target).distinct().limit(2).count() < 2


def tstr_utility(train: DataFrame, synthetic: DataFrame, test: DataFrame, target: str, evaluator: str = "gbt", real: Utility | None = None, **settings) -> dict:
    """F1 and AUC on real test rows of models trained on real and on synthetic rows, their ratios, and utility_score = min(1, f1_ratio)."""
    if _single_class(synthetic, target):
        raise ValueError("the synthetic target has one class only")
    used = real or Utility(train, test, target, evaluator, **settings)
    predicted = used.predictions(synthetic).cache()
    row = predicted.agg(metrics.f1(F.col("pred_real"), F.col("label")).alias("r"), metrics.f1(F.col("pred_synth"), F.col("label")).alias("s")).first()
    aucs = [_auc(predicted.withColumnRenamed(c, "score")) or 0.0 for c in ("score_real", "score_synth")]
    ratio = lambda s, r: s / r if r > 0 else 0.0
    f1_ratio = ratio(row["s"], row["r"])
    predicted.unpersist()
    if real is None:
        used.close()
    return {
        "f1_real": row["r"], "f1_synthetic": row["s"], "f1_ratio": f1_ratio, "auc_real": aucs[0], "auc_synthetic": aucs[1], "auc_ratio": ratio(aucs[1], aucs[0]),
        "utility_score": min(1.0, f1_ratio),
    }


def tstr_utility_mlp(train: DataFrame, synthetic: DataFrame, test: DataFrame, target: str, **settings) -> dict:
    return tstr_utility(train, synthetic, test, target, "mlp", **settings) | {"evaluator": "mlp"}


def tstr_utility_per_subgroup(train: DataFrame, synthetic: DataFrame, test: DataFrame, target: str, subgroup: str, min_subgroup_size: int = 100, overall: dict | None = None, without: Utility | None = None, **settings) -> dict:
    """overall_f1_ratio (with the subgroup as a feature) and F1 ratios by subgroup (models without it); smaller subgroups are listed as excluded."""
    whole = overall or tstr_utility(train, synthetic, test, target, **settings)
    without = without or Utility(train, test, target, exclude=(subgroup,), **settings)
    marked = without.predictions(synthetic).join(test.select("row_id", subgroup), "row_id")
    table = metrics.by_subgroup(marked, subgroup, min_subgroup_size).cache()
    each = {r["subgroup"]: r for r in table.collect()}
    return {
        "overall_f1_ratio": whole["f1_ratio"], "subgroup_f1_ratios": {k: r["f1_ratio"] for k, r in each.items() if r["kept"]}, "subgroup_sizes": {k: r["n"] for k, r in each.items() if r["kept"]},
        "excluded_subgroups": sorted(str(k) for k, r in each.items() if not r["kept"]), "table": table,
    }


def fairness_gap(train: DataFrame, synthetic: DataFrame, test: DataFrame, target: str, subgroup: str, min_subgroup_size: int = 100, **settings) -> dict:
    """Largest and mean distance of subgroup F1 ratios from the overall one, and fairness_score = max(0, 1 - max_gap / 0.5)."""
    found = tstr_utility_per_subgroup(train, synthetic, test, target, subgroup, min_subgroup_size, **settings)
    overall = found["overall_f1_ratio"]
    row = metrics.gaps(found["table"], F.lit(float(overall))).first()
    ratios = found["subgroup_f1_ratios"]
    return row.asDict() | {
        "subgroup_gaps": {k: abs(v - overall) for k, v in ratios.items()}, "overall_utility": overall, "subgroup_utilities": ratios,
        "subgroup_sizes": found["subgroup_sizes"], "excluded_subgroups": found["excluded_subgroups"],
    }


def compare_fairness_across_methods(train: DataFrame, tables: dict[str, DataFrame], test: DataFrame, target: str, subgroup: str, min_subgroup_size: int = 100, **settings) -> DataFrame:
    """(method, max_gap, mean_gap, worst_subgroup, overall_utility, fairness_score) for each named synthetic table; the real models are fitted once."""
    whole = Utility(train, test, target, **settings)
    without = Utility(train, test, target, exclude=(subgroup,), **settings)
    rows = []
    for name, df in tables.items():
        overall = tstr_utility(train, df, test, target, real=whole)
        r = fairness_gap(train, df, test, target, subgroup, min_subgroup_size, overall=overall, without=without)
        rows.append((name, float(r["max_gap"]), float(r["mean_gap"]), r["worst_subgroup"], float(r["overall_utility"]), float(r["fairness_score"])))
    whole.close()
    without.close()
    return train.sparkSession.createDataFrame(rows, "method string, max_gap double, mean_gap double, worst_subgroup string, overall_utility double, fairness_score double")


def with_target(df: DataFrame, target: str, rule: dict | None) -> DataFrame:
    """df with the 0/1 target made from rule's source column, which goes; df itself without a rule."""
    return df if not rule else df.withColumn(target, binarize(F.col(rule["source_column"]), rule["threshold"])).drop(rule["source_column"])
