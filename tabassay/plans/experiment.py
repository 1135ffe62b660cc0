"""The experiment: prepare microdata, generate, measure, aggregate; resumable run by run."""

from __future__ import annotations

import hashlib
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabassay.config import DatasetConfig
from tabassay.constants import CORE_METRICS, METHODS, SEEDS
from tabassay.functions import recode
from tabassay.operators import generators, measures, sampling
from tabassay.sources import io

ACS_SAMPLE = 50_000


def filter_adults(df: DataFrame) -> DataFrame:
    return df.filter("AGEP >= 18")


def filter_valid_income(df: DataFrame) -> DataFrame:
    return df.filter("PINCP IS NOT NULL")


def select_and_recode(df: DataFrame) -> DataFrame:
    """The nine analysis columns (and row_id) of person records, in one projection."""
    keep = ["row_id"] if "row_id" in df.columns else []
    return df.select(
        *keep, "AGEP", "PINCP", "SEX", recode.race_ethnicity(F.col("RAC1P"), F.col("HISP")).alias("RACETH"), recode.education(F.col("SCHL")).alias("SCHL_RECODED"),
        "MAR", "ESR", recode.birthplace(F.col("POBP")).alias("POBP_RECODED"), "PWGTP",
    )


def distinct_counts(df: DataFrame) -> DataFrame:
    """One row: the number of distinct values of every column."""
    return df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in df.columns])


def preprocess_acs(df: DataFrame, sample_size: int = ACS_SAMPLE, train_fraction: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    ready = select_and_recode(filter_valid_income(filter_adults(sampling.with_row_id(df))))
    return sampling.train_test_split(sampling.sample_exact(ready, sample_size, seed), train_fraction, seed)


def load_and_preprocess(spark: SparkSession, config: DatasetConfig) -> tuple[DataFrame, DataFrame]:
    """(train, test) of a configured dataset, each with row_id."""
    if config.preprocessing == "acs_pums":
        return preprocess_acs(io.read_acs(spark, config.data_path), config.sample_size or ACS_SAMPLE, config.train_fraction, config.random_state)
    if config.preprocessing:
        raise ValueError(f"unknown preprocessing {config.preprocessing}")
    df = io.read_microdata(spark, config.data_path)
    config.validate_against_data(df)
    if config.strict_columns:
        df = df.select(*dict.fromkeys(c for c, _ in config.roles()))
    df = sampling.with_row_id(df)
    if config.sample_size:
        df = sampling.sample_exact(df, config.sample_size, config.random_state)
    return sampling.train_test_split(df, config.train_fraction, config.random_state)


def seed_of(replicate: int) -> int:
    """The published seeds first, then seeds hashed from the replicate's number."""
    return SEEDS[replicate] if replicate < len(SEEDS) else int(hashlib.md5(f"replicate:{replicate}".encode()).hexdigest()[:7], 16)


def compute_all_measures(train: DataFrame, test: DataFrame, synthetic: DataFrame, config: DatasetConfig, trees: int = 100, min_subgroup_size: int = 100, real: measures.Utility | None = None, without: measures.Utility | None = None) -> dict:
    """The six result numbers; a measure that fails is None and does not stop the others."""
    tr, te, sy = (measures.with_target(df, config.target_variable, config.target_binarize) for df in (train, test, synthetic))
    out: dict = dict.fromkeys(("fidelity_auc", "privacy_dcr", "privacy_mi_auc", "privacy_mi_valid", "utility_tstr", "fairness_gap"))
    whole: dict = {}

    def guarded(work) -> None:
        try:
            out.update(work())
        except Exception as error:  # noqa: BLE001  one measure's failure is its own
            print(f"measure failed: {type(error).__name__}: {str(error)[:200]}")

    guarded(lambda: {"fidelity_auc": measures.propensity_auc(train, synthetic, trees, importance=False)["auc"]})
    guarded(lambda: {"privacy_dcr": measures.dcr_privacy(train, synthetic).first()["dcr_percentile"]})

    def membership() -> dict:
        r = measures.membership_inference_privacy(train, test, synthetic)
        return {"privacy_mi_auc": r["attack_auc"], "privacy_mi_valid": r["attack_valid"]}

    def utility() -> dict:
        whole.update(measures.tstr_utility(tr, sy, te, config.target_variable, real=real, n_estimators=trees))
        return {"utility_tstr": whole["f1_ratio"]}

    guarded(membership)
    guarded(utility)
    guarded(lambda: {"fairness_gap": measures.fairness_gap(tr, sy, te, config.target_variable, config.subgroup_column, min_subgroup_size, overall=whole or None, without=without, n_estimators=trees)["max_gap"]})
    return out


def summary(results: DataFrame, digits: int = 4) -> DataFrame:
    """(method, <metric>_mean, <metric>_std), rounded."""
    aggs = [F.round(f(F.col(m).cast("double")), digits).alias(f"{m}_{k}") for m in CORE_METRICS for k, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return results.groupBy("method").agg(*aggs)


def run(
    spark: SparkSession, config: DatasetConfig, output: Path, methods: list[str] | None = None, replicates: int = 5, n_synthetic: int | None = None,
    skip_measures: bool = False, reset: bool = False, trees: int = 100, min_subgroup_size: int = 100, workers: int = 1,
) -> DataFrame:
    """Runs every method and replicate that is not done yet; returns results (and writes them, the summary and a checkpoint).

    A synthetic table that exists is used again, also one made elsewhere. Runs that were only
    generated are measured when measures are wanted. A generator that fails leaves its run open.
    """
    checkpoint = output / "checkpoint.json"
    if reset:
        checkpoint.unlink(missing_ok=True)
    state = io.load_checkpoint(checkpoint)
    train, test = (df.cache() for df in load_and_preprocess(spark, config))
    n = n_synthetic or train.count()
    real = without = None
    if not skip_measures:  # what is fitted on real rows alone serves every run
        tables = [measures.with_target(df, config.target_variable, config.target_binarize) for df in (train, test)]
        real = measures.Utility(*tables, config.target_variable, n_estimators=trees)
        without = measures.Utility(*tables, config.target_variable, n_estimators=trees, exclude=(config.subgroup_column,))

    def one(method: str, r: int) -> tuple[str, dict | None, bool]:
        run_id, seed, began = f"{method}_rep{r + 1}", seed_of(r), time.time()
        path = str(output / "synthetic" / f"{run_id}.parquet")
        synthetic = io.read_external(spark, path) or io.read_external(spark, path.removesuffix(".parquet") + ".csv")
        if synthetic is None:
            if method not in generators.REGISTRY:
                raise FileNotFoundError(f"{method} is made outside Spark; put its table at {path}")
            io.write_table(generators.REGISTRY[method](seed).fit(train).sample(n), path)
            synthetic = io.read_external(spark, path)
        synthetic = sampling.with_row_id(io.restore_types(synthetic, train)).cache()
        if skip_measures:
            synthetic.unpersist()
            return run_id, None, True
        found = compute_all_measures(train, test, synthetic, config, trees, min_subgroup_size, real, without)
        synthetic.unpersist()
        row = {"method": method, "replicate": r + 1, "seed": seed, "n_samples": n, **found, "timestamp": datetime.now(timezone.utc).isoformat(), "seconds": time.time() - began}
        return run_id, row, True

    wanted = [(m, r) for m in (methods or METHODS) for r in range(replicates)]
    wanted = [(m, r) for m, r in wanted if f"{m}_rep{r + 1}" not in state["completed"]]
    with ThreadPoolExecutor(max(1, workers)) as pool:
        for (method, r), job in [(w, pool.submit(one, *w)) for w in wanted]:
            try:
                run_id, row, _ = job.result()
            except Exception as error:  # noqa: BLE001  the run stays open and is tried again next time
                print(f"{method}_rep{r + 1} failed: {type(error).__name__}: {str(error)[:200]}")
                continue
            state["generated"] = sorted({*state["generated"], run_id})
            if row is not None:
                state["completed"].append(run_id)
                state["results"].append(row)
            io.save_checkpoint(checkpoint, state)
    for kept in (real, without):
        if kept is not None:
            kept.close()
    train.unpersist()
    test.unpersist()
    rows = [{k: v for k, v in x.items() if k != "seconds"} for x in state["results"]]
    frame = spark.createDataFrame(rows, io.RESULT_SCHEMA) if rows else spark.createDataFrame([], io.RESULT_SCHEMA)
    if rows:
        io.write_results(rows, output / "all_results.csv")
        io.write_summary(summary(frame), output / "summary.csv")
    return frame
