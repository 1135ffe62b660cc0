"""Readers and writers: microdata, results, summaries, checkpoints and externally made synthetic tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.constants import CORE_METRICS

ACS_COLUMNS = ("AGEP", "PINCP", "SEX", "MAR", "ESR", "PWGTP", "RAC1P", "HISP", "SCHL", "POBP")
ACS_SCHEMA = T.StructType([T.StructField(c, T.DoubleType() if c in ("PINCP", "ESR", "SCHL") else T.IntegerType()) for c in ACS_COLUMNS])
RESULT_SCHEMA = (
    "method string, replicate int, seed int, n_samples int, fidelity_auc double, privacy_dcr double, privacy_mi_auc double, "
    "privacy_mi_valid boolean, utility_tstr double, fairness_gap double, timestamp string"
)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are NULL everywhere: NaN would compare above every number."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(t)) for c, t in df.dtypes if c in floats})


def read_microdata(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, or Parquet by its name; a schema given avoids the pass that infers one."""
    if path.rstrip("/").endswith(".parquet"):
        return nan_to_null(spark.read.parquet(path))
    reader = spark.read.option("header", True).option("nanValue", "NaN")
    return nan_to_null(reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path))


def read_acs(spark: SparkSession, path: str) -> DataFrame:
    """The census columns of a person file, by name; all others are pruned by the reader."""
    if path.rstrip("/").endswith(".parquet"):
        return nan_to_null(spark.read.parquet(path).select(*ACS_COLUMNS))
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in ACS_SCHEMA])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results CSV by its header's names: known columns get their types, others stay strings, efficiency columns are numbers."""
    known = {f.name: f.dataType for f in T._parse_datatype_string(RESULT_SCHEMA)}
    raw = spark.read.option("header", True).csv(path)
    extra = {c: T.DoubleType() for c in ("efficiency_time", "generation_time_min", "generation_time_sec")}
    return nan_to_null(raw.select(*[F.col(c).try_cast(known.get(c, extra.get(c, T.StringType()))).alias(c) for c in raw.columns]))


def write_table(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Overwrites path with CSV or, by its name, Parquet."""
    writer = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    writer.parquet(path) if path.rstrip("/").endswith(".parquet") else writer.option("header", True).csv(path)


def write_results(rows: list[dict], path: Path) -> None:
    """A small results file with the published header, written by the driver."""
    names = [f.name for f in T._parse_datatype_string(RESULT_SCHEMA)]
    text = lambda v: "" if v is None else str(v)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([",".join(names), *(",".join(text(r.get(n)) for n in names) for r in rows)]) + "\n")


def write_summary(summary: DataFrame, path: Path) -> None:
    """summary(): method and <metric>_mean, <metric>_std, with the three-line header of a two-level index."""
    metrics = [m for m in CORE_METRICS if f"{m}_mean" in summary.columns]
    lines = ["," + ",".join(f"{m},{m}" for m in metrics), "," + ",".join("mean,std" for _ in metrics), "method" + "," * 2 * len(metrics)]
    for r in summary.orderBy("method").collect():
        lines.append(r["method"] + "".join("," + ("" if r[f"{m}_{k}"] is None else str(r[f"{m}_{k}"])) for m in metrics for k in ("mean", "std")))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def load_checkpoint(path: Path) -> dict:
    """{"completed": [run ids], "generated": [run ids], "results": [rows]}; empty if there is none."""
    found = json.loads(path.read_text()) if path.exists() else {}
    return {"completed": [], "generated": [], "results": []} | found


def save_checkpoint(path: Path, state: dict) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    partial = path.with_suffix(".tmp")
    partial.write_text(json.dumps(state, indent=1))
    partial.replace(path)


def pending_runs(planned: DataFrame, completed: DataFrame) -> DataFrame:
    """Planned (run_id, ...) without those that completed (run_id)."""
    return planned.join(completed.select("run_id").distinct(), "run_id", "left_anti")


def read_external(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame | None:
    """A synthetic table made elsewhere, with the types of like restored; None if path does not exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    found = read_microdata(spark, path)
    return restore_types(found, like) if like is not None else found


def restore_types(df: DataFrame, like: DataFrame) -> DataFrame:
    """df's columns that like has, cast to like's types, in like's order."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in like.schema if f.name in df.columns])
