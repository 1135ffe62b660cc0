"""Settings that a session needs before the library's Python functions run in its workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch at most; long texts make the usual batches of 10,000 heavy.
BATCH_ROWS = 3000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Workers that share this file system find the package, whatever their working folder; elsewhere it must be installed.

    Lowers the session's rows of an Arrow batch to BATCH_ROWS; a smaller setting stands.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that spark.checkpoint.dir names; None in a local session without one. Any other master without one raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not path and master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return path.rstrip("/") if path else None


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of an iterative plan in the session's checkpoint folder, where there is one."""
    context, path = df.sparkSession.sparkContext, shared_folder(df.sparkSession) if not df.sparkSession.sparkContext.getCheckpointDir() else None
    if path:
        context.setCheckpointDir(path)
    return df.checkpoint() if context.getCheckpointDir() else df.cache()
