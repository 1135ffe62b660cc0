"""Running method means over results files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabassay.constants import CORE_METRICS
from tabassay.sources.io import RESULT_SCHEMA


def stream_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results files in a folder as a stream, with the published header's columns."""
    return spark.readStream.option("header", True).schema(RESULT_SCHEMA).csv(folder)


def running_means(results: DataFrame) -> DataFrame:
    """(method, n, one mean for each core metric); for output mode complete or update."""
    return results.groupBy("method").agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in CORE_METRICS])
