"""Corpus cleaning pipeline: quality, repeated lines, near-duplicates, benchmark passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabassay.llm import decontamination, line_dedup, near_dedup, packing, quality
from tabassay.llm._shared import read, table
from tabassay.llm.queries import CAPACITY, tokenizer_path
from tabassay.session import prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(stage: Stage) -> Stage:
    """Runs a stage on doc_id, text and n_chars under their names and all other columns under names that no operator uses."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = {c: c if c in ("doc_id", "text", "n_chars") else f"_other{i}" for i, c in enumerate(docs.columns)}
        out = stage(prepare(spark), docs.toDF(*inner.values()), sf_dir)
        outer = {b: a for a, b in inner.items()}
        return out.toDF(*[outer.get(c, c) for c in out.columns])

    run_stage.__doc__ = stage.__doc__
    return run_stage


@_apart
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier, fitted on the labelled documents of its input, scores 0.5 or more.

    Null and empty texts are scored like others, repeated rows alike; very long texts are read
    whole. An empty table stays empty. Columns of any other name pass through.
    """
    ranker = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, ranker, keep=tuple(c for c in docs.columns if c != "doc_id")).filter("score >= 0.5").select(*docs.columns)


@_apart
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later repeated runs of lines; documents that were cut and of which only white space is left go. n_chars follows the text.

    Null texts stay null, empty ones stay; repeated rows are cut alike, a null doc_id counts as the
    first. An empty table stays empty. Columns of any other name pass through.
    """
    cut = line_dedup.dedup(docs)
    out = cut.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("n_lines", "n_removed")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


@_apart
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one of the least doc_id; repeated rows of that id all stay.

    Null and blank texts and null ids link with nothing and stay. An empty table stays empty, very
    long texts are compared whole. Columns of any other name pass through.
    """
    gone = near_dedup.groups(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@_apart
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages by the contamination rule.

    Null and empty texts stay; each text of one doc_id is judged by itself, a null id like any
    other. An empty table stays empty, an empty benchmark drops nothing. Columns of any other name pass through.
    """
    found = decontamination.contamination(docs, read(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id", "t").distinct()
    found = found.select(F.col("doc_id").alias("_id"), F.col("t").alias("_hash"))
    same = docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_hash"])
    return docs.join(found, same, "left_anti").select(*docs.columns)


@_apart
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document that is left into sequences: one row for each piece.

    A null text is an empty one, which is one piece of the closing id. Repeated rows are packed as
    often as they occur, very long texts are cut into pieces. An empty table gives an empty one; other columns are not read.
    """
    return packing.pack_documents(docs, tokenizer_path(), CAPACITY)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontamination", benchmark_stage), ("packing", packing_stage)]
#: Classifier and tokenizer are beyond SQL; tests compare run() with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is a written table that the next one reads."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
