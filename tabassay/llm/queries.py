"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabassay.llm import change_applier, collocations, decontamination, language_id, line_dedup, lm_scoring, near_dedup, packing, quality, substring_dedup, suffix_repeats, topk, url_filter
from tabassay.llm._shared import fold, read

CAPACITY = 2048
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(read(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = language_id.train(documents.filter(fold("doc_id", 5) != 0))
    return language_id.predict(documents, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(read(spark, sf_dir, "documents"), percent=75)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    ranker = quality.train(documents, read(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1))
    scored = quality.score(documents, ranker)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read(spark, sf_dir, "documents"), size=35, digest=True)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    scored = lm_scoring.score(documents, documents.filter(fold("doc_id", 7) != 2))
    return scored.withColumn("held_out", fold("doc_id", 7) == 2)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.dedup(read(spark, sf_dir, "documents"), size=400, digest=True)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), least=30, max_words=4, percent=80, top=2000)


def client_changes(changes: DataFrame) -> DataFrame:
    """Distinct rows of client_changes, numbered and cut into ten batches of a delayed day.

    The number is the rank over all rows; rows without valid_at, and those whose hash is divisible by 11, vanish after that.
    """
    rows = change_applier.ranked(changes.distinct())
    h = F.coalesce(F.crc32(F.col("change_id").cast("string")), F.lit(0))
    rows = rows.filter(F.col("valid_at").isNotNull() & (h % 11 != 0))
    day = F.unix_date(F.to_date("valid_at")) + 5 * (h % 4)
    batch = F.least(F.lit(10), 1 + F.floor((F.col("day") - 19723) * 10 / F.lit(160)))
    cents = F.floor(100 * F.col("balance") + 0.5)
    return rows.withColumn("day", day).select("client_id", "n", "change_id", "day", "op", "city", cents.alias("cents"), batch.alias("batch"))


def op13_sequenced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = change_applier.apply(client_changes(read(spark, sf_dir, "client_changes")), batches=10)
    return done.select("change_id", "client_id", "status", "batch", "missed", "city", "cents", "current")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_url_filters, op2_language_id, op3_near_dedup, op4_best_fit_packing, op5_quality_classifier, op6_substring_dedup, op7_lm_scoring, op8_line_dedup, op9_benchmark_decontamination, op10_exact_top_k, op11_suffix_array_dedup, op12_phrase_collocations, op13_sequenced_changes]
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}
