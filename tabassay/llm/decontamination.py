"""Benchmark decontamination by a prefix-filtered containment join. DataFrame operations only.

A benchmark window (13 words, or a shorter item's all) is contained in a document only if its
rarest word is, so that word, rarest by its count over the whole corpus, is the one necessary
prefix token. Documents look up their words among the prefix tokens; a match proposes a place,
which must leave room for the window's length before the words are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.llm._shared import lower_ascii, table, within

WINDOW = 13
#: Up to so many prefix tokens are written into the plan; more are joined by a shuffle.
MAX_LITERAL_TOKENS = 20_000
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words outside the ASCII separators, A-Z lower-cased; null has none."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(lower_ascii(text))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), _BREAK), "")


def windows_of(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows (window array<string>, items array<string>) of benchmark (item_id, text); an item is = and its id, or empty for a null id."""
    items = benchmark.select(F.coalesce(F.concat(F.lit("="), F.col("item_id").cast("string")), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def prefixes(windows: DataFrame, words: DataFrame) -> DataFrame:
    """(token, offset, window, items): the rarest word of each window by its count in words (word), with its place from 0."""
    parts = windows.select("window", "items", F.posexplode("window").alias("offset", "word"))
    vocabulary = parts.select("word").distinct()
    if within(vocabulary, MAX_LITERAL_TOKENS):
        vocabulary = F.broadcast(vocabulary)
    counts = words.join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("c"))
    rated = parts.join(counts, "word", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "word", "offset")).alias("rare"), F.first("items").alias("items"))
    return rated.select(F.col("rare.word").alias("token"), F.col("rare.offset").alias("offset"), "window", "items")


def hits(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Base rows (doc_id, t, n_words) and verified places (doc_id, t, start, length, items); t is xxhash64(text)."""
    found = table(windows_of(benchmark, size), "benchmark")
    tokens = table(prefixes(found, documents.select(F.explode(words_of(F.col("text"))).alias("word"))), "prefixes")
    names = tokens.select("token").distinct()
    split = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), words_of(F.col("text")).alias("w"))
    context = lambda i: F.slice("w", F.greatest(i - size + 1, F.lit(0)) + 1, 2 * size)  # noqa: E731  words around place i, from 0
    if within(names, MAX_LITERAL_TOKENS):
        known = [r["token"] for r in names.collect()]
        places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).isin(known)) if known else F.array().cast("array<int>")
        places = F.when(F.size("w") > 0, places)
        near = F.transform(places, lambda i: F.struct(i.alias("at"), context(i).alias("near")))
        base = table(split.select("doc_id", "t", F.size("w").alias("n_words"), near.alias("places")), "places")
        proposed = base.select("doc_id", "t", "n_words", F.inline("places")).withColumn("token", F.get("near", F.least(F.col("at"), F.lit(size - 1)))).join(tokens, "token")
    else:
        base = split.select("doc_id", "t", F.size("w").alias("n_words"))
        each = split.select("doc_id", "t", F.size("w").alias("n_words"), F.posexplode("w").alias("at", "token")).join(tokens, "token").filter("at >= offset").distinct()
        own = split.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "w").dropDuplicates(["_d", "_t"])
        proposed = each.join(own, each.doc_id.eqNullSafe(F.col("_d")) & (each.t == F.col("_t"))).withColumn("near", context(F.col("at")))
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    from_near = start - F.greatest(F.col("at") - size + 1, F.lit(0)) + 1
    same = F.slice("near", F.greatest(from_near, F.lit(1)), F.size("window")) == F.col("window")
    places = proposed.filter(fits & same).select("doc_id", "t", start.alias("start"), F.size("window").alias("length"), "items")
    return base.select("doc_id", "t", "n_words"), places


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, one_in: int = 20) -> DataFrame:
    """One row for each row of documents: doc_id, n_words, n_hit, items (array), contaminated.

    n_hit counts words inside any occurrence of a window of any item; items are those with an
    occurring window, sorted as strings. A document is contaminated if n_hit > 0 and
    one_in * n_hit >= n_words. Null and empty texts have no words and are clean, items without
    words have no windows, an item of fewer words than a window is one window. Repeated rows are
    judged alike, a null doc_id like any other; items of a null item_id count as one item, which
    is listed first, as null. Texts of any length are searched whole. Other columns are not read.
    """
    base, places = hits(documents, benchmark, size)
    spans = F.collect_set(F.struct("start", "length"))
    marks = places.groupBy("doc_id", "t").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    marks = marks.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), covered.cast("long").alias("n_hit"), "items")
    out = base.join(marks, base.doc_id.eqNullSafe(marks["_d"]) & base.t.eqNullSafe(marks["_t"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    named = F.transform("items", lambda x: F.when(x != "", F.substring(x, 2, 2**31 - 1)))
    items = F.coalesce(named, F.array().cast("array<string>"))
    return out.select("doc_id", "t", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), items.alias("items"), ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"))
