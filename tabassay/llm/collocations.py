"""Phrase collocation mining: phrases counted by word-id suffix arrays, a shard at a time, and scored by their weakest cut.

Texts are packed into shards of one language. A shard's words become ids, its suffix array is built
by prefix doubling over those ids, and the intervals of the common-prefix array are its phrases with
their counts, which are added up by phrase over all shards. Phrases grow by rounds (one word, two,
all others): a longer phrase is looked for only where its parts are frequent, which each shard
learns from the frequent parts themselves while they are few bytes, else as a list of its own places.
Where the frequent words are sent, phrases of two to CODED words are shuffled as numbers of their words, not as text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabassay.llm._shared import batched, discard, table
from tabassay.llm._text import LOWER, column_bytes, slices

#: Bytes of a shard, unless one piece is longer.
SHARD_BYTES = 1 << 20
#: Bytes of frequent parts that are sent to every task; more are joined with the shards' own phrases.
SENT_BYTES = 1 << 25
#: Bytes of an Arrow batch of shards.
BATCH_BYTES = 1 << 22
#: Words of a phrase at most that are coded: two numbers in each of two columns.
CODED = 4
#: Shards of a row group, which one task reads.
TASK_ROWS = 8
#: Phrases whose words are gathered at once.
AT_ONCE = 20_000

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_SHARD = "lang string, words binary"
_LOCAL = "shard long, lang string, phrase string, at int"
#: The key is the language, a tab and the phrase, which has none: one short column to shuffle.
_COUNTS = "key string, c long"
#: Numbers of the first two words, and of the next two, if there are any.
_PAIRS, _CODES = "a long, c long", "a long, b long, c long"
_FREQUENT = "lang string, n int, phrase string, f long"


def normalised(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of the texts' words in lower case, each word followed by a space, or by a line feed at the end of a piece."""
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    inside = ~_GAP[data]
    before = np.r_[False, inside[:-1]] & ~edges[:-1]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & (edges[1:] | ~np.r_[inside[1:], False])) + 1
    if not len(starts):
        return np.zeros(0, np.uint8)
    breaks = np.r_[0, np.cumsum(_BREAK[data])]
    texts = np.searchsorted(offsets, starts, side="right")
    # A piece ends where a break stands before the next word, and at the end of its text.
    final = np.r_[(breaks[starts[1:]] > breaks[ends[:-1]]) | (texts[1:] != texts[:-1]), True]
    at = np.cumsum(ends - starts + 1) - 1
    out = np.empty(at[-1] + 1, np.uint8)
    keep = np.ones(len(out), bool)
    keep[at] = False
    out[keep] = LOWER[data[inside]]
    out[at] = np.where(final, 0x0A, 0x20)
    return out


def _pieces(words: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """words cut at ends of pieces into parts of at most size bytes, or one longer piece."""
    ends, lo = np.flatnonzero(words == 0x0A) + 1, 0
    while lo < len(words):
        k = int(np.searchsorted(ends, lo + size, side="right"))
        hi = int(ends[k - 1]) if k and ends[k - 1] > lo else int(ends[k])
        yield words[lo:hi]
        lo = hi


def _pack(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """From (lang, text) the shards (lang, words) of a partition; what waits for a full one is bounded."""
    waiting: dict[str, list[np.ndarray]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in waiting.items():
            for part in _pieces(np.concatenate(parts), size):
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([part.tobytes()], pa.binary())], names=["lang", "words"])
        waiting.clear()

    for batch in batches:
        codes = batch.column(0).dictionary_encode()
        code, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
        for i, lang in enumerate(names):
            data, offsets = column_bytes(batch.column(1).take(pa.array(np.flatnonzero(code == i))))
            for lo, hi in slices(offsets):
                words = normalised(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                if len(words):
                    waiting.setdefault(lang, []).append(words)
                    held += len(words)
                if held >= 4 * size:
                    yield from flush()
                    held = 0
    yield from flush()


def suffix_array(ids: np.ndarray, places: np.ndarray, words: int) -> np.ndarray:
    """places in the order of the first `words` ids from each of them, by prefix doubling."""
    rank, have = ids, 1
    while have < words:
        step = min(have, words - have)
        after = np.r_[rank[step:] + 1, np.zeros(min(step, len(rank)), rank.dtype)]
        key = rank * (int(after.max(initial=0)) + 1) + after
        rank, have = np.unique(key, return_inverse=True)[1], have + step
    return places[np.argsort(rank[places], kind="stable")]


def intervals(ids: np.ndarray, order: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of each interval whose suffixes share at least `words` ids; order is a suffix array."""
    if not len(order):
        return order, order
    common, same = np.zeros(len(order) - 1, np.int8), np.ones(len(order) - 1, bool)
    for k in range(words):
        same &= ids[order[1:] + k] == ids[order[:-1] + k]
        common += same
    heads = np.flatnonzero(np.r_[True, common < words])
    return order[heads], np.diff(np.r_[heads, len(order)])


def _phrases(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings words[starts[i]:ends[i]]."""
    size = (ends - starts).astype(np.int32)
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat((starts - offsets[:-1]).astype(np.int32), size)
    at += np.arange(offsets[-1], dtype=np.int32)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(words[at])).cast(pa.string())


class Vocabulary:
    """Frequent words of all languages under one numbering, those of a language in a row."""

    def __init__(self, words: dict[str, pa.Array]):
        self.words, self.langs = words, list(words)
        self.first = np.cumsum([0, *map(len, words.values())])
        self.size = int(self.first[-1])

    def numbers(self, lang: str, words: pa.Array) -> np.ndarray:
        """Number of each word, -1 if it is none of the language's."""
        if lang not in self.words:
            return np.full(len(words), -1, np.int64)
        at = pc.fill_null(pc.index_in(words.cast(pa.string()), value_set=self.words[lang]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where(at < 0, -1, at + self.first[self.langs.index(lang)])

    def coded(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (a, b) of phrases of 2 to CODED words, a row of numbers each."""
        more = np.zeros((len(numbers), CODED - 2), np.int64)
        more[:, : numbers.shape[1] - 2] = numbers[:, 2:] + 1
        return numbers[:, 0] * self.size + numbers[:, 1], more[:, 0] * (self.size + 1) + more[:, 1]

    def decoded(self, a: np.ndarray, b: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Language, length and words of each coded phrase."""
        every = pa.concat_arrays(list(self.words.values()))
        at = np.stack([a // self.size, a % self.size, b // (self.size + 1) - 1, b % (self.size + 1) - 1], axis=1)
        parts = [pa.array(np.where(k < 0, 0, k)) for k in at.T]
        phrase = pc.binary_join_element_wise(every.take(parts[0]), every.take(parts[1]), " ")
        for k in (2, 3):
            phrase = pc.if_else(pa.array(at[:, k] >= 0), pc.binary_join_element_wise(phrase, every.take(parts[k]), " "), phrase)
        lang = pa.array(self.langs, pa.string()).take(pa.array(np.searchsorted(self.first, at[:, 0], side="right") - 1))
        return lang, pa.array((at >= 0).sum(axis=1).astype(np.int32)), phrase


def _decode(batches: Iterable[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    """From (a, b, f) rows of _FREQUENT."""
    vocabulary = Vocabulary(sent.value)
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if len(a):
            yield pa.RecordBatch.from_arrays([*vocabulary.decoded(a, b), batch.column(2)], names=["lang", "n", "phrase", "f"])


def count_shard(words: np.ndarray, known: np.ndarray | pa.Array | None, part: int, least: int, most: int, numbers: Callable[[pa.Array], np.ndarray] | None = None) -> Iterator[tuple[int, pa.Array | np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases of least to most words, some AT_ONCE at a time: their length, words (or a row of their numbers), counts and a place of each.

    known: frequent phrases of `part` words, or places in this shard of one occurrence of each; a longer phrase's
    parts of that length must all be frequent. None: every phrase counts.
    """
    ends = np.flatnonzero((words == 0x20) | (words == 0x0A))
    starts = np.r_[0, ends[:-1] + 1]
    bare = np.ones(len(words), bool)
    bare[ends] = False
    offsets = np.r_[0, np.cumsum(ends - starts)]
    encoded = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(words[bare])).dictionary_encode()
    ids = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    number = numbers(encoded.dictionary) if numbers else None
    # Words from each place to the end of its piece.
    last = np.flatnonzero(words[ends] == 0x0A)
    room = last[np.searchsorted(last, np.arange(len(ends)))] - np.arange(len(ends)) + 1
    if known is not None:
        whole = np.flatnonzero(room >= part)
        key = ids[whole]
        for k in range(1, part):
            key = np.unique(key * (int(ids.max()) + 1) + ids[whole + k], return_inverse=True)[1]
        good = np.zeros(int(key.max(initial=0)) + 1, bool)
        if isinstance(known, pa.Array):
            values, at = np.unique(key, return_index=True)
            at = whole[at]
            parts = [_phrases(words, starts[a], ends[a + part - 1]) for a in np.split(at, range(AT_ONCE, len(at), AT_ONCE))]
            good[values] = pc.is_in(pa.chunked_array(parts), value_set=known).to_numpy()
        else:
            good[key[np.searchsorted(whole, known)]] = True
        frequent = np.zeros(len(ends), bool)
        frequent[whole] = good[key]
        # Frequent parts in a row from each place bound the words of a phrase there.
        stop = np.flatnonzero(np.r_[~frequent, True])
        run = stop[np.searchsorted(stop, np.arange(len(ends)))] - np.arange(len(ends))
        room = np.where(run > 0, np.minimum(room, run + part - 1), 0)
    order = suffix_array(ids, np.flatnonzero(room >= least), most)
    for n in range(least, most + 1):
        at, size = intervals(ids, order[room[order] >= n], n)
        for lo in range(0, len(at), AT_ONCE):
            here = at[lo : lo + AT_ONCE]
            yield n, _phrases(words, starts[here], ends[here + n - 1]) if number is None else number[ids[here[:, None] + np.arange(n)]], size[lo : lo + AT_ONCE], here


def _count(batches: Iterable[pa.RecordBatch], part: int, least: int, most: int, local: bool, sent: Broadcast | None, coded: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    """From (shard, lang, words, known) rows of _LOCAL, or of _COUNTS; of _PAIRS or _CODES if coded."""
    vocabulary = Vocabulary(coded.value) if coded is not None else None
    for batch in batches:
        for shard, lang, words, known in zip(*(batch.column(i) for i in range(4)), strict=True):
            if sent is not None:
                places = sent.value.get(lang.as_py(), pa.array([], pa.string()))
            else:
                places = known.values.to_numpy(zero_copy_only=False) if part and known.values is not None else np.zeros(0, np.int64) if part else None
            numbers = partial(vocabulary.numbers, lang.as_py()) if vocabulary else None
            for n, phrases, size, at in count_shard(np.frombuffer(words.as_buffer(), np.uint8), places, part, least, most, numbers):
                m = len(size)
                if local:
                    columns = {"shard": pa.array(np.full(m, shard.as_py(), np.int64)), "lang": pa.array([lang.as_py()] * m, pa.string()), "phrase": phrases, "at": pa.array(at.astype(np.int32))}
                elif vocabulary:
                    a, b = vocabulary.coded(phrases)
                    columns = {"a": pa.array(a)} | ({"b": pa.array(b)} if most > 2 else {}) | {"c": pa.array(size.astype(np.int64))}
                else:
                    columns = {"key": pc.binary_join_element_wise(pa.scalar(lang.as_py()), phrases, "\t"), "c": pa.array(size.astype(np.int64))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            pa.default_memory_pool().release_unused()


def _sent(frequent: DataFrame) -> Broadcast | None:
    """The phrases of each language for every task, unless they are over SENT_BYTES."""
    size = frequent.agg(F.sum(F.octet_length("phrase") + 16)).first()[0] or 0
    if size > SENT_BYTES:
        return None
    rows = frequent.select("lang", "phrase").toArrow()
    lang = rows.column("lang")
    return frequent.sparkSession.sparkContext.broadcast({k: rows.column("phrase").filter(pc.equal(lang, k)).combine_chunks() for k in pc.unique(lang).to_pylist()})


def phrase_counts(documents: DataFrame, least: int, max_words: int, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Written tables: phrases (lang, n, phrase, f) of 1 to max_words words with f >= least, and all words of each language (lang, total).

    documents: lang and text. A null lang is 'und', a null or empty text has no words; repeated rows
    count again; an empty table has no phrases. A text is split between pieces if it is long.
    """
    spark = documents.sparkSession
    # A task counts TASK_ROWS shards, so that its sums stay small.
    settings = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.files.maxPartitionBytes": 2 * BATCH_BYTES}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        packed = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").transform(batched, partial(_pack, size=shard_bytes), _SHARD)
        shards = table(packed.withColumn("shard", F.monotonically_increasing_id()), "shards", **{"parquet.block.row.count.limit": TASK_ROWS})
        bare = shards.withColumn("known", F.lit(None).cast("array<int>"))
        found, lists, part, sent, coded = [], None, 0, None, None
        for low, high in ((1, 1), (2, 2), (3, max_words)):
            if low > max_words:
                break
            source = bare if lists is None else shards.join(lists, "shard")
            count = partial(_count, part=part, least=low, most=high, sent=sent)
            by_number = coded is not None and high <= CODED
            kinds = _COUNTS if not by_number else _CODES if high > 2 else _PAIRS
            got = source.select("shard", "lang", "words", "known").transform(batched, partial(count, local=False, coded=coded if by_number else None), kinds)
            keys = [c for c in got.columns if c != "c"]
            summed = got.groupBy(*keys).agg(F.sum("c").alias("f"))
            phrase = F.substring_index("key", "\t", -1)
            lang = F.expr("substring(key, 1, length(key) - length(substring_index(key, '\t', -1)) - 1)")
            if low == 1:
                summed = table(summed, "words")
                totals = table(summed.groupBy(lang.alias("lang")).agg(F.sum("f").alias("total")), "totals")
            frequent = summed.filter(F.col("f") >= least)
            if by_number:
                frequent = frequent.select("a", "b" if "b" in keys else F.lit(0).cast("long").alias("b"), "f").mapInArrow(partial(_decode, sent=coded), _FREQUENT)
            else:
                frequent = frequent.select(lang.alias("lang"), F.size(F.split(phrase, " ", -1)).alias("n"), phrase.alias("phrase"), "f")
            frequent = table(frequent, "phrases")
            if low == 1:
                discard(summed)
            found.append(frequent)
            if high < max_words:
                sent, lists, part = _sent(frequent), None, low
                coded = sent if low == 1 and sent is not None and sent.value else coded
                if sent is None:
                    own = source.select("shard", "lang", "words", "known").transform(batched, partial(count, local=True), _LOCAL)
                    lists = own.join(frequent.select("lang", "phrase"), ["lang", "phrase"], "left_semi").groupBy("shard").agg(F.collect_list("at").alias("known"))
        out = table(reduce(DataFrame.unionByName, found), "phrases")
        discard(shards, *found)
        return out, totals
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def collocations(documents: DataFrame, least: int = 30, max_words: int = 4, percent: int = 80, top: int = 2000) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words and pieces: A-Z in lower case, pieces split at .,;:!? and 0x0A to 0x0D, words at space and tab.
    Candidates are phrases of 2 to max_words words with a = f >= least. A cut after k words has
    l = f(first), r = f(rest) and score floor(2000000 a / (l + r)); the lowest counts, ties to the least k. A
    candidate inside a longer one of at least `percent` per cent of its count is dropped. Order: score,
    a (both descending), phrase by its bytes. Integer arithmetic is done in decimals of 38 digits.

    Null lang is 'und', null or empty texts have no words, an empty table gives no rows; repeated rows
    count again; other columns are not read. n counts all words of the language.
    """
    phrases, totals = phrase_counts(documents, least, max_words)
    words = F.split("phrase", " ", -1)
    candidates = phrases.filter("n >= 2").select("lang", "n", "phrase", F.col("f").alias("a"), words.alias("words"))
    cuts = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("words", F.lit(1), k), " ").alias("first"), F.array_join(F.slice("words", k + 1, F.col("n") - k), " ").alias("rest")))
    cut = candidates.select("lang", "phrase", "a", F.explode(cuts).alias("x")).select("lang", "phrase", "a", "x.*")
    known = phrases.select("lang", "phrase", "f")
    cut = cut.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"])
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)")
    weakest = cut.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("x"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    longer = candidates.filter("n >= 3").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"most IS NULL OR CAST(100 AS DECIMAL(10,0)) * most < CAST({percent} AS DECIMAL(10,0)) * x.a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.select("lang", "phrase", "x.a", "x.l", "x.r", "x.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
