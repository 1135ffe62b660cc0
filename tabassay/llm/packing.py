"""Best-fit packing of tokenised documents into sequences of bounded length.

The whole corpus is tokenised once, in Arrow batches, into narrow piece rows. Pieces of one length
are exchangeable, and so are equal gaps, so a bulk-synchronous round holds both range-sorted in
run-length form: at most `capacity` lengths and `capacity` gap sizes, whatever the number of
documents. A round matches every active length at once: along the sorted sizes documents count up
and gaps count down, and on each level of that count a document's successor is the gap that comes
next, the smallest one that no longer document has taken. Ranks among equals resolve conflicts, gaps
that could take more documents of the same length do, the gaps are updated, and the round's table
is written for the next one. Rounds yield placements by rank interval; documents find theirs by
their distributed rank among equal lengths.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabassay.llm._shared import batched, discard, table
from tabassay.llm._text import column_bytes, slices

#: Words, and parts of words, whose ids a worker remembers at most; others are encoded whenever they come.
CACHE_WORDS = 800_000
#: Rows of one length in one rank group; further rows of that length open further groups.
RANK_GROUP = 20_000
#: A round places lengths from the longest one left down to this share of it.
BAND = 0.5
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# The tokenizer's pre-token pattern over Latin-1 bytes in lower case, and that lower case.
_LETTER, _NUMBER, _SPACE = rb"a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb"\x09-\x0d\x20\x85\xa0"
_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[" + _LETTER + rb"]+|[" + _NUMBER + rb"]|[^" + _SPACE + _LETTER + _NUMBER + rb"]+").findall
_LOWER_LATIN = bytes(b + 32 if 65 <= b <= 90 or (192 <= b <= 222 and b != 215) else b for b in range(256))


_TRIALS = ["Don't STOP\u00a0now: it's 2024, we've 1,234.50 \u00bd!", "  two  spaces\n\nand\ttabs ", "\u00c9cole \u00e9t\u00e9 na\u00efve \u00d7 \u00df\u00aa", "\u65e5\u672c\u8a9e text \U0001f600", "x_y=z; a<b>c {d} [e] #1 @f $9 %", "'tis 'S 'RE ''ll don''t"]


class _Known(dict):
    """Remembered ids; others are looked for among those of the batch at hand."""

    batch: dict[bytes, bytes]

    def __missing__(self, key: bytes) -> bytes:
        return self.batch[key]


class _Encoder:
    """Packed ids of texts from the remembered ids of their pre-tokens.

    In Latin-1 texts, which normalisation leaves as they are but for case, pre-tokens are read off
    by the tokenizer's own pattern. In other texts the units are words, as white space always ends
    a pre-token. A text with a special token's string goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = {"latin-1": _Known(), "utf-8": _Known()}
        self.by_parts = True
        self.by_parts = all(a == struct.pack(f"<{len(b)}I", *b) for a, b in zip(self.texts(_TRIALS), (self.tokenizer.encode(t, add_special_tokens=False).ids for t in _TRIALS), strict=True))

    def _encode(self, new: list[str]) -> Iterator[bytes]:
        for i in range(0, len(new), 8192):
            for e in self.tokenizer.encode_batch_fast(new[i : i + 8192], add_special_tokens=False):
                yield struct.pack(f"<{len(ids := e.ids)}I", *ids)

    def _learn(self, kind: str, units: set[bytes]) -> None:
        known = self.known[kind]
        new = list(units.difference(known))
        known.batch = dict(zip(new, self._encode([u.decode(kind) for u in new]), strict=True))
        if room := max(0, CACHE_WORDS - len(known)):
            known.update(known.batch if len(new) <= room else islice(known.batch.items(), room))

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        split: list[tuple[str, list[bytes]]] = []
        for t in texts:
            if "<|" in t or not self.by_parts:
                split.append(("", []))
                continue
            try:
                split.append(("latin-1", _PARTS(t.encode("latin-1").translate(_LOWER_LATIN))))
            except UnicodeEncodeError:
                split.append(("utf-8", t.encode().split()))
        for kind in self.known:
            self._learn(kind, set().union(*[units for k, units in split if k == kind]))
        for text, (kind, units) in zip(texts, split, strict=True):
            if kind:
                yield b"".join(map(self.known[kind].__getitem__, units))
            else:
                one = self.tokenizer.encode(text, add_special_tokens=False).ids
                yield struct.pack(f"<{len(one)}I", *one)


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return _Encoder(path)


def token_bytes(text: str | None, path: str) -> bytes:
    """Little-endian 32-bit ids of a text."""
    return next(_encoder(path).texts([text or ""]))


def _pieces(batches: Iterable[pa.RecordBatch], path: str, capacity: int, end: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        step, encoder, ids_of = 4 * capacity, _encoder(path), batch.column(0).to_pylist()
        _, offsets = column_bytes(batch.column(1))
        for lo, hi in slices(offsets, 4 << 20):
            texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
            for doc, ids in zip(ids_of[lo:hi], encoder.texts(texts), strict=True):
                ids += end
                rows += [(doc, i // step, i // 4, len(part := ids[i : i + step]) // 4, zlib.crc32(part)) for i in range(0, len(ids), step)]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def tokenised(documents: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of each document's ids and a closing end_id, cut every capacity ids; null texts are empty.

    A tokenizer whose pre-tokens are not those of the pattern above is found out on a few texts and reads whole texts itself.
    """
    run = partial(_pieces, path=path, capacity=capacity, end=np.array([end_id], "<u4").tobytes())
    return documents.select(F.col("doc_id").cast("long"), "text").transform(batched, run, PIECES)


def _match(left: DataFrame, gaps: DataFrame) -> DataFrame:
    """(length, gap, m): how many documents of a length have a gap of that size as successor, from left (length, n) and gaps (gap, number).

    The count over the sorted sizes is cut into cells at every level where a size begins or ends;
    within a cell documents and gaps alternate, and a document goes with the gap behind it.
    """
    sizes = left.select(F.col("length").alias("size"), F.lit(0).alias("kind"), "n").union(gaps.groupBy("gap").agg(F.sum("number").alias("n")).select("gap", F.lit(1), "n"))
    step = F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))
    walk = sizes.withColumn("after", F.sum(step).over(Window.orderBy("size", "kind"))).withColumn("before", F.col("after") - step)
    ends = walk.select("size", "kind", F.explode(F.array(F.least("before", "after"), F.greatest("before", "after"))).alias("level"))
    ends = ends.withColumn("cell", F.dense_rank().over(Window.orderBy("level")))
    widths = ends.groupBy("cell").agg(F.min("level").alias("level")).select("cell", (F.lead("level").over(Window.orderBy("level")) - F.col("level")).alias("m"))
    spans = ends.groupBy("size", "kind").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi")).filter("lo < hi")
    cells = spans.select("size", "kind", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("cell"))
    along = Window.partitionBy("cell").orderBy("size", "kind")
    pairs = cells.withColumns({"gap": F.lead("size").over(along), "then": F.lead("kind").over(along)}).filter("kind = 0 AND then = 1")
    return pairs.join(widths, "cell").groupBy(F.col("size").alias("length"), "gap").agg(F.sum("m").alias("m"))


def _before(value: str, keys: list[str], order: list) -> F.Column:
    """Sum of value over the rows before this one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0).cast("long"))


ROUND = ["length", "lo", "hi", "each", "base", "gap", "first", "number"]


def _round(left: DataFrame, gaps: DataFrame, capacity: int) -> DataFrame:
    """One round over documents left (length, lo, n) and gaps (gap, first, number), placing lengths within BAND of the longest.

    Rows with `each` are placements: ranks lo to hi of a length go to `number` sequences from
    `first`, `each` to a sequence, from offset `base`, and leave it `gap`. Rows with a gap alone are
    gaps that got nothing, rows with a length alone are the documents there were.
    """
    matched = _match(left.withColumn("_most", F.max("length").over(Window.partitionBy())).filter(F.col("length") >= F.col("_most") * BAND), gaps)
    # Gaps of one size are dealt to their lengths by rank; those that no length wants come last.
    dealt = matched.unionByName(gaps.groupBy("gap").agg(F.sum("number").alias("m")).withColumn("length", F.lit(None).cast("long")))
    dealt = dealt.withColumn("from", _before("m", ["gap"], [F.col("length").asc_nulls_last()]))
    dealt = dealt.withColumn("m", F.when(F.col("length").isNull(), F.col("m") - F.col("from")).otherwise(F.col("m")))
    runs = gaps.withColumn("at", _before("number", ["gap"], ["first"]))
    a, b = F.greatest("from", "at"), F.least(F.col("from") + F.col("m"), F.col("at") + F.col("number"))
    met = runs.join(dealt, "gap").filter(a < b).select("gap", "length", (F.col("first") + a - F.col("at")).alias("first"), (b - a).alias("u"))
    # Lengths with more documents than gaps fill their gaps further, in rank order.
    want = met.join(left, "length", "left").withColumn("more", F.floor(F.col("gap") / F.col("length")).cast("long") - 1)
    want = want.withColumns({"spare": F.col("n") - F.sum("u").over(Window.partitionBy("length")), "asked": F.col("u") * F.col("more")}).withColumn("got", _before("asked", ["length"], ["gap", "first"]))
    want = want.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least("asked", F.col("spare") - F.col("got"))))
    want = want.withColumns({"full": F.coalesce(F.expr("extra div nullif(more, 0)"), F.lit(0).cast("long"))}).withColumn("part", F.col("extra") - F.col("full") * F.col("more"))
    one = F.when(F.col("part") > 0, 1).otherwise(0).cast("long")
    each = [(F.col("full"), F.col("more") + 1, F.lit(0)), (one, F.col("part") + 1, F.col("full")), (F.col("u") - F.col("full") - one, F.lit(1), F.col("full") + one)]
    split = F.array(*[F.struct(k.cast("long").alias("number"), e.cast("long").alias("each"), skip.cast("long").alias("skip")) for k, e, skip in each])
    parts = want.select("length", "gap", F.col("lo").alias("start"), F.col("first").alias("at"), F.inline(split)).filter("number > 0")
    parts = parts.withColumns({"each": F.when(F.col("length").isNotNull(), F.col("each")), "first": F.col("at") + F.col("skip")}).withColumn("docs", F.col("number") * F.col("each"))
    parts = parts.withColumn("lo", F.col("start") + _before("docs", ["length"], ["gap", "first"])).withColumns({"hi": F.col("lo") + F.col("docs"), "base": F.lit(capacity) - F.col("gap")})
    placed = parts.withColumn("gap", F.col("gap") - F.coalesce(F.col("each") * F.col("length"), F.lit(0))).withColumn("base", F.when(F.col("each").isNotNull(), F.col("base")))
    none = F.lit(None).cast("long")
    return placed.select(*[F.col(c).cast("long") for c in ROUND]).union(left.select("length", "lo", F.col("lo") + F.col("n"), *[none.alias(c) for c in ROUND[3:]]))


@contextmanager
def _planned_once(spark: SparkSession) -> Iterator[None]:
    """No adaptive planning: a round's tables are one small partition each, and planning them anew stage by stage takes longer than they do."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def best_fit(counts: DataFrame, capacity: int) -> DataFrame:
    """Placements (length, lo, hi, first, each, base) for counts (length, n): see _round. Written, and read back.

    Sequences are opened for the lengths that no gap takes: one for each document over half the
    capacity, and otherwise as many as their ids fill. Only sums and maxima of a round reach the driver.
    A round's tables are bounded by the capacity alone and stay in one partition.
    """
    spark, none = counts.sparkSession, F.lit(None).cast("long")
    state = table(counts.coalesce(1).select("length", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"), *[none.alias(c) for c in ROUND[3:]]), "packing-round")
    rounds, opened = [state], 0
    was = F.col("each").isNull()
    while True:
        every = state.coalesce(1).groupBy("length").agg(
            F.coalesce(F.max(F.when(~was, F.col("hi"))), F.max(F.when(was, F.col("lo")))).alias("lo"), F.max(F.when(was, F.col("hi"))).alias("hi"), F.max("gap").alias("widest")
        )
        left = every.filter("lo < hi").select("length", "lo", (F.col("hi") - F.col("lo")).alias("n"))
        seen = every.withColumn("widest", F.coalesce(F.max("widest").over(Window.partitionBy()), F.lit(0))).filter("lo < hi").withColumn("n", F.when(F.col("length") > F.col("widest"), F.col("hi") - F.col("lo")))
        shortest, ids, big = seen.agg(F.min("length"), F.sum(F.col("n") * F.col("length")), F.sum(F.when(F.col("length") * 2 > capacity, F.col("n")))).first()
        if shortest is None:
            break
        gaps = state.coalesce(1).filter(F.col("gap") >= shortest).select("gap", "first", "number")
        if ids:
            new = max(big or 0, -(-ids // capacity))
            gaps = gaps.union(spark.sql(f"VALUES ({capacity}L, {opened}L, {new}L)")).coalesce(1)
            opened += new
        state = table(_round(left, gaps, capacity), "packing-round")
        rounds.append(state)
    placed = spark.read.schema(state.schema).parquet(*[r._written_at for r in rounds]).filter("each IS NOT NULL")
    plan = table(placed.select("length", "lo", "hi", "first", "each", "base"), "packing-plan")
    discard(*rounds)
    return plan


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...), each length from 1 to capacity.

    Every piece is placed, none is cut; ties are broken by doc_id, piece and the pieces' other
    columns. An empty table gives an empty table. Repeated rows are placed as often as they occur.
    Columns named sequence_id or offset are replaced, all others pass through.
    """
    names = {c: c if c in ("doc_id", "piece", "length") else f"_c{i}" for i, c in enumerate(pieces.columns)}
    pieces = pieces.toDF(*names.values())
    counts = table(pieces.groupBy(F.col("length").cast("long").alias("length")).agg(F.count("*").alias("n")), "lengths")
    shortest, longest, most = counts.agg(F.min("length"), F.max("length"), F.coalesce(F.max("n"), F.lit(1))).first()
    if longest is not None and not 0 < shortest <= longest <= capacity:
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    groups = -(-most // RANK_GROUP)
    with _planned_once(pieces.sparkSession):
        plan = best_fit(counts, capacity)
    intervals = plan.toDF("length", *[f"_{c}" for c in plan.columns[1:]])
    others = [c for c in pieces.columns if c not in ("doc_id", "piece", "length")]
    keyed = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    at = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    before = keyed.groupBy("length", "_g").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(at), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("length", "_g").orderBy("doc_id", "piece", *others)) - 1
    ranked = keyed.withColumn("_own", own).join(before, ["length", "_g"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    # Intervals of one length are cut at every multiple of `step`, so that a rank finds few of them by an equi-join.
    step = max(1, most // 256)
    cut = intervals.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / step), F.floor((F.col("_hi") - 1) / step))))
    placed = ranked.withColumn("_cell", F.floor(F.col("_rank") / step)).join(cut, ["length", "_cell"]).filter("_rank >= _lo AND _rank < _hi")
    nth = F.col("_rank") - F.col("_lo")
    return placed.select(
        *[F.col(inner).alias(c) for c, inner in names.items() if c not in ("sequence_id", "offset")], (F.col("_first") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_base") + (nth % F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(documents: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """tokenised() and pack(): one row for each piece of each document (doc_id, text).

    A null text is an empty one, whose one piece is end_id; very long texts become many pieces;
    repeated rows are packed as often as they occur; other columns are not read.
    """
    return pack(table(tokenised(documents, path, capacity, end_id), "pieces"), capacity)
