"""Near-duplicate groups: MinHash bands propose pairs, odd sketches screen them, full shingle sets confirm them.

Copies with equal shingle sets collapse into one class first. Inside a band bucket every class is
tried against one pivot instead of against every other member: pairs whose odd sketches are near
enough have their texts compared, and links found that way are closed into components. Only buckets whose members are still in different components are compared across
those components, in blocks, where an odd sketch (the parity bitmap of the MinHash samples; the
XOR's population count estimates the similarity) must come near the threshold before sets are
compared. Every link that counts has been confirmed on whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm._components import components
from tabassay.llm._shared import batched, discard, table
from tabassay.llm._text import U64, column_bytes, mix, prefix_sums, slices, span_hashes, words

SHINGLE, BANDS, ROWS = 5, 25, 4
SAMPLES, SKETCH_WORDS = BANDS * ROWS, 8
#: A pair is dropped unread only if its estimate lies this far below the threshold: 5 standard deviations of the estimate.
MARGIN = 0.27
#: Parts that the partners of one pivot are dealt to while they are confirmed; a pivot with more than 1 in HEAVY of all pairs gets as many for each such share.
SALTS, HEAVY = 16, 1024
#: Documents and text bytes of a block, of which two meet in a task.
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20

_RANDOM = np.random.Generator(np.random.PCG64(77))
_XOR = _RANDOM.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_MULTIPLY = _RANDOM.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALT = _RANDOM.integers(0, 2**63, SAMPLES, dtype=np.int64).astype(U64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and where each row's begin; fewer than SHINGLE words are one shingle."""
    units = words(data, offsets)
    n = np.diff(units.first)
    sums = prefix_sums(units.hashes(lower=True))
    starts = np.flatnonzero((np.arange(len(units.row)) <= units.first[units.row + 1] - SHINGLE) | ((np.arange(len(units.row)) == units.first[units.row]) & (n[units.row] < SHINGLE)))
    row = units.row[starts]
    hashes = span_hashes(sums, starts, np.minimum(starts + SHINGLE, units.first[row + 1]))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])] if len(row) else np.zeros(0, bool)
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(offsets)))


def signatures(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint (2 words), band hashes and odd sketch of each non-empty set."""
    heads = first[:-1]
    prints = np.stack([np.add.reduceat(hashes, heads), np.bitwise_xor.reduceat(mix(hashes ^ U64(0xA5A5A5A5DEADBEEF)), heads)], axis=1)
    short = (hashes >> U64(32)).astype(np.uint32)
    least = np.empty((len(heads), SAMPLES), np.uint32)
    for k in range(SAMPLES):
        least[:, k] = np.minimum.reduceat((short ^ _XOR[k]) * _MULTIPLY[k], heads)
    sample = mix(least.astype(U64) ^ _SALT)
    bands = sample[:, ::ROWS].copy()
    for k in range(1, ROWS):
        bands = mix(bands * U64(0x100000001B3) ^ sample[:, k::ROWS])
    sketch = np.zeros((len(heads), SKETCH_WORDS), U64)
    place = sample % U64(64 * SKETCH_WORDS)
    at = np.arange(len(heads))
    for k in range(SAMPLES):
        sketch[at, (place[:, k] >> U64(6)).astype(int)] ^= U64(1) << (place[:, k] & U64(63))
    return prints, bands, sketch


def most_different_bits(similarity: float) -> int:
    """Set bits of the XOR of two odd sketches that a pair of this MinHash similarity has on average."""
    bits = 64 * SKETCH_WORDS
    return math.ceil(bits / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / bits)))


_SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>"


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for lo, hi in slices(offsets):
            hashes, first = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            n = np.diff(first)
            full = np.flatnonzero(n)
            prints, bands, sketch = np.zeros((hi - lo, 2), np.int64), np.zeros((hi - lo, BANDS), np.int64), np.zeros((hi - lo, SKETCH_WORDS), np.int64)
            if len(full):
                got = signatures(hashes, np.r_[first[full], len(hashes)])
                for out, x in zip((prints, bands, sketch), got, strict=True):
                    out[full] = x.view(np.int64)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (bands, sketch)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(prints[:, 0]), pa.array(prints[:, 1]), *lists], names=["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y), 1):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared * 100 >= percent * (len(x) + len(y) - shared)


def _confirm(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, salt, partner or null, text) in the order of pivot, salt, pivot's own row first: links (a, b)."""
    now, own = None, []
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        partners = batch.column(2).to_pylist()
        data, offsets = column_bytes(batch.column(3))
        a, b = [], []
        for lo, hi in slices(offsets):
            hashes, first = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            for r in range(lo, hi):
                this = hashes[first[r - lo] : first[r - lo + 1]]
                if partners[r] is None:
                    own = [*(own if keys[r] == now else []), this.copy()]
                    now = keys[r]
                elif keys[r] == now and any(_linked(x, this, percent) for x in own):
                    a.append(now[0])
                    b.append(partners[r])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose whole shingle sets, made of texts (cid, text), have 100 * shared >= percent * united.

    A pivot's text travels once to each of the salted parts that hold its partners, and partners
    stream past it, so one popular pivot neither fills a task nor collects its partners. There are
    at most HEAVY pivots with more parts than SALTS, and they alone are broadcast.
    """
    share = max(1, pairs.count() // HEAVY)
    heavy = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > share).select(F.col("a").alias("_a"), F.ceil(F.col("n") / share).alias("_n"))
    parts = SALTS * F.coalesce("_n", F.lit(1))
    salted = pairs.join(F.broadcast(heavy), F.col("a") == F.col("_a"), "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("salt"))
    asked = salted.select("a", "salt", F.col("b").alias("partner"), F.col("b").alias("cid")).union(
        salted.select("a", "salt").distinct().select("a", "salt", F.lit(None).cast("long"), "a")
    )
    rows = asked.join(texts.hint("merge"), "cid").select("a", "salt", "partner", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("partner").asc_nulls_first())
    return rows.transform(batched, partial(_confirm, percent=percent), "a long, b long").distinct()


_LINKED = "a long, b long"


def _match(group: pa.Table, percent: int, most: int) -> pa.Table:
    """Links between documents of different components in a pair of blocks, one for each two components that a link joins.

    Only pairs that share a band and whose sketches are near enough are confirmed, the nearest
    first; once two components are joined, their other pairs need no look.
    """
    group = group.combine_chunks()
    get = lambda c, n: np.array(group.column(c).to_pylist(), np.int64).reshape(-1, n)
    cid, label, n, block = (group.column(c).to_numpy() for c in ("cid", "label", "n_shingles", "block"))
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    bands, sketch = get("bands", BANDS), get("sketch", SKETCH_WORDS).view(U64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for x in left.tolist():
        y = right[right > x] if lo == hi else right
        y = y[(label[y] != label[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent)]
        y = y[(bands[y] == bands[x]).any(axis=1)]
        apart = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1)
        y, apart = y[apart <= most], apart[apart <= most]
        found.append((np.full(len(y), x), y, apart))
    i, j, apart = (np.concatenate(c) if found else np.zeros(0, int) for c in (zip(*found, strict=True) if found else ([], [], [])))
    order = np.argsort(apart, kind="stable")
    data, offsets = column_bytes(group.column("text").combine_chunks() if isinstance(group.column("text"), pa.ChunkedArray) else group.column("text"))
    used, sets, parent = set(i.tolist()) | set(j.tolist()), {}, {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for r in sorted(used):
        sets[r] = shingle_sets(data[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]))[0]
    a, b = [], []
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        p, q = root(int(label[x])), root(int(label[y]))
        if p != q and _linked(sets[x], sets[y], percent):
            parent[max(p, q)] = min(p, q)
            a.append(int(cid[x]))
            b.append(int(cid[y]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _matcher(percent: int, most: int) -> Callable[[pa.Table], pa.Table]:
    def match(group: pa.Table) -> pa.Table:
        return _match(group, percent, most)

    return match


def _across(open_members: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket; open_members: (bucket, cid, label).

    Buckets that overlap are one family. A family is cut into blocks of bounded rows and bytes and
    every two blocks meet in a task of their own, which sends back links only.
    """
    hubs = table(open_members.groupBy("bucket").agg(F.min("cid").alias("hub")), "hubs")
    family = components(open_members.join(hubs, "bucket").select(F.col("cid").alias("a"), F.col("hub").alias("b")))
    docs = family.select(F.col("node").alias("cid"), F.col("component").alias("family")).join(open_members.select("cid", "label").distinct(), "cid")
    docs = table(docs.join(classes.select("cid", "n_shingles", "bands", "sketch"), "cid").join(texts.hint("merge"), "cid"), "families")
    need = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES))
    sizes = docs.groupBy("family").agg(F.greatest(need, F.lit(1)).cast("int").alias("blocks"))
    placed = docs.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # Without this the pairs would stay where their family is: one task for all of them.
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other").cast("int")).withColumn("hi", F.greatest("block", "other").cast("int"))
    most = most_different_bits(percent / 100 - MARGIN)
    spread = pairs.drop("other", "blocks").repartition("family", "lo", "hi")
    links = table(spread.groupBy("family", "lo", "hi").applyInArrow(_matcher(percent, most), _LINKED), "links")
    discard(docs, hubs)
    return links


def screened(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose odd sketches and set sizes allow the similarity."""
    one = lambda c: classes.select(F.col("cid").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    near = (apart <= most_different_bits(percent / 100 - MARGIN)) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return pairs.join(one("a"), "a").join(one("b"), "b").filter(near).select("a", "b")


def groups(documents: DataFrame, percent: int = 75) -> DataFrame:
    """One row for each row of documents (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) runs outside ASCII white space, shingles five of them. Rows of one
    doc_id are one document. component_id is the least doc_id that confirmed links reach, kept says
    whether it is the row's own. Null, empty and blank texts have no shingles and stay alone; a
    null doc_id links with nothing, its component is null and it is kept. An empty table gives an
    empty one, texts of any length are read whole, other columns are not read. Bands of four
    samples miss a pair at similarity 0.75 with probability (1 - 0.75**4)**25, below 1 in 10,000.
    Shingles are compared by 64-bit hashes.
    """
    signed = table(documents.select(F.col("doc_id").cast("long"), "text").transform(batched, _sign, _SIGNED), "signatures")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = table(usable.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("cid"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    # Rows of one doc_id with different texts, and rows of one text, are linked without a look at the texts.
    same_id = usable.select(F.col("doc_id"), "f1", "f2", "n_shingles").join(classes.select("f1", "f2", "n_shingles", "cid"), ["f1", "f2", "n_shingles"])
    same_id = same_id.filter("doc_id != cid").select(F.col("doc_id").alias("a"), F.col("cid").alias("b"))

    banded = classes.select("cid", F.posexplode("bands").alias("i", "h")).select("cid", F.xxhash64("i", "h").alias("bucket"))
    # What is grouped by bucket is written before it is joined, so that a crowded bucket can be split over tasks.
    shared = table(banded.groupBy("bucket").agg(F.min("cid").alias("pivot"), F.max("cid").alias("top")).filter("pivot < top").drop("top"), "shared")
    members = table(banded.join(shared, "bucket"), "buckets")
    ids = documents.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("cid"), "text")
    texts = table(ids.join(members.select("cid").distinct().hint("merge"), "cid", "left_semi"), "texts")
    stars = members.filter("cid != pivot").groupBy("cid").agg(F.min("pivot").alias("a")).select("a", F.col("cid").alias("b"))
    stars = table(screened(stars, classes, percent), "stars")
    links = table(confirm(stars, texts, percent), "links")
    labels = components(links)

    placed = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", F.coalesce("component", "cid").alias("label"))
    mixed = table(placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket"), "mixed")
    open_members = table(placed.join(mixed, "bucket"), "open")
    late = _across(open_members, classes, texts, percent)
    every = same_id.union(links).union(late)
    component = components(every)
    discard(shared, members, texts, stars, mixed, open_members, links, late)  # the components are a table of their own
    return signed.join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept")
    )
