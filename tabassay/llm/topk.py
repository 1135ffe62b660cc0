"""Exact top-k inner products by reading sorted lists without random access.

Candidates lie in blocks, each stored as one list for every dimension, sorted by value, with the
candidates' places. Queries are read through all blocks where these lie: bounded sets of queries
are broadcast one after the other, and nothing but the best rows is shuffled. Reading a block's
lists from the top for positive weights and from the bottom for negative ones fixes a lower and an
upper score of every candidate: what has been read counts as it is, what has not lies between the
value just read and the list's other end. Reading deepens until no outsider's upper score reaches
the k-th best score known so far, in this block or, from a first round over one block in SHARE,
anywhere; only then are the remaining candidates' scores resolved from the rest of the lists.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabassay.llm._shared import batched, discard, table

#: Parts of the lists that are read before bounds are compared; the last settles every score.
DEPTHS = (0.0, 0.125, 0.25, 0.5, 1.0)
#: Components beyond this are multiplied as Python integers instead.
MAX_FLOAT_COMPONENT = 2**20
#: One block in so many gives the first scores that outsiders must reach.
SHARE = 16
_BLOCK = "b int, dims int, ids array<long>, lists array<long>, places array<int>"
_HIT = "query_id long, vec_id long, score long, read long"


def packed(group: pa.Table) -> pa.Table:
    """One row of a block: its ids in order, and for every dimension the values from the top down and whose they are."""
    ids = group.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    dims = group.column("dims")[0].as_py()
    values = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)[order]
    places = np.argsort(-values, axis=0, kind="stable")
    lists = np.take_along_axis(values, places, axis=0)
    one = lambda x, t: pa.array([x], pa.list_(t))
    return pa.table({
        "b": pa.array([group.column("b")[0].as_py()], pa.int32()), "dims": pa.array([dims], pa.int32()), "ids": one(ids[order], pa.int64()),
        "lists": one(lists.T.ravel(), pa.int64()), "places": one(places.T.ravel().astype(np.int32), pa.int32()),
    })


def _read(lists: np.ndarray, places: np.ndarray, depth: int, top: bool, rest: np.ndarray) -> np.ndarray:
    """Candidates x dimensions: the first depth values of each list from its top or bottom, and rest where nothing was read."""
    dims, n = lists.shape
    out = np.tile(rest, (n, 1))
    some = slice(0, depth) if top else slice(n - depth, n)
    out[places[:, some].ravel(), np.repeat(np.arange(dims), depth)] = lists[:, some].ravel()
    return out


def survivors(queries: np.ndarray, lists: np.ndarray, places: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates can still be among the k best of each query, and how much of the lists each query read.

    own marks candidates that are the query itself; floor is a score that k candidates are known to reach.
    """
    n = lists.shape[1]
    lists, alive, read = lists.astype(np.float64), ~own, np.zeros(len(queries))
    up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    pending = np.arange(len(queries))
    for share in DEPTHS:
        depth = min(n, int(np.ceil(n * share)))
        read[pending] = depth
        # The value just read, or the list's own end before anything is read.
        high, low = lists[:, max(0, depth - 1)], lists[:, min(n - 1, n - depth)]
        upper = up[pending] @ _read(lists, places, depth, True, high).T + down[pending] @ _read(lists, places, depth, False, low).T
        known = floor[pending]
        if depth:
            lower = up[pending] @ _read(lists, places, depth, True, lists[:, -1]).T + down[pending] @ _read(lists, places, depth, False, lists[:, 0]).T
            lower[own[pending]] = -np.inf
            if n >= k:
                known = np.maximum(known, np.partition(lower, n - k, axis=1)[:, n - k])
        alive[pending] &= upper >= known[:, None]
        pending = pending[alive[pending].sum(axis=1) > 4 * k]
        if not len(pending):
            break
    return alive, read


def block_top(query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, ids: np.ndarray, lists: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of query, candidate, score) of the k best of a block that reach floor, ties to the smaller id, and the values each query read."""
    own = query_ids[:, None] == ids[None, :]
    dims, n = lists.shape
    if max(np.abs(lists).max(initial=0), np.abs(queries).max(initial=0)) < MAX_FLOAT_COMPONENT and dims < 4096:
        alive, depth = survivors(queries, lists, places, own, floor, k)
        q, c = np.nonzero(alive)
        whole = _read(lists, places, n, True, lists[:, 0])
        scores = np.concatenate([np.einsum("ij,ij->i", queries[q[i : i + 65536]], whole[c[i : i + 65536]]) for i in range(0, max(1, len(q)), 65536)])
    else:
        q, c = np.nonzero(~own)
        depth, whole = np.full(len(queries), n), _read(lists, places, n, True, lists[:, 0])
        scores = np.array([min(max(sum(map(int.__mul__, queries[i].tolist(), whole[j].tolist())), -(2**63)), 2**63 - 1) for i, j in zip(q, c, strict=True)], np.int64)
    small = not len(scores) or np.abs(scores.astype(np.float64)).max() < 2**53
    best = np.lexsort((c, -scores.astype(np.float64), q)) if small else np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(scores[i]), c[i])))
    q, c, scores = q[best], c[best], scores[best]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], ids[c[rank < k]], scores[rank < k], depth * dims


def _meet(batches: Iterable[pa.RecordBatch], shared: Broadcast, k: int, step: int = 512) -> Iterator[pa.RecordBatch]:
    """The best of each block for every query of a set: (query ids, vectors, floors) by number of dimensions."""
    for batch in batches:
        for r in range(batch.num_rows):
            _, dims, ids, lists, places = (batch.column(i)[r] for i in range(5))
            if (dims := dims.as_py()) not in shared.value:
                continue
            ids, lists, places = (x.values.to_numpy(zero_copy_only=False) for x in (ids, lists, places))
            query_ids, vectors, floor = shared.value[dims]
            for i in range(0, len(query_ids), step):
                q, c, s, read = block_top(query_ids[i : i + step], vectors[i : i + step], floor[i : i + step], ids, lists.reshape(dims, -1), places.reshape(dims, -1), k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[i : i + step][q]), pa.array(c), pa.array(s), pa.array(read[q].astype(np.int64))], names=["query_id", "vec_id", "score", "read"])


def _by_size(rows: pa.Table, floor: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    found: dict[int, list] = {}
    for i, v in zip(rows.column("vec_id").to_pylist(), rows.column("v").to_pylist(), strict=True):
        found.setdefault(len(v), []).append((i, v, floor.get(i, -np.inf)))
    return {n: (np.array([x[0] for x in r], np.int64), np.array([x[1] for x in r], np.int64).reshape(-1, n), np.array([x[2] for x in r], float)) for n, r in found.items()}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, query_rows: int = 16384, block: int = 4096) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query the k highest inner products, ties to the smaller id.

    vectors and queries: (vec_id long, v array<long>). A query never finds rows of its own id.
    Rows with a null id, a null or empty vector or null components take no part; only vectors of
    the same number of components meet; a repeated candidate row counts once for each row, of
    several vectors of one query id the least is asked. Scores outside 64 bits are held at the
    nearest end. Empty tables give an empty one; other columns are not read. At most query_rows
    queries are broadcast at a time, and a task holds one block of about `block` candidates.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    vectors, queries = clean(vectors.select("vec_id", "v")), clean(queries.select("vec_id", "v"))
    blocks_wanted = max(1, -(-vectors.count() // block))
    # Of a row that is repeated over and over, k can matter.
    different = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("n")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))))
    placed = different.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id", "v", "nth"), F.lit(blocks_wanted)).cast("int").alias("b"))
    blocks = table(placed.groupBy("b", "dims").applyInArrow(packed, _BLOCK).repartition(blocks_wanted, "b", "dims"), "blocks")
    sets = max(1, -(-queries.select("vec_id").distinct().count() // (query_rows * 3 // 4)))
    asked = table(queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(sets)).cast("int")), "queries")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda hits: hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out = []
    for s in range(sets):
        rows = asked.filter(F.col("s") == s).select("vec_id", "v").toArrow()
        first = spark.sparkContext.broadcast(_by_size(rows, {}))
        seen = blocks.filter(F.col("b") % SHARE == 0).transform(batched, partial(_meet, shared=first, k=k), _HIT)
        floor = {r["query_id"]: r["score"] for r in top(seen).filter(F.col("rank") == k).collect()}
        first.unpersist()
        second = spark.sparkContext.broadcast(_by_size(rows, floor))
        hits = blocks.transform(batched, partial(_meet, shared=second, k=k), _HIT)
        out.append(table(top(hits).select("query_id", "rank", "vec_id", "score"), "best"))
        second.unpersist()
    discard(blocks, asked)
    found = out[0]
    for one in out[1:]:
        found = found.unionByName(one)
    return found


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as a double; vectors with null or non-finite components go."""
    finite = "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))"
    return embeddings.filter(finite).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
