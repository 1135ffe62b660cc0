"""Connected components by alternating large-star and small-star steps, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm._shared import discard, table

#: A hub has more than 1 in HUB_SHARE of all edge ends, so there are at most HUB_SHARE hubs, and hubs may be broadcast.
HUB_SHARE = 1024
#: Edges from which hubs are treated apart.
HUBS_FROM = 200_000


def _with_least(near: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """Joins each (u, v) with the least neighbour m of u. Hubs' rows stay where they are and meet a broadcast of at most HUB_SHARE rows."""
    if ends < HUBS_FROM:
        return near.join(least.select("u", "m"), "u")
    hub = F.col("d") > ends // HUB_SHARE
    hubs = least.filter(hub).select("u", "m")
    light = near.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.filter(~hub).select("u", "m"), "u")
    return near.join(F.broadcast(hubs), "u").unionByName(light)


def _stars(edges: DataFrame, large: bool, ends: int) -> DataFrame:
    """One step over edges (u, v), u > v: each node's larger (or not larger) neighbours move to its least one."""
    near = edges.select("u", "v")
    if large:
        near = near.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("d"))
    moved = _with_least(near, least, ends)
    if large:
        moved = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Rows (node, component) for every node of edges (a, b); the component is its least node.

    Null ends and self-links connect nothing. The ids may have any orderable type. Every round is a
    written table, and the rounds end when the edges no longer change. A hub's edges are neither
    shuffled nor gathered to find its least neighbour: counts and minima are combined before the
    shuffle, and the few hubs there can be come back by broadcast. A graph that has not settled
    after max_rounds raises instead of giving partial labels.
    """
    pair = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    now = table(edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(*pair).distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        ends = 2 * state[0]
        earlier, now = now, table(_stars(_stars(now, True, ends), False, ends), "edges")
        state, before = _state(now), state
        discard(earlier)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
