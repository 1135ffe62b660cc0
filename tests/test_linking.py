"""Nearest records by blocks around pivots equal a plain search over all pairs, and bounds leave few blocks where rows cluster."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabassay.operators import linking

NAMES = ["a", "b c", "d"]


def plain(s: pd.DataFrame, t: pd.DataFrame, metric: str) -> dict:
    out = {}
    for _, r in s.iterrows():
        x, y = r[NAMES].to_numpy(float), t[NAMES].to_numpy(float)
        with np.errstate(all="ignore"):
            if metric == "cityblock":
                d = np.abs(y - x).sum(axis=1)
            elif metric == "euclidean":
                d = np.sqrt(((y - x) ** 2).sum(axis=1))
            else:
                d = 1 - y @ x / (np.linalg.norm(y, axis=1) * np.linalg.norm(x))
        good = np.isfinite(d)
        if good.any():
            least = d[good].min()
            out[int(r["row_id"])] = (least, set(t["_t"][good & (d <= least + 1e-12)].astype(int)))
    return out


@pytest.fixture
def tables(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(0, 50, (12, 3))
    t = pd.DataFrame(centres[draw.integers(12, size=1500)] + draw.normal(0, 1, (1500, 3)), columns=NAMES)
    t.loc[200:699] = t.loc[200].to_numpy()  # a third of all rows is one
    t.loc[700:760] = np.round(t.loc[700:760])
    t.loc[5, "a"], t.loc[6] = None, 0.0
    t["_t"] = draw.permutation(1500)
    s = pd.DataFrame(np.r_[centres[draw.integers(12, size=160)] + draw.normal(0, 1, (160, 3)), t[NAMES].iloc[190:230].to_numpy()], columns=NAMES)
    s.loc[3, "d"], s.loc[4] = None, 0.0
    s["row_id"] = range(200)
    frame = lambda p: spark.createDataFrame(p).select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) for c in NAMES], *[c for c in p.columns if c not in NAMES])
    return s, t, frame(s), frame(t)


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "cosine"])
def test_blocks_around_pivots_equal_a_plain_search(tables, monkeypatch, metric):
    monkeypatch.setattr(linking, "BLOCK_ROWS", 64)
    s, t, sd, td = tables
    found = {r["row_id"]: r for r in linking.PivotedNearest(sd, td, NAMES, metric, "row_id", block=64).rows().collect()}
    want = plain(s, t, metric)
    assert set(found) == set(want)
    for k, (d, ids) in want.items():
        got = linking_value(found[k]["_d"], metric)
        assert got == pytest.approx(d, abs=1e-9) and found[k]["_t"] in ids
        if metric != "cosine":
            assert found[k]["_t"] == min(ids)


def linking_value(d: float, metric: str) -> float:
    return d**0.5 if metric == "euclidean" else d


def test_blocks_of_many_parts_and_few_pivots(tables, monkeypatch):
    monkeypatch.setattr(linking, "MAX_PIVOTS", 2)
    monkeypatch.setattr(linking, "MAX_BLOCKS", 3)
    s, t, sd, td = tables
    search = linking.PivotedNearest(sd, td, NAMES, "euclidean", "row_id", block=40)
    assert search.blocks.parts.max() > 1
    found = {r["row_id"]: r["_t"] for r in search.rows().collect()}
    assert found == {k: min(ids) for k, (_, ids) in plain(s, t, "euclidean").items()}


def test_bounds_rule_out_most_blocks_of_clustered_rows(tables):
    _, _, sd, td = tables
    left, every = linking.PivotedNearest(sd, td, NAMES, "euclidean", "row_id", block=64).tried()
    assert every > 2000 and left < every / 10


def test_empty_sides(tables):
    _, _, sd, td = tables
    assert linking.blocked_nearest(sd.limit(0), td, NAMES, "euclidean").count() == 0
    none = linking.blocked_nearest(sd, td.limit(0), NAMES, "euclidean")
    assert none.count() == 0 and none.columns == ["row_id", "dcr", "closest"]


def test_nearest_takes_blocks_beyond_the_broadcast(tables, monkeypatch):
    _, _, sd, td = tables
    td = td.withColumnRenamed("_t", "row_id")
    few = {r["row_id"]: (r["dcr"], r["closest"]) for r in linking.nearest(sd, td, NAMES).collect()}
    monkeypatch.setattr(linking, "BROADCAST_ROWS", 100)
    many = {r["row_id"]: (r["dcr"], r["closest"]) for r in linking.nearest(sd, td, NAMES).collect()}
    assert many == few


def test_cityblock_distances_take_little_more_than_their_result():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(200, 9)), rng.normal(size=(1000, 9))
    tracemalloc.start()
    got = linking._block_minimum("cityblock")(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == sum(np.abs(a[:, [i]] - b[:, i]) for i in range(9))).all() and peak < 1.5 * got.nbytes
