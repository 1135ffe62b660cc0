"""Operator 13 against a plain version that handles one row at a time."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabassay.llm import change_applier
from tabassay.llm import queries as Q

SF = "/root/testdata/sf0.01"
FIELDS = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


def one_by_one(rows, batches=10, patience=8):
    """rows: (client, n, change_id, day, op, city, cents, batch); output rows by change_id."""
    out, seen = [], None
    state = defaultdict(lambda: {"next": 1, "held": {}, "city": None, "cents": None})
    final = {}

    def do(client, s, batch, missed):
        while s["next"] in s["held"]:
            change, _, op, city, cents = s["held"].pop(s["next"])
            s["next"] += 1
            if op == "I":
                s["city"], s["cents"] = city, cents
            elif op == "D":
                s["city"] = s["cents"] = None
            elif op == "U":
                s["city"] = s["city"] if city is None else city
                s["cents"] = s["cents"] if cents is None else cents
            final[client] = (len(out), op)
            out.append([change, client, "applied", batch, missed, s["city"], s["cents"], False])
            missed = 0

    for batch in range(1, batches + 2):
        for client, s in state.items():
            while s["held"] and (batch > batches or (seen is not None and min(x[1] for x in s["held"].values()) + patience <= seen)):
                n = min(s["held"])
                missed, s["next"] = n - s["next"], n
                do(client, s, batch, missed)
        mine = sorted((r for r in rows if r[7] == batch), key=lambda r: (r[3], r[2], str(r[4] or ""), str(r[5] or ""), str(r[6] or "")))
        for client, n, change, day, op, city, cents, _ in mine:
            s = state[client]
            if n < s["next"] or n in s["held"]:
                out.append([change, client, "rejected", batch, 0, None, None, False])
                continue
            s["held"][n] = (change, day, op, city, cents)
            do(client, s, batch, 0)
        if mine:
            seen = max([r[3] for r in mine] + ([] if seen is None else [seen]))
    for i, op in final.values():
        out[i][-1] = op != "D"
    return sorted(map(tuple, out), key=str)


def plain(rows):
    """The query's cut of whole rows of client_changes, by hand."""
    rows = set(rows)
    seqs = defaultdict(set)
    for r in rows:
        seqs[r[1]].add(r[2])
    rank = {c: {s: i + 1 for i, s in enumerate(sorted(v, key=lambda s: (s is not None, s)))} for c, v in seqs.items()}
    out = []
    for change, client, seq, op, at, _, _, city, balance in rows:
        h = 0 if change is None else zlib.crc32(str(change).encode())
        if at is None or h % 11 == 0:
            continue
        day = (at - datetime(1970, 1, 1)).days + 5 * (h % 4)
        cents = None if balance is None else int(np.floor(100 * balance + 0.5))
        out.append((client, rank[client][seq], change, day, op, city, cents, max(1, min(10, 1 + (day - 19723) * 10 // 160))))
    return one_by_one(out)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/client_changes.parquet").select(*[f.split()[0] for f in FIELDS.split(", ")]).collect()]
    want, have = plain(rows), got(Q.op13_sequenced_changes(spark, SF))
    assert have == want
    assert {r[2] for r in have} == {"applied", "rejected"} and any(r[4] for r in have) and any(r[3] == 11 for r in have)


@pytest.mark.parametrize("seed", range(1))
def test_tick_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.randrange(1, 40), i, rng.randrange(0, 100), rng.choice("IUDUX"), rng.choice([None, "a", "b"]), rng.choice([None, 5, 2**60]), 0) for i in range(300)]
    rows = [(*r[:7], 1 + r[3] * 4 // 100) for r in rows]
    rows = [r for r in rows if r[7] != 3]  # a batch without rows
    df = spark.createDataFrame(rows, "client_id long, n long, change_id long, day long, op string, city string, cents long, batch int")
    have = change_applier.apply(df.repartition(5), batches=4, patience=6, buckets=3)
    assert got(have.select("change_id", "client_id", "status", "batch", "missed", "city", "cents", "current")) == one_by_one(rows, 4, 6)


def test_edges(spark, tmp_path):
    at = datetime(2024, 2, 3, 4)
    rows = [(1, 7, None, "I", at, "s", "t", None, float("nan")), (1, 7, None, "I", at, "s", "t", None, float("nan")), (2, None, 5, None, at, None, None, "x", None), (None, 7, 3, "U", at, "s", "t", "y", 1.0), (5, 7, 3, "U", None, "s", "t", "y", 1.0), (6, 7, 9, "D", at, "s", "t", "y" * 100_000, -0.005)]
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 AS n", "2 AS day", "3 AS part")
    cut = Q.client_changes(df.drop("n", "day", "part"))
    assert {(r.change_id, r.n) for r in cut.collect()} == {(1, 1), (2, 1), (6, 3)}
    cut = cut.withColumn("batch", F.lit(1))
    out = {r.change_id: r for r in change_applier.apply(cut, 1, buckets=2).collect()}
    assert out[1].cents == 0 and out[1].city is None and out[2].client_id is None and out[2].city is None and out[2].current
    assert out[6].missed == 1 and out[6].batch == 2 and not out[6].current and out[6].city is None
    assert change_applier.apply(cut.filter("false"), 1, buckets=2).count() == 0


def test_rank_of_a_client_over_many_partitions(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 2 END AS client_id", "id % 700 AS seq")
    assert change_applier.ranked(rows).exceptAll(rows.selectExpr("*", "CAST(dense_rank() OVER (PARTITION BY client_id ORDER BY seq) AS BIGINT) AS n")).count() == 0
