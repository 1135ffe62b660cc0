"""Sequenced change applier: numbered changes of many clients, applied in order by a stateful stream.

Clients are dealt into hash buckets. A bucket is one key of a transformWithStateInPandas query; it
gets one tick row in every batch, so that its held changes are looked at even if none arrives. State
is two maps: (client, n) to a held change and client to its next number and values. A batch handles
all clients of a bucket together: held and arriving changes are sorted once, runs of consecutive
numbers are found by differences, and values are carried along by segmented scans.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tabassay.llm._shared import discard, shared_dir, table

#: Days that a held change waits for the numbers before it.
PATIENCE = 8
#: Rows for which one bucket more is dealt out.
BUCKET_ROWS = 100_000

_HELD = "change_id long, day long, op string, city string, cents string"
_ROWS = f"bucket long, client string, n long, {_HELD}, batch int, edge long"
_OUT = "change_id long, client string, n long, op string, status string, batch int, missed long, city string, cents string"
_COLUMNS = ["client", "n", "change_id", "day", "op", "city", "cents"]
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Each start is one micro-batch: a store that is closed with its task leaves nothing on the executor.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def ranked(rows: DataFrame) -> DataFrame:
    """rows with n, the dense rank of seq among its client's rows, from 1; null seqs come first, a null client is one client.

    Distinct numbers are range-sorted and counted by partition, and only the counts are ranked by
    client, so that a client of any size is spread over tasks.
    """
    keys = table(rows.select("client_id", "seq").distinct().repartitionByRange(F.col("client_id"), F.col("seq")).withColumn("part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("client_id", "part").orderBy("seq")
    before = Window.partitionBy("client_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = keys.groupBy("client_id", "part").count().select(F.col("client_id").alias("_c"), F.col("part").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    local = keys.withColumn("i", F.row_number().over(inside))
    n = table(local.join(counts, local["client_id"].eqNullSafe(counts["_c"]) & (local["part"] == counts["_p"])).select(F.col("client_id").alias("_c"), F.col("seq").alias("_s"), (F.col("i") + F.col("before")).alias("n")), "numbers")
    out = table(rows.join(n, rows["client_id"].eqNullSafe(n["_c"]) & rows["seq"].eqNullSafe(n["_s"])).drop("_c", "_s"), "ranked")
    discard(keys, n)
    return out


def _ends(codes: np.ndarray) -> np.ndarray:
    """Whether each element is the last of its group of neighbours."""
    return np.r_[codes[1:] != codes[:-1], True] if len(codes) else np.zeros(0, bool)


def _starts(codes: np.ndarray) -> np.ndarray:
    return np.r_[True, codes[1:] != codes[:-1]] if len(codes) else np.zeros(0, bool)


def _place(starts: np.ndarray) -> np.ndarray:
    """Position of the first element of each element's group."""
    return np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))


def released(codes: np.ndarray, n: np.ndarray, day: np.ndarray, latest: float) -> np.ndarray:
    """Of held changes in the order of client and n, those that jumps free: runs of consecutive numbers, while the earliest day of what is left is at most latest."""
    if not len(n):
        return np.zeros(0, bool)
    # The least day from each change to its client's last one: a running minimum from behind, apart by client.
    back, order = codes[::-1], day[::-1].astype(np.float64)
    rank = np.cumsum(_starts(back))
    span = order.max() - order.min() + 1
    least = (np.minimum.accumulate(order - rank * span) + rank * span)[::-1]
    heads = _starts(codes) | np.r_[True, np.diff(n) != 1]
    return least[_place(heads)] <= latest


def carried(codes: np.ndarray, op: np.ndarray, value: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A value after each applied change: I and D set it (D to null), U sets it if not null, others leave it; before is what the client had."""
    i = np.arange(len(codes))
    some = np.array([v is not None for v in value], bool)
    sets = (op == "I") | (op == "D") | ((op == "U") & some)
    last = np.maximum.accumulate(np.where(sets, i, -1)) if len(i) else i
    own = last >= _place(_starts(codes))
    return np.where(own, np.where(op == "D", None, value)[last], before) if len(i) else value


def tick(held: pd.DataFrame, clients: pd.DataFrame, rows: pd.DataFrame, latest: float, batch: int) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """One batch of a bucket: output rows, held changes afterwards, those no longer held, and changed clients.

    held and rows have _COLUMNS, clients client, next, city and cents; latest is the day up to which waiting has ended.
    """
    names = pd.unique(pd.concat([held["client"], rows["client"], clients["client"]], ignore_index=True))
    code = pd.Series(np.arange(len(names)), index=names)
    number = np.ones(len(names), np.int64)
    number[code.loc[clients["client"]].to_numpy()] = clients["next"].to_numpy()

    def sort(df: pd.DataFrame, *ties: str) -> tuple[pd.DataFrame, np.ndarray]:
        codes = code.loc[df["client"]].to_numpy()
        # Names of ties are few and short; numbers stay numbers.
        keys = [pd.factorize(df[t].fillna("").astype(str), sort=True)[0] if df[t].dtype == object else df[t].to_numpy() for t in reversed(ties)]
        order = np.lexsort((*keys, df["n"].to_numpy(), codes))
        return df.iloc[order].reset_index(drop=True), codes[order]

    held, codes = sort(held)
    n = held["n"].to_numpy(np.int64)
    out = released(codes, n, held["day"].to_numpy(np.int64), latest)
    heads = _starts(codes) | np.r_[True, np.diff(n) != 1][: len(n)]
    reached = np.where(_starts(codes), number[codes], np.r_[0, n[:-1] + 1][: len(n)])
    freed, missed = held[out], np.where(heads, n - reached, 0)[out]
    np.maximum.at(number, codes[out], n[out] + 1)
    kept = held[~out]

    rows, at = sort(rows, "day", "change_id", "op", "city", "cents")
    first = _starts(at) | np.r_[True, np.diff(rows["n"].to_numpy(np.int64)) != 0][: len(at)]
    known = pd.MultiIndex.from_arrays([rows["client"], rows["n"]]).isin(pd.MultiIndex.from_arrays([kept["client"], kept["n"]])) if len(rows) and len(kept) else np.zeros(len(rows), bool)
    taken = first & ~known & (rows["n"].to_numpy(np.int64) >= number[at])
    refused = rows[~taken]

    waiting, codes = sort(pd.concat([kept, rows[taken]], ignore_index=True) if len(kept) else rows[taken])
    n = waiting["n"].to_numpy(np.int64)
    run = n == number[codes] + np.arange(len(n)) - _place(_starts(codes))
    np.maximum.at(number, codes[run], n[run] + 1)

    applied, codes = sort(pd.concat([freed.assign(missed=missed), waiting[run].assign(missed=0)], ignore_index=True))
    had = clients.set_index("client")
    op, at_client = applied["op"].to_numpy(object), names[codes]
    for value in ("city", "cents"):
        old = had[value].reindex(at_client).to_numpy(object)
        applied[value] = carried(codes, op, _plain(applied[value]), np.array([None if v is None or v != v else v for v in old], object))
    last = applied[_ends(codes)]
    changed = pd.DataFrame({"client": last["client"], "next": number[codes[_ends(codes)]], "city": last["city"], "cents": last["cents"]})
    refused = refused.assign(status="rejected", missed=0, city=None, cents=None)
    result = pd.concat([applied.assign(status="applied"), refused], ignore_index=True).assign(batch=batch)
    after = waiting[~run]
    before = pd.MultiIndex.from_arrays([held["client"], held["n"]])
    gone = held[~before.isin(pd.MultiIndex.from_arrays([after["client"], after["n"]]))] if len(held) else held
    return result, after, gone, changed


def _plain(column: pd.Series) -> np.ndarray:
    """Objects with None for any missing value."""
    return np.array([None if v is None or v != v else v for v in column], object)


class Applier(StatefulProcessor):
    """State of one bucket; see the module."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "client string, n long", _HELD)
        self.clients = handle.getMapState("clients", "client string", "next long, city string, cents string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True)
        clock = got[got["client"].isna()]
        edge, batch = clock["edge"].max(), int(got["batch"].iloc[0])
        new = got.loc[got["client"].notna(), _COLUMNS].astype({"n": "int64", "change_id": "int64", "day": "int64"})
        stored = [(*k, *v) for k, v in self.held.iterator()]
        held = pd.DataFrame(stored, columns=_COLUMNS).astype({"n": "int64", "change_id": "int64", "day": "int64"})
        known = pd.DataFrame([(*k, *v) for k, v in self.clients.iterator()], columns=["client", "next", "city", "cents"])
        for df, names in ((new, ("op", "city", "cents")), (held, ("op", "city", "cents")), (known, ("city", "cents"))):
            for c in names:
                df[c] = _plain(df[c])
        out, after, gone, changed = tick(held, known, new, -np.inf if pd.isna(edge) else float(edge), batch)
        for k in zip(gone["client"], gone["n"], strict=True):
            self.held.removeKey((k[0], int(k[1])))
        there = {(r[0], r[1]) for r in stored}
        for r in after.itertuples(index=False):
            if (r.client, r.n) not in there:
                self.held.updateValue((r.client, int(r.n)), (int(r.change_id), int(r.day), r.op, r.city, r.cents))
        for r in changed.itertuples(index=False):
            self.clients.updateValue((r.client,), (int(r.next), r.city, r.cents))
        if len(out):
            yield out[["change_id", "client", "n", "op", "status", "batch", "missed", "city", "cents"]]

    def close(self) -> None:
        pass


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    old = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def apply(changes: DataFrame, batches: int, patience: int = PATIENCE, buckets: int | None = None) -> DataFrame:
    """Applies changes batch by batch; one row for each: change_id, client_id, n, op, status, batch, missed, city, cents, current.

    changes: client_id, n, change_id, day, op, city, cents and batch (1 to batches; less counts as 1, more as the last). A row
    whose n is held or below its client's next number is rejected, of several rows of one n in a
    batch all but the first by day and change_id (then op, city, cents). A batch starts with jumps
    over missing numbers for clients whose earliest held change has waited for `patience` days
    before the latest day of earlier batches; after the last batch all are freed, as batch
    batches + 1. missed counts the numbers jumped right before a change.

    Nulls: client_id null is one client; rows without n, change_id, day or batch take no part. An empty
    table gives an empty one. Repeated rows are changes of one n. Ops other than I, U and D change no value.

    The batches are written under spark.checkpoint.dir and fed in order to a query started anew
    for each on one checkpoint. A client's rows of one batch meet in its bucket; buckets (one for
    each BUCKET_ROWS rows, two for each shuffle partition at least) keep apart what is not one client's.
    """
    spark = changes.sparkSession
    home = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    rows = changes.filter("n IS NOT NULL AND change_id IS NOT NULL AND day IS NOT NULL AND batch IS NOT NULL")
    rows = rows.select(F.coalesce(F.col("client_id").cast("string"), F.lit("")).alias("client"), F.col("n").cast("long"), F.col("change_id").cast("long"), F.col("day").cast("long"), F.col("op").cast("string"), F.col("city").cast("string"), F.col("cents").cast("string"), F.least(F.greatest(F.col("batch").cast("int"), F.lit(1)), F.lit(batches)).alias("batch"))
    rows.write.partitionBy("batch").parquet(f"{home}/staged")
    staged = spark.read.schema(rows.schema).parquet(f"{home}/staged")
    seen = {r["batch"]: (r["day"], r["count"]) for r in staged.groupBy("batch").agg(F.max("day").alias("day"), F.count("*").alias("count")).collect()}
    if buckets is None:
        buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), sum(c for _, c in seen.values()) // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("client"), F.lit(buckets))
    latest = None
    with _settings(spark):
        for batch in range(1, batches + 2):
            edge = 1 << 60 if batch > batches else None if latest is None else latest - patience
            ticks = spark.range(buckets).select(F.col("id").alias("bucket"), *[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in _ROWS.split(", ")[1:-2])], F.lit(batch).alias("batch"), F.lit(edge).cast("long").alias("edge"))
            arrived = staged.filter(F.col("batch") == batch).select(bucket.alias("bucket"), *_COLUMNS, "batch", F.lit(None).cast("long").alias("edge"))
            arrived.unionByName(ticks.coalesce(1)).write.mode("append").parquet(f"{home}/feed")
            fed = spark.readStream.schema(_ROWS).parquet(f"{home}/feed")
            run = fed.groupBy("bucket").transformWithStateInPandas(Applier(), _OUT, "Append", "None")
            run.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
            day = seen.get(batch, (None, 0))[0]
            latest = latest if day is None else day if latest is None else max(latest, day)
    out = spark.read.schema(_OUT).parquet(f"{home}/out")
    last = out.filter("status = 'applied'").groupBy("client").agg(F.max("n").alias("n")).withColumn("last", F.lit(True))
    done = out.join(last, ["client", "n"], "left")
    current = (F.col("status") == "applied") & F.coalesce("last", F.lit(False)) & ~F.col("op").eqNullSafe("D")
    client = F.when(F.col("client") != "", F.col("client").cast(changes.schema["client_id"].dataType)).alias("client_id")
    return done.select("change_id", client, "n", "op", "status", "batch", "missed", "city", F.col("cents").cast("long").alias("cents"), current.alias("current"))
