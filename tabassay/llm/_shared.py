"""Session, storage and skew helpers used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as spark.checkpoint.dir names it. Only a local session, which is one machine, gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tabassay-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def table(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write df (with options of the writer) to the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables written by table() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(column: str | F.Column, parts: int) -> F.Column:
    """crc32 of the key's decimal text, modulo parts; a null key falls in fold 0."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(col.cast("string")) % parts, F.lit(0))


def lower_ascii(col: F.Column) -> F.Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def within(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; reads no more than limit + 1 of them."""
    return df.limit(limit + 1).count() <= limit


def hashed_sample(df: DataFrame, n: int, total: int, *keys: str) -> DataFrame:
    """At most n of df's total rows, chosen by the hash of keys; what reaches the last task stays near n at any size."""
    span = 1 << 30
    most = min(span, -(-span * (n + 4 * math.isqrt(n) + 16) // max(1, total)))
    some = df.filter(F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(span)) < most)
    return some.orderBy(F.xxhash64(*keys), *keys).limit(n)


def _released(batches: Iterable[pa.RecordBatch], work: Batches) -> Iterator[pa.RecordBatch]:
    """work(batches), after which the worker, which lives on, gives freed memory back to the system."""
    yield from work(batches)
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def batched(df: DataFrame, work: Batches, schema: str) -> DataFrame:
    """df.mapInArrow; the worker gives freed memory back when a task ends. session.prepare bounds the batches."""
    return df.mapInArrow(partial(_released, work=work), schema)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
