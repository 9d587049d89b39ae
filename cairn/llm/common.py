"""What the operators share: tables in the shared folder, small filters, crc32 of ids."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
#: Paths that each open scratch() deletes at its end, outermost first.
_scratches: ContextVar[tuple[list[str], ...]] = ContextVar("scratches", default=())
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only on a local master without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="cairn-")
    return _own_dirs[app]


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cairn/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2048) -> Iterator[None]:
    """Arrow batches for Python workers of so few rows that long texts fit; the session's own setting comes back."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside, but for kept ones, are deleted at the end; kept ones belong to the scratch around it."""
    mine: list[str] = []
    token = _scratches.set((*_scratches.get(), mine))
    try:
        yield
    finally:
        _scratches.reset(token)
        for path in mine:
            _delete(spark, path)


def stored(df: DataFrame, name: str, keep: bool = False, rows: int = 2048) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that lost executors cost no more than one step.

    keep: the table outlives the innermost scratch(). rows: of an Arrow batch, should df need Python workers.
    """
    spark = df.sparkSession
    path = f"{_home(spark)}/{name}-{uuid.uuid4().hex}"
    open_ones = _scratches.get()
    if len(open_ones) > keep:
        open_ones[-1 - keep].append(path)
    with small_batches(spark, rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has stored; results that have not been read or written are lost."""
    _delete(spark, _home(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the decimal text of an id; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


#: Bits of a membership filter, as powers of two: 128 KB at least, 128 MB at most.
LEAST_BITS, MOST_BITS = 20, 30


def membership_filter(keys: DataFrame, key: str) -> np.ndarray:
    """Bitmap with bit (key mod its size) set for each long in keys: eight bits or more for each key up to 134 million keys.

    It is never over 128 MB, so that it may be sent to all executors. A hit may be false and must
    be checked by a join or an aggregation; a miss never is, so that filtering by it loses nothing
    at any load: beyond that many keys it only lets more rows through.
    """
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * n - 1).bit_length() if n else 0))
    slot = F.pmod(F.col(key), F.lit(1 << bits))
    words = (
        keys.select(slot.alias("s"))
        .groupBy((F.col("s") / 64).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros((1 << bits) // 64, np.uint64)
    if len(words):
        out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For an array of int64 or uint64 keys: may each be a member?"""
    slot = keys.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
