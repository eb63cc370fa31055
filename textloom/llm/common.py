"""Shared folder, written tables, hashing and skew-safe lookups for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def attach(spark: SparkSession) -> SparkSession:
    """Workers can import this package; Arrow batches of texts are smaller than Spark's default of 10,000 rows, if the
    session has left it at that. Sessions for texts of some 100 KB on the average should lower it further."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "4000")
    return session.attach(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session.table(attach(spark), sf_dir, name)


@contextmanager
def batch_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Actions inside take Arrow batches of ``n`` rows at most: for rows that are large themselves."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(n))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


#: ASCII lower case over UTF-8 bytes: only A-Z change, bytes of other characters stay as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset and runs on one machine (as in tests) a temporary folder is chosen and
    recorded in the session, so that later calls agree; a cluster must name a folder that all its machines share.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


#: Tables of our own are read by who wrote them: no file has to say that they are complete. On a local file system
#: (file://; others are not touched) Hadoop starts chmod processes for each file and its checksum file, which for a moment
#: count as much memory as the JVM that starts them; the raw one makes files without either.
OWN_TABLE = {
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


def save(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """Write ``df`` as a Parquet table of our own."""
    df.write.options(**OWN_TABLE).option("compression", codec).parquet(path)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and lost
    executors cost nothing that is already written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    save(df, path, codec)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or plain path, on any worker."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def open_output(uri: str):
    """An output stream at ``uri``; parent folders are made."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    return fs.open_output_stream(path, compression=None)  # as it is, whatever the name says


def open_input(uri: str):
    fs, path = open_fs(uri)
    return fs.open_input_file(path)


_held: tuple[str, Callable[[], None]] | None = None


def holds(owner: str, let_go: Callable[[], None]) -> None:
    """A kernel says that it fills a cache of this worker, and how to empty it. Workers outlive operators: what another
    operator has left goes first."""
    global _held
    if _held is not None and _held[0] != owner:
        _held[1]()
        release()
    _held = owner, let_go


def release() -> None:
    """Give memory that is free in this process back to the machine."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes each (one row at least)."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        n = batch.num_rows
        if batch.column(at).nbytes <= limit:
            if n:
                yield batch
            continue
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_pylist()
        begin, held = 0, 0
        for i, s in enumerate(size):
            if held and held + s > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += s
        if begin < n:
            yield batch.slice(begin)
    # The task is over, but its worker stays for the next one.
    release()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def crc32_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; a null id has that of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


#: A key that holds more than one row in HOT_SHARE is hot; by arithmetic there are fewer than HOT_SHARE of them,
#: which is the proven bound of what ``lookup`` broadcasts.
HOT_SHARE = 512


def lookup(big: DataFrame, small: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``big`` LEFT JOIN ``small`` on ``key`` when single keys may hold a third of ``big``.

    ``small`` has one row per key; its column ``count`` counts the rows of ``big`` with that key, and ``total``
    their sum. Keys above ``total / HOT_SHARE`` rows (fewer than HOT_SHARE keys) are broadcast; their rows of
    ``big`` leave the shuffle join under salted keys that match nothing, spread evenly. ``key`` is binary.
    Rows with a null key find nothing. The column ``count`` is not returned.
    """
    rest = [c for c in small.columns if c not in (key, count)]
    floor = max(64, total // HOT_SHARE)
    hot = small.where(F.col(count) > floor).select(F.col(key).alias("__hk"), *[F.col(c).alias(f"__h_{c}") for c in rest])
    cold = small.where(F.col(count) <= floor).select(F.col(key).alias("__ck"), *[F.col(c).alias(f"__c_{c}") for c in rest])
    salted = F.concat(F.lit("hot:").cast("binary"), F.unhex(F.hex(F.monotonically_increasing_id())))
    x = big.join(F.broadcast(hot), F.col(key) == F.col("__hk"), "left")
    x = x.withColumn("__jk", F.when(F.col("__hk").isNotNull() | F.col(key).isNull(), salted).otherwise(F.col(key)))
    x = x.join(cold, F.col("__jk") == F.col("__ck"), "left")
    return x.select(*[F.col(c) for c in big.columns], *[F.coalesce(F.col(f"__h_{c}"), F.col(f"__c_{c}")).alias(c) for c in rest])


# -- a filter of bounded size -----------------------------------------------------------------------------------

#: Bits per key and most bits (64 MB). Beyond that more keys pass for nothing; an exact join always follows, so that a
#: full filter costs a shuffle of what it would have left out and never changes a result.
SKETCH_BITS, SKETCH_MOST = 24, 1 << 29
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    k = keys.astype(np.uint64)
    shift = np.uint64(65 - bits.bit_length())
    return [((k ^ (k >> np.uint64(31))) * m) >> shift for m in _MIX]


class Sketch:
    """A Bloom filter over 64-bit keys as a table in the shared folder, which tasks load by themselves.

    It only spares work: rows that don't pass can't be among the keys; rows that pass are joined exactly later.
    """

    def __init__(self, keys: DataFrame, column: str):
        spark = attach(keys.sparkSession)
        keys = keys.select(F.col(column).cast("long").alias("k")).where(F.col("k").isNotNull())
        n = keys.count()
        self.bits = bits = min(SKETCH_MOST, 1 << max(12, (n * SKETCH_BITS).bit_length()))
        self.path = scratch(spark, "sketch")

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                at = np.unique(np.concatenate(_places(k, bits))) if len(k) else np.empty(0, np.uint64)
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["w", "m"])

        out = keys.mapInArrow(words, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m"))
        save(out, self.path)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """For 64-bit keys (as int64 or uint64): could each be among the sketch's?"""
        holds("sketch", _loaded.cache_clear)
        held = _loaded(self.path, self.bits)
        ok = np.ones(len(keys), bool)
        for p in _places(keys.view(np.uint64) if keys.dtype == np.int64 else keys, self.bits):
            ok &= (held[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) != 0
        return ok


def parquet_files(uri: str) -> Iterator[pa.Table]:
    """Tables of the Parquet files below ``uri``, on any worker."""
    fs, path = open_fs(uri)
    for info in fs.get_file_info(pafs.FileSelector(path)):
        if info.path.endswith(".parquet"):
            yield pq.read_table(fs.open_input_file(info.path))


@lru_cache(maxsize=3)
def _loaded(uri: str, bits: int) -> np.ndarray:
    held = np.zeros(max(1, bits >> 6), np.uint64)
    for got in parquet_files(uri):
        held[got["w"].to_numpy()] = got["m"].to_numpy().view(np.uint64)
    return held
