"""Shared pieces: Arrow text blocks, rolling fingerprints, shared-folder tables."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch holds on its way to Python; blocks below bound the bytes.
ARROW_ROWS = 1024
#: Bytes of text that one vectorised block holds (a longer document is a block of its own).
BLOCK_BYTES = 1 << 20
#: Bytes that are summed at once.
PIECE = 1 << 16


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches: a batch of 10,000 long documents would not fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Packed bytes that one bucket is to hold; there are as many buckets as the measured input needs.
BUCKET_BYTES = 32 << 20


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def bucket_count(spark: SparkSession, size: float) -> int:
    """Buckets for so many packed bytes: at least one for each shuffle partition."""
    return max(partitions(spark), int(size // BUCKET_BYTES) + 1)


def _int_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash of integers (Murmur3 with seed 42)."""
    u = lambda v: np.uint32(v)
    turn = lambda v, r: (v << u(r)) | (v >> u(32 - r))
    h = u(42) ^ turn(x.astype(np.uint32) * u(0xCC9E2D51), 15) * u(0x1B873593)
    h = turn(h, 13) * u(5) + u(0xE6546B64)
    h ^= u(4)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).view(np.int32)


def even_keys(spark: SparkSession, buckets: int | None = None) -> np.ndarray:
    """Names (integers) of buckets that hash partitioning deals to the shuffle partitions in turn: they spread evenly."""
    n = partitions(spark)
    buckets, tries = buckets or n, 16
    each = -(-buckets // n)
    while True:
        ids = np.arange(tries * n * each, dtype=np.int32)
        to = _int_hash(ids).astype(np.int64) % n
        order = np.argsort(to, kind="stable")
        held = np.bincount(to, minlength=n)
        if held.min() >= each:
            begin = np.cumsum(held) - held
            return ids[order[(begin[None, :] + np.arange(each)[:, None]).ravel()[:buckets]]].astype(np.int64)
        tries *= 2


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), text (string) and further columns by name, whatever else docs has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and driver and executors are one process."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = current.get() if current.isDefined() else os.path.join(tempfile.gettempdir(), "codelode-shared")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and the C library would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """run (over batches, or of one group) for Spark's workers, which give back what it has freed.

    Spark keeps workers for later tasks, at times more of them than cores; each would hold
    the largest size it ever had, beside the JVM of its executor."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def over_batches(batches):
            yield from run(batches)
            give_back()

        return over_batches

    @functools.wraps(run)
    def of_group(table):
        out = run(table)
        give_back()
        return out

    return of_group


def text_blocks(batches, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) blocks: null texts are empty; offsets has one entry more than rows."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        column = column.cast(pa.large_binary()).fill_null(b"")
        if not len(column):
            continue
        _, off, data = column.buffers()
        offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        start = 0
        while start < len(column):
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), len(column))
            yield batch.slice(start, end - start), raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end


class Rolling:
    """Polynomial fingerprints modulo 2^64 over a random byte table, for any substring by prefix sums."""

    def __init__(self, seed: int, size: int = BLOCK_BYTES):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.base = int(rng.integers(2**40, 2**62)) | 5
        self.inverse = pow(self.base, -1, 2**64)
        self._grow(size + 1)

    def _grow(self, n: int) -> None:
        self.power = self._powers(self.base, n)
        self.negative = self._powers(self.inverse, n)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        out[0], filled = 1, 1
        while filled < n:
            step = np.uint64(pow(base, filled, 2**64))
            take = min(filled, n - filled)
            np.multiply(out[:take], step, out=out[filled : filled + take])
            filled += take
        return out

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """prefix[j] - prefix[i], scaled by negative[i], is the fingerprint of data[i:j]."""
        if len(data) + 1 > len(self.power):
            self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        for a in range(0, len(data), PIECE):  # in pieces: whole temporary arrays would take as much again
            b = min(a + PIECE, len(data))
            np.cumsum(self.table[data[a:b]] * self.power[a:b], out=out[a + 1 : b + 1])
            out[a + 1 : b + 1] += out[a]
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.negative[start])

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Fingerprints of every window of `width` bytes."""
        n = len(prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((prefix[width:] - prefix[:n]) * self.negative[:n])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as byte planes: the leading planes, nearly constant, compress away in the shuffle."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(planes: bytes) -> np.ndarray:
    raw = np.frombuffer(planes, np.uint8).reshape(8, -1).T
    return np.ascontiguousarray(raw).view(">u8").ravel().astype(np.uint64)
