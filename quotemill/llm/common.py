"""Helpers shared by the training-data operators: shared storage, hashing expressions, bounded Bloom filters."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Lists of ids of up to this many rows of 24 bytes are broadcast, longer ones are joined by shuffling.
BROADCAST_ROWS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    A folder of our own is made only where the setting is absent and Spark runs inside one process, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quotemill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quotemill-{uuid.uuid4().hex}"


#: Rows of text in an Arrow batch at most, while a table is written; a batch is held in the JVM and in Python at once.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of such a batch, but for a single longer row.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


#: Shuffle files of a table go once it is written; should they be asked for again, Spark makes them anew.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Smaller Arrow batches, by rows and by bytes, for what is planned inside; the session's settings come back afterwards."""
    old, old_bytes = spark.conf.get(_BATCH), spark.conf.get(_BATCH_BYTES, None)
    if not 0 < int(old) <= rows:
        spark.conf.set(_BATCH, str(rows))
    spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, old)
        if old_bytes is None:
            spark.conf.unset(_BATCH_BYTES)
        else:
            spark.conf.set(_BATCH_BYTES, old_bytes)


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it has ended."""
    old = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, old)


def tidy() -> None:
    """Give memory that this Python worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(batches: Iterator) -> Iterator:
    try:
        yield from batches
    finally:
        tidy()


def few_tasks(df: DataFrame, share: int = 8) -> int:
    """How many tasks are to write a table that is much smaller than ``df``: a file each, not one for every partition of an exchange.

    It follows the size of what ``df`` reads, by as many bytes as a scan gives to a task.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    scans = size // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(2 * spark.sparkContext.defaultParallelism, min(scans // share, 1 << 20))


def materialise(df: DataFrame, tag: str = "table", tasks: int | None = None, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to shared storage, by at most so many tasks, and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}"
    schema = df.schema
    with small_batches(spark), cleaned(spark):
        (df if tasks is None else df.coalesce(tasks)).write.parquet(path, compression=compression)
    out = spark.read.schema(schema).parquet(path)
    out._quotemill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialise` wrote and that nothing reads any more."""
    path = getattr(df, "_quotemill_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def id_crc(col: Column | str) -> Column:
    """crc32 of an id written as text; a null id counts as empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")))


def buckets_for(df: DataFrame, least: int = 128, most: int = 1 << 16) -> int:
    """A power of two that follows the number of input partitions."""
    parts, n = df.rdd.getNumPartitions(), least
    while n < parts and n < most:
        n *= 2
    return n


def by_group(f):
    """A callable object as the one-argument function that ``applyInPandas`` asks for."""

    def run(pdf):
        try:
            return f(pdf)
        finally:
            tidy()

    return run


def by_batch(f):
    """A callable object over batches as a function for ``mapInArrow`` that leaves no memory behind."""
    return lambda batches: tidied(f(batches))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class SegmentedBloom:
    """Bloom filter of a fixed number of bits whose segments are built apart, one per key bucket.

    A key's bucket is its top bits; all its probes fall into that bucket's segment.  Size is fixed by the caller, so
    broadcasting it is bounded whatever the input; a fuller filter only answers "maybe" more often.
    """

    def __init__(self, bits: int, buckets: int, hashes: int = 3, data: np.ndarray | None = None):
        self.buckets, self.hashes = buckets, hashes
        self.segment = max(64, bits // buckets)
        self.shift = np.uint64(64 - (buckets.bit_length() - 1)) if buckets > 1 else None
        self.data = data if data is not None else np.zeros(buckets * self.segment // 8, np.uint8)

    def _probe(self, keys: np.ndarray, i: int) -> np.ndarray:
        base = (keys >> self.shift) * np.uint64(self.segment) if self.shift is not None else np.uint64(0)
        return base + mix64(keys + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(self.segment)

    def segment_bytes(self, keys: np.ndarray, bucket: int) -> bytes:
        """The finished segment of one bucket, from all of that bucket's keys."""
        bits = np.zeros(self.segment, np.uint8)
        start = np.uint64(bucket * self.segment)
        for i in range(self.hashes):
            bits[(self._probe(keys, i) - start).astype(np.int64)] = 1
        return np.packbits(bits, bitorder="little").tobytes()

    def place(self, bucket: int, segment: bytes) -> None:
        n = self.segment // 8
        self.data[bucket * n : (bucket + 1) * n] = np.frombuffer(segment, np.uint8)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for i in range(self.hashes):
            p = self._probe(keys, i)
            out &= (self.data[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out
