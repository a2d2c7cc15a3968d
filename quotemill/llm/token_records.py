"""Token ids as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

File format.  A file is a sequence of records, each
``length u64 | masked crc u32 of those 8 bytes | payload | masked crc u32 of the payload | 0x0A``, little-endian, where
masked(c) = (rotate c right by 15) + 0xa282ead8 mod 2**32 over zlib's crc32.  A payload is
``doc_id i64 | flags u8 | count u32 | ids``, with flag 1 if there is a doc_id and flag 2 if
the ids are u16 (none is over 65,535), else u32.  Files are written by Spark's own writer (any file system, task commit,
retries) in ascending doc_id order, one range of ids a file.  The index is a table (doc_id, file, offset, length).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, tidied, tidy
from .textkit import buffers, ragged, words

END_ID = 2
HEAD, BODY = "<QI", "<qBI"
BODY_BYTES = struct.calcsize(BODY)
#: Words kept in a worker's cache of encoded words, and bytes of a range of rows for one file.
CACHE_WORDS = 1 << 19
GROUP_WORDS = 512
FILE_TEXT_BYTES = 16 << 20


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload)), b"\n"))


def frames(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, payload) of each record; a damaged file raises ValueError."""
    at, end = 0, len(content)
    while at < end:
        if at + 12 > end:
            raise ValueError(f"record at {at} is cut off")
        size, crc = struct.unpack_from(HEAD, content, at)
        if crc != masked_crc(content[at : at + 8]):
            raise ValueError(f"length of the record at {at} is damaged")
        stop = at + 12 + size + 5
        if stop > end or content[stop - 1] != 0x0A:
            raise ValueError(f"record at {at} is cut off")
        payload = content[at + 12 : at + 12 + size]
        if struct.unpack_from("<I", content, at + 12 + size)[0] != masked_crc(payload):
            raise ValueError(f"record at {at} is damaged")
        yield at, stop - at, payload
        at = stop


def pack(doc: int | None, ids: np.ndarray) -> bytes:
    """A payload."""
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return struct.pack(BODY, 0 if doc is None else doc, (doc is not None) + 2 * narrow, len(ids)) + ids.astype("<u2" if narrow else "<u4").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of a payload."""
    doc, flags, n = struct.unpack_from(BODY, payload)
    return doc if flags & 1 else None, np.frombuffer(payload, "<u2" if flags & 2 else "<u4", n, BODY_BYTES).astype("<u4")


class WordEncoder:
    """Encodes texts through a cache of white-space words.

    The tokenizer's pre-tokenizer never crosses ASCII white space, so a text's ids are its words' ids in a row; each
    distinct word is encoded once while it stays in the cache.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Encode new words, many to a text; a token's place in the text tells its word.  ``keys`` ascend."""
        ids, sizes = [], []
        groups = [texts[i : i + GROUP_WORDS] for i in range(0, len(texts), GROUP_WORDS)]
        for group, got in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ends = np.cumsum([len(t) + 1 for t in group])
            at = np.array(got.offsets, np.int64).reshape(-1, 2)[:, 0]
            ids.append(np.array(got.ids, np.uint32))
            sizes.append(np.bincount(np.searchsorted(ends, at, "right"), minlength=len(group)))
        flat, sizes = np.concatenate(ids), np.concatenate(sizes)
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, flat])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.size = np.insert(self.keys, at, keys), np.insert(self.start, at, starts), np.insert(self.size, at, sizes)

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of documents: (ids, bounds); document i has ids[bounds[i]:bounds[i+1]], without an end id."""
        for w in words(texts, fold=False, limit=1 << 20):
            distinct, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
            at = np.searchsorted(self.keys, distinct)
            known = self.keys[np.minimum(at, max(0, len(self.keys) - 1))] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
            if not known.all():
                if len(self.keys) + int((~known).sum()) > CACHE_WORDS:
                    self.clear()
                    known[:] = False
                new = np.flatnonzero(~known)
                data = w.data.tobytes()
                self._learn(distinct[new], [data[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist(), strict=True)])
                at = np.searchsorted(self.keys, distinct)
            start, size = self.start[at][back], self.size[at][back]
            ids = self.ids[ragged(start, size)]
            total = np.concatenate([[0], np.cumsum(size)])
            yield ids, total[w.bounds]


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """This worker's encoder; its cache lives on from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            docs, out, i = batch.column(0).to_pylist(), [], 0
            for ids, bounds in encoder.encode(batch.column(1)):
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    doc = docs[i]
                    out.append(frame(pack(doc, np.append(ids[a:b], tail)))[:-1])  # the writer adds the last byte
                    i += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                out = []
        tidy()

    return run


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, file_bytes: int = FILE_TEXT_BYTES) -> None:
    """Encode every text (null: empty), append ``end_id`` and write record files in ascending id order (null ids first).

    Of ``files`` files, or as many as give about ``file_bytes`` of text each.  Rows of one id come in no given order, in one file or
    in several in a row.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if files is None:
        total = base.select(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(base.rdd.getNumPartitions() if total > file_bytes else 1, total // file_bytes + 1)
    # The second key deals a repeated id out to several files; ids still ascend from file to file.
    first = F.col("doc_id").asc_nulls_first()
    ordered = base.withColumn("_part", F.rand(7)).repartitionByRange(files, first, "_part").sortWithinPartitions(first, "_part").drop("_part")
    records = ordered.mapInArrow(_encode(tokenizer, end_id), "record binary").select(F.col("record").cast("string").alias("value"))
    with small_batches(docs.sparkSession):
        records.write.option("lineSep", "\n").text(path)


class _Parse:
    """Records of whole files; the ids themselves only if asked for."""

    def __init__(self, ids: bool):
        self.ids = ids
        self.schema = "file string, doc_id long, offset long, length long, n_tokens long, ids_crc32 long" + ", ids binary" * ids

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                for at, size, payload in frames(content.as_py()):
                    doc, got = unpack(payload)
                    raw = got.tobytes()
                    rows.append((path.rsplit("/", 1)[-1], doc, at, size, len(got), zlib.crc32(raw), *[raw] * self.ids))
                    if len(rows) == 512:
                        yield self._batch(rows)
                        rows = []
                if rows:
                    yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int64()] * 5, pa.binary()]
        cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in self.schema.split(", ")])


def read_records(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Every record of a folder: file, doc_id, offset, length, n_tokens, ids_crc32, ids (little-endian u32); checks all checksums."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    parse = _Parse(ids)
    return files.mapInArrow(lambda batches: tidied(parse(batches)), parse.schema)


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """The offset index of a folder of records, written as its own table, with the digest of each record."""
    with small_batches(spark, 1):  # a row is a file
        read_records(spark, path, ids=False).write.parquet(index_path)
    return spark.read.parquet(index_path)


def record_report(index: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file, offset, length.

    Files are ranges of ids in the order of their names; starts are sums within a file plus the sum of the files before.
    """
    from pyspark.sql import Window

    files = index.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = files.select("file", before.alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = index.select("*", inside.alias("inside")).join(base, "file")
    return placed.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "file", "offset", "length")


def token_records(docs: DataFrame, tokenizer: str, end_id: int = END_ID, out: str | None = None, files: int | None = None, file_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Write records and index below ``out`` (a fresh shared folder if not given), read them back, report on each document.

    Null or empty text: the end id alone.  Repeated rows each get a record, next to each other in no given order.  A text of any length
    is one record.  An empty table gives no rows.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    out = out or shared_dir(spark)
    write_records(docs, f"{out}/records", tokenizer, end_id, files=files, file_bytes=file_bytes)
    return record_report(write_index(spark, f"{out}/records", f"{out}/index"))


__all__ = ["token_records", "write_records", "read_records", "write_index", "record_report", "frame", "frames", "masked_crc", "buffers"]
