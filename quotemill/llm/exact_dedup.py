"""Grace hash deduplication: partition by hash, one open-addressing table of complete contents per bucket, recursion on overflow.

Plan.  Map tasks fold copies within a batch and send one text per distinct content and batch (so a hot group costs a
text per batch, not per row).  One exchange takes texts to buckets by their hash; membership rows ride along by row
number.  A bucket's task fills an open-addressing table that compares whole contents.  When the table is full, contents
not yet in it are written to spill files and partitioned again by other hash bits, level by level, until nothing is left.
Every level admits at least one content a task, so the recursion ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

SPACES = re.compile(rb"[\x20\x09-\x0D]+")
NULL_ID = (1 << 63) - 1
#: kind 0: a text to be placed; kind 1: a row and its text's slot; kind 2: a placed slot.
ROW = "kind int, part long, row long, slot long, n long, min_id long, min_row long, sha string, body binary"
FIELDS = ["kind", "part", "row", "slot", "n", "min_id", "min_row", "sha", "body"]
TYPES = [pa.int32(), *[pa.int64()] * 6, pa.string(), pa.binary()]
SCHEMA = pa.schema(list(zip(FIELDS, TYPES, strict=True)))


def normalise(text: bytes) -> bytes:
    return SPACES.sub(b" ", text)


def _key(body: bytes, level: int) -> int:
    return int.from_bytes(hashlib.blake2b(body, digest_size=8, key=b"grace%d" % level).digest(), "little")


class ContentTable:
    """Open addressing with linear probing; equal hashes are told apart by comparing complete contents."""

    def __init__(self, limit_bytes: int, size: int = 1 << 12):
        self.limit, self.used = limit_bytes, 0
        self.slots = np.full(size, -1, np.int64)
        self.hashes: list[int] = []
        self.bodies: list[bytes] = []

    def find(self, h: int, body: bytes) -> tuple[int, int]:
        """(entry or -1, slot)."""
        mask = len(self.slots) - 1
        i = h & mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == h and self.bodies[e] == body:
                return int(e), i
            i = (i + 1) & mask
        return -1, i

    def add(self, h: int, body: bytes, slot: int, force: bool = False) -> int:
        """Entry of a new content, or -1 if the table is full."""
        if self.bodies and not force and self.used + len(body) + 64 > self.limit:
            return -1
        e = len(self.bodies)
        self.slots[slot] = e
        self.hashes.append(h)
        self.bodies.append(body)
        self.used += len(body) + 64
        if 2 * len(self.bodies) > len(self.slots):
            self._grow()
        return e

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            i = h & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = e


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(TYPES)], schema=SCHEMA)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: normalise, fold copies within a batch."""
    task = TaskContext.get()
    row = (task.partitionId() if task else 0) << 36
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        texts = texts.cast(pa.binary()) if texts.null_count == len(texts) else texts.view(pa.binary()) if texts.type == pa.string() else texts.cast(pa.binary())
        table, owners = ContentTable(1 << 62), []
        out, members = [], []
        for doc, text in zip(ids, texts, strict=True):
            body = normalise(text.as_py() or b"")
            doc = NULL_ID if doc is None else doc
            h = _key(body, -1)
            e, at = table.find(h, body)
            if e < 0:
                e = table.add(h, body, at)
                owners.append([row, 0, doc, row])
            o = owners[e]
            o[1] += 1
            if (doc, row) < (o[2], o[3]):
                o[2], o[3] = doc, row
            members.append((1, row & 0x7FFFFFFF, row, o[0], 1, doc, row, None, None))
            row += 1
        for (slot, n, doc, first), body in zip(owners, table.bodies, strict=True):
            out.append((0, _key(body, 0) >> 1, slot, slot, n, doc, first, None, body))
            if len(out) >= 512:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)
        for i in range(0, len(members), 8192):
            yield _batch(members[i : i + 8192])


def _place(level: int, limit_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(limit_bytes)
        best: list[list] = []
        slots, entries = [], []
        for batch in batches:
            kinds = batch.column(0).to_numpy(zero_copy_only=False)
            rides = np.flatnonzero(kinds == 1)
            if len(rides):
                yield batch.take(pa.array(rides))
            spill = []
            for r in batch.take(pa.array(np.flatnonzero(kinds == 0))).to_pylist():
                body = r["body"]
                h = _key(body, level)
                e, at = table.find(h, body)
                if e < 0:
                    e = table.add(h, body, at)
                    if e < 0:
                        spill.append((0, _key(body, level + 1) >> 1, r["row"], r["slot"], r["n"], r["min_id"], r["min_row"], None, body))
                        continue
                    best.append([0, r["min_id"], r["min_row"]])
                b = best[e]
                b[0] += r["n"]
                if (r["min_id"], r["min_row"]) < (b[1], b[2]):
                    b[1], b[2] = r["min_id"], r["min_row"]
                slots.append(r["slot"])
                entries.append(e)
            if spill:
                yield _batch(spill)
        shas = [hashlib.sha256(x).hexdigest() for x in table.bodies]
        for i in range(0, len(slots), 8192):
            yield _batch([(2, 0, s, s, best[e][0], best[e][1], best[e][2], shas[e], None) for s, e in zip(slots[i : i + 8192], entries[i : i + 8192], strict=True)])

    return run


def grace_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 64 << 20, partitions: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Contents are equal when identical after each run of white space became one space.  A null text counts as empty.  Of
    equal contents the row with the smallest id stays; of rows with the same id the first read.  A null id sorts after
    all others.  Repeated rows each count in ``group_size``, exactly one stays.  A content of any length is compared whole; one over
    ``table_bytes`` has a table to itself.  Other columns are not looked at.  An empty table gives no rows.

    ``table_bytes`` bounds a bucket's table of distinct contents; more goes to spill files and another level.
    """
    spark = docs.sparkSession
    n = partitions or max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = base.mapInArrow(_fold, ROW)
    levels, level = [], 0
    while True:
        placed = materialise(rows.repartition(n, "part").mapInArrow(_place(level, table_bytes), ROW), f"level{level}")
        levels.append(placed)
        rows = placed.where("kind = 0")
        if rows.isEmpty():
            break
        level += 1
    members = levels[0].where("kind = 1").select(F.col("slot"), F.col("min_id").alias("doc_id"), F.col("row"))
    found = levels[0].where("kind = 2")
    for x in levels[1:]:
        found = found.unionByName(x.where("kind = 2"))
    found = found.select("slot", "n", "min_id", "min_row", "sha")
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return members.join(found, "slot").select(
        real("doc_id").alias("doc_id"),
        real("min_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("min_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


__all__ = ["grace_dedup", "normalise", "ContentTable", "discard"]
