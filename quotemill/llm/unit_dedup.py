"""Repeated passages by hashing lines and their sentences.

A unit is a line, cut further after words that end in ``.``, ``!`` or ``?``, so a passage within a paragraph is found as well as
one of whole lines.  Units are normalised (A-Z as a-z, white space between words not regarded) and get a 128-bit digest.
Digests are grouped over all documents; the occurrence first by (id, row, unit) stays and all others are repeats.  Repeats next
to each other in a document form a run, and runs of at least ``min_words`` words are removed (1: every repeat), as ranges of
characters of the original text.

Repeats of at least ``PASSAGE_WORDS`` words across texts may also start and end within a unit.  Of every ``PASSAGE_WORDS`` words in a row the least digest of
``ANCHOR_WORDS`` words is an anchor, so texts that share such a passage share an anchor of it.  Repeated anchors are extended word by word
against the text that has them first, and what is found is merged with the runs.

Counts are combined before the exchange, so a line that is everywhere costs a row per task there.  Repeated digests are written before
they are joined, so that both sides of the join are dealt out anew and adaptive execution can split a digest that is everywhere.
Ids and texts of rows join their spans at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, discard, few_tasks, materialise, mix64, small_batches
from .textkit import Words, ngram_hashes, words

PASSAGE_WORDS, ANCHOR_WORDS = 50, 20
PAIR_ROWS = 100
_ENDS = np.zeros(256, bool)
_ENDS[[0x21, 0x2E, 0x3F]] = True
_MULTIPLIERS = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
NULL_ID = (1 << 63) - 1


def _digests(h: np.ndarray, first: np.ndarray, size: np.ndarray, multiplier: int) -> np.ndarray:
    """Polynomial hash of each run of word hashes, from prefix sums."""
    n = len(h)
    power = np.full(n + 1, multiplier, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(n + 1, pow(multiplier, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(h + np.uint64(multiplier)) * power[:n], out=sums[1:])
    return mix64((sums[first + size] - sums[first]) * back[first] + size.astype(np.uint64))


def units(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, number of words, unit number within the document) of every unit."""
    n = len(w.hashes)
    doc = w.docs()
    cut = np.zeros(n, bool)
    cut[1:] = _ENDS[w.data[w.ends[:-1] - 1]] | (doc[1:] != doc[:-1])
    breaks = np.flatnonzero(w.data == 0x0A)
    before = np.searchsorted(breaks, w.starts)
    cut[1:] |= before[1:] != before[:-1]
    cut[:1] = True
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, n))
    doc = doc[first]
    number = np.arange(len(first)) - np.searchsorted(doc, doc)
    return doc, first, size, number


def anchors(w: Words) -> np.ndarray:
    """First words of the anchors."""
    g = ngram_hashes(w.hashes, ANCHOR_WORDS)
    width = PASSAGE_WORDS - ANCHOR_WORDS + 1
    if len(g) < width:
        return np.zeros(0, np.int64)
    doc = w.docs()
    at = np.flatnonzero(doc[: len(g) - width + 1] == doc[PASSAGE_WORDS - 1 :])
    return np.unique(at + np.lib.stride_tricks.sliding_window_view(g, width)[at].argmin(1)) if len(at) else at


class Units:
    """Every unit with its digest, its first word and its range of characters; anchors likewise as unit -1."""

    schema = "doc_id long, text_key long, row long, unit int, d1 long, d2 long, words int, word int, start int, end int"

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 36
        for batch in batches:
            for w in words(batch.column(2)):
                if len(w.hashes):
                    yield self._batch(batch, w, row)
                row += w.count

    def _batch(self, batch: pa.RecordBatch, w: Words, row: int) -> pa.RecordBatch:
        doc, first, size, number = units(w)
        also = anchors(w)
        doc, first = np.append(doc, w.docs()[also]), np.append(first, also)
        size, number = np.append(size, np.full(len(also), ANCHOR_WORDS)), np.append(number, np.full(len(also), -1))
        chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        offsets = batch.column(2).slice(w.first, w.count)
        lengths = pa.compute.coalesce(pa.compute.binary_length(offsets), 0).to_numpy(zero_copy_only=False)
        base = chars[np.cumsum(lengths) - lengths][doc]
        d1, d2 = (_digests(w.hashes, first, size, m).view(np.int64) for m in _MULTIPLIERS)
        at = pa.array(w.first + doc)
        cols = [
            batch.column(0).take(at), batch.column(1).take(at), pa.array(row + doc), pa.array(number, pa.int32()), pa.array(d1), pa.array(d2), pa.array(size, pa.int32()), pa.array(first - w.bounds[doc], pa.int32()),
            pa.array(chars[w.starts[first]] - base, pa.int32()), pa.array(chars[w.ends[first + size - 1]] - base, pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in self.schema.split(", ")])


class Passages:
    """Extends the anchors that two texts share to all words around that they share."""

    schema = "text_key long, keep long, word int, to int, start int, end int"

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                key, keep, seeds, text, other = (c[i] for c in batch.columns)
                own, far = (next(words(pa.array([x.as_py()]), limit=1 << 40)) for x in (text, other))
                chars = np.append(0, np.cumsum((own.data & 0xC0) != 0x80))
                rows += [(key.as_py(), keep.as_py(), f, t, int(chars[own.starts[f]]), int(chars[own.ends[t - 1]])) for f, t in self.shared(own.hashes, far.hashes, seeds.as_py())]
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in self.schema.split(", ")])

    @staticmethod
    def shared(x: np.ndarray, y: np.ndarray, seeds: list[dict]) -> Iterator[tuple[int, int]]:
        done: dict[int, int] = {}
        for a, b in sorted((s["word"], s["other"]) for s in seeds):
            if a < done.get(a - b, 0):
                continue
            n = min(len(x) - a, len(y) - b)
            off = np.flatnonzero(x[a : a + n] != y[b : b + n])
            to = a + (int(off[0]) if len(off) else n)
            n = min(a, b)
            off = np.flatnonzero(x[a - n : a] != y[b - n : b])
            begin = a - n + (int(off[-1]) + 1 if len(off) else 0)
            done[a - b] = to
            if to - begin >= PASSAGE_WORDS:
                yield begin, to


def _repeated(table: DataFrame, order: list[str], tasks: int) -> DataFrame:
    """(d1, d2, first) of digests that stand more than once: ``first`` is the least occurrence."""
    groups = table.groupBy("d1", "d2").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n")).where("n > 1")
    return materialise(groups.select("d1", "d2", "first"), "repeated", tasks)


def _anchored(found: DataFrame, tasks: int) -> DataFrame:
    """Repeated anchors: text_key, row, word, and the ``first`` text that has each."""
    groups = _repeated(found, ["doc_id", "row", "word", "text_key"], tasks)
    again = found.select("d1", "d2", "text_key", "row", "word").join(groups, ["d1", "d2"]).where("text_key <> first.text_key")
    again = materialise(again.select("text_key", "row", "word", "first"), "anchors", tasks)
    discard(groups)
    return again


def _passages(base: DataFrame, again: DataFrame, tasks: int) -> DataFrame:
    """Repeated passages of every row by their words, found from anchors."""
    seeds = F.collect_set(F.struct("word", F.col("first.word").alias("other"))).alias("seeds")
    pairs = again.groupBy("text_key", F.col("first.text_key").alias("other_key")).agg(F.min("first.doc_id").alias("keep"), seeds)
    wanted = again.select(F.explode(F.array("text_key", "first.text_key")).alias("text_key")).distinct()
    texts = materialise(base.select("text_key", "text").join(wanted, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text")), "texts", tasks)
    others = texts.select(F.col("text_key").alias("other_key"), F.col("text").alias("other"))
    both = pairs.join(texts, "text_key").join(others, "other_key").select("text_key", "keep", "seeds", "text", "other")
    with small_batches(base.sparkSession, PAIR_ROWS):
        passages = materialise(both.mapInArrow(by_batch(Passages()), Passages.schema), "passages", tasks)
    discard(texts)
    return again.select("text_key", "row").distinct().join(passages, "text_key").drop("text_key")


def _spans(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """The spans, and all rows with words by their number, id and text."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    tasks = few_tasks(docs, 1)
    table = materialise(base.mapInArrow(by_batch(Units()), Units.schema), "units")
    rows = materialise(table.where("unit = 0").select("row", "doc_id", "text_key"), "rows", tasks)
    all_units = table.where("unit >= 0")
    groups = _repeated(all_units, ["doc_id", "row", "unit"], tasks)
    found = all_units.select("d1", "d2", "row", "unit", "words", "word", "start", "end").join(groups, ["d1", "d2"])
    again = found.where((F.col("row") != F.col("first.row")) | (F.col("unit") != F.col("first.unit"))).select("row", "unit", "words", "word", "start", "end", F.col("first.doc_id").alias("keep"))
    again = again.withColumn("run", F.col("unit") - F.row_number().over(Window.partitionBy("row").orderBy("unit")))
    runs = again.groupBy("row", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.sum("words").alias("n_words"), F.min(F.struct("unit", "keep")).alias("kept"), F.min("word").alias("word")
    )
    runs = runs.where(F.col("n_words") >= min_words)
    runs = materialise(runs.select("row", "word", (F.col("word") + F.col("n_words")).alias("to"), "start", "end", "n_units", F.col("kept.keep").alias("keep")), "runs", tasks)
    discard(groups)
    anchored = _anchored(table.where("unit < 0"), tasks)
    discard(table)
    more = _passages(base, anchored, tasks).select("row", "word", F.col("to").cast("long").alias("to"), "start", "end", F.lit(0).cast("long").alias("n_units"), "keep")
    # spans that touch become one
    of_row = Window.partitionBy("row").orderBy("word", "to", "n_units", "keep")
    apart = (F.col("word") > F.coalesce(F.max("to").over(of_row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    merged = runs.unionByName(more).withColumn("apart", apart).withColumn("part", F.sum("apart").over(of_row))
    spans = merged.groupBy("row", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_units").alias("n_units"), (F.max("to") - F.min("word")).alias("n_words"), F.min(F.struct("word", "keep")).alias("kept")
    )
    real = lambda c: F.when(c != NULL_ID, c)
    spans = spans.join(rows, "row").select(real(F.col("doc_id")).alias("doc_id"), "start", "end", "n_units", "n_words", real(F.col("kept.keep")).alias("keep_doc_id"), "text_key", "row")
    return spans, rows


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1) -> DataFrame:
    """A row per removed span: doc_id, start, end (characters of the original text), n_units, n_words, keep_doc_id, text_key.

    Of repeated units every run of ``min_words`` words in all is removed, so with 1 every repeated line and sentence.  ``n_units``
    counts whole repeated units.  ``keep_doc_id`` is the document that keeps the span's first words.  Null and blank texts
    have no units.  A null id sorts after all others.  Repeated rows are documents of their own: the first read keeps its passages.
    A text of any length is one row of many units.  Other columns are not looked at.  An empty table gives no rows.
    """
    return _spans(docs, id_col, text_col, min_words)[0]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1) -> DataFrame:
    """``docs`` with the spans taken out of the text, and ``removed``: their (start, end) in the original text.

    Of rows alike in id and text, the one that keeps its passages cannot be told from the others, so all keep what the first does.
    """
    found, rows = _spans(docs, id_col, text_col, min_words)
    first = rows.groupBy(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("_id"), F.col("text_key").alias("_key")).agg(F.min("row").alias("row"))
    spans = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    spans = first.join(spans, "row").drop("row")
    names = [c for c in docs.columns if c != "removed"]
    keyed = docs.select(*names).withColumn("_k", F.xxhash64(F.col(text_col)))
    out = keyed.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left")
    stops = F.expr("concat(transform(removed, r -> r.start), array(2147483647))")
    starts = F.expr("concat(array(0), transform(removed, r -> r.end))")
    kept = F.array_join(F.zip_with(starts, stops, lambda a, b: F.substring(F.col(text_col), a + 1, b - a)), "")
    return out.withColumn(text_col, F.when(F.col("removed").isNotNull(), kept).otherwise(F.col(text_col))).select(*names, "removed")
