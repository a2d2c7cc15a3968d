"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answer checks.

* Benchmark items are cut to pieces of at most ``PIECE`` words.  The features are the pieces' words, weighted by IDF over all
  documents; the rows are passages of ``WINDOW`` words of all documents, and the pieces.
* A randomised SVD of that matrix takes one pass: tasks add up ``A'(A S)`` for a thin random matrix S of fixed size, their sums meet
  in a tree of ``FAN_IN``, and the driver factorises sums of that size only.
* Every window of every document, at a step of ``STEP`` words and as long as a piece of that length may reach, is projected,
  and is a candidate for the piece if their cosine reaches ``COSINE``, or for pieces short of their window the lower cosine
  that it leaves them.
* A candidate counts if the longest common subsequence with the words around the window covers ``COVER`` of the piece, or
  ``PARAPHRASE`` of it while the answer, its last words, stands there unchanged.

Items are worked off in blocks of bounded size, so what is broadcast has a fixed bound whatever the benchmark's size.  Texts are worked
off in slices, whatever their length.  Sums over a row's features take the ``DENSE`` commonest ones by a product of matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, by_group, materialise, small_batches
from .textkit import Words, ragged, words

PIECE, WINDOW, STEP = 64, 64, 16
RANK, OVERSAMPLE = 160, 16
COSINE = 0.7
COVER, PARAPHRASE = 0.8, 0.6
ANSWER_SHARE, ANSWER_LEAST = 0.25, 4
#: Pieces and distinct words of a block at most, so the broadcast stays below 24 MB.
BLOCK_PIECES, BLOCK_WORDS = 1024, 1 << 14
#: So many partial sums meet in a task.
FAN_IN = 16
SKETCH_PARTS = 12
DENSE = 128
SLICE_CELLS, SLICE_PASSAGES, SLICE_HITS = 2048, 512, 4096


class Lookup:
    """Position of each hash in a sorted array, or -1, by tables of its low bits; what collides goes on to the next table."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = keys, []
        left, shift = np.arange(len(keys)), 0
        bits = max(8, (8 * len(keys)).bit_length())
        while len(left) and shift + bits <= 64:
            slot = (keys[left] >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
            table = np.full(1 << bits, -1, np.int32)
            table[slot[::-1]] = left[::-1]
            self.levels.append((np.uint64(shift), np.uint64((1 << bits) - 1), table))
            left, shift = left[table[slot] != left], shift + bits
        self.left = left

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        for shift, mask, table in self.levels:
            at = table[(h >> shift & mask).astype(np.int64)]
            hit = np.flatnonzero(at >= 0)
            hit = hit[self.keys[at[hit]] == h[hit]]
            out[hit] = at[hit]
        for k in self.left:
            out[h == self.keys[k]] = k
        return out


class Block:
    """A bounded set of pieces: their words as indices into the sorted vocabulary."""

    def __init__(self, pieces: list[tuple[int, int, np.ndarray]]):
        self.item = np.array([p[0] for p in pieces])
        self.part = np.array([p[1] for p in pieces])
        self.words = [p[2] for p in pieces]
        self.vocabulary = np.unique(np.concatenate(self.words))
        self.lookup = Lookup(self.vocabulary)
        self.flat = np.concatenate([self.index(w) for w in self.words])
        self.cuts = np.concatenate([[0], np.cumsum([len(w) for w in self.words])])
        self.idf = np.ones(len(self.vocabulary), np.float32)
        self.basis = np.zeros((len(self.vocabulary), 0), np.float32)
        self.common(np.zeros(len(self.vocabulary)))

    def index(self, h: np.ndarray) -> np.ndarray:
        """Feature of each word hash, or -1."""
        return self.lookup(h)

    def common(self, frequency: np.ndarray) -> None:
        """Sets the commonest features, ``dense``; ``place`` is a feature's place among them, or -1."""
        self.dense = np.argsort(-frequency, kind="stable")[:DENSE]
        self.place = np.full(len(frequency), -1, np.int64)
        self.place[self.dense] = np.arange(len(self.dense))

    def parts(self, feature: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the dense features (rows x dense), and which of the given features are others."""
        place = self.place[feature]
        inside = place >= 0
        counts = np.bincount(row[inside] * len(self.dense) + place[inside], minlength=rows * len(self.dense))
        return counts.reshape(rows, len(self.dense)).astype(np.float32), np.flatnonzero(~inside)


def pieces(items: pd.DataFrame) -> list[tuple[int, int, np.ndarray]]:
    """(item, part, word hashes); a long item gives parts of equal size."""
    out = []
    texts = pa.array(items["text"].tolist(), pa.string())
    for w in words(texts):
        for k in range(w.count):
            h = w.hashes[w.bounds[k] : w.bounds[k + 1]]
            if len(h):
                n = -(-len(h) // PIECE)
                for part, x in enumerate(np.array_split(h, n)):
                    out.append((int(items["item_id"].iloc[w.first + k]), part, x))
    return out


def _blocks(rows: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[Block]:
    held, seen = [], set()
    for row in rows:
        new = seen | set(row[2].tolist())
        if held and (len(held) == BLOCK_PIECES or len(new) > BLOCK_WORDS):
            yield Block(held)
            held, new = [], set(row[2].tolist())
        held.append(row)
        seen = new
    if held:
        yield Block(held)


class Frequencies:
    """How many documents of a task have each feature, the number of documents before them."""

    schema = "part int, node int, size int, rows binary"

    def __init__(self, shared):
        self.shared = shared

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = self.shared.value
        n, df, size = 0, np.zeros(len(block.vocabulary), np.int64), len(block.vocabulary)
        for batch in batches:
            for w in words(batch.column(0)):
                x = block.index(w.hashes)
                ok = x >= 0
                key = np.unique(w.docs()[ok] * size + x[ok])
                df += np.bincount(key % size, minlength=size)
                n += w.count
        yield _partial(0, np.concatenate([[n], df]).astype(np.float64))


def passages(block: Block, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature, passage) of the words that are features, passages of ``WINDOW`` words within documents."""
    x = block.index(w.hashes)
    at = np.arange(len(x)) - np.repeat(w.bounds[:-1], np.diff(w.bounds))
    new = at % WINDOW == 0
    passage = np.cumsum(new) - 1
    ok = x >= 0
    return x[ok], passage[ok]


def _add_rows(out: np.ndarray, row: np.ndarray, values: np.ndarray) -> None:
    """``out[row] += values`` for ascending rows."""
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1) > 0)
        out[row[first]] += np.add.reduceat(values, first, axis=0)


def covariance_times(block: Block, s: np.ndarray, feature: np.ndarray, passage: np.ndarray, out: np.ndarray) -> None:
    """Add ``A'(A S)`` of passages, in ascending order, to ``out``; rows of A are IDF-weighted and of unit length."""
    if not len(feature):
        return
    idf = block.idf
    first = np.flatnonzero(np.diff(passage, prepend=-1) > 0)
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(feature))))
    norm = np.maximum(np.sqrt(np.add.reduceat(idf[feature] ** 2, first)), 1e-9)
    dense, other = block.parts(feature, row, len(first))
    dense *= idf[block.dense] / norm[:, None]
    projected = dense @ s[block.dense]
    f, r = feature[other], row[other]
    weight = (idf[f] / norm[r])[:, None]
    _add_rows(projected, r, s[f] * weight)
    out[block.dense] += dense.T @ projected
    order = np.argsort(f, kind="stable")
    _add_rows(out, f[order], projected[r[order]] * weight[order])


class Sketch:
    """A task's share of ``A'(A S)`` as one matrix of fixed size."""

    schema = "part int, node int, size int, rows binary"

    def __init__(self, shared):
        self.shared = shared

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = self.shared.value
        s = block.basis
        out, some = np.zeros(s.shape, np.float32), False
        for batch in batches:
            for w in words(batch.column(0), limit=128 << 10):
                feature, passage = passages(block, w)
                last = int(passage[-1]) + 1 if len(passage) else 0
                for lo in range(0, last, SLICE_PASSAGES):
                    i, j = np.searchsorted(passage, [lo, lo + SLICE_PASSAGES])
                    covariance_times(block, s, feature[i:j], passage[i:j], out)
                some = True
        if some:
            for k, part in enumerate(np.array_split(out, SKETCH_PARTS)):
                yield _partial(k, part)


def _partial(part: int, rows: np.ndarray) -> pa.RecordBatch:
    """A task's sums, to be added to those of others."""
    task = TaskContext.get()
    node = pa.array([task.partitionId() if task else 0], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), node, pa.array([rows.dtype.itemsize], pa.int32()), pa.array([rows.tobytes()], pa.binary())], ["part", "node", "size", "rows"])


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of the vectors of one part, as doubles."""
    size = int(pdf["size"].iloc[0])
    total = np.zeros(len(pdf["rows"].iloc[0]) // size)
    for x in pdf["rows"]:
        total += np.frombuffer(x, np.float32 if size == 4 else np.float64)
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "node": pdf["node"].iloc[:1], "size": [8], "rows": [total.tobytes()]})


def _summed(partial: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """The sums of all tasks by part: a tree, so no task reads more than about ``FAN_IN`` of them and what reaches the driver has a fixed size."""
    schema = Sketch.schema
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        partial = partial.withColumn("node", F.pmod("node", F.lit(tasks))).groupBy("part", "node").applyInPandas(by_group(_add), schema)
    with small_batches(partial.sparkSession):
        rows = partial.collect()
    return {r["part"]: np.frombuffer(r["rows"], np.float64 if r["size"] == 8 else np.float32) for r in rows}


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        m = masks.get(y)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def judge(piece: np.ndarray, region: np.ndarray) -> tuple[float, bool]:
    """(share of the piece covered, whether its answer stands in the region)."""
    cover = lcs(piece, region) / len(piece)
    k = min(len(piece), max(ANSWER_LEAST, int(ANSWER_SHARE * len(piece))))
    answer, m = piece[-k:], len(region) - k + 1
    found = False
    if m > 0:
        hit = np.ones(m, bool)
        for i in range(k):
            hit &= region[i : i + m] == answer[i]
        found = bool(hit.any())
    return cover, found


class Search:
    """Windows of whole documents against the pieces: candidates by cosine, then the verdict."""

    schema = "doc_id long, item_id long, part int, cosine double, cover double, answer boolean, position long"

    def __init__(self, shared):
        self.shared = shared

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = self.shared.value
        table = block.idf[:, None] * block.basis
        goal = np.add.reduceat(table[block.flat], block.cuts[:-1], axis=0)
        goal /= np.maximum(np.linalg.norm(goal, axis=1, keepdims=True), 1e-9)
        # A piece is looked for in windows of as many steps as it may touch, so little else is in them.
        sizes = np.diff(block.cuts)
        reach = (sizes + 2 * STEP - 2) // STEP
        # Of words of like weight, the share that the verdict asks for gives this cosine in a worst placed window full of other such words.
        least = np.minimum(COSINE, PARAPHRASE * np.sqrt(sizes / (reach * STEP))).astype(np.float32)
        classes = [(int(g), np.flatnonzero(reach == g), np.ascontiguousarray(goal[reach == g].T)) for g in np.unique(reach)]
        members = np.zeros((len(block.words), len(block.vocabulary) + 1), bool)  # the last column is that of words that are no features
        members[np.repeat(np.arange(len(block.words)), np.diff(block.cuts)), block.flat] = True
        for batch in batches:
            ids, found = batch.column(0), []
            for w in words(batch.column(1), limit=128 << 10):
                if not len(w.hashes):
                    continue
                x = block.index(w.hashes)
                n = np.diff(w.bounds)
                cells = -(-n // STEP)
                doc_of = np.repeat(np.arange(w.count), cells)
                at = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
                start = w.bounds[:-1][doc_of] + at * STEP
                done: dict[tuple[int, int], int] = {}
                for c, p, g, value in self._hits(block, table, classes, least, x, start, doc_of):
                    d = doc_of[c]
                    size = sizes[p]
                    lo = np.maximum(w.bounds[d], start[c] - size)
                    hi = np.minimum(w.bounds[d + 1], start[c] + g * STEP + size)
                    for i in np.flatnonzero(self._shared(members, p, x, lo, hi) >= PARAPHRASE * size):
                        key = int(d[i]), int(p[i])
                        if hi[i] <= done.get(key, -1):
                            continue
                        cover, answer = judge(block.words[key[1]], w.hashes[lo[i] : hi[i]])
                        if cover >= COVER or (cover >= PARAPHRASE and answer):
                            done[key] = int(hi[i])
                            found.append((ids[w.first + key[0]].as_py(), int(block.item[key[1]]), int(block.part[key[1]]), float(value[i]), cover, answer, int(start[c[i]] - w.bounds[key[0]])))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]
            cols = list(zip(*found, strict=True)) if found else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "part", "cosine", "cover", "answer", "position"])

    @staticmethod
    def _hits(block: Block, table: np.ndarray, classes: list, least: np.ndarray, x: np.ndarray, start: np.ndarray, doc_of: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(cell, piece, reach in cells, cosine) of windows near enough to a piece, slice by slice, in the order of cells for each reach."""
        most = classes[-1][0]
        for c0 in range(0, len(start), SLICE_CELLS):
            own, more = min(SLICE_CELLS, len(start) - c0), min(SLICE_CELLS + most - 1, len(start) - c0)
            lo, hi = start[c0], start[c0 + more] if c0 + more < len(start) else len(x)
            ok = np.flatnonzero(x[lo:hi] >= 0)
            cell = np.repeat(np.arange(more), np.diff(np.append(start[c0 : c0 + more], hi)))[ok]
            feature = x[lo + ok]
            dense, other = block.parts(feature, cell, more)
            sums = dense @ table[block.dense]
            _add_rows(sums, cell[other], table[feature[other]])
            doc = doc_of[c0 : c0 + more]
            window, width = sums.copy(), 1
            for g, pieces_of, target in classes:
                while width < min(g, more):
                    ahead = sums[width:].copy()
                    ahead[doc[width:] != doc[:-width]] = 0
                    window[:-width] += ahead
                    width += 1
                near = window[:own] @ target
                near /= np.maximum(np.linalg.norm(window[:own], axis=1), 1e-9)[:, None]
                c, p = np.nonzero(near >= least[pieces_of])
                for i in range(0, len(c), SLICE_HITS):
                    k = slice(i, i + SLICE_HITS)
                    yield c0 + c[k], pieces_of[p[k]], g, near[c[k], p[k]]

    @staticmethod
    def _shared(members: np.ndarray, p: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many words of each range are words of the piece."""
        size = hi - lo
        hit = members[np.repeat(p, size), x[ragged(lo, size)]]
        sums = np.concatenate([[0], np.cumsum(hit)])
        ends = np.cumsum(size)
        return sums[ends] - sums[ends - size]


def fit_block(texts: DataFrame, block: Block, rank: int = RANK, oversample: int = OVERSAMPLE, seed: int = 5, passes: int = 1) -> None:
    """IDF and the latent basis of a block, over all documents; nothing larger than words x rank reaches the driver."""
    sc, tasks = texts.sparkSession.sparkContext, texts.rdd.getNumPartitions()
    shared = sc.broadcast(block)
    total = _summed(texts.mapInArrow(by_batch(Frequencies(shared)), Frequencies.schema), tasks).get(0, np.zeros(1 + len(block.vocabulary)))
    shared.destroy()
    n, df = total[0], total[1:]
    block.idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)
    block.common(df)
    width = min(len(block.vocabulary), rank + oversample)
    rng = np.random.default_rng(seed)
    own = np.repeat(np.arange(len(block.words)), np.diff(block.cuts))
    # One pass: for the covariance C = A'A the sketch Y = C S gives its Nystrom form Y (S'Y)^-1 Y', whose eigenvectors are
    # the right singular vectors of A.  A further pass starts from those.
    block.basis = np.linalg.qr(rng.standard_normal((len(block.vocabulary), width)))[0].astype(np.float32)
    for k in range(passes):
        shared = sc.broadcast(block)
        parts = _summed(texts.mapInArrow(by_batch(Sketch(shared)), Sketch.schema), tasks)
        shared.destroy()
        y = np.concatenate([parts[k] for k in sorted(parts)]).reshape(block.basis.shape).astype(np.float32) if parts else np.zeros(block.basis.shape, np.float32)
        block.basis = _factor(block, y, own, width if k + 1 < passes else rank)


def _factor(block: Block, y: np.ndarray, own: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors from the sketch ``y``, with the block's own pieces added."""
    mine = np.zeros(block.basis.shape, np.float32)
    covariance_times(block, block.basis, block.flat, own, mine)
    # The pieces count as much as the documents' passages, so that their words are in the basis.
    y += mine * max(1.0, float(np.abs(y).max()) / max(1e-9, float(np.abs(mine).max())))
    s, y = block.basis.astype(np.float64), y.astype(np.float64)
    y += 1e-6 * np.linalg.norm(y) * s
    core = s.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-12
    left = np.linalg.svd((y @ vectors[:, good]) / np.sqrt(values[good]), full_matrices=False)[0]
    return np.ascontiguousarray(left[:, :rank].astype(np.float32))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document and benchmark item found in it: doc_id, item_id, cosine, cover, answer, position, contaminated.

    ``cover`` is the largest share of a piece of the item that a common subsequence covers, ``position`` the word at which
    that window starts; of equal ones the first counts.  Null and empty texts or items match nothing.  Rows of one id are one document, so
    repeated rows are reported once; rows without an id are searched and reported under null.  Texts of any length are searched whole.
    Empty tables give no rows.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))

    def rows() -> Iterator[tuple[int, int, np.ndarray]]:
        held = []
        for r in items.toLocalIterator():
            held.append((r["item_id"], r["text"]))
            if len(held) == BLOCK_PIECES:
                yield from pieces(pd.DataFrame(held, columns=["item_id", "text"]))
                held = []
        if held:
            yield from pieces(pd.DataFrame(held, columns=["item_id", "text"]))

    out = spark.createDataFrame([], Search.schema)
    for block in _blocks(rows()):
        fit_block(base.select("text"), block)
        shared = spark.sparkContext.broadcast(block)
        out = out.unionByName(materialise(base.mapInArrow(by_batch(Search(shared)), Search.schema), "leaks"))
        shared.destroy()
    best = F.max(F.struct("cover", "cosine", "answer", (-F.col("position")).alias("p"))).alias("best")
    out = out.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", F.col("best.cosine").alias("cosine"), F.col("best.cover").alias("cover"), F.col("best.answer").alias("answer"), (-F.col("best.p")).alias("position"), F.lit(True).alias("contaminated"))
