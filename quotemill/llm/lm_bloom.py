"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of words, pairs and triples are summed over all training texts.  An n-gram of count c enters the filter once
for each level 1 .. floor(log2 c) + 1; a lookup probes level after level until one is missing, and the last level found
stands for the count.  Probabilities are Dirichlet-smoothed from triples down to words.

The filter's bits follow the number of its entries, without a ceiling, and it is never broadcast: it lies in segments, one for each
range of hashes.  Texts are packed into chunks, the distinct n-grams of a chunk go to their segment, which answers with their levels, and
the answers meet the chunk's texts again.

Base scores are exact: the counts of at most ``TOP_WORDS`` of the commonest words go to every task, all other words are looked up by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SegmentedBloom, buckets_for, by_batch, by_group, id_crc, materialise, small_batches, tidy
from .ngram_join import unpack_keys
from .textkit import ngram_hashes, words

BITS_PER_ENTRY = 16
HASHES = 2
ORDERS = 3
STRENGTH = (0.0, 0.0, 300.0, 100.0)
TOP_WORDS = 1 << 18
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 8
#: Text bytes whose n-grams fall into a bucket, and the fewest and most buckets.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 1 << 24, 256, 1 << 16
#: Keys of a bucket that are sorted and probed at once.
PIECE_KEYS = 1 << 19
#: Top bits of a key that are the same at all its levels.
FIXED_BITS = 20
END = np.uint64(0xE5A9D1C37B2F8604)
LEVEL_STEP = 0xC2B2AE3D27D4EB4F


def tokens(texts: pa.Array, limit: int = 512 << 10) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, token hashes, bounds) with the end token after each document's words."""
    for w in words(texts, limit=limit):
        h = np.insert(w.hashes, w.bounds[1:], END)
        yield w.first, h, w.bounds + np.arange(len(w.bounds))


def last_words(bounds: np.ndarray, n: int) -> np.ndarray:
    """Positions of the last tokens of all n-grams that stay within a document."""
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(bounds[-1])
    return np.flatnonzero(room >= n) + n - 1


def grams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that stay within a document, and the positions of their last tokens."""
    last = last_words(bounds, n)
    return ngram_hashes(h, n)[last - n + 1], last


class Pack:
    """Consecutive texts of about ``CHUNK_BYTES`` as one row; a chunk's number is that of its first text."""

    schema = "chunk long, ids array<long>, held array<boolean>, texts array<string>"

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 36
        parts, size = [], 0
        for batch in batches:
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at, before = 0, 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES - size, "right")))
                parts.append(batch.slice(at, to - at))
                size += int(sizes[to - 1]) - before
                at, before = to, int(sizes[to - 1])
                if size >= CHUNK_BYTES or at < batch.num_rows:
                    yield self._chunk(row, parts)
                    row += sum(p.num_rows for p in parts)
                    parts, size = [], 0
        if parts:
            yield self._chunk(row, parts)

    def _chunk(self, row: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        cols = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), pa.concat_arrays(c.chunks)) for c in t.columns]
        return pa.RecordBatch.from_arrays([pa.array([row]), *cols], ["chunk", "ids", "held", "texts"])


def chunk_grams(texts: pa.Array) -> list[np.ndarray]:
    """The texts' words, as hashes, and their pairs and triples, as 40-bit keys, each in the order of the texts."""
    held: list[list] = [[np.zeros(0, np.uint64)] for _ in range(ORDERS)]
    for _, h, bounds in tokens(texts):
        held[0].append(h)
        for n in range(2, ORDERS + 1):
            held[n - 1].append(grams(h, bounds, n)[0] >> np.uint64(24))
    return [np.concatenate(x) for x in held]


def distinct_grams(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted (keys, counts) of the texts' n-grams."""
    return [np.unique(x, return_counts=True) for x in chunk_grams(texts)]


def sides(held: pa.Array) -> list[np.ndarray]:
    """Positions of the training texts of a chunk and of those held out."""
    held = held.to_numpy(zero_copy_only=False).astype(bool)
    return [np.flatnonzero(~held), np.flatnonzero(held)]


class Counts:
    """Map side: a chunk's words as (hash, count), its longer n-grams as bucketed 40-bit keys with counts.

    Kinds 0, 1 and 2 are words, pairs and triples of training texts; 3, 4 and 5 those of texts held out, which are asked for only.
    """

    schema = "chunk long, kind int, bucket int, keys binary, counts binary"

    def __init__(self, buckets: int):
        self.buckets, self.bits = buckets, buckets.bit_length() - 1

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts, rows = batch.column(2)[i].values, []
                for side, at in enumerate(sides(batch.column(1)[i].values)):
                    if len(at):
                        rows += self._rows(distinct_grams(texts.take(pa.array(at))), 3 * side)
                kinds, buckets, keys, counts = zip(*rows, strict=True)
                chunk = pa.array([batch.column(0)[i].as_py()] * len(rows))
                yield pa.RecordBatch.from_arrays([chunk, pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["chunk", "kind", "bucket", "keys", "counts"])

    def _rows(self, sets: list[tuple[np.ndarray, np.ndarray]], kind: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        for n, (keys, counts) in enumerate(sets):
            wide_bits = 40 if n else 64
            cuts = np.searchsorted(keys, np.arange(self.buckets, dtype=np.uint64) << np.uint64(wide_bits - self.bits))
            cuts = np.append(cuts, len(keys))
            for b in range(self.buckets):
                part, c = keys[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]]
                if not len(part):
                    continue
                if not n:
                    yield kind, b, part.tobytes(), c.astype(np.uint32).tobytes()
                    continue
                steps = np.diff(part, prepend=np.uint64(b << (40 - self.bits)))
                wide, many = np.flatnonzero(steps > np.uint64(0xFFFFFFFF)), np.flatnonzero(c > 1)
                cols = [np.array([len(part), len(wide), len(many)]), steps & np.uint64(0xFFFFFFFF), wide, steps[wide] >> np.uint64(32), many, c[many]]
                yield kind + n, b, b"".join(x.astype(np.uint32).tobytes() for x in cols), b""


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their exact counts."""
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back, counts, len(keys)).astype(np.int64)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, c in zip(batch.column(0), batch.column(1), strict=True):
            h, c = (np.frombuffer(x.as_py(), np.int64) for x in (h, c))
            for i in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 16)]), pa.array(c[i : i + (1 << 16)])], ["hash", "count"])


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]


def leveled(keys: np.ndarray, level: int) -> np.ndarray:
    """The filter's key of an n-gram at a level; its top ``FIXED_BITS`` bits, and so its bucket, stay."""
    low = np.uint64((1 << 64 - FIXED_BITS) - 1)
    return keys & ~low | (keys + np.uint64(level * LEVEL_STEP & 0xFFFFFFFFFFFFFFFF)) & low


class Segment:
    """Reduce side of one bucket: exact word counts, the filter's segment of all its n-grams at all their levels, and its answers.

    A bucket of more than ``PIECE_KEYS`` keys is worked off in ranges of hashes, each with a segment of its own, so that sorting and
    probing take as much memory whatever the bucket's size; all that grows with it are the keys and their counts.

    A segment has ``BITS_PER_ENTRY`` bits an entry, or its part of ``bits`` where that is given, which leaves the bucket whole.  The first
    row, of chunk -1, holds the counts, and the segments where nothing is asked for; a row for each row of n-grams asked for holds their
    levels.
    """

    schema = "chunk long, kind int, bucket int, levels binary, hashes binary, counts binary, n long, v long, segment binary"

    def __init__(self, buckets: int, bits: int | None = None):
        self.buckets, self.bits = buckets, bits

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, bits = int(pdf["bucket"].iloc[0]), self.buckets.bit_length() - 1
        kind, asked = pdf["kind"].to_numpy(), "chunk" in pdf
        sizes = [int(np.frombuffer(x, np.uint32, 1)[0]) if k % 3 else len(x) // 8 for k, x in zip(kind, pdf["keys"], strict=True)]
        edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        more = 0
        while PIECE_KEYS << more < edges[-1] and self.bits is None and bits + more < FIXED_BITS:
            more += 1
        keys, counts, piece = np.empty(edges[-1], np.uint64), np.zeros(edges[-1], np.uint32), np.zeros(edges[-1] if more else 0, np.uint16)
        for k, x, c, i, j in zip(kind, pdf["keys"], pdf["counts"], edges[:-1], edges[1:], strict=True):
            if k % 3:
                own, many = unpack_keys(x, bucket, bits)
                keys[i:j] = own << np.uint64(24)
            else:
                keys[i:j], many = np.frombuffer(x, np.uint64), np.frombuffer(c, np.uint32)
            if k < 3:  # those held out are asked for only
                counts[i:j] = many
            if more:
                piece[i:j] = keys[i:j] << np.uint64(bits) >> np.uint64(64 - more)
        longer, word = np.repeat(kind % 3 > 0, sizes), np.repeat(kind == 0, sizes)
        found, parts = np.zeros(len(keys) if asked else 0, np.uint8), []
        for p in range(1 << more):
            at = np.flatnonzero(piece == p) if more else slice(None)
            hashes, own, segment, answers = self._piece(keys[at], counts[at], longer[at], word[at], asked)
            parts.append((hashes, own, b"" if asked else segment))
            if asked:
                found[at] = answers
        hashes, own = (np.concatenate([x[i] for x in parts]) for i in range(2))
        out = pd.DataFrame({"chunk": [-1], "kind": [-1], "bucket": [bucket], "levels": [b""], "hashes": [hashes.tobytes()], "counts": [own.tobytes()], "n": [int(own.sum())], "v": [len(own)], "segment": [b"".join(x[2] for x in parts)]})
        if not asked:
            return out
        answers = [found[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
        asked = pd.DataFrame({"chunk": pdf["chunk"], "kind": kind, "bucket": bucket, "levels": answers, "hashes": b"", "counts": b"", "n": 0, "v": 0, "segment": b""})
        return pd.concat([out, asked], ignore_index=True)

    def _piece(self, keys: np.ndarray, counts: np.ndarray, longer: np.ndarray, word: np.ndarray, asked: bool) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray | None]:
        """Words and their counts, the segment, and the levels of all keys, in their order."""
        hashes, own = tally(keys[word], counts[word])
        others, back = np.unique(keys[longer], return_inverse=True)
        many = np.bincount(back, counts[longer], len(others)).astype(np.int64)
        found, level = [np.zeros(0, np.uint64)], 1
        left, high = np.concatenate([hashes >> np.uint64(24) << np.uint64(24), others[many > 0]]), levels(np.concatenate([own, many[many > 0]]))
        while (m := high >= level).any():
            left, high = left[m], high[m]
            found.append(leveled(left, level))
            level += 1
        entries = np.concatenate(found)
        size = len(entries) * BITS_PER_ENTRY if self.bits is None else self.bits // self.buckets
        bloom = SegmentedBloom(-(-size // 64) * 64, 1, HASHES)
        segment = bloom.segment_bytes(entries, 0)
        if not asked:
            return hashes, own, segment, None
        del found, left, high, entries
        bloom.place(0, segment)
        answers = np.empty(len(keys), np.uint8)
        answers[longer] = probe(bloom, others, level - 1)[back]
        singles, back = np.unique(keys[~longer], return_inverse=True)
        answers[~longer] = probe(bloom, singles, level - 1)[back]
        return hashes, own, segment, answers


def probe(bloom: SegmentedBloom, keys: np.ndarray, most: int = 63) -> np.ndarray:
    """Levels of n-grams, by probing one after another up to the largest one stored."""
    keys = keys >> np.uint64(24) << np.uint64(24)
    found = np.zeros(len(keys), np.uint8)
    alive, level = np.arange(len(keys)), 1
    while len(alive) and level <= most:
        alive = alive[bloom.contains(leveled(keys[alive], level))]
        found[alive] = level
        level += 1
    return found


_COUNTS = np.array([0.0, 1.0, *(1.4 * 2.0 ** (level - 1) for level in range(2, 64))])


def quantised(found: np.ndarray) -> np.ndarray:
    """A level stands for counts 2**(l-1) .. 2**l - 1."""
    return _COUNTS[np.minimum(found, len(_COUNTS) - 1)]


def lookup(bloom: SegmentedBloom, keys: np.ndarray, most: int = 63) -> np.ndarray:
    """Quantised counts by probing level after level."""
    return quantised(probe(bloom, keys, most))


class Score:
    """The texts of a chunk with the answers to its n-grams."""

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>"

    def __init__(self, shared, n: int, v: int):
        self.shared, self.mass = shared, n + 0.1 * (v + 1)

    def __call__(self, packed: pa.Table, answers: pa.Table) -> pa.Table:
        given = answers.select(["kind", "bucket", "levels"]).to_pandas().sort_values(["kind", "bucket"])
        of_kind = {k: np.frombuffer(b"".join(x["levels"]), np.uint8) for k, x in given.groupby("kind")}
        chunk = packed["chunk"][0].as_py()
        ids, held, texts = (packed[c][0].values for c in ("ids", "held", "texts"))
        out = []
        for side, at in enumerate(sides(held)):
            if len(at):
                own = texts.take(pa.array(at))
                # The answers are in the order of the sorted keys, which the inverse turns into that of the texts.
                found = [of_kind[3 * side + n][np.unique(x, return_inverse=True)[1]] if len(x) else x.astype(np.uint8) for n, x in enumerate(chunk_grams(own))]
                out += self._scored(own, found, chunk + at, ids.take(pa.array(at)), held.take(pa.array(at)))
        return pa.Table.from_batches(out)

    def _scored(self, texts: pa.Array, found: list[np.ndarray], rows: np.ndarray, ids: pa.Array, held_out: pa.Array) -> Iterator[pa.RecordBatch]:
        top, top_counts = self.shared.value
        top_logs = np.log10((top_counts + 0.1) / self.mass)
        used = [0] * ORDERS
        for first, h, bounds in tokens(texts):
            count = len(bounds) - 1
            counts = quantised(found[0][used[0] : used[0] + len(h)])
            used[0] += len(h)
            distinct, back = np.unique(h, return_inverse=True)
            at = np.minimum(np.searchsorted(top, distinct), max(0, len(top) - 1))
            hit = top[at] == distinct if len(top) else np.zeros(len(distinct), bool)
            logs = np.where(hit, top_logs[at], 0.0) if len(top) else np.zeros(len(distinct))
            p = np.minimum(1.0, (counts + 0.1) / self.mass)  # a quantised count may be over the true one
            prior = counts
            for n in range(2, ORDERS + 1):
                last = last_words(bounds, n)
                counts = quantised(found[n - 1][used[n - 1] : used[n - 1] + len(last)])
                used[n - 1] += len(last)
                history = np.maximum(prior[last - 1], counts)
                p[last] = (counts + STRENGTH[n] * p[last]) / (history + STRENGTH[n])
                prior = np.zeros(len(h))
                prior[last] = counts
            cut = bounds[:-1]
            sums = lambda x: np.add.reduceat(x, cut)  # noqa: B023, E731
            rare = ~hit[back]
            held = h[rare].view(np.int64)
            edges = np.concatenate([[0], np.cumsum(sums(rare.astype(np.int64)))]).astype(np.int32)
            cols = [
                pa.array(rows[first : first + count]), ids.slice(first, count), held_out.slice(first, count), pa.array(np.diff(bounds)), pa.array(sums((hit & True)[back].astype(np.int64))), pa.array(sums(logs[back])),
                pa.array(sums(np.log10(p))), pa.ListArray.from_arrays(pa.array(edges), pa.array(held)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"])


def _commonest(vocabulary: DataFrame, most: int) -> DataFrame:
    """At most so many of the commonest words: those above a count, found from the numbers of words by count in steps."""
    step = F.floor(8 * F.log2("count")).cast("int")
    sizes = vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()  # a few hundred rows
    least, total = 1 << 30, 0
    for r in sorted(sizes, reverse=True):
        total += r["n"]
        if total > most:
            break
        least = r["step"]
    return vocabulary.where(step >= least)


def by_chunk(f):
    """A callable object as the two-argument function that ``applyInArrow`` asks for."""

    def run(left, right):
        try:
            return f(left, right)
        finally:
            tidy()

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top_words: int = TOP_WORDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id as text is divisible by 10 are held out of the counts (a null id counts as empty text).
    A null text counts as empty: its one token is the end.  Repeated rows count and are scored each.  With no
    training row every count is 0 and scores are those of the empty model.  Scores are never over 0.  A text longer than
    ``CHUNK_BYTES`` is a chunk of its own, counted and scored whole.  An empty table gives no rows.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (id_crc(id_col) % 10 == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    buckets = buckets_for(docs, LEAST_BUCKETS)
    octets = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    while buckets * BUCKET_BYTES < octets and buckets < MOST_BUCKETS:
        buckets *= 2
    packed = materialise(base.mapInArrow(by_batch(Pack()), Pack.schema), "packed", compression="zstd")
    with small_batches(spark, CHUNK_ROWS):
        counts = packed.select("chunk", "held", "texts").mapInArrow(by_batch(Counts(buckets)), Counts.schema)
        reduced = materialise(counts.groupBy("bucket").applyInPandas(by_group(Segment(buckets)), Segment.schema).drop("segment"), "counts")
    model = reduced.where("chunk < 0")
    n, v = model.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    vocabulary = model.select("hashes", "counts").mapInArrow(by_batch(_word_rows), "hash long, count long")
    top = _commonest(vocabulary, top_words).toPandas()
    keys = top["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], top["count"].to_numpy(np.int64)[order]))
    answers = reduced.where("chunk >= 0").select("chunk", "kind", "bucket", "levels")
    with small_batches(spark, CHUNK_ROWS):
        scored = materialise(packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(by_chunk(Score(shared, n, v)), Score.schema), "scored")
    rare = scored.select("row", F.explode("rare").alias("hash")).join(vocabulary, "hash", "left")
    mass = n + 0.1 * (v + 1)
    c = F.coalesce(F.col("count"), F.lit(0))
    rest = rare.groupBy("row").agg(F.sum(F.log10((c + 0.1) / mass)).alias("more"), F.sum((c > 0).cast("long")).alias("also"))
    out = scored.drop("rare").join(rest, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
