"""Language identification by string kernels: blended n-gram presence, Nystrom landmarks, one-versus-rest kernel ridge.

``k(x, z) = |G(x) & G(z)| / sqrt(|G(x)| |G(z)|)`` where G holds the byte n-grams (n of ``LENGTHS``) of a text among those of
the landmarks, ASCII letters lower-cased and runs of other ASCII bytes as one blank.  Scoring a block of texts is a
presence matrix times the landmark matrix, times the inverse root of the landmark kernel, times the ridge weights.

The classifier is fitted on whole texts of a bounded sample of rows.  Executors turn them into sets of n-grams, of at most
``SET_BYTES`` each whatever the text's length, and only these reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, by_batch, few_tasks, id_crc, materialise
from .textkit import buffers, chunks

LENGTHS = (1, 2, 3, 4)
SLOT_BITS = 18
SLOTS = len(LENGTHS) << SLOT_BITS
#: A set of n-grams in its longer form: a bit for each slot.
SET_BYTES = SLOTS // 8
#: The bounded sample of labelled rows that the classifier is fitted on: rows a label and in all, and the most labels.
SAMPLE_ROWS, SAMPLE_TOTAL, MOST_LABELS = 400, 4096, 1024
FRAGMENTS = (1, 2, 4, 8, 16)
LANDMARKS = 128
RIDGE = 0.05
UNDETERMINED = "und"
SLICE = 256 << 10
SEEN_BYTES = 8 << 20
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER = _FOLD < 0x80
_LETTER &= _FOLD != 0x20


def _folded(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of the texts and their bounds among these."""
    x = _FOLD[data]
    keep = x != 0x20
    keep[1:] |= x[:-1] != 0x20
    keep[cuts[:-1][cuts[:-1] < len(x)]] = True
    sizes = [np.count_nonzero(keep[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return x[keep], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def grams(data: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, slot) of every n-gram of the texts ``data[cuts[i]:cuts[i+1]]``, slice by slice and length by length."""
    x, cuts = _folded(data, cuts)
    for lo in range(0, len(x), SLICE):
        part = x[lo : lo + SLICE + max(LENGTHS) - 1].astype(np.uint32)
        doc = np.searchsorted(cuts, np.arange(lo, lo + len(part)), "right") - 1
        code = np.zeros(0, np.uint32)
        for k, n in enumerate(LENGTHS):
            m = min(SLICE, len(part) - n + 1)
            if m <= 0:
                break
            code = part[:m].copy()
            for i in range(1, n):
                code = code << np.uint32(8) | part[i : i + m]
            inside = doc[:m] == doc[n - 1 : n - 1 + m]
            slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
            yield doc[:m][inside], slot[inside].astype(np.int64) + (k << SLOT_BITS)


@dataclass
class Model:
    labels: list[str]
    column: np.ndarray  # slot -> column of the landmark matrix, or -1
    landmarks: np.ndarray  # columns x landmarks, each normalised
    root: np.ndarray  # inverse root of the landmark kernel
    weights: np.ndarray  # features and bias x labels

    def _kernel(self, seen: np.ndarray) -> np.ndarray:
        return (seen @ self.landmarks) / np.sqrt(np.maximum(1, seen.sum(1, keepdims=True)))

    def kernel(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        seen = np.zeros((len(cuts) - 1, len(self.landmarks)), np.float32)
        for doc, slot in grams(data, cuts):
            col = self.column[slot]
            ok = col >= 0
            seen[doc[ok], col[ok]] = 1
        return self._kernel(seen)

    def kernel_of_sets(self, sets: list[np.ndarray]) -> np.ndarray:
        seen = np.zeros((len(sets), len(self.landmarks)), np.float32)
        for i, s in enumerate(sets):
            col = self.column[s]
            seen[i, col[col >= 0]] = 1
        return self._kernel(seen)

    def best(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best label of each text and its score; a text without any n-gram of the landmarks scores 0."""
        k = self.kernel(data, cuts)
        s = k @ self.root @ self.weights[:-1] + self.weights[-1]
        return s.argmax(1), np.where(k.any(1), np.clip((1 + s.max(1)) / 2, 0, 1), 0.0)

    @property
    def least(self) -> float:
        """What the best label has before any n-gram is seen: a text that scores less has nothing in favour of any label."""
        return float(np.clip((1 + self.weights[-1].max()) / 2, 0, 1)) - 1e-6

    @property
    def block_rows(self) -> int:
        """Texts scored at once: their presence matrix is bounded."""
        return int(np.clip(SEEN_BYTES // (4 * max(1, len(self.landmarks))), 8, 256))


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), cuts


def gram_set(data: np.ndarray) -> np.ndarray:
    """The sorted slots of a text's n-grams."""
    cuts = np.array([0, len(data)])
    if len(data) <= SLICE:
        return np.unique(np.concatenate([np.zeros(0, np.int64), *[slot for _, slot in grams(data, cuts)]])).astype(np.int32)
    seen = np.zeros(SLOTS, bool)
    for _, slot in grams(data, cuts):
        seen[slot] = True
    return np.flatnonzero(seen).astype(np.int32)


def _packed(s: np.ndarray) -> bytes:
    """A set as its slots, or as a bit for each slot where that is shorter."""
    if 4 * len(s) < SET_BYTES:
        return s.tobytes()
    bits = np.zeros(SLOTS, np.uint8)
    bits[s] = 1
    return np.packbits(bits).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32) if len(raw) < SET_BYTES else np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)))


def has_letter(data: np.ndarray) -> bool:
    return bool(_LETTER[data].any()) or any(c.isalpha() for c in data[data >= 0x80].tobytes().decode("utf-8", "ignore"))


def sample_sets(data: np.ndarray, seed: int) -> list[np.ndarray]:
    """The set of a whole text, and those of fragments of it of ``FRAGMENTS`` words at random places; nothing without a letter."""
    if not has_letter(data):
        return []
    out, rng = [gram_set(data)], np.random.default_rng(seed % (1 << 63))
    for size in FRAGMENTS:
        at = int(rng.integers(0, max(1, len(data) - 16 * size)))
        near = data[at : at + 64 * size + 64].tobytes().split()
        part = np.frombuffer(b" ".join(near[1 : size + 1] if at and len(near) > size else near[:size]), np.uint8)
        if _LETTER[part].any():
            out.append(gram_set(part))
    return out


class SampleSets:
    """(lang, place, text) of sampled rows -> their sets, packed; ``part`` 0 is that of the whole text."""

    schema = "lang string, place int, part int, slots binary"

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column(2))
            for i in range(batch.num_rows):
                place = batch.column(1)[i].as_py()
                sets = [_packed(s) for s in sample_sets(data[offsets[i] : offsets[i + 1]], place)]
                lang = batch.column(0).slice(i, 1).take(pa.array([0] * len(sets), pa.int32()))
                cols = [lang, pa.array([place] * len(sets), pa.int32()), pa.array(range(len(sets)), pa.int32()), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "place", "part", "slots"])


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 7) -> Model | None:
    """Fit on labelled texts and on short fragments of them; None without any text that has a letter."""
    rows = []
    for i, (t, y) in enumerate(zip(texts, labels, strict=True)):
        rows += [(y, part, s) for part, s in enumerate(sample_sets(np.frombuffer(t.encode(), np.uint8), i))]
    return fit_sets(rows, landmarks, ridge, seed)


def fit_sets(rows: list[tuple[str, int, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 7) -> Model | None:
    """Fit on (label, part, set); landmarks are drawn evenly among the labels' whole texts."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    names = sorted({y for y, _, _ in rows})
    chosen: list[int] = []
    for y in names:
        own = [i for i, r in enumerate(rows) if r[0] == y and r[1] == 0]
        chosen += [int(i) for i in rng.permutation(own)[: max(1, landmarks // len(names))]]
    used = np.unique(np.concatenate([rows[i][2] for i in chosen]))
    column = np.full(SLOTS, -1, np.int32)
    column[used] = np.arange(len(used))
    z = np.zeros((len(used), len(chosen)), np.float32)
    for k, i in enumerate(chosen):
        z[column[rows[i][2]], k] = 1
    z /= np.sqrt(np.maximum(1, z.sum(0, keepdims=True)))
    model = Model(names, column, z, np.eye(len(chosen), dtype=np.float32), np.zeros((len(chosen) + 1, len(names)), np.float32))
    values, vectors = np.linalg.eigh((z.T @ z).astype(np.float64))
    model.root = (vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T).astype(np.float32)
    step, parts = model.block_rows, []
    for i in range(0, len(rows), step):
        parts.append(model.kernel_of_sets([s for _, _, s in rows[i : i + step]]) @ model.root)
    x = np.concatenate([np.concatenate(parts), np.ones((len(rows), 1), np.float32)], axis=1).astype(np.float64)
    at = {n: k for k, n in enumerate(names)}
    own = np.array([at[y] for y, _, _ in rows])
    y = np.full((len(rows), len(names)), -1.0)
    y[np.arange(len(rows)), own] = 1
    # Every label weighs the same, however many rows of it are in the sample.
    weight = 1 / np.bincount(own)[own]
    xw = x * (weight / weight.mean())[:, None]
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(xw.T @ x + penalty * len(rows) / 100, xw.T @ y).astype(np.float32)
    return model


class Predict:
    """The last column is the text; the others are carried along, with lang_pred and score behind them."""

    def __init__(self, shared: Broadcast):
        self.shared = shared

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = self.shared.value
        step = model.block_rows if model is not None else 256
        for batch in batches:
            offsets, data = buffers(batch.column(batch.num_columns - 1))
            labels, scores = [], []
            for lo, hi in chunks(offsets, 512 << 10):
                for i in range(lo, hi, step):
                    j = min(hi, i + step)
                    part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                    best, top = np.zeros(j - i, int), np.zeros(j - i)
                    if model is not None:
                        best, top = model.best(part, cuts)
                    for k in range(j - i):
                        ok = model is not None and has_letter(part[cuts[k] : cuts[k + 1]])
                        labels.append(model.labels[best[k]] if ok else UNDETERMINED)
                        scores.append(float(top[k]) if ok else 0.0)
            cols = [*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], "lang_pred", "score"])


def _learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int, landmarks: int) -> tuple[DataFrame, Broadcast]:
    text, lang = F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (id_crc(id_col) % 4 == 2).alias("held_out"), text, lang)
    model = fit_sets(training_sample(base, sample_rows), landmarks)
    return base, docs.sparkSession.sparkContext.broadcast(model)


def training_sample(docs: DataFrame, rows: int) -> list[tuple[str, int, np.ndarray]]:
    """(label, part, set of n-grams) of at most ``rows`` rows a label and ``SAMPLE_TOTAL`` in all (or one of each label), by a hash
    of the row, each read whole."""
    labelled = docs.where("lang is not null and text is not null and not held_out")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MOST_LABELS + 1).toLocalIterator()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels: this is no column of languages")
    if not counts:
        return []
    rows = max(1, min(rows, SAMPLE_TOTAL // len(counts)))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000)) / 1e9
    share = F.lit(1.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.2 * rows / n + 20 / n))).otherwise(share)
    drawn = labelled.where(draw < share).select("lang", draw.alias("d"), "doc_id", "text")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("d", "doc_id", "text"))
    drawn = drawn.withColumn("place", place).where(F.col("place") <= rows)
    got = drawn.select("lang", "place", "text").mapInArrow(by_batch(SampleSets()), SampleSets.schema).collect()  # SAMPLE_TOTAL sets and their fragments
    got.sort(key=lambda r: (r["lang"], r["place"], r["part"]))
    return [(r["lang"], r["part"], _unpacked(r["slots"])) for r in got]


def predict_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (0 to 1).

    Rows whose crc32 of the id as text leaves 2 modulo 4 are held out (a null id counts as empty text).  Predictions see
    the whole text alone; a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing
    can be learned (no labelled training row).  A text without any n-gram of the landmarks scores 0.  Repeated rows get equal predictions; of labels with equal scores the first by name
    counts.  A text of any length is worked off in slices, beside its folded bytes.  Other columns are not looked at.  An empty
    table gives no rows.  More than ``MOST_LABELS`` labels are an error.
    """
    base, shared = _learn(docs, id_col, text_col, lang_col, sample_rows, landmarks)
    return base.select("doc_id", "held_out", "text").mapInArrow(by_batch(Predict(shared)), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, placed: float | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is told: ``lang_pred`` is a label and its score ``placed`` or more.

    By default that is what the best label has before any n-gram is seen, so a row goes if its text has nothing in favour of any label, whatever its own label says; of 256,410 rows of the check tool's large table fewer than 10 do.  Where nothing can be learned,
    all texts with a letter stay.  Repeated rows stay or go together, null ids are ids like others.  Only ids and hashes of the
    texts of rows that go are exchanged; their table is broadcast only if counted as small.
    """
    base, shared = _learn(docs, id_col, text_col, lang_col, sample_rows, landmarks)
    if shared.value is None:
        return docs.where(F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)))
    key = F.xxhash64(F.col(text_col).cast("string"))
    seen = base.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(by_batch(Predict(shared)), "doc_id long, key long, lang_pred string, score double")
    gone = materialise(seen.where((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < (shared.value.least if placed is None else placed))).select(F.col("doc_id").alias("_gone"), F.col("key").alias("_gone_key")).distinct(), "unplaced", few_tasks(docs))
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(side, F.col(id_col).cast("long").eqNullSafe(F.col("_gone")) & (key == F.col("_gone_key")), "left_anti")
