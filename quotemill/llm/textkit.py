"""Vectorised tokenising of Arrow text: words become 64-bit hashes without any Python string.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z count as a-z.  A word's hash is a polynomial over
random byte values, taken from prefix sums, then finalised; a batch costs a few nanoseconds a byte.  A text of any length is one
document of its chunk: it costs its bytes three times over and 24 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64

CHUNK_BYTES = 256 << 10
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


def _byte_values(fold: bool) -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if fold:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_VALUES = {True: _byte_values(True), False: _byte_values(False)}
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


@dataclass
class Words:
    """Words of consecutive documents.  ``bounds[i]:bounds[i+1]`` are the words of document ``first+i`` of the batch."""

    first: int
    count: int
    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.count), np.diff(self.bounds))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    kind = np.int64 if texts.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return offs, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def _hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """Hash of each word ``part[starts[i]:ends[i]]``.  Sums are taken over at most ``CHUNK_BYTES``, so the eight bytes a byte that they
    cost do not grow with a text; a word that spans several sums adds up its parts."""
    h = np.zeros(len(starts), np.uint64)
    sums = np.zeros(min(len(part), CHUNK_BYTES) + 1, np.uint64)
    for lo in range(0, len(part), CHUNK_BYTES):
        hi = min(len(part), lo + CHUNK_BYTES)
        i, j = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
        if i == j:
            continue
        np.cumsum(_VALUES[fold][part[lo:hi]] * _power(_P, hi - lo), out=sums[1 : hi - lo + 1])
        first = np.maximum(starts[i:j], lo) - lo
        own = (sums[np.minimum(ends[i:j], hi) - lo] - sums[first]) * _power(_PINV, hi - lo + 1)[first]
        if starts[i] < lo:
            own[:1] *= np.uint64(pow(_P, int(lo - starts[i]), 1 << 64))
        h[i:j] += own
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words(texts: pa.Array, fold: bool = True, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    offsets, data = buffers(texts)
    for i, j in chunks(offsets, limit):
        lo, hi = offsets[i], offsets[j]
        part, cuts = data[lo:hi], offsets[i : j + 1] - lo
        n = len(part)
        inside = ~_SPACE[part]
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        inner = cuts[:-1][cuts[:-1] < n]
        before[inner] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[inner[inner > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        h = _hashes(part, starts, ends, fold)
        yield Words(i, j - i, h, np.searchsorted(starts, cuts), starts, ends, part)


def hash_word(word: bytes, fold: bool = True) -> int:
    """The hash that :func:`words` gives a single word."""
    return int(next(words(pa.array([word.decode("utf-8", "replace")]), fold)).hashes[0])


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (over the whole array, document bounds not regarded)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out *= np.uint64(_P)
        out += h[k : k + m]
    return mix64(out + np.uint64(n))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] : starts[i]+lengths[i]``, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)
