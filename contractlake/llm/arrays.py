"""Numpy views of Arrow text columns: slices, words, hashes. Runs inside Spark tasks only.

A word is a run of bytes other than space and the controls 9 to 13; it never crosses documents.
Word hashes ignore the case of A-Z, cover the whole word, and are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
# Bytes of text worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def byte_table(salt: int) -> np.ndarray:
    """One pseudo-random 64-bit number for each byte value."""
    return mix(mix(np.arange(256, dtype=U64) + U64(salt)) + U64(_BASE))


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTES = byte_table(1)[LOWER]
_POWERS = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Base and inverse-base powers 0..n modulo 2^64."""
    if len(_POWERS["up"]) <= n:
        size = (int(n) >> 18) + 1 << 18
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size + 1, base, U64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows, from 0); null counts as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offs[0]:offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `limit` bytes of text each, at least one row."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.diff(text_bytes(texts)[1])
    ends = np.cumsum(sizes)
    row = 0
    while row < len(sizes):
        before = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(row, stop - row)
        row = stop


def segment_sums(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups, 0 for groups without values."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, starts[some], axis=0)
    return out


class Words:
    """Words of a run of documents: byte starts and ends, document number, 64-bit hash. `gaps`: the bytes between words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE):
        self.n_docs = len(offsets) - 1
        up, self._down = powers(len(data))
        self._total = np.zeros(len(data) + 1, U64)
        if not len(data):
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U64)
        else:
            inside = ~gaps[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            begins, stops = inside.copy(), inside.copy()
            begins[1:] &= ~inside[:-1] | edge[1:-1]
            stops[:-1] &= ~inside[1:] | edge[1:-1]
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
            self.doc = np.searchsorted(offsets, self.start, "right") - 1
            np.cumsum(WORD_BYTES[data] * up[:len(data)], out=self._total[1:])
            self.hash = self.spans(self.start, self.end)
        self.counts = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.cumsum(self.counts) - self.counts

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes start:end."""
        return mix((self._total[end] - self._total[start]) * self._down[start] + (end - start).astype(U64))


_STEPS = byte_table(2)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of every run of `size` words; a shorter text is one run of all its words."""
    n = len(words.hash)
    full = words.counts >= size
    short = (words.counts > 0) & ~full
    docs, hashes = [], []
    if full.any():
        last = np.zeros(n, bool)
        run = np.zeros(max(0, n - size + 1), U64)
        for k in range(size):
            run += words.hash[k:n - size + 1 + k] * (_STEPS[k] | U64(1))
        last[:len(run)] = words.doc[:len(run)] == words.doc[size - 1:]
        at = np.flatnonzero(last)
        docs.append(words.doc[at])
        hashes.append(mix(run[at] + _STEPS[128 + size]))
    for d in np.flatnonzero(short):
        own = words.hash[words.first[d]:words.first[d] + words.counts[d]]
        docs.append(np.array([d]))
        with np.errstate(over="ignore"):
            hashes.append(mix((own * (_STEPS[:len(own)] | U64(1))).sum(keepdims=True) + _STEPS[128 + len(own)]))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(docs), np.concatenate(hashes)
