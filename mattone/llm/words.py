"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes, A-Z lower-cased. All work is done on the flat byte
buffer of an Arrow string column; a batch is cut into slices of half a MB so that memory does not follow the batch.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_ROLL = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits (a bijection)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)[_LOWER]
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 64, 2 * len(_POWERS)), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.cumprod(grown, dtype=np.uint64)
    return _POWERS


class Words:
    """The words of some rows: ``hashes`` of all words in order; row r holds words ``first[r]:first[r + 1]``.

    ``starts`` and ``ends`` are byte offsets into ``data``; ``rows`` names the rows in the caller's batch.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray):
        self.data, self.rows = data, rows
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.ones(len(data), bool)
        before[1:] = ~inside[:-1]
        after = np.ones(len(data), bool)
        after[:-1] = ~inside[1:]
        self.starts = np.flatnonzero(inside & (before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        lengths = self.ends - self.starts
        if len(lengths):
            begin = np.cumsum(lengths) - lengths
            place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(begin, lengths)
            values = _BYTE[data[inside]] * _powers(int(lengths.max()))[place]
            self.hashes = mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64) * _STEP)
        else:
            self.hashes = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """The rows of a string column in order, half a MB at a time (one row at least). A null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, where, raw = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, len(texts))
        yield Words(data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row], np.arange(row, stop))
        row = stop


def grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and where each row's runs begin (rows + 1 entries).

    A row of fewer words, but at least one, has one run: its whole sequence.
    """
    h, first, counts = words.hashes, words.first, words.counts()
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(runs)])
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), begin
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for t in range(size):
        rolled = rolled * _ROLL + h[t:t + len(rolled)]
    out = np.empty(int(begin[-1]), np.uint64)
    full = np.flatnonzero(counts >= size)
    if len(full):
        lengths = runs[full]
        inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(begin[full], lengths) + inner] = rolled[np.repeat(first[full], lengths) + inner]
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        short = np.full(1, counts[r], np.uint64)
        for x in h[first[r]:first[r + 1]]:
            short = short * _ROLL + x
        out[begin[r]] = short[0] ^ _STEP
    return mix(out), begin
