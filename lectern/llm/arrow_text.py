"""Small numpy helpers for tasks that read Arrow batches of texts: words, their hashes and shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M64 = 0xFFFFFFFFFFFFFFFF
_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIER = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each bit of 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def text_buffers(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; a null text is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about `most` bytes in `column`, or of one row."""
    for batch in batches:
        size = batch.column(batch.schema.names.index(column)).nbytes
        rows = max(1, batch.num_rows * most // max(size, most))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def word_hashes(data: np.ndarray, offsets: np.ndarray, piece: int = 8 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text). Words are runs without ASCII white space, with
    A-Z in lower case. Works through `piece` bytes at a time, cut between words."""
    space = SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = ~space & (first[:-1] | np.concatenate([[True], space[:-1]])) if len(data) else np.empty(0, bool)
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(~space & (first[1:] | np.concatenate([space[1:], [True]]))) + 1 if len(data) else starts
    counts = np.diff(np.searchsorted(starts, offsets))
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(stops, starts[at] + piece, "right")))
        lengths = stops[at:end] - starts[at:end]
        total = np.cumsum(lengths)
        begin = total - lengths
        within = np.arange(int(total[-1])) - np.repeat(begin, lengths)
        value = BYTE_VALUE[LOWER[data[within + np.repeat(starts[at:end], lengths)]]]
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(lengths.max()), MULTIPLIER, np.uint64))
            out[at:end] = mix(np.add.reduceat(value * power[within], begin))
        at = end
    return out, counts


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words of one text, sorted and distinct; with fewer words, of the whole."""
    if not len(words):
        return words
    size = min(n, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(words) - size + 1, size * 0x2545F4914F6CDD1D & M64, np.uint64)
        factor = 1
        for k in range(size):
            factor = factor * MULTIPLIER & M64
            h += words[k : len(words) - size + 1 + k] * np.uint64(factor)
    return np.unique(mix(h))
