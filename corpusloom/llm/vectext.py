"""Vectorised text primitives over Arrow string columns.

Every function works on the UTF-8 buffer of a whole slice of documents at once: words are found with a
256-entry byte table, and any word or shingle is hashed from one prefix sum, so cost per byte is a few array
operations and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in one slice; a longer document is a slice of its own.
SLICE_BYTES = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z only."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_table(text: bytes) -> np.ndarray:
    """Byte table that is true for the given bytes."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(text, np.uint8)] = True
    return table


LOWER = lower_table()
#: ASCII letters, digits and every byte of a non-ASCII character.
ALNUM = word_table(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
#: Everything but the space and the ASCII controls 9 to 13.
NON_SPACE = ~word_table(bytes([32, *range(9, 14)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection, so it adds no collisions."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, min(2 * n, SLICE_BYTES + 1))
        made = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        if size > 4 * SLICE_BYTES:
            return made[0], made[1]  # of one very long document: not kept
        _powers[:] = made
    return _powers[0], _powers[1]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of a slice has at most ``limit`` bytes, or one document; null becomes empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
        columns = list(batch.columns)
        columns[at] = text
        batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        ends = np.cumsum(np.asarray(pc.binary_length(text), dtype=np.int64))
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of the documents."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of code points of each document."""
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return heads[offsets[1:]] - heads[offsets[:-1]]


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 word offsets of the documents."""
    inside = np.concatenate(([False], table[raw], [False]))
    edge = inside[1:] != inside[:-1]
    start, end = edge & inside[1:], edge & inside[:-1]
    cuts = np.unique(offsets)
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    joined = cuts[table[raw[cuts]] & table[raw[cuts - 1]]] if len(cuts) else cuts
    start[joined] = end[joined] = True
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, offsets)


def distinct_words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct lower-cased words, which of them each occurrence is, and the n + 1 word offsets of the documents."""
    low = LOWER[raw]
    starts, ends, at = words(low, offsets, table)
    bounds = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(low[table[low]])).dictionary_encode()
    return found.dictionary.cast(pa.string()), np.asarray(found.indices).astype(np.int64), at


class Hasher:
    """Hashes of any byte spans of one buffer."""

    def __init__(self, raw: np.ndarray, seed: int = 0):
        self.forward, self.backward = _power_tables(len(raw) + 1)
        self.seed = np.uint64(seed * 0x2545F4914F6CDD1D % 2**64)
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.forward[: len(raw)], out=sums[1:])
        self.sums = sums

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        body = (self.sums[ends] - self.sums[starts]) * self.backward[starts]
        return mix(body + self.seed + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words (of all words where a document has fewer, none where it has none).

    Returns the hashes and the n + 1 offsets of the documents.
    """
    counts = np.diff(offsets)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out = np.concatenate(([0], np.cumsum(sizes)))
    position = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], sizes)
    last = np.repeat(offsets[1:], sizes)
    padded = np.concatenate((hashes, np.zeros(k, np.uint64)))
    total = np.zeros(out[-1], np.uint64)
    for j in range(k):
        at = position + j
        total = total * _BASE + np.where(at < last, padded[np.minimum(at, len(padded) - 1)], np.uint64(0))
    return mix(total), out
