"""Vectorised word kernels over Arrow string buffers.

A batch of texts is handled as one UTF-8 byte array plus offsets; words, shingles and
windows are found and hashed with numpy, so no Python string is made for each word.
Words are runs of bytes other than space and \\t\\n\\v\\f\\r.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are worked on in slices of about so many bytes, which bounds the memory of a batch.
SLICE_BYTES = 1 << 20

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    up, down = _powers(base, -(-int(n) // 2**18) * 2**18)
    return up[:n], down[:n]


class ByteSums:
    """Prefix sums from which any span of bytes is hashed in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(_BYTE_BASE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=self.sums[1:])

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


class Words:
    """The words of a slice of texts.

    starts, ends: byte places of each word; bounds: for text i its words are
    bounds[i]:bounds[i + 1]; hashes: 64 bits of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = _SEP):
        self.data, self.offsets = data, offsets
        if lower:
            data = _LOWER[data]
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = ByteSums(data).spans(self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word windows from each word, and whether that window ends within its text."""
        n = len(self.hashes)
        left = np.repeat(self.bounds[1:], self.counts) - np.arange(n)
        return self.spans(np.arange(n), np.minimum(np.arange(n) + k, n)), left >= k

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences lo:hi."""
        n = len(self.hashes)
        up, down = powers(_WORD_BASE, n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hashes * up[:n], out=sums[1:])
        return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct k-word shingles of each text; a text of 1 to k-1 words has one, its whole sequence."""
    h, whole = words.windows(k)
    text = words.text_of_word()
    h, text = h[whole], text[whole]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        h = np.concatenate([h, words.spans(words.bounds[short], words.bounds[short + 1])])
        text = np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[keep], text[keep]
    return h, np.searchsorted(text, np.arange(len(words.offsets)))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in slices of consecutive rows with about `limit` bytes of text (or one longer text): (rows, bytes, offsets)."""
    for batch in batches:
        data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values[bounds[i]:bounds[i + 1]] of each i as binary."""
    values = np.ascontiguousarray(values)
    offs = (np.asarray(bounds) * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offs), pa.py_buffer(values)]).cast(pa.binary())


def unblob(column: pa.Array | pa.ChunkedArray, dtype=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of blobs(): values and bounds."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, dtype=dtype), np.zeros(1, dtype=np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    width = np.dtype(dtype).itemsize
    return np.frombuffer(raw.tobytes(), dtype=dtype), (offsets - offsets[0]) // width
