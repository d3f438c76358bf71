"""Words of Arrow text columns as NumPy arrays.

Texts stay in their UTF-8 buffers: a chunk of rows is tokenised with a few array operations and each word becomes
a 64-bit hash, so no Python string is made for a word. Used inside ``mapInArrow`` tasks; a chunk is bounded by
``CHUNK_BYTES`` of text (a longer text is a chunk of its own), which bounds a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

#: Upper-case A-Z to lower case, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space parts: ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of lower-cased words of letters and digits: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
PLAIN = np.ones(256, dtype=bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    PLAIN[_a : _b + 1] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit values, the same everywhere."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_BYTE = constants(256, 17)
_BASE = 0xD1342543DE82EF95
_UNDO = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text in ``column`` each, but at least one row."""
    if not batch.num_rows:
        return
    offsets, _ = texts(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a chunk of texts: ``hash``, ``doc`` (row in the chunk) and ``count`` (words of each row)."""

    def __init__(self, column: pa.Array, table: np.ndarray) -> None:
        offsets, data = texts(column)
        self.rows = len(offsets) - 1
        lower = LOWER[data]
        inside = table[lower]
        size = len(lower)
        before, after = np.zeros(size, bool), np.zeros(size, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < size]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[lower] * powers(_BASE, size), out=sums[1:])
        self.hash = mix((sums[end] - sums[start]) * powers(_UNDO, size)[start]) if size else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(offsets, start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.rows)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.start, self.end = start - offsets[self.doc], end - offsets[self.doc]


_PLACE = constants(64, 991)


def runs(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words of one row, and where each starts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    total = np.full(len(at), k, np.uint64)
    for j in range(k):
        total += words[at + j] * _PLACE[j % 64]
        if k > 64:
            total = mix(total)
    return mix(total), at
