"""Arrow batches of documents as bounded numpy blocks, and vectorised hashes over their bytes.

Every operator that runs numpy inside tasks reads ``(doc_id, text)`` through ``blocks``: a block holds whole
documents, about ``limit`` bytes of them, so a task's memory depends on the block and on its longest document only.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_PLACE = _rng.integers(1, 2**63, 1 << 16, dtype=np.uint64) * U64(2) + U64(1)
_FAR_PLACE = np.r_[U64(1), _rng.integers(1, 2**63, (1 << 16) - 1, dtype=np.uint64) * U64(2) + U64(1)]
#: The space characters of ``[\x20\x09-\x0D]``.
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])

if sys.platform == "linux":
    # glibc: keep freed buffers of up to 64 MB for reuse, rather than have the kernel clear new pages for every array
    with contextlib.suppress(AttributeError):
        ctypes.CDLL(None).mallopt(-3, 1 << 26)
        ctypes.CDLL(None).mallopt(-1, 1 << 26)


def release() -> None:
    """Gives freed memory back: idle Python workers live on beside those that work."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


class Block(NamedTuple):
    """Whole documents: ids, byte offsets (one more than documents) and the bytes."""

    ids: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def docs_at(self, positions: np.ndarray) -> np.ndarray:
        """Which document each byte position lies in."""
        return np.searchsorted(self.offsets, positions, "right") - 1


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id long, text string`` of a documents table; null texts become empty, rows without an id and other columns go."""
    return docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column."""
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def binary_column(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary column from byte offsets and the values in a row; as other Arrow columns, at most 2 GB."""
    if len(offsets) and offsets[-1] >= 2**31:
        raise ValueError("a block of results over 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def blocks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 21, most: int = 20_000) -> Iterator[Block]:
    """Documents of ``(doc_id, text)`` batches in blocks of about ``limit`` bytes and ``most`` documents, in their order."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        offsets, data = bytes_of(batch.column(1))
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            to = min(to, len(ids), at + most)
            # a view would hold the whole batch for as long as its reader holds the block
            yield Block(ids[at:to].copy(), offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]].copy())
            at = to
        del batch, ids, offsets, data
    release()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that their order is as good as random."""
    t = h >> U64(31)
    t ^= h
    t *= U64(0xBF58476D1CE4E5B9)
    u = t >> U64(29)
    t ^= u
    t *= U64(0x94D049BB133111EB)
    np.right_shift(t, U64(32), out=u)
    t ^= u
    return t


def byte_values(data: np.ndarray) -> np.ndarray:
    """A random 64-bit value for each byte value."""
    return _BYTE[data]


def rolling(values: np.ndarray, k: int, mul: np.uint64 = _MUL) -> np.ndarray:
    """Polynomial hashes of all ``k`` consecutive values, built by doubling: ``len(values) - k + 1`` of them."""
    if len(values) < k:
        return np.zeros(0, U64)
    total, width, have = None, 0, values
    step, power = 1, mul
    while True:
        if k & step:
            total = have[: len(values) - k + 1 + 0].copy() if total is None else _joined(total, width, have, power, len(values) - k + 1)
            width += step
        if step * 2 > k:
            return total
        have = have[:-step] * power + have[step:]
        step, power = step * 2, U64((int(power) * int(power)) % 2**64)


def _joined(left: np.ndarray, width: int, right: np.ndarray, power: np.uint64, n: int) -> np.ndarray:
    return left * power + right[width : width + n]


_POWERS = [np.ones(1, U64), np.ones(1, U64)]
_PREFIX_MUL = U64(0xD6E8FEB86659FD93)


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the prefix multiplier and of its inverse modulo 2^64, kept by the Python worker."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((int(_PREFIX_MUL), pow(int(_PREFIX_MUL), -1, 2**64))):
            steps = np.full(n, U64(base))
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


class Prefix:
    """Polynomial hashes of any stretch of values, from sums over their beginnings: for few stretches of many values."""

    def __init__(self, units: np.ndarray, value: Callable[[np.ndarray], np.ndarray], stretch: int = 1 << 17):
        """``value`` turns units into values, ``stretch`` units at a time."""
        n = len(units)
        powers, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        for lo in range(0, n, stretch):
            hi = min(lo + stretch, n)
            sums = np.cumsum(value(units[lo:hi]) * powers[lo:hi], out=self.sums[lo + 1 : hi + 1])
            sums += self.sums[lo]

    def hashes(self, start: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    have, width = values, 1
    while width * 2 <= w:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    rest = w - width
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


class Words(NamedTuple):
    """Words of a block: first byte, byte after the last, document, and number of words per document."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    counts: np.ndarray


def words_of(block: Block) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every document; a document's end also ends a word."""
    n, n_docs = len(block.data), len(block.ids)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACE[block.data]
    edges = np.zeros(n + 1, bool)
    edges[block.offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edges))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edges))
    doc = block.docs_at(start)
    return Words(start, end, doc, np.bincount(doc, minlength=n_docs))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; no span may be empty."""
    if not len(start):
        return np.zeros(0, U64)
    lengths = end - start
    first = np.cumsum(lengths) - lengths
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    at = place + np.repeat(start, lengths) if first[-1] != start[-1] else slice(0, len(place))
    parts = _BYTE[data[at]] * _PLACE[place & 0xFFFF]
    if lengths.max() > 0xFFFF:  # places repeat every 65,536 bytes and stretches every 4 GB, beyond any text
        parts *= _FAR_PLACE[place >> 16]
    return mix(np.add.reduceat(parts, first) + lengths.astype(U64) * _MUL)


def word_hashes(block: Block, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return span_hashes(block.data, words.start, words.end)


_HEAD = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], U64)


def heads(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span as a number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    return view[start] & _HEAD[np.minimum(end - start, 8)]


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths: the run each element belongs to, and its place in the run."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def covered_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as sorted disjoint intervals; touching ones are joined."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > reach[:-1]]
    return start[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]
