"""Pieces of text that byte-level BPE encodes independently of their neighbours.

The tokenizers' pattern starts a match at a space that stands between two characters that aren't white space, and
no match crosses it; a single newline between such characters is a match of its own. Cutting there, and only where
both neighbours are surely not white space, gives word-sized chunks whose encodings concatenate to that of the text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd

from lumenframe.llm.blocks import Block, heads, span_hashes

_B = np.arange(256)
#: Printable ASCII; lead bytes of 2-byte characters above U+00BF; of 3- and 4-byte characters outside U+1000-U+3FFF.
_SOLID_LEAD = ((_B > 32) & (_B < 127)) | ((_B >= 0xC3) & (_B <= 0xDF)) | ((_B >= 0xE4) & (_B <= 0xF4))
_TWO, _THREE = (_B >= 0xC3) & (_B <= 0xDF), (_B >= 0xE4) & (_B <= 0xEF)
_TRAIL = (_B >= 0x80) & (_B < 0xC0)


def chunk_bounds(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all chunks, with the end of the last one appended, and the number of chunks per document."""
    data, n = block.data, len(block.data)
    gap = np.flatnonzero((data == 32) | (data == 10))
    gap = gap[(gap > 0) & (gap < n - 1)]
    before, after = data[gap - 1], data[gap + 1]
    two_back, three_back = data[np.maximum(gap - 2, 0)], data[np.maximum(gap - 3, 0)]
    solid_before = ((before > 32) & (before < 127)) | (_TRAIL[before] & (_TWO[two_back] | (_TRAIL[two_back] & _THREE[three_back])))
    gap = gap[solid_before & _SOLID_LEAD[after]]
    starts = np.sort(np.concatenate([block.offsets[:-1], gap, gap[data[gap] == 10] + 1]))
    starts = starts[(np.diff(starts, append=n) > 0) & (starts < n)]
    counts = np.bincount(block.docs_at(starts), minlength=len(block.ids)) if n else np.zeros(len(block.ids), np.int64)
    return np.append(starts, n), counts


class Distinct(NamedTuple):
    """Distinct chunks of a block with their hashes and first bytes, the number of each chunk in turn, and chunks per document."""

    chunks: list[bytes]
    hashes: np.ndarray
    heads: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray


def distinct_chunks(block: Block) -> Distinct:
    """Numbers the distinct chunks of a block by hash; equal hashes must also agree in length and first bytes."""
    bounds, counts = chunk_bounds(block)
    start, end = bounds[:-1], bounds[1:]
    hashes = span_hashes(block.data, start, end)
    numbers, found = pd.factorize(hashes)
    first, head = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(numbers):
        top = np.maximum.accumulate(numbers)
        first = np.concatenate([[0], np.flatnonzero(top[1:] > top[:-1]) + 1])
        head = heads(block.data, start, end)
        same = (head[first][numbers] == head) & ((end - start)[first][numbers] == end - start)
        if not same.all():
            raise ValueError("two words of a block share a hash")
    raw = block.data.tobytes()
    return Distinct([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())], found, head[first], numbers, counts)
