"""Runs of windows that share an anchor, for finding repeated windows without handling each one.

A window is ``k`` consecutive units (words or bytes) of one document. Its anchor is the least of the hashes of its
``m``-unit grams, so equal windows have equal anchors wherever they stand. Consecutive windows with one anchor are a
run; two runs with the same anchor, first window and last window consist of the same windows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from lumenframe.llm.blocks import U64, mix, rolling, sliding_min

_LOW = U64(16)
_LOW_MASK = U64((1 << 16) - 1)
_A, _B = U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


class Runs(NamedTuple):
    """Anchor (48 bits) and where it stands, first window (both as block-wide unit indexes) and number of windows."""

    anchor: np.ndarray
    at: np.ndarray
    first: np.ndarray
    count: np.ndarray


def window_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive units, by another polynomial than the grams'."""
    return mix(rolling(units, k, _A))


def runs_of(units: np.ndarray, left: np.ndarray, k: int, m: int) -> Runs:
    """Runs of a block. ``left``: units from each one to its document's end."""
    none = Runs(np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3)
    if len(units) < k:
        return none
    grams = gram_hashes(units, m)
    # the lower bits hold the place, so that of equal grams the rightmost is taken
    place = np.arange(len(grams), dtype=U64)
    np.bitwise_and(place, _LOW_MASK, out=place)
    np.subtract(_LOW_MASK, place, out=place)
    grams |= _LOW_MASK
    grams ^= _LOW_MASK
    grams |= place
    w = k - m + 1
    low = sliding_min(grams, w)
    # where the 16-bit places start anew within a window, the rightmost of its least grams is sought by itself
    torn = np.arange(len(low))
    torn = torn[(torn & 0xFFFF) > 0x10000 - w]
    if len(torn):
        hashes = np.lib.stride_tricks.sliding_window_view(grams, w)[torn] >> _LOW
        best = w - 1 - np.argmin(hashes[:, ::-1], 1)
        low[torn] = grams[torn + best]
    at = np.flatnonzero(left[: len(low)] >= k)
    if not len(at):
        return none
    mine = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (at[1:] != at[:-1] + 1)
    start = np.flatnonzero(new)
    count = np.diff(start, append=len(at))
    first = at[start]
    stands = first + (((_LOW_MASK - (mine[start] & _LOW_MASK)).astype(np.int64) - first) & 0xFFFF)
    return Runs(mine[start] >> _LOW, stands, first, count)


def picked(runs: Runs, which: np.ndarray) -> Runs:
    return Runs(*[x[which] for x in runs])


def gram_hashes(units: np.ndarray, m: int) -> np.ndarray:
    """The hashes of which anchors are the least."""
    return mix(rolling(units, m))


def contents(runs: Runs, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each run's content, from those of its first and last window, which meet at least."""
    return mix(first * _B + last) + runs.count.astype(U64)


def to_ends(sizes: np.ndarray) -> np.ndarray:
    """Units from each one to its document's end, for documents of these sizes."""
    ends = np.cumsum(sizes)
    return np.repeat(ends, sizes) - np.arange(ends[-1] if len(ends) else 0)
