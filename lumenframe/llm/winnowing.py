"""Document fingerprints by winnowing: rolling k-gram hashes, the least of every window kept with its position.

The hash of every ``k`` consecutive code points is taken; of each ``w`` consecutive hashes the least is kept, the
rightmost of equal ones. Two texts that share ``k + w - 1`` code points in a row therefore share a kept hash, and kept
positions are at most ``w`` apart. A text shorter than ``k`` has one hash, of the whole text; a text with fewer than
``w`` grams is one window; an empty text has no hash.

Defined results: null texts are empty; rows without an id are left out; documents of one id follow each other in
descending order of text; an empty table gives no rows; a single document is its own next. Two empty fingerprints
are alike (1), an empty and another are not (0).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.blocks import U64, blocks, mix, rolling, sliding_min, spread, texts_of
from lumenframe.llm.scratch import partitions

#: Short enough that a text of 23 code points whose last third is replaced still shares a kept hash with it.
K, W = 8, 8
_PLACE_BITS = U64(24)
_PLACE_MASK = U64((1 << 24) - 1)
_NONE = U64(2**64 - 1)


class Prints(NamedTuple):
    """Kept hashes (40 bits) of a block in order: document, hash, position in code points."""

    doc: np.ndarray
    hash: np.ndarray
    position: np.ndarray


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the documents' offsets among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, ends[offsets]


def winnow(points: np.ndarray, offsets: np.ndarray, k: int = K, w: int = W, longest: int = 1 << 23) -> Prints:
    """Fingerprints of all documents of a block; windows of a text over ``longest`` code points are taken in stretches."""
    sizes = np.diff(offsets)
    if not len(sizes) or sizes.max() <= longest:
        return _winnowed(points, offsets, k, w)
    doc, step = spread(np.maximum(-(-(sizes - (w + k - 2)) // longest), 1))
    start = offsets[:-1][doc] + step * longest
    stop = np.minimum(start + longest + w + k - 2, offsets[1:][doc])
    found = _winnowed(np.concatenate([points[a:b] for a, b in zip(start, stop, strict=True)]), np.concatenate([[0], np.cumsum(stop - start)]), k, w)
    doc, position = doc[found.doc], found.position + (step * longest)[found.doc]
    new = np.ones(len(doc), bool)  # the last window of a stretch and the first of the next may keep the same gram
    new[1:] = (doc[1:] != doc[:-1]) | (position[1:] != position[:-1])
    return Prints(doc[new], found.hash[new], position[new])


def _winnowed(points: np.ndarray, offsets: np.ndarray, k: int, w: int) -> Prints:
    n, sizes = len(points), np.diff(offsets)
    values = mix(points.astype(U64) + U64(1))
    place = np.arange(n) - np.repeat(offsets[:-1], sizes)
    left = np.repeat(sizes, sizes) - place  # code points from here to the document's end
    grams = np.full(n, _NONE)
    if n >= k:
        grams[: n - k + 1] = mix(rolling(values, k))
    key = (grams & ~_PLACE_MASK) | (_PLACE_MASK - (place.astype(U64) & _PLACE_MASK))
    key[left < k] = _NONE
    parts = []
    if n >= w:  # documents of one window at least
        low = sliding_min(key, w)
        at = np.flatnonzero(left[: len(low)] >= w + k - 1)
        new = np.ones(len(at), bool)
        new[1:] = (low[at[1:]] != low[at[:-1]]) | (place[at[1:]] == 0)
        at = at[new]
        parts.append((np.searchsorted(offsets, at, "right") - 1, low[at]))
    few = np.flatnonzero((sizes > 0) & (sizes < w + k - 1))
    if len(few):
        lengths = np.maximum(sizes[few] - k + 1, 1)
        run, step = spread(lengths)
        short = key[offsets[few][run] + step]
        tiny = np.flatnonzero(sizes[few] < k)
        if len(tiny):
            # shorter than a gram: the polynomial of the whole text, with its length
            which, step_ = spread(sizes[few][tiny])
            scaled = values[offsets[few][tiny][which] + step_] * mix(step_.astype(U64) + U64(7))
            whole = mix(np.add.reduceat(scaled, np.cumsum(sizes[few][tiny]) - sizes[few][tiny]) + sizes[few][tiny].astype(U64))
            short[(np.cumsum(lengths) - lengths)[tiny]] = (whole & ~_PLACE_MASK) | _PLACE_MASK
        parts.append((few, np.minimum.reduceat(short, np.cumsum(lengths) - lengths)))
    doc = np.concatenate([d for d, _ in parts]) if parts else np.zeros(0, np.int64)
    low = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, U64)
    order = np.argsort(doc, kind="stable")
    return Prints(doc[order], (low >> _PLACE_BITS)[order], (_PLACE_MASK - (low & _PLACE_MASK)).astype(np.int64)[order])


def distinct(prints: Prints) -> tuple[np.ndarray, np.ndarray]:
    """Documents and their distinct hashes, sorted."""
    order = np.lexsort((prints.hash, prints.doc))
    doc, h = prints.doc[order], prints.hash[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Dice coefficient of two fingerprints for each of ``n`` documents."""
    doc, h = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    same = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
    both, total = np.bincount(doc[1:][same], minlength=n)[:n], np.bincount(doc, minlength=n)[:n]
    return np.where(total > 0, 2 * both / np.maximum(total, 1), 1.0)


def as_text(docs: np.ndarray, hashes: np.ndarray, n: int) -> list[str]:
    """Each document's distinct hashes, five bytes each, in base64."""
    raw = np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()
    ends = np.searchsorted(docs, np.arange(n + 1)) * 5
    return [base64.b64encode(raw[a:b]).decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """``doc_id, hashes array<long>, positions array<long>``: the kept grams of every text, in text order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            points, offsets = code_points(block.data, block.offsets)
            found = winnow(points, offsets, k, w)
            ends = pa.array(np.searchsorted(found.doc, np.arange(len(block.ids) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (found.hash, found.position)]
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), *lists], names=["doc_id", "hashes", "positions"])

    return texts_of(docs).mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_prints long, widest_gap long"


def _compared(ids: np.ndarray, points: np.ndarray, offsets: np.ndarray, next_of: np.ndarray) -> pa.RecordBatch:
    """Results for the first ``len(ids)`` documents of a block, of which ``next_of`` names each one's next."""
    n, sizes = len(ids), np.diff(offsets)
    own = sizes[:n]
    keep, take = own - own // 3, np.minimum(own // 3, sizes[next_of])
    run, place = spread(np.stack([keep, take], 1).ravel())
    starts = np.stack([offsets[:n], offsets[next_of]], 1).ravel()
    edited = points[starts[run] + place]
    ends = np.concatenate([[0], np.cumsum(keep + take)])
    found, found_edited = winnow(points, offsets), winnow(edited, ends)
    mine, changed = distinct(found), distinct(found_edited)
    after_at = np.searchsorted(mine[0], np.arange(len(sizes) + 1))
    which, step = spread(np.diff(after_at)[next_of])
    following = (which, mine[1][after_at[next_of][which] + step])
    only = mine[0] < n
    mine = (mine[0][only], mine[1][only])
    raw = edited.astype("<u4").tobytes()
    shas = [hashlib.sha256(raw[a * 4 : b * 4].decode("utf-32-le").encode()).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    gaps = np.zeros(len(sizes), np.int64)
    same = found.doc[1:] == found.doc[:-1]
    np.maximum.at(gaps, found.doc[1:][same], (found.position[1:] - found.position[:-1])[same])
    columns = [ids, own.astype(np.int64), shas, as_text(*mine, n), as_text(*changed, n), likeness(mine, changed, n), likeness(mine, following, n), np.bincount(found.doc, minlength=n)[:n].astype(np.int64), gaps[:n]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _OUT.split(", ")])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint against that of its edited text and of its next document (descending ``doc_id``).

    Documents are dealt by ranges of ids, so a document's next one is the next row of its range; only the last of
    each range has it elsewhere. Those few pairs, two documents per range, are worked out apart.
    """
    spark = docs.sparkSession
    texts = texts_of(docs)
    n = partitions(spark)
    bounds = np.unique(texts.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else [])

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), "right").astype(np.int32))

    placed = texts.withColumn("part", range_of("doc_id"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last document so far, whose next is the first of the next block
        for batch in batches:
            parts, at = batch.column(2).to_numpy(), 0
            for block in blocks([batch]):
                own = parts[at : at + len(block.ids)]
                at += len(own)
                ids, data, offsets = block.ids, block.data, block.offsets
                if held is not None:
                    ids, own = np.append(held[0], ids), np.append(held[1], own)
                    data, offsets = np.concatenate([held[2], data]), np.concatenate([[0], offsets + len(held[2])])
                held = (ids[-1:], own[-1:], data[offsets[-2] : offsets[-1]])
                points, ends = code_points(data, offsets)
                inner = np.flatnonzero(own[1:] == own[:-1])
                if len(inner):
                    # documents that end a range are seen as next ones only
                    result = _compared(ids[:-1], points, ends, np.arange(1, len(ids)))
                    yield result if len(inner) == len(ids) - 1 else result.take(pa.array(inner))

    inside = placed.repartitionByRange(n, "part").sortWithinPartitions("part", F.desc("doc_id"), F.desc("text")).mapInArrow(within, _OUT)

    # the lowest and highest id of each range: two numbers a range
    ends = sorted(texts.select("doc_id", range_of("doc_id").alias("part")).groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect())
    pairs = [(r.low, ends[i - 1].high) for i, r in enumerate(ends)]
    near = spark.createDataFrame(pairs, "low long, high long")
    wanted = spark.createDataFrame([(x,) for x in {i for p in pairs for i in p}], "doc_id long")
    edge = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    joined = near.join(edge.select(F.col("doc_id").alias("low"), F.col("least").alias("text")), "low").join(edge.select(F.col("doc_id").alias("high"), F.col("most").alias("after")), "high")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, after in zip(*(batch.column(i).to_pylist() for i in range(3))):
                points = np.frombuffer((text + after).encode("utf-32-le"), np.uint32)
                yield _compared(np.array([doc_id]), points, np.array([0, len(text), len(points)]), np.array([1]))

    return inside.unionByName(joined.select("low", "text", "after").mapInArrow(across, _OUT))
