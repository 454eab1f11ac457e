"""Repeated word spans by compaction of a de Bruijn graph of word k-mers.

Every window of ``WINDOW`` words is an edge between its first and last ``WINDOW - 1`` words. Edges are grouped by
their anchor (see ``anchors``): a run of consecutive edges with one anchor is a stretch of a path. Where all
occurrences of an anchor have the same content, the stretch has no branch: all its edges occur at the same places,
and it stays one row. Joins keep the anchors that occur in two documents at least; only stretches that branch there are
opened into single edges, which are grouped by hash again. Edges are named by anchor and window hash together (112
bits); a stretch by anchor and by the hashes of its first and last window, which overlap or meet and so fix all words
between.

Counting is by grouped minima that are combined before the shuffle; what is joined back to them is keyed by anchor
with one row on the grouped side, so a passage that a third of all documents share is split among tasks.

Defined results: a null or empty text has no words; texts of fewer than ``WINDOW`` words lose nothing; repeats within
one document alone, or between rows of one id, are no repeats; rows without an id are left out; rows of one id are
judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.anchors import contents, runs_of, to_ends, window_hashes
from lumenframe.llm.blocks import Block, binary_column, blocks, spread, texts_of, word_hashes, words_of
from lumenframe.llm.scratch import kept

WINDOW, GRAM = 50, 12


def _prepared(block: Block):
    words = words_of(block)
    units = word_hashes(block, words)
    return words, units, np.cumsum(words.counts) - words.counts, window_hashes(units, WINDOW)


def stretches(texts: DataFrame) -> DataFrame:
    """``anchor, content, doc_id, first, n``: stretches of edges with one anchor, ``first`` counted in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words, units, begin, windows = _prepared(block)
            found = runs_of(units, to_ends(words.counts), WINDOW, GRAM)
            doc = words.doc[found.first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.anchor.view(np.int64)), pa.array(contents(found, windows[found.first], windows[found.first + found.count - 1]).view(np.int64)), pa.array(block.ids[doc]), pa.array((found.first - begin[doc]).astype(np.int32)), pa.array(found.count.astype(np.int32))],
                names=["anchor", "content", "doc_id", "first", "n"],
            )

    return texts.mapInArrow(run, "anchor long, content long, doc_id long, first int, n int")


def edges(marked: DataFrame) -> DataFrame:
    """``anchor, edge, doc_id, first``: the single edges of ``doc_id, text, marks`` (stretches to open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, values = _lists(batch.column(2))
            at = 0
            for block in blocks([batch.select([0, 1])]):
                words, _, begin, windows = _prepared(block)
                lo, hi = ends[at], ends[at + len(block.ids)]
                doc = np.repeat(np.arange(len(block.ids)), np.diff(ends[at : at + len(block.ids) + 1]))
                anchor, first, n = (values.field(i).to_numpy()[lo:hi] for i in range(3))
                at += len(block.ids)
                which, step = spread(n)
                place = first[which] + step
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[which]), pa.array(windows[begin[doc[which]] + place].view(np.int64)), pa.array(block.ids[doc[which]]), pa.array(place.astype(np.int32))],
                    names=["anchor", "edge", "doc_id", "first"],
                )

    return marked.mapInArrow(run, "anchor long, edge long, doc_id long, first int")


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Offsets and values of a list column without nulls in its lists; null lists are empty."""
    column = pa.concat_arrays([column])
    sizes = np.nan_to_num(np.asarray(column.value_lengths().fill_null(0)))
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), column.flatten()


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, first, n, source``: ``n`` windows from word ``first`` on that also start in ``source``, the least such id."""
    texts = texts_of(docs)
    rows = stretches(texts)
    shared = rows.groupBy("anchor").agg(
        F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min("content").alias("c0"), F.max("content").alias("c1")
    ).filter("source < last").select("anchor", "source", (F.col("c0") == F.col("c1")).alias("plain"))
    live = kept(rows.join(shared, "anchor"), "stretches")
    plain = live.filter("plain and source < doc_id").select("doc_id", "first", "n", "source")
    marks = live.filter("not plain").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "first", "n")).alias("marks"))
    single = kept(edges(texts.join(marks, "doc_id").select("doc_id", "text", "marks")), "edges")
    twice = single.groupBy("anchor", "edge").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).filter("source < last").select("anchor", "edge", "source")
    opened = single.join(twice, ["anchor", "edge"]).filter("source < doc_id").select("doc_id", "first", F.lit(1).alias("n"), "source")
    return plain.unionByName(opened)


def cleaned(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every document: its words outside repeats, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, values = _lists(batch.column(2))
            at = 0
            for block in blocks([batch.select([0, 1])]):
                words = words_of(block)
                n = len(block.ids)
                begin = np.cumsum(words.counts) - words.counts
                lo, hi = ends[at], ends[at + n]
                doc = np.repeat(np.arange(n), np.diff(ends[at : at + n + 1]))
                first, count = (values.field(i).to_numpy()[lo:hi] for i in range(2))
                at += n
                depth = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(depth, begin[doc] + first, 1)
                np.add.at(depth, begin[doc] + first + count + WINDOW - 1, -1)
                keep = np.cumsum(depth)[:-1] == 0
                start, own = words.start[keep], words.doc[keep]
                sizes = words.end[keep] - start + 1  # with the space after each word
                last = np.ones(len(own), bool)
                last[:-1] = own[1:] != own[:-1]
                sizes[last] -= 1
                which, step = spread(sizes)
                source = start[which] + step
                raw = np.where(step < (words.end[keep] - start)[which], block.data[np.minimum(source, max(len(block.data) - 1, 0))], 32).astype(np.uint8) if len(source) else np.zeros(0, np.uint8)
                total = np.concatenate([[0], np.cumsum(np.bincount(own, sizes, n))]).astype(np.int64)
                removed = words.counts - np.bincount(own, minlength=n)[:n]
                yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), binary_column(total, raw).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    texts = texts_of(docs)
    marks = repeats(docs).groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("marks"))
    return texts.join(marks, "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
