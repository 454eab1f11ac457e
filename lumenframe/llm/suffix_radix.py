"""Removal of repeated byte strings by a depth-limited radix sort of suffixes, most significant digit first.

Only the first ``DEPTH`` bytes of suffixes are ordered; groups of equal ones are the repeated windows. A window's
digits are taken from its anchor outwards (see ``anchors``), so that equal windows have equal digits in one order, and
consecutive windows with one anchor go through the passes as one run:

1. the ``GRAM`` bytes at the anchor: suffixes whose digit one document alone holds are done;
2. the whole content of the run: where an earlier document has the same, all its windows are repeated. With it, the
   next ``GRAM`` bytes before and after the anchor: a window reaches that far on one side at least, so the other runs
   go on with those halves only that two documents share;
3. the single window, for those halves.

A pass is one question, "who holds this digit first?", asked in packed form: a block of documents sends its distinct
digits, sorted, with their least document, to buckets by range of digits; a bucket sorts what it gets and answers each
block with one byte a digit, in the same order. So a passage that many documents share is one entry per block.
Texts are written once, compressed, a block per row, bucketed by block, so that answers meet them without moving
them. Contents and windows are named by 96 bits, of hash and anchor.

Defined results: a null or empty text has no bytes; texts of fewer than ``DEPTH`` bytes lose nothing; repeats within
one document alone, or between rows of one id, are no repeats; rows without an id are left out; an empty table gives
no rows. What is left of a text need not be valid UTF-8 and is returned as bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.anchors import Runs, contents, picked, runs_of, to_ends
from lumenframe.llm.blocks import U64, Block, Prefix, binary_column, blocks, byte_values, mix, release, spread, texts_of
from lumenframe.llm.scratch import kept, new_folder, partitions

DEPTH, GRAM, PASSES = 50, 16, 3
BLOCK_BYTES = 1 << 20
#: Bytes whose windows are hashed at a time: the arrays of that are a worker's largest.
STRETCH_BYTES = 1 << 17
#: Blocks whose digits one bucket answers: the memory of a Python worker follows this number.
BUCKET_BLOCKS = 8
#: Answers: two documents hold the digit; a document before the block's first holds it.
SHARED, EARLIER = 1, 2
_LOW32 = U64(0xFFFFFFFF)
_EVEN = U64(0x9E3779B97F4A7C15)


def packed_texts(texts: DataFrame, n_buckets: int) -> DataFrame:
    """``block, payload``: one row per block of documents, as a table bucketed by block in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for block in blocks(batches, BLOCK_BYTES):
            raw = np.array([len(block.ids)], np.int64).tobytes() + block.ids.astype(np.int64).tobytes() + block.offsets.astype(np.int64).tobytes() + block.data.tobytes()
            # the number only tells blocks apart; whole blocks that repeat share it and are handled together
            yield pa.record_batch([pa.array([xxhash.xxh3_64_intdigest(raw) - 2**63], pa.int64()), pa.array([pack(raw)], pa.binary())], names=["block", "payload"])

    spark, name = texts.sparkSession, f"texts_{uuid.uuid4().hex}"
    rows = texts.mapInArrow(run, "block long, payload binary")
    rows.write.bucketBy(n_buckets, "block").option("path", new_folder(spark, "texts")).option("compression", "uncompressed").saveAsTable(name)
    return spark.table(name)


def _unpacked(payload: bytes) -> Block:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return Block(np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n + 1, 8 + 8 * n), np.frombuffer(raw, np.uint8, offset=16 + 16 * n))


class Question(NamedTuple):
    """Distinct digits of a block in order, their checks, least documents, whether two documents hold one, and which digit each item has."""

    digits: np.ndarray
    checks: np.ndarray
    least: np.ndarray
    shared: np.ndarray
    of: np.ndarray
    docs: np.ndarray

    def earlier(self, answer: np.ndarray) -> np.ndarray:
        """Items whose digit a document before theirs holds."""
        return ((answer[self.of] & EARLIER) > 0) | (self.least[self.of] < self.docs)

    def held_by_two(self, answer: np.ndarray) -> np.ndarray:
        return ((answer[self.of] & SHARED) > 0) | self.shared[self.of]


def question(digits: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> Question:
    order = np.argsort(digits, kind="stable")
    d, c, ids = digits[order], checks[order], docs[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(new)
    of = np.empty(len(d), np.int64)
    of[order] = np.cumsum(new) - 1
    low, high = (f.reduceat(ids, at) if len(at) else ids for f in (np.minimum, np.maximum))
    return Question(d[at], c[at], low, low < high, of, docs)


def _planes(values: np.ndarray) -> bytes:
    """Values as planes of bytes: constant high bytes and random low ones compress apart."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _unplanes(raw: bytes, dtype, n: int, at: int) -> tuple[np.ndarray, int]:
    size = np.dtype(dtype).itemsize
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(dtype).ravel()
    return values, at + n * size


_ASKED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("payload", pa.binary())])
_ASKED_SQL = "block long, bucket int, n int, payload binary"


def _asked(block_key: int, q: Question, n_buckets: int, with_docs: bool) -> pa.Table:
    """The question's digits by bucket; buckets are equal ranges of digits."""
    pack = zstandard.ZstdCompressor(level=1).compress
    bucket = ((q.digits >> U64(32)) * U64(n_buckets)) >> U64(32)
    ends = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=U64)).tolist()
    rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])) if hi > lo]
    least = q.least if with_docs else np.zeros(len(q.digits), np.int64)
    payload = [
        pack(_planes(np.diff(q.digits[lo:hi], prepend=U64(0))) + _planes(q.checks[lo:hi].astype(np.uint32)) + _planes(least[lo:hi]) + q.shared[lo:hi].tobytes())
        for _, lo, hi in rows
    ]
    return pa.table([pa.array([block_key] * len(rows), pa.int64()), pa.array([b for b, _, _ in rows], pa.int32()), pa.array([hi - lo for _, lo, hi in rows], pa.int32()), pa.array(payload, pa.binary())], schema=_ASKED)


def _answered(group: pa.Table) -> pa.Table:
    """One byte for every digit that a bucket was asked for."""
    pack, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    parts, sizes = [], group.column("n").to_pylist()
    for n, payload in zip(sizes, group.column("payload").to_pylist()):
        raw, at = unpack(payload), 0
        steps, at = _unplanes(raw, U64, n, at)
        checks, at = _unplanes(raw, np.uint32, n, at)
        least, at = _unplanes(raw, np.int64, n, at)
        parts.append((np.cumsum(steps), checks, least, np.frombuffer(raw, bool, n, at)))
    digits, checks, least, shared = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((checks, digits))
    d, c = digits[order], checks[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
    at, of = np.flatnonzero(new), np.cumsum(new) - 1
    many = (np.diff(at, append=len(d)) > 1) | np.logical_or.reduceat(shared[order], at)
    code = np.empty(len(d), np.uint8)
    code[order] = many[of] * SHARED + (least[order] > np.minimum.reduceat(least[order], at)[of]) * EARLIER
    ends = np.cumsum(sizes)
    out = [pack(code[hi - n : hi].tobytes()) for hi, n in zip(ends.tolist(), sizes)]
    del digits, checks, least, shared, order, d, c, new, at, of, many, code
    release()
    return pa.table([group.column("block"), group.column("bucket"), group.column("n"), pa.array(out, pa.binary())], schema=_ASKED)


def _runs(block: Block) -> Runs:
    """Runs of the block's windows, taken from about ``STRETCH_BYTES`` of whole documents at a time."""
    cuts = np.unique(np.r_[np.searchsorted(block.offsets, np.arange(0, len(block.data), STRETCH_BYTES)), len(block.ids)])
    parts = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        lo, hi = block.offsets[a], block.offsets[b]
        runs = runs_of(byte_values(block.data[lo:hi]), to_ends(np.diff(block.offsets[a : b + 1])), DEPTH, GRAM)
        parts.append(Runs(runs.anchor, runs.at + lo, runs.first + lo, runs.count))
    return Runs(*[np.concatenate(x) for x in zip(*parts)]) if parts else runs_of(byte_values(block.data), block.data, DEPTH, GRAM)


def _judged(block: Block, answers: dict[int, np.ndarray]) -> Question | tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next question that the answers so far lead to; after the last, the repeated windows.

    These are documents (by place), first window (by byte of the block) and number of windows.
    """
    runs = _runs(block)
    d = block.docs_at(runs.first)
    # anchors are 48 bits and, as least hashes, mostly small; times an odd number they fall evenly on ranges
    q = question((runs.anchor << U64(16)) * _EVEN, np.zeros(len(d), U64), block.ids[d])
    if 1 not in answers:
        return q
    go = np.flatnonzero(q.held_by_two(answers[1]))
    runs, d = picked(runs, go), d[go]
    ids, check = block.ids[d], runs.anchor & _LOW32
    prefix = Prefix(block.data, byte_values)
    reach = np.clip(runs.at - runs.first - GRAM + 1, 0, runs.count)  # windows that reach far enough before the anchor
    before, after = np.flatnonzero(reach > 0), np.flatnonzero(reach < runs.count)
    whole = contents(runs, prefix.hashes(runs.first, DEPTH), prefix.hashes(runs.first + runs.count - 1, DEPTH))
    digits = [whole, prefix.hashes(runs.at[before] - GRAM, GRAM) + U64(1), prefix.hashes(runs.at[after] + GRAM, GRAM) + U64(2)]
    anchored = [mix(x + a) for x, a in zip(digits, (runs.anchor, runs.anchor[before], runs.anchor[after]))]
    q = question(np.concatenate(anchored), np.concatenate([check, check[before], check[after]]), np.concatenate([ids, ids[before], ids[after]]))
    if 2 not in answers:
        return q
    lost = q.earlier(answers[2])[: len(go)]
    two = q.held_by_two(answers[2])
    open_before, open_after = ~lost[before] & two[len(go) : len(go) + len(before)], ~lost[after] & two[len(go) + len(before) :]
    before, after = before[open_before], after[open_after]
    run = np.concatenate([before, after])
    first = np.concatenate([runs.first[before], (runs.first + reach)[after]])
    which, step = spread(np.concatenate([reach[before], (runs.count - reach)[after]]))
    place, of = first[which] + step, run[which]
    q = question(mix(prefix.hashes(place, DEPTH) + runs.anchor[of]), check[of], ids[of])
    if 3 not in answers:
        return q
    single = q.earlier(answers[3])
    return np.concatenate([d[lost], d[of][single]]), np.concatenate([runs.first[lost], place[single]]), np.concatenate([runs.count[lost], np.ones(int(single.sum()), np.int64)])


def _answers(rows: pa.Table) -> dict[int, np.ndarray]:
    """Answers by pass, in the order of the question."""
    out: dict[int, dict[int, bytes]] = {}
    for step, bucket, payload in zip(*(rows.column(c).to_pylist() for c in ("pass", "bucket", "payload"))):
        out.setdefault(step, {})[bucket] = zstandard.ZstdDecompressor().decompress(payload)
    return {step: np.frombuffer(b"".join(parts[b] for b in sorted(parts)), np.uint8) for step, parts in out.items()}


def _next_question(step: int, n_buckets: int):
    def run(texts: pa.Table, rows: pa.Table) -> pa.Table:
        known = _answers(rows)
        # a pass without any digit of this block has no answer
        known |= {i: np.zeros(0, np.uint8) for i in range(1, step) if i not in known}
        out = [_ASKED.empty_table()]
        for key, payload in zip(texts.column("block").to_pylist(), texts.column("payload").to_pylist()):
            out.append(_asked(key, _judged(_unpacked(payload), known), n_buckets, step > 1))
        release()
        return pa.concat_tables(out)

    return run


_CLEAN = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, text_md5 string"
_READABLE = "doc_id long, n_removed long, rest string, text_md5 string"


def _cut_out(readable: bool):
    """Every document of a block without its repeated windows: as bytes, or as text without characters of which a cut left only a part."""

    def run(texts: pa.Table, rows: pa.Table) -> pa.Table:
        known = _answers(rows)
        known |= {i: np.zeros(0, np.uint8) for i in range(1, PASSES + 1) if i not in known}
        out = []
        for payload in texts.column("payload").to_pylist():
            block = _unpacked(payload)
            _, first, n = _judged(block, known)
            depth = np.zeros(len(block.data) + 1, np.int32)
            np.add.at(depth, first, 1)
            np.add.at(depth, first + n + DEPTH - 1, -1)
            gone = np.cumsum(depth)[:-1] > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            at = block.offsets[:-1][np.diff(block.offsets) > 0]
            begins[at] = gone[at]
            total = np.concatenate([[0], np.cumsum(gone)])[block.offsets]
            spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[block.offsets])
            sizes, removed = np.diff(block.offsets), np.diff(total)
            ends, left = np.concatenate([[0], np.cumsum(sizes - removed)]), block.data[~gone]
            digests = [hashlib.md5(block.text(i)).hexdigest() for i in range(len(sizes))]
            if readable:
                rest = [left[lo:hi].tobytes().decode("utf-8", "ignore") for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())]
                out.append(pa.table({"doc_id": block.ids, "n_removed": removed, "rest": pa.array(rest, pa.string()), "text_md5": pa.array(digests, pa.string())}))
            else:
                out.append(pa.table({"doc_id": block.ids, "n_bytes": sizes, "n_removed": removed, "n_spans": spans, "kept": binary_column(ends, left), "text_md5": digests}))
            del first, n, depth, gone, begins, total, left
            release()
        return pa.concat_tables(out)

    return run


def cleaned(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every document."""
    return _cut(docs, _cut_out(False), _CLEAN)


def _cut(docs: DataFrame, cut_out, columns: str) -> DataFrame:
    n = partitions(docs.sparkSession)
    texts = packed_texts(texts_of(docs), n)
    # a bucket holds the digits of so many blocks, however many blocks and shuffle partitions there are
    n = max(n, -(-texts.count() // BUCKET_BLOCKS))
    answers = docs.sparkSession.createDataFrame([], f"pass int, {_ASKED_SQL}")
    for step in range(1, PASSES + 1):
        asked = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_next_question(step, n), _ASKED_SQL)
        found = asked.groupBy("bucket").applyInArrow(_answered, _ASKED_SQL)
        answers = answers.unionByName(kept(found.select(F.lit(step).alias("pass"), "*"), f"pass-{step}"))
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut_out, columns)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their columns, repeated strings cut out of ``text`` and ``n_chars`` (if there) counted anew.

    A document of which nothing but white space is left goes; texts that lose nothing stay as they are, nulls too.
    Rows of one id each get the cut of their own text, equal rows stay as many as they are.
    """
    found = _cut(docs, _cut_out(True), _READABLE).withColumnRenamed("rest", "_text").dropDuplicates(["doc_id", "text_md5"])
    whole = F.coalesce(F.col("text"), F.lit(""))
    rest = docs.select(F.col("doc_id").cast("long").alias("_id"), F.md5(whole).alias("_md5"), F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), F.col("text").isNull().alias("_null"))
    both = found.join(rest, (F.col("doc_id") == F.col("_id")) & (F.col("text_md5") == F.col("_md5"))).filter((F.col("n_removed") == 0) | (F.trim("_text") != ""))
    text = F.when(~F.col("_null"), F.col("_text"))
    counted = lambda c: F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"_row.{c}")
    return both.select(*[text.alias("text") if c == "text" else counted(c) for c in docs.columns])
