"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios.

Indicators say which byte trigrams and which one- to three-word runs of word shapes a text has (a shape tells capitals,
small letters, digits, other signs, length one and a repeat of the word before); they are hashed to ``DIM`` places.
The counts behind the log ratios come from all training rows, added up per task before the shuffle; the weights are
fitted by dual coordinate descent on a bounded sample of them (``max_rows``), and a logistic curve on their margins
gives the score.

Defined results: a null or empty text has no indicator and gets the score of the bias alone; rows without an id are
left out; repeated rows are scored each; labels without a document and null labels are not used; with no training
rows, or one class only, every score is that class's share (0.5 without rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.blocks import Block, binary_column, blocks, texts_of, word_hashes, words_of
from lumenframe.llm.scratch import kept

DIM = 1 << 15
MAX_ROWS, ROUNDS, COST, SMOOTHING = 8000, 12, 1.0, 1.0
THRESHOLD = 0.7
_BLOCK = {"limit": 1 << 20, "most": 600}
_B = np.arange(256)
#: Capitals; small letters and all bytes beyond ASCII; digits; other signs.
_KINDS = [(_B >= 65) & (_B <= 90), ((_B >= 97) & (_B <= 122)) | (_B >= 128), (_B >= 48) & (_B <= 57), ((_B > 32) & (_B < 48)) | ((_B > 57) & (_B < 65)) | ((_B > 90) & (_B < 97)) | ((_B > 122) & (_B < 127))]
_KIND_BITS = sum(np.where(kind, 1 << i, 0) for i, kind in enumerate(_KINDS)).astype(np.uint8)


def _place(codes: np.ndarray) -> np.ndarray:
    """Hashed place of an n-gram code."""
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64)


def indicators(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Document and place of every indicator that is set, sorted."""
    n_docs, data = len(block.ids), block.data
    on = np.zeros(n_docs * DIM, bool)
    if len(data) >= 3:
        sizes = np.diff(block.offsets)
        doc = np.repeat(np.arange(n_docs), sizes)
        wide = data.astype(np.uint64)
        grams = wide[:-2] | (wide[1:-1] << np.uint64(8)) | (wide[2:] << np.uint64(16))
        whole = doc[:-2] == doc[2:]
        on[(doc[:-2] * DIM + _place(grams))[whole]] = True
    words = words_of(block)
    if len(words.start):
        hashes = word_hashes(block, words)
        starts = np.stack([words.start, words.end], 1).ravel()
        shape = np.bitwise_or.reduceat(np.append(_KIND_BITS[data], 0).astype(np.uint8), starts)[::2].astype(np.uint64)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
        shape |= (again.astype(np.uint64) << np.uint64(4)) | ((words.end - words.start == 1).astype(np.uint64) << np.uint64(5)) | np.uint64(1 << 6)
        code = shape
        for n in range(1, 4):
            if n > 1:
                code = (code[:-1] << np.uint64(8)) | shape[n - 1 :]
            same = words.doc[: len(code)] == words.doc[n - 1 :]
            on[(words.doc[: len(code)] * DIM + _place(code + np.uint64(n << 40)))[same]] = True
    found = np.flatnonzero(on)
    return found // DIM, found % DIM


class Model(NamedTuple):
    """Weights by place, bias, and slope and offset of the score's logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, doc: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        counts = np.bincount(doc, minlength=n)[:n]
        margin = np.bincount(doc, self.weights[place], minlength=n)[:n] / np.sqrt(np.maximum(counts, 1)) + self.bias
        return 1 / (1 + np.exp(-(self.slope * margin + self.offset)))


def is_held_out(doc_id: Column) -> Column:
    """Rows kept from all learning: ``crc32`` of the id as text leaves 2 when divided by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(ratio: np.ndarray, rows: list[tuple[np.ndarray, int]]) -> Model:
    """Dual coordinate descent for the hinge loss over indicator vectors scaled by ``ratio``."""
    y = np.array([1.0 if label == 1 else -1.0 for _, label in rows])
    if len(rows) == 0 or len(set(y)) < 2:
        share = 0.5 if len(rows) == 0 else float(y[0] > 0)
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(DIM), 0.0, 1.0, float(np.log(share / (1 - share))))
    # the driver holds two bytes a place; a text's vector is made when it is asked for
    vector = lambda f: ratio[f] / np.sqrt(max(len(f), 1))
    limit = np.where(y > 0, COST, COST * np.sqrt((y > 0).sum() / (y < 0).sum()))
    norm = np.array([(x := vector(f)) @ x + 1.0 for f, _ in rows])
    w, bias, alpha = np.zeros(DIM), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(ROUNDS):
        for i in rng.permutation(len(rows)).tolist():
            f = rows[i][0]
            x = vector(f)
            slack = y[i] * (w[f] @ x + bias) - 1
            new = min(max(alpha[i] - slack / norm[i], 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * x
                bias += step
                alpha[i] = new
    margin = np.array([w[f] @ vector(f) for f, _ in rows]) + bias
    slope, offset = _logistic(margin, y)
    return Model(w * ratio, float(bias), slope, offset)


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins, by Newton steps with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-6)
        m = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(m, [(g * margin).sum(), g.sum()])
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
    return a, b


def _packed_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id`` and the places of a text's indicators, two bytes each."""
    for block in blocks(batches, **_BLOCK):
        doc, place = indicators(block)
        ends = np.searchsorted(doc, np.arange(len(block.ids) + 1)) * 2
        yield pa.RecordBatch.from_arrays([pa.array(block.ids), binary_column(ends, place.astype(np.uint16).view(np.uint8))], names=["doc_id", "places"])


_LEARNED = "place int, zeros long, ones long, label int, found binary"


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learns from the labelled documents that are not held out."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~is_held_out(F.col("doc_id").cast("long")))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    share = min(1.0, max_rows / max(marks.count(), 1))
    # the sample is drawn by hash, so it is the same in every run
    marks = marks.withColumn("drawn", F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))
    # places, not texts, meet the labels, and by the same kind of join at any size
    packed = texts_of(docs).filter(~is_held_out(F.col("doc_id"))).mapInArrow(_packed_places, "doc_id long, places binary")
    rows = packed.join(marks.hint("merge"), "doc_id").select("places", "label", "drawn")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, DIM), np.int64)
        for batch in batches:
            places, label, drawn = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                found = b"".join(places.filter(pa.array(label == k)).to_pylist())
                totals[k] += np.bincount(np.frombuffer(found, np.uint16), minlength=DIM)
            some = pa.array(np.flatnonzero(drawn))
            none = pa.nulls(len(some))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(label, pa.int32()).take(some), places.take(some)], names=["place", "zeros", "ones", "label", "found"])
        used = np.flatnonzero(totals.any(0))
        none = pa.nulls(len(used))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(totals[0][used]), pa.array(totals[1][used]), none.cast(pa.int32()), none.cast(pa.binary())], names=["place", "zeros", "ones", "label", "found"])

    learned = kept(rows.mapInArrow(count, _LEARNED), "indicators")
    # at most DIM rows of sums, and the sample of about max_rows documents
    sums = learned.filter("place is not null").groupBy("place").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).collect()
    counts = np.full((2, DIM), SMOOTHING)
    for r in sums:
        counts[:, r.place] += r.zeros, r.ones
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    return fit(ratio, _sorted_sample(learned.filter("place is null").select("label", "found").toArrow().combine_chunks()))


def _sorted_sample(found: pa.Table) -> list[tuple[np.ndarray, int]]:
    """Places and label of the sampled texts, views of one buffer, by label, number of places and places."""
    label, places = found["label"].to_pylist(), found["found"]
    views = [np.frombuffer(v.as_buffer(), np.uint16) for v in places]
    order = sorted(range(len(label)), key=lambda i: (label[i], len(views[i]), views[i].tobytes()))
    return [(views[i], label[i]) for i in order]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, **_BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(model.scores(*indicators(block), len(block.ids)))], names=["doc_id", "score"])

    scored = texts_of(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model predicts to be of quality 1, with their columns."""

    @F.arrow_udf("double")
    def score_of(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(text))), text.fill_null("")], names=["doc_id", "text"])
        parts = [model.scores(*indicators(block), len(block.ids)) for block in blocks([batch], **_BLOCK)]
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    return docs.filter(F.col("doc_id").isNotNull()).filter(score_of(F.col("text")) >= THRESHOLD)
