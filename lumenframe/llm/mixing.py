"""Mixing sources to target weights: token weights raked to source, language and topic marginals, then sampling.

Tokens (words) are summed into cells of source, language and topic. Iterative proportional fitting scales the cells in
turn until each marginal has its target share: these are the weights. The sample's expected tokens are raked once more
under the bound that no cell gives more than it has, so that the sample itself has the target shares; a cell's
probability is its expected part. The budget is met where that can be; where a value hasn't enough tokens for its
share of the budget, the sample is the largest with the target shares (to ``CLOSE``). The cells, not the documents,
are held by the driver: some 100 bytes each. A hash of the id draws the documents, so a run can be repeated. Without
targets, each marginal's shares are flattened by the power ``FLATTEN``.

The topic, where the table has none, is the vocabulary group that most of a text's long words hash to.

Defined results: null sources and languages are values of their own; a null or empty text has topic 0 and no tokens
and takes its cell's probability; rows without an id are left out; rows of one id are drawn together; target values
without tokens are passed over, values without a target keep their share; targets that no weights of the cells meet
are approached, with a warning, and the sample has the weights' shares; an empty table gives no rows.
"""

from __future__ import annotations

import warnings
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.blocks import Block, bytes_of, release, word_hashes, words_of
from lumenframe.llm.scratch import kept

TOPICS, LONG_WORD = 8, 5
DIMS = ("source", "lang", "topic")
FLATTEN = {"source": 0.7, "lang": 0.7, "topic": 0.0}
BUDGET = 0.8
#: Rounds of raking at most, the departure from a target (as a part of it) that ends them, and how closely the largest
#: possible sample is sought.
ROUNDS, TOLERANCE, CLOSE = 500, 1e-6, 1e-3


@F.arrow_udf(T.StructType([T.StructField("topic", T.IntegerType()), T.StructField("n_tokens", T.LongType())]))
def described(text: pa.Array) -> pa.Array:
    """Topic and number of words of each text."""
    topics, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    offsets, data = bytes_of(text.fill_null(""))
    at = 0
    while at < len(text):
        to = min(len(text), max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 21), "right")) - 1), at + 20_000)
        block = Block(np.arange(at, to), offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]])
        words = words_of(block)
        hashes = word_hashes(block, words)
        long_ = words.end - words.start >= LONG_WORD
        votes = np.bincount(words.doc[long_] * TOPICS + (hashes[long_] % np.uint64(TOPICS)).astype(np.int64), minlength=(to - at) * TOPICS)
        topics.append(votes.reshape(-1, TOPICS).argmax(1).astype(np.int32))
        counts.append(words.counts)
        at = to
    release()
    return pa.StructArray.from_arrays([pa.array(np.concatenate(topics)), pa.array(np.concatenate(counts).astype(np.int64))], names=["topic", "n_tokens"])


def with_cells(docs: DataFrame) -> DataFrame:
    """The documents with their cell: ``_source, _lang, _topic`` as strings, and ``_n_tokens``."""
    own = [c for c in ("doc_id", "text", "source", "lang", "_row") if c in docs.columns]
    named = docs.select(*own).filter(F.col("doc_id").isNotNull()).withColumn("_described", described(F.col("text")))
    text = lambda c: F.when(F.col(c).isNull(), F.lit("(none)")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    return named.withColumns({"_source": text("source"), "_lang": text("lang"), "_topic": F.col("_described.topic").cast("string"), "_n_tokens": F.col("_described.n_tokens")}).drop("_described")


class Cells(NamedTuple):
    """The cells in order of their names: each one's value in every dimension as a number, its tokens, the values."""

    codes: list[np.ndarray]
    tokens: np.ndarray
    values: list[pa.Array]

    def sums(self, d: int, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.codes[d], x, len(self.values[d]))


def gathered(cells: DataFrame) -> Cells:
    """``_source, _lang, _topic, tokens`` rows on the driver."""
    found = cells.toArrow().sort_by([(f"_{d}", "ascending") for d in DIMS])
    columns = [found.column(f"_{d}").combine_chunks().dictionary_encode() for d in DIMS]
    return Cells([c.indices.to_numpy().astype(np.int64) for c in columns], found.column("tokens").to_numpy().astype(np.float64), [c.dictionary for c in columns])


def goals_of(cells: Cells, targets: dict[str, DataFrame] | None) -> list[np.ndarray]:
    """Tokens that every value shall have; each dimension's sum is that of all tokens."""
    out, total = [], cells.tokens.sum()
    for d, dim in enumerate(DIMS):
        now = cells.sums(d, cells.tokens)
        if targets:
            named = dict(targets[dim].select(f"_{dim}", F.col("goal").cast("double")).collect())
            goal = np.array([named.get(v, np.nan) for v in cells.values[d].to_pylist()], np.float64)
        else:
            goal = np.where(now > 0, now ** FLATTEN[dim], np.nan)
        own = np.isnan(goal) | (now == 0)  # these keep their share; the others have the rest
        rest, asked = total - now[own].sum(), goal[~own].sum()
        out.append(np.where(own, now, np.where(own, 0.0, goal) * (rest / asked if asked > 0 else 0.0)))
    return out


def missed(cells: Cells, x: np.ndarray, goals: list[np.ndarray]) -> float:
    """Largest departure of a marginal of ``x`` from its goal, as a part of the goal."""
    off = [np.abs(cells.sums(d, x) - g)[g > 0] / g[g > 0] for d, g in enumerate(goals)]
    return max((float(o.max()) for o in off if len(o)), default=0.0)


def rake(cells: Cells, goals: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """The cells' tokens scaled until every marginal is as ``goals`` say, to ``TOLERANCE``."""
    w = cells.tokens.copy()
    for _ in range(rounds):
        for d, goal in enumerate(goals):
            now = cells.sums(d, w)
            w = w * np.divide(goal, now, out=np.ones_like(goal), where=now > 0)[cells.codes[d]]
        if missed(cells, w, goals) <= TOLERANCE:
            break
    return w


def bounded(cells: Cells, w: np.ndarray, goals: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray | None:
    """Raking in which no cell has more than its tokens: ``min(tokens, w * factors)``; None if ``goals`` aren't met.

    For one value the factor solves a sum of ``min`` terms: Newton's steps rise to it from the factor without bounds.
    """
    y, t = w.copy(), cells.tokens
    for _ in range(rounds):
        for d, goal in enumerate(goals):
            code, now = cells.codes[d], cells.sums(d, y)
            factor = np.divide(goal, now, out=np.ones_like(goal), where=now > 0)
            full = np.zeros(len(t), bool)
            while True:
                more = y * factor[code] >= t
                if not (more & ~full).any():
                    break
                full |= more
                free = cells.sums(d, np.where(full, 0.0, y))
                factor = np.divide(np.maximum(goal - cells.sums(d, np.where(full, t, 0.0)), 0.0), free, out=factor, where=free > 0)
            y = y * factor[code]
        if not np.isfinite(y).all():
            return None
        x = np.minimum(y, t)
        if missed(cells, x, goals) <= TOLERANCE:
            return x
    return None


def expected(cells: Cells, w: np.ndarray, budget: float) -> np.ndarray:
    """Tokens of each cell in the sample: ``budget`` of them with the marginals of ``w``, or the most that have these."""
    whole = w.sum()
    if not whole or not budget:
        return np.zeros_like(w)
    marginals = [cells.sums(d, w) / whole for d in range(len(DIMS))]
    at = lambda size: bounded(cells, w * (size / whole), [m * size for m in marginals])
    used = w > 0
    low = min(budget, whole * float((cells.tokens[used] / w[used]).min()))  # here no cell meets its bound
    best = w * (low / whole)
    # no value can have more than its tokens
    high = min([budget, *(float((cells.sums(d, cells.tokens)[m > 0] / m[m > 0]).min()) for d, m in enumerate(marginals))])
    if high <= low:
        return best
    found = at(high)
    if found is not None:
        return found
    while high > low * (1 + CLOSE):
        middle = (low + high) / 2
        found = at(middle)
        if found is None:
            high = middle
        else:
            low, best = middle, found
    return best


def probabilities(cells: Cells, goals: list[np.ndarray], budget: float) -> pa.Table:
    """``weight`` (factor of each cell) and ``prob``: at most 1, and ``budget`` tokens expected in all where the goals allow it."""
    w, t = rake(cells, goals), cells.tokens
    if (off := missed(cells, w, goals)) > TOLERANCE:
        warnings.warn(f"no weights of the cells meet the targets: the largest miss is {off:.2g} of a target", stacklevel=2)
    x = expected(cells, w, budget)
    weight = np.divide(w, t, out=np.ones_like(t), where=t > 0)
    prob = np.divide(x, t, out=np.full_like(t, x.sum() / t.sum() if t.sum() else 1.0), where=t > 0)
    names = [pa.DictionaryArray.from_arrays(pa.array(c), v).cast(pa.string()) for c, v in zip(cells.codes, cells.values)]
    return pa.table([*names, weight, np.minimum(prob, 1.0)], names=[*(f"_{d}" for d in DIMS), "weight", "prob"])


def weighted(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """The documents with cell, ``_n_tokens``, ``weight``, ``prob`` and ``sampled``. ``budget``: share of all tokens."""
    placed = with_cells(docs)
    keys = [f"_{d}" for d in DIMS]
    cells = gathered(placed.groupBy(*keys).agg(F.sum("_n_tokens").alias("tokens")))
    shares = docs.sparkSession.createDataFrame(probabilities(cells, goals_of(cells, targets), budget * cells.tokens.sum()))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("mixing")), F.lit(1 << 52)) / float(1 << 52)
    return placed.join(kept(shares, "shares"), keys).withColumn("sampled", draw < F.col("prob"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """The documents drawn, with their columns."""
    whole = docs.select("doc_id", "text", "source", "lang", F.struct("*").alias("_row"))
    return weighted(whole, targets, budget).filter("sampled").select("_row.*")
