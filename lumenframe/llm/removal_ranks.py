"""Filter interaction audit: what each filter removes under every order of the filters.

A document is reduced to the set of filters it fails, and documents of one part (source) and one such set are counted
together, so everything after the counts is matrix work whose size depends on the number of filters and parts only.
The mask matrix holds 0 where a set contains a filter and infinity elsewhere; the position matrix holds, for every
order, the step at which a filter runs (the inverse permutation). Their min-plus product is the step at which
documents of a set are removed under an order; it says where a set's weight is scattered to, and which later filters
of the order are redundant for it.

Defined results: null texts are empty, a null part is the empty string; rows without an id count as documents, are nobody's
earlier copy and have no labels; repeated rows count each, and rows of one id are not copies of each other; several
labels of a document count as their greatest; a null label counts as 0. Parts and steps without a document get zeros. An empty table has no part
and gives no row. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.scratch import kept

FILTERS = "ABCDE"
#: Filters that look at one text only; the last one of ``FILTERS`` compares texts.
OWN = FILTERS[:-1]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_WEIGHTS = ["n", "good", "toxic"]
_SPACES = r"[\x20\x09-\x0D]+"


class Ranks(NamedTuple):
    """Orders of the filters, and what happens at each of their steps to documents of each set of failed filters."""

    names: list[str]
    orders: np.ndarray  # [order, step] -> filter
    removal: np.ndarray  # [set, order] -> step, or the number of filters if the set is never removed
    redundant: np.ndarray  # [set, order, step] -> fails the step's filter, but was removed before


def min_plus(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``out[i, k] = min over j of left[i, j] + right[j, k]``."""
    return (left[:, :, None] + right[None, :, :]).min(axis=1)


def ranks(filters: str = FILTERS) -> Ranks:
    """Removal steps of all sets of failed filters under all orders."""
    n = len(filters)
    orders = np.array(list(permutations(range(n))))
    position = np.argsort(orders, axis=1)  # the inverse permutations: the step of each filter
    fails = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    mask = np.where(fails == 1, 0.0, np.inf)
    removal = np.minimum(min_plus(mask, position.T.astype(float)), n).astype(np.int64)
    redundant = (fails[:, orders] == 1) & (removal[:, :, None] < np.arange(n))
    return Ranks(["".join(filters[i] for i in order) for order in orders], orders, removal, redundant)


def failures(text: Column) -> Column:
    """Set of the filters that a text fails by itself, filter ``i`` of ``OWN`` as bit ``i``."""
    words = F.array_remove(F.split(text, _SPACES), "")
    return F.transform(
        F.array(F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("kinds"))),
        lambda w: F.when(w["n"] < 50, 1).otherwise(0)
        + F.when(100 * w["kinds"] < 65 * w["n"], 2).otherwise(0)
        + F.when(100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text), 4).otherwise(0)
        + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0),
    )[0]


def counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part, fails, n, good, toxic``: documents per part and set of failed filters.

    Texts are read once and become digests (SHA-256). Copies are folded by digest, part and labels before a digest's least id is looked up,
    so a text that a third of all rows share is a few rows by then.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = kept(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("fails")
        ),
        "failures",
    )
    marks = (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")))
    )
    unlabelled = [F.lit(0).alias("quality"), F.lit(0).alias("toxic")]
    known = thin.filter("doc_id is not null").join(marks, "doc_id", "left").select(*thin.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")))
    rows = known.groupBy("doc_id", "digest", "part", "fails", "quality", "toxic").agg(F.count("*").alias("n"))
    rows = rows.unionByName(thin.filter("doc_id is null").select("*", *unlabelled).groupBy("digest", "part", "fails", "quality", "toxic", "doc_id").agg(F.count("*").alias("n")))
    copies = rows.groupBy("digest", "part", "fails", "quality", "toxic", F.col("doc_id").isNull().alias("nameless")).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    copies = kept(copies, "copies")
    least = copies.filter("not nameless").groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    placed = copies.join(least, "digest", "left")
    firsts = F.when(F.col("nameless"), F.col("n")).when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.array(F.struct(F.col("fails"), firsts.alias("n")), F.struct((F.col("fails") + (1 << len(OWN))).alias("fails"), (F.col("n") - firsts).alias("n")))
    cases = placed.select("part", "quality", "toxic", F.explode(split).alias("case")).filter("case.n > 0")
    return cases.groupBy("part", F.col("case.fails").alias("fails")).agg(
        F.sum("case.n").alias("n"), F.sum(F.col("case.n") * F.col("quality")).alias("good"), F.sum(F.col("case.n") * F.col("toxic")).alias("toxic")
    )


def scatter(weights: np.ndarray, table: Ranks) -> dict[str, np.ndarray]:
    """Counts per part, order and step from documents per part and set: ``weights[name, part, set]``."""
    n_parts, n_sets = weights.shape[1:]
    n_orders, n_steps = table.orders.shape
    size = n_steps + 1
    at = np.arange(n_orders) * size + table.removal  # [set, order] -> cell of the order's step, the last one for what stays
    lost = np.zeros((len(weights), n_parts, n_orders * size), np.int64)
    for s in range(n_sets):
        lost[:, :, at[s]] += weights[:, :, s, None]
    lost = lost.reshape(len(weights), n_parts, n_orders, size)[..., :n_steps]
    removed, good, toxic = lost
    alone = np.array([weights[0][:, 1 << f] for f in range(n_steps)])  # [filter, part]
    worth = np.zeros((n_parts, n_steps), np.int64)
    for f in range(n_steps):
        worth[:, f] = removed[:, table.orders == f].sum(axis=1)
    return {
        "kept": weights[0].sum(axis=1)[:, None, None] - np.cumsum(removed, axis=2),
        "removed": removed,
        "redundant": np.tensordot(weights[0], table.redundant.astype(np.int64), 1),
        "unique_fails": np.moveaxis(alone[table.orders], 2, 0),
        "good_lost": good,
        "toxic_lost": toxic,
        "shapley": worth[:, table.orders],
    }


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, zeros included: ``part, filter_order, step`` and ``COUNTS``."""
    n_sets = 1 << len(FILTERS)
    cells = F.transform(F.sequence(F.lit(0), F.lit(n_sets - 1)), lambda s: F.coalesce(F.element_at("by_set", s), F.array(*[F.lit(0).cast("long")] * len(_WEIGHTS))))
    parts = counts(docs, labels, part).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("fails", F.array(*_WEIGHTS)))).alias("by_set"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks()
        for batch in batches:
            for at in range(0, len(batch), 100):
                some = batch.slice(at, 100)
                weights = some.column("cells").flatten().flatten().to_numpy().reshape(len(some), n_sets, len(_WEIGHTS)).transpose(2, 0, 1)
                found = scatter(weights, table)
                n_orders, n_steps = table.orders.shape
                per_part = n_orders * n_steps
                columns = [
                    some.column("part").take(pa.array(np.repeat(np.arange(len(some)), per_part))),
                    pa.array(np.tile(np.repeat(table.names, n_steps), len(some))),
                    pa.array(np.tile(np.arange(1, n_steps + 1, dtype=np.int32), len(some) * n_orders)),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(found[c].ravel()) for c in COUNTS], ["part", "filter_order", "step", *COUNTS])

    return parts.select("part", cells.alias("cells")).mapInArrow(tables, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
