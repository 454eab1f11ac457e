"""Attaching per-case columns to voxel-sized tables, and exact per-case quantiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenframe.session import cut

BROADCAST_CASES = 200_000
SALTS = 32


def case_joiner(per_case: DataFrame, *columns: str) -> Callable[[DataFrame], DataFrame]:
    """A function that inner-joins ``columns`` of ``per_case`` (one row per case) onto a large table.

    The rows are counted once per table. Up to ``BROADCAST_CASES`` rows are broadcast; beyond that
    both sides are salted, so that one case holding much of the data is spread over tasks.
    """
    small = per_case.select("case_id", *columns) if columns else per_case
    rows = per_case.__dict__.get("_counted_rows")
    if rows is None:
        rows = per_case.limit(BROADCAST_CASES + 1).count()
        per_case.__dict__["_counted_rows"] = rows
    if rows <= BROADCAST_CASES:
        return lambda df: df.join(F.broadcast(small), "case_id")
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def salted(df: DataFrame) -> DataFrame:
        keyed = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), SALTS).cast("int"))
        return keyed.join(copies, ["case_id", "__salt"]).drop("__salt")

    return salted


def join_case(df: DataFrame, per_case: DataFrame, *columns: str) -> DataFrame:
    return case_joiner(per_case, *columns)(df)


HELD_VALUES = 1_000_000


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, qs: Sequence[float], names: Sequence[str], held: int = HELD_VALUES
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``qs``.

    Equal values are counted first, so integer intensities shrink to a few thousand rows per group.
    When a group keeps more than ``held`` distinct values, its order statistics are picked by rank
    over range partitions instead of inside one aggregate buffer.
    """
    group = list(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    counts = cut(counts, "value-counts")
    widest = counts.groupBy(*group).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
    if widest <= held:
        q = F.percentile("__v", F.array(*[F.lit(float(x)) for x in qs]), F.col("__n")).alias("__q")
        out = counts.groupBy(*group).agg(q)
        return out.select(*group, *[F.get("__q", i).alias(n) for i, n in enumerate(names)])
    return _ranked_quantiles(counts, group, qs, names)


def _ranked_quantiles(counts: DataFrame, group: list[str], qs: Sequence[float], names: Sequence[str]) -> DataFrame:
    ranged = counts.repartitionByRange(*[F.col(g) for g in group], F.col("__v")).withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged, "value-ranges")
    per = ranged.groupBy(*group, "__part").agg(F.sum("__n").alias("__s"))
    before = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*group, "__part", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__off"))
    run = W.partitionBy(*group, "__part").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    ranks = ranged.withColumn("__hi", F.sum("__n").over(run)).join(per, [*group, "__part"])
    ranks = ranks.select(*group, "__v", (F.col("__hi") + F.col("__off")).alias("__hi"), "__n")
    total = counts.groupBy(*group).agg(F.sum("__n").alias("__total"))
    pos = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("__total") - 1)).alias("p")) for i, q in enumerate(qs)]))
    j = ranks.join(total, group).select("*", pos.alias("__w"))
    low, high = F.floor("__w.p"), F.ceil("__w.p")
    holds = lambda r: (r >= F.col("__hi") - F.col("__n")) & (r < F.col("__hi"))
    j = j.where(holds(low) | holds(high)).groupBy(*group, F.col("__w.i").alias("i"), F.col("__w.p").alias("p")).agg(
        F.max(F.when(holds(low), F.col("__v"))).alias("lo"), F.max(F.when(holds(high), F.col("__v"))).alias("hi")
    )
    at: Column = F.col("lo") + (F.col("p") - F.floor("p")) * (F.col("hi") - F.col("lo"))
    return j.groupBy(*group).agg(*[F.max(F.when(F.col("i") == i, at)).alias(n) for i, n in enumerate(names)])
