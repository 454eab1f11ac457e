"""Distribution summaries, threshold studies and histograms of one feature by class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenframe.params import DEFAULTS, Params
from lumenframe.session import cut

# Reported percentiles.
QUANTILES = (0, 10, 25, 50, 75, 90, 95, 100)


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, min, max, mean, median and exact percentiles of the finite values."""
    v = F.percentile(value, F.array(*[F.lit(q / 100.0) for q in QUANTILES])).alias("__q")
    out = df.where(finite(value)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), v
    )
    return out.select(
        *by, "n", "min", "max", "mean", F.get("__q", QUANTILES.index(50)).alias("median"),
        *[F.get("__q", i).alias(f"p{q:02d}") for i, q in enumerate(QUANTILES)],
    )


def keep_all_cut(df: DataFrame, value: str, is_true: Column, higher_is_signal: bool = True) -> DataFrame:
    """The loosest cut keeping every true row, and how many others it drops.

    One pass: the other rows are counted per distinct value, so the second step joins counts.
    """
    rows = df.where(finite(value)).select(F.col(value).alias("v"), is_true.alias("t")).where(F.col("t").isNotNull())
    per = rows.groupBy("v").agg(F.count_if("t").alias("nt"), F.count_if(~F.col("t")).alias("nf"))
    edge = F.min(F.when(F.col("nt") > 0, F.col("v"))) if higher_is_signal else F.max(F.when(F.col("nt") > 0, F.col("v")))
    ends = per.agg(edge.alias("cut"), F.sum("nt").alias("n_true"), F.sum("nf").alias("n_extra"))
    beyond = F.col("v") < F.col("cut") if higher_is_signal else F.col("v") > F.col("cut")
    dropped = per.join(F.broadcast(ends.select("cut"))).where(beyond).agg(F.coalesce(F.sum("nf"), F.lit(0)).alias("n_dropped"))
    return ends.join(F.broadcast(dropped))  # one row each


def _cumulative(per: DataFrame, parts: int = 64) -> DataFrame:
    """Running class counts over distinct values without a single global window.

    Values are range-partitioned; ranges are summed, then each range is scanned from its start.
    """
    ranged = cut(per.repartitionByRange(parts, "v").withColumn("__part", F.spark_partition_id()), "values")
    sums = ranged.groupBy("__part").agg(F.sum("nt").alias("st"), F.sum("nf").alias("sf"))
    # at most ``parts`` rows
    before = W.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        "__part", F.coalesce(F.sum("st").over(before), F.lit(0)).alias("bt"), F.coalesce(F.sum("sf").over(before), F.lit(0)).alias("bf")
    )
    run = W.partitionBy("__part").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    below = ranged.select(
        "__part", "v", "nt", "nf",
        F.coalesce(F.sum("nt").over(run), F.lit(0)).alias("rt"), F.coalesce(F.sum("nf").over(run), F.lit(0)).alias("rf"),
    )
    return below.join(F.broadcast(sums), "__part").select(
        "v", "nt", "nf", (F.col("rt") + F.col("bt")).alias("true_below"), (F.col("rf") + F.col("bf")).alias("extra_below")
    )


def best_youden(df: DataFrame, value: str, is_true: Column, higher_is_signal: bool = True) -> DataFrame:
    """Cut with the largest true-positive minus false-positive rate; the lowest such cut wins."""
    rows = df.where(finite(value)).select(F.col(value).alias("v"), is_true.alias("t")).where(F.col("t").isNotNull())
    per = rows.groupBy("v").agg(F.count_if("t").alias("nt"), F.count_if(~F.col("t")).alias("nf"))
    cum = _cumulative(per)
    total = cum.agg(F.sum("nt").alias("n_true"), F.sum("nf").alias("n_extra"))
    j = cum.join(F.broadcast(total))  # one row
    if higher_is_signal:
        tp, fp = F.col("n_true") - F.col("true_below"), F.col("n_extra") - F.col("extra_below")
    else:
        tp, fp = F.col("true_below") + F.col("nt"), F.col("extra_below") + F.col("nf")
    j = j.select("v", "n_true", "n_extra", tp.alias("tp"), fp.alias("fp"))
    youden = F.col("tp") / F.greatest("n_true", F.lit(1)) - F.col("fp") / F.greatest("n_extra", F.lit(1))
    best = j.withColumn("youden", youden).agg(F.max(F.struct("youden", (-F.col("v")).alias("k"), "v", "tp", "fp", "n_true", "n_extra")).alias("b"))
    return best.select(
        F.col("b.v").alias("threshold"), "b.youden", "b.tp", (F.col("b.n_true") - F.col("b.tp")).alias("fn"),
        "b.fp", (F.col("b.n_extra") - F.col("b.fp")).alias("tn"),
    )


def overlap_band(df: DataFrame, value: str, is_true: Column) -> DataFrame:
    """Range covered by both classes and how many rows of each fall into it."""
    rows = df.where(finite(value)).select(F.col(value).alias("v"), is_true.alias("t")).where(F.col("t").isNotNull())
    t, f = F.when(F.col("t"), F.col("v")), F.when(~F.col("t"), F.col("v"))
    band = rows.agg(
        F.greatest(F.min(t), F.min(f)).alias("lo"), F.least(F.max(t), F.max(f)).alias("hi"),
        F.count_if("t").alias("n_true"), F.count_if(~F.col("t")).alias("n_extra"),
    )
    inside = rows.join(F.broadcast(band)).where(F.col("v").between(F.col("lo"), F.col("hi")))  # one row
    counts = inside.agg(F.count_if("t").alias("n_true_in"), F.count_if(~F.col("t")).alias("n_extra_in"))
    return band.join(F.broadcast(counts))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in ``bins`` equal bins of [lo, hi], last bin closed; empty bins are present."""
    width = (hi - lo) / bins
    inside = df.where(finite(value)).where(F.col(value).between(lo, hi))
    slot = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*by, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    spine = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(counts, [*by, "bin"], "left").select(
        *by, "bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n")
    )


def histogram_over_range(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Histogram over the observed range of all rows."""
    r = df.where(finite(value)).agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    lo, hi = (0.0, 1.0) if r["a"] is None else (float(r["a"]), float(r["b"]))
    return histogram(df, value, lo, hi if hi > lo else lo + 1.0, bins, by)


def short_paths(df: DataFrame, path: str = "path_mm", p: Params = DEFAULTS) -> DataFrame:
    return df.where(F.col(path) < p.min_path_mm)
