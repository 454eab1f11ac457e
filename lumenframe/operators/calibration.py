"""Per-case intensity calibration and the adaptive tube threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.percase import exact_quantiles
from lumenframe.params import DEFAULTS, Params

MIN_VOXELS = 10  # fixed value: fewer parent voxels cannot be calibrated


def calibrate(voxels: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Contrast window of each case from the intensities of its parent voxels.

    Cases with too few parent voxels are left out; see ``uncalibrated``.
    """
    inside = voxels.where("parent").select("case_id", F.col("hu").cast("double").alias("hu"))
    qs = [0.05, 0.10, 0.50, 0.90, 0.95, p.low_percentile / 100.0, p.high_percentile / 100.0]
    q = exact_quantiles(inside, ["case_id"], "hu", qs, ["p05", "p10", "p50", "p90", "p95", "__lo", "__hi"])
    n = inside.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_voxels"), F.max("hu").alias("__max"))
    df = q.join(n.where(F.col("n_voxels") >= MIN_VOXELS), "case_id")
    span = F.greatest(F.col("p50") - F.col("p10"), F.lit(20.0))
    df = df.withColumn("blood_low", F.greatest(F.col("__lo") - p.low_relax * span, F.least("p05", 0.35 * F.col("p50"))))
    high = F.least(F.col("__hi") + p.high_margin, F.lit(p.high_cap))
    narrow = high <= F.col("blood_low") + 20.0
    df = df.withColumn("blood_high", F.when(narrow, F.least("__max", F.lit(p.high_cap))).otherwise(high))
    return df.withColumn("strict_low", 0.55 * F.col("p50") + 0.45 * F.col("blood_low")).drop("__lo", "__hi", "__max")


def uncalibrated(voxels: DataFrame) -> DataFrame:
    n = voxels.groupBy("case_id").agg(F.count_if("parent").alias("n_voxels"))
    return n.where(F.col("n_voxels") < MIN_VOXELS)


def tube_threshold(support: DataFrame, cases: DataFrame, value: str = "vesselness", p: Params = DEFAULTS) -> DataFrame:
    """``v_thresh`` per case from the response on ``support`` rows; the floor where there are none."""
    q = exact_quantiles(support.select("case_id", value), ["case_id"], value, [p.tube_percentile / 100.0], ["__q"])
    floor = F.lit(p.tube_floor)
    t = F.greatest(floor, p.tube_scale_of_percentile * F.coalesce(F.col("__q"), F.lit(0.0)))
    return cases.select("case_id").join(q, "case_id", "left").select("case_id", t.alias("v_thresh"))
