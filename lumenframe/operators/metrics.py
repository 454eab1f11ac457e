"""Precision, recall and localisation metrics per case and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.rounding import half_even


def _prf(df: DataFrame) -> DataFrame:
    """Adds precision/recall/f1 from n_gt, n_pred, n_matched, with the empty-side conventions."""
    g, q, m = F.col("n_gt"), F.col("n_pred"), F.col("n_matched")
    empty = (g == 0) & (q == 0)
    df = df.withColumns(
        {
            "precision": F.when(empty, 1.0).when(q == 0, 0.0).otherwise(m / F.greatest(q, F.lit(1))),
            "recall": F.when(empty | (g == 0), 1.0).otherwise(m / F.greatest(g, F.lit(1))),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn(
        "f1", F.when(empty, 1.0).when((g == 0) | (p + r == 0), 0.0).otherwise(2.0 * p * r / F.when(p + r > 0, p + r))
    )


def case_counts(cases: DataFrame, gt: DataFrame, pred: DataFrame, attrs: DataFrame) -> DataFrame:
    """One row per case of ``cases`` with counts and mean errors; a single shuffle on the case.

    ``attrs`` is the output of ``match_attributes``.
    """
    null = F.lit(None).cast("double")
    blank = {"ostium_err_mm": null, "seed_err_mm": null, "cosine": null}

    def tagged(df: DataFrame, g: int, q: int, m: int, values=None) -> DataFrame:
        v = values or blank
        return df.select(
            "case_id", F.lit(g).alias("g"), F.lit(q).alias("q"), F.lit(m).alias("m"), *[c.alias(k) for k, c in v.items()]
        )

    rows = (
        tagged(cases, 0, 0, 0)
        .unionByName(tagged(gt, 1, 0, 0))
        .unionByName(tagged(pred, 0, 1, 0))
        .unionByName(tagged(attrs, 0, 0, 1, {k: F.col(k) for k in blank}))
    )
    return rows.groupBy("case_id").agg(
        F.sum("g").alias("n_gt"),
        F.sum("q").alias("n_pred"),
        F.sum("m").alias("n_matched"),
        F.avg("ostium_err_mm").alias("mean_ostium_err_mm"),
        F.avg("seed_err_mm").alias("mean_seed_err_mm"),
        F.avg("cosine").alias("mean_dir_cosine"),
    )


def case_metrics(cases: DataFrame, gt: DataFrame, pred: DataFrame, attrs: DataFrame) -> DataFrame:
    return _prf(case_counts(cases, gt, pred, attrs))


def case_status(metrics: DataFrame) -> DataFrame:
    """Case-level flag of one-sided cases."""
    return metrics.select(
        "*",
        F.when((F.col("n_pred") == 0) & (F.col("n_gt") > 0), "no_predictions")
        .when((F.col("n_gt") == 0) & (F.col("n_pred") > 0), "gt_empty")
        .alias("case_flag"),
    )


def overall_metrics(metrics: DataFrame) -> DataFrame:
    """Micro precision/recall/F1; the origin error is the mean of the case means."""
    total = metrics.agg(
        F.coalesce(F.sum("n_gt"), F.lit(0)).alias("n_gt"),
        F.coalesce(F.sum("n_pred"), F.lit(0)).alias("n_pred"),
        F.coalesce(F.sum("n_matched"), F.lit(0)).alias("n_matched"),
        F.avg("mean_ostium_err_mm").alias("mean_ostium_err_mm"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    total = total.withColumns({"precision": ratio("n_matched", "n_pred"), "recall": ratio("n_matched", "n_gt")})
    p, r = F.col("precision"), F.col("recall")
    return total.withColumn("f1", F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(0.0))


def serialised(metrics: DataFrame) -> DataFrame:
    """Ratios at four decimals, distances and cosines at three, half to even."""
    out = metrics
    for c, digits in (
        ("precision", 4), ("recall", 4), ("f1", 4),
        ("mean_ostium_err_mm", 3), ("mean_seed_err_mm", 3), ("mean_dir_cosine", 3),
    ):
        if c in out.columns:
            out = out.withColumn(c, half_even(F.col(c), digits))
    return out


def metric_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per-case differences between two metric snapshots; cases in one snapshot only stay visible."""
    names = ["n_pred", "n_matched", "precision", "recall", "f1"]
    b = before.select("case_id", *[F.col(c).alias(f"{c}_before") for c in names])
    a = after.select("case_id", *[F.col(c).alias(f"{c}_after") for c in names])
    return b.join(a, "case_id", "full").select(
        "case_id",
        *[F.col(f"{c}_before") for c in names],
        *[F.col(f"{c}_after") for c in names],
        *[(F.col(f"{c}_after") - F.col(f"{c}_before")).alias(f"{c}_delta") for c in names],
    )
