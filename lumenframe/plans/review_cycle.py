"""The review loop: detections with status, verdicts, the logistic study and the impact of the rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import distributions, matching, quality_model, review, rules
from lumenframe.params import DEFAULTS, Params
from lumenframe.session import cut


@dataclass
class Study:
    features: DataFrame
    medians: DataFrame
    scores: DataFrame
    sweep: DataFrame
    safest: DataFrame
    impact: DataFrame
    implied: DataFrame


def feature_rows(pred: DataFrame, gt: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Predictions with draft status and the reason the artefact rules would give."""
    rows = matching.draft_status(pred, matching.optimal_matches(gt, pred, p))
    return rules.with_artifact_reason(rows, p, "rule_drop")


def study(rows: DataFrame, verdicts: DataFrame, n_gt: int, folds: int | None = None) -> Study:
    """Everything reported on labelled features.

    ``folds`` groups cases for the held-out scores; leave it unset to hold out one case at a time.
    """
    f = review.attach_verdicts(rows.drop("verdict") if "verdict" in rows.columns else rows, verdicts)
    f = cut(f.withColumn("path_mm", F.col("path_mm")), "study")
    long = f.select("verdict", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("value")) for k in quality_model.FEATURES])).alias("v"))
    med = distributions.summary(long.where(F.col("verdict").isNotNull()).select("verdict", "v.feature", "v.value"), "value", ["verdict", "feature"])
    labelled = quality_model.design_rows(f)
    if folds is not None:
        labelled = quality_model.fold_column(labelled, folds)
    scores = cut(quality_model.leave_one_case_out(labelled, fold="case_id" if folds is None else "fold"), "study-scores")
    sweep = quality_model.threshold_sweep(scores, "p_real", F.col("label") == 1.0)
    return Study(
        f, med.select("verdict", "feature", "n", "median", "p10", "p90"), scores, sweep, quality_model.safest_threshold(sweep),
        quality_model.rule_impact(f, reason="rule_drop"), quality_model.implied_scores(f.where(F.col("status").isNotNull()), n_gt, reason="rule_drop"),
    )
