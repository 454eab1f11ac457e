"""Scoring of prediction documents against annotation documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import matching, metrics
from lumenframe.params import DEFAULTS, Params
from lumenframe.session import cut
from lumenframe.sources import documents


@dataclass
class Score:
    cases: DataFrame
    overall: DataFrame
    matches: DataFrame
    flags: DataFrame
    unmatched: DataFrame


def score(cases: DataFrame, gt: DataFrame, pred: DataFrame, p: Params = DEFAULTS, legacy_missing: DataFrame | None = None) -> Score:
    """Scores every case of ``cases(case_id)``.

    ``legacy_missing(case_id)`` lists cases without a prediction file whose references should not
    count as misses; by default they do.
    """
    if legacy_missing is not None:
        gt = gt.join(legacy_missing.select("case_id"), "case_id", "left_anti")
    m = cut(matching.optimal_matches(gt, pred, p), "matches")
    attrs = cut(matching.match_attributes(m, gt, pred), "attrs")
    per_case = cut(metrics.case_status(metrics.case_metrics(cases, gt, pred, attrs)), "case-metrics")
    if legacy_missing is not None:
        gone = legacy_missing.select("case_id", F.lit(True).alias("__gone"))
        per_case = per_case.join(gone, "case_id", "left")
        none = F.coalesce("__gone", F.lit(False))
        zero = {c: F.when(none, 0.0).otherwise(F.col(c)) for c in ("precision", "recall", "f1")}
        per_case = per_case.withColumns({**zero, "case_flag": F.when(none, F.lit("missing_prediction")).otherwise(F.col("case_flag"))}).drop("__gone")
    return Score(per_case, metrics.overall_metrics(per_case), attrs, matching.match_flags(attrs, p), matching.unmatched(gt, pred, m))


def score_folders(spark: SparkSession, annotations: str, predictions: str, p: Params = DEFAULTS) -> Score:
    """Scores ``<annotations>/<case>/annotations.json`` against the prediction folder.

    The prediction file of a case is found by the four naming conventions.
    """
    gt = documents.read_annotations(spark, f"{annotations}/*/annotations.json")
    files = documents.read_documents(spark, [f"{annotations}/*/annotations.json"]).select("source_path")
    cases = files.select(F.regexp_extract("source_path", r"([^/]+)/[^/]+$", 1).alias("case_id")).distinct()
    docs = documents.read_documents(spark, predictions)
    base = predictions.rstrip("/").rsplit("/", 1)[-1]
    docs = docs.withColumn("path", F.regexp_extract("source_path", rf"/{base}/(.+)$", 1))
    chosen = cut(documents.choose_prediction_files(cases, docs.select("path")), "chosen")
    picked = chosen.where(F.col("path").isNotNull())
    named = picked.select(F.col("case_id").alias("__case"), "path").join(docs, "path").withColumn("case_id", F.col("__case"))
    pred = documents.explode_landmarks(named)
    folder = gt.select("case_id").distinct().join(cases, "case_id", "left_semi")
    gt = gt.join(folder, "case_id", "left_semi")
    return score(cases, gt, pred, p)


def metrics_table(s: Score, p: Params = DEFAULTS) -> DataFrame:
    return documents.metrics_document(metrics.serialised(s.cases), metrics.serialised(s.overall), s.matches, s.flags, p.match_mm)
