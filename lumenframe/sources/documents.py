"""Prediction, annotation and metrics documents (JSON) in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe import schema
from lumenframe.functions.rounding import half_even

PARENT_ID = "aorta"  # fixed value of the document format


def _vec(name: str) -> list[Column]:
    return [F.get(F.col(name), i) for i in range(3)]


def _flatten(exploded: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    o, s, d = _vec("d.ostium_xyz_mm"), _vec("d.seed_xyz_mm"), _vec("d.direction_xyz")
    names = ("x", "y", "z"), ("sx", "sy", "sz"), ("dx", "dy", "dz")
    flat = [c.alias(n) for cs, ns in zip((o, s, d), names) for c, n in zip(cs, ns)]
    return exploded.select("case_id", F.col("d.instance_id").alias("id"), *flat, F.col("d.radius_mm").alias("radius_mm"), *keep)


def read_documents(spark: SparkSession, path: str | list[str], document: T.StructType | None = None) -> DataFrame:
    """One row per document, with its path and any unparsable text kept in ``_corrupt``."""
    shape = T.StructType([*(document or schema.PREDICTION).fields, T.StructField("_corrupt", T.StringType())])
    return (
        spark.read.schema(shape)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
        .withColumn("source_path", F.col("_metadata.file_path"))
    )


def explode_landmarks(docs: DataFrame) -> DataFrame:
    return _flatten(docs.select("case_id", F.explode("daughters").alias("d")))


def explode_rows(docs: DataFrame) -> DataFrame:
    """Raw landmark rows for schema checks, arrays unchanged."""
    return docs.select(
        "case_id", F.col("parent.instance_id").alias("document_parent"), F.posexplode("daughters").alias("position", "d")
    ).select("case_id", "document_parent", "position", "d.*")


def read_predictions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return explode_landmarks(read_documents(spark, path))


def read_annotations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Reference landmarks; the folder of the document names the case."""
    docs = read_documents(spark, path, schema.ANNOTATION)
    folder = F.regexp_extract("source_path", r"([^/]+)/[^/]+$", 1)
    docs = docs.withColumn("case_id", folder).select("case_id", F.explode("daughters").alias("d"))
    # Two spellings of one confidence grade.
    grade = F.coalesce("d.confidence", "d.guide.confidence", F.lit(""))
    out = docs.withColumns(
        {
            "confidence": F.when(grade == "medium", "moderate").otherwise(grade),
            "notes": F.coalesce("d.notes", "d.guide.notes", F.lit("")),
            "diameter_mm": F.coalesce("d.origin_diameter_estimate_mm", "d.guide.origin_diameter_estimate_mm"),
        }
    )
    return _flatten(out, ["confidence", "notes", "diameter_mm"])


def read_guides(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tracing guides with missing fields as null; one row per guide."""
    out = spark.read.schema(schema.GUIDE).option("multiLine", True).json(path)
    grade = F.col("confidence")
    return out.withColumn("confidence", F.when(grade == "medium", "moderate").otherwise(grade))


def read_excluded(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Excluded candidates; single objects and arrays of objects both become rows."""
    out = spark.read.schema(schema.EXCLUDED).option("multiLine", True).json(path)
    return out.withColumn("case_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def choose_prediction_files(cases: DataFrame, files: DataFrame) -> DataFrame:
    """First existing prediction file of each case among the four naming conventions.

    ``cases(case_id)`` such as ``case_07``; ``files(path)`` relative to the prediction folder.
    """
    num = F.regexp_extract("case_id", r"_(\d+)$", 1)
    # Conventions in priority order.
    names = F.array(
        F.when(num != "", F.format_string("subject%03d.json", num.try_cast("int"))),
        F.concat(F.lit("case_"), num, F.lit(".json")),
        F.concat(F.col("case_id"), F.lit(".json")),
        F.concat(F.col("case_id"), F.lit("/prediction.json")),
    )
    wanted = cases.select("case_id", F.posexplode(names).alias("priority", "path"))
    first = wanted.join(files.select("path").distinct(), "path").groupBy("case_id").agg(F.min(F.struct("priority", "path")).alias("hit"))
    return cases.join(first, "case_id", "left").select("case_id", F.col("hit.path").alias("path"))


def output_direction(df: DataFrame) -> DataFrame:
    """Heading from the two landmarks; the stored heading, then +X, when they coincide."""
    step = [F.col(b) - F.col(a) for a, b in (("x", "sx"), ("y", "sy"), ("z", "sz"))]
    own = [F.col(c) for c in ("dx", "dy", "dz")]
    n = F.sqrt(sum((c * c for c in step[1:]), step[0] * step[0]))
    m = F.sqrt(sum((c * c for c in own[1:]), own[0] * own[0]))
    out = df.withColumns({"__n": n, "__m": m})
    parts = {}
    for name, s, o, f in zip(("dx", "dy", "dz"), step, own, (1.0, 0.0, 0.0)):
        parts[name] = F.when(F.col("__n") >= 1e-8, s / F.col("__n")).when(F.col("__m") >= 1e-8, o / F.col("__m")).otherwise(F.lit(f))
    return out.withColumns(parts).drop("__n", "__m")


def build_documents(cases: DataFrame, landmarks: DataFrame) -> DataFrame:
    """One prediction document per case of ``cases``, ``daughters`` ordered by instance id.

    ``landmarks(case_id, instance_id, x..z, sx..sz, radius_mm, dx..dz)``. A case without landmarks
    gets an empty list. Coordinates carry six decimals, radii four.
    """
    lm = output_direction(landmarks)
    six = lambda *names: F.array(*[half_even(F.col(n), 6) for n in names])
    item = F.struct(
        F.col("instance_id"),
        F.lit(PARENT_ID).alias("parent_instance_id"),
        six("x", "y", "z").alias("ostium_xyz_mm"),
        six("sx", "sy", "sz").alias("seed_xyz_mm"),
        half_even(F.col("radius_mm"), 4).alias("radius_mm"),
        six("dx", "dy", "dz").alias("direction_xyz"),
    )
    per_case = lm.groupBy("case_id").agg(F.sort_array(F.collect_list(item)).alias("daughters"))
    joined = cases.select("case_id").join(per_case, "case_id", "left")
    empty = F.array().cast(schema.PREDICTION["daughters"].dataType)
    return joined.select(
        F.col("case_id").cast("string").alias("case_id"),
        F.struct(F.lit(PARENT_ID).alias("instance_id")).alias("parent"),
        F.coalesce("daughters", empty).alias("daughters"),
    )


def write_documents(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, spread over files by case."""
    docs.write.mode(mode).json(path)


def pretty_documents(docs: DataFrame) -> DataFrame:
    """``(case_id, text)`` with the two-space layout of single-case files."""
    body = F.to_json(F.struct("case_id", "parent", "daughters"), {"pretty": "true", "ignoreNullFields": "false"})
    return docs.select("case_id", body.alias("text"))


def metrics_document(case_metrics: DataFrame, overall: DataFrame, attrs: DataFrame, flags: DataFrame, gate_mm: float) -> DataFrame:
    """Per-case metric rows with nested matches and flags, and the overall row repeated on each."""
    m = attrs.groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("gt_id").alias("gt"), F.col("pred_id").alias("pred"),
            half_even(F.col("ostium_err_mm"), 3).alias("ostium_err_mm"),
            half_even(F.col("seed_err_mm"), 3).alias("seed_err_mm"),
            half_even(F.col("cosine"), 3).alias("direction_cosine"),
            F.col("pred_radius_mm"), F.col("gt_radius_mm"),
        ))).alias("matches")
    )
    f = flags.groupBy("case_id").agg(F.sort_array(F.collect_list("flag")).alias("flags"))
    total = overall.select(F.struct(*overall.columns).alias("overall"))
    return (
        case_metrics.join(m, "case_id", "left").join(f, "case_id", "left")
        .join(F.broadcast(total))  # one row by construction
        .withColumn("match_threshold_mm", F.lit(float(gate_mm)))
        .withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    )


