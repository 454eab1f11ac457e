"""CSV tables, label dictionaries, manifests, run logs and file hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe import schema


def read_rows(spark: SparkSession, path: str | list[str], shape: T.StructType) -> DataFrame:
    """CSV with a header; columns are taken by name, blanks become null."""
    raw = spark.read.option("header", True).option("enforceSchema", False).option("nullValue", "").csv(path)
    have = set(raw.columns)
    typed = lambda f: F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
    return raw.select(*[typed(f).alias(f.name) for f in shape.fields])


def write_rows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_detections(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_rows(spark, path, schema.DETECTION_ROWS).withColumnRenamed("case", "case_id")


def read_features(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_rows(spark, path, schema.FEATURE_ROWS).withColumnRenamed("case", "case_id")


def read_verdicts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_rows(spark, path, schema.VERDICT_ROWS).withColumnRenamed("case", "case_id")


def read_runs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_rows(spark, path, schema.RUN_ROWS)


def read_census(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_rows(spark, path, schema.CENSUS_ROWS)


def read_curvature(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_rows(spark, path, schema.CURVATURE_ROWS)


# Fixed value: layout of a label line.
LABEL_LINE = r'^\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+([0-9.]+)\s+(\d)\s+(\d)\s+"(.*)"\s*$'


def read_labels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Label dictionary lines; comment lines are skipped."""
    t = spark.read.text(path).where(F.col("value").rlike(LABEL_LINE))
    part = lambda i, kind: F.regexp_extract("value", LABEL_LINE, i).cast(kind)
    names = [("idx", "int"), ("r", "int"), ("g", "int"), ("b", "int"), ("a", "double"), ("vis", "int"), ("msh", "int"), ("label", "string")]
    return t.select(*[part(i, k).alias(n) for i, (n, k) in enumerate(names, 1)])


def read_checksums(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``sha256  path`` lines; the size is unknown."""
    t = spark.read.text(path)
    line = r"^([0-9a-fA-F]{64})\s+\*?(.+)$"
    t = t.where(F.col("value").rlike(line))
    return t.select(F.regexp_extract("value", line, 2).alias("path"), F.lit(None).cast("long").alias("bytes"), F.lower(F.regexp_extract("value", line, 1)).alias("sha256"))


def read_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Manifest document with a ``files`` list."""
    shape = T.StructType([T.StructField("files", T.ArrayType(schema.MANIFEST_ROWS))])
    return spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("files").alias("f")).select("f.*")


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """``(path, bytes, sha256)`` below ``root``; paths are relative to it."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.expr(f"substring(regexp_replace(path, '^[a-z0-9]+:/*', '/'), {len(base) + 1})").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_run_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(case_id, line)`` of log files named after their case."""
    t = spark.read.text(path)
    return t.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("case_id"), F.col("value").alias("line"))
