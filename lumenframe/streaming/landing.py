"""Continuous ingest of prediction documents from a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenframe import schema
from lumenframe.operators import quality_checks
from lumenframe.sources import documents


def document_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema.PREDICTION)
        .option("multiLine", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
        .withColumn("source_path", F.col("_metadata.file_path"))
    )


def split_batch(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(landmarks of valid documents, violations)``.

    Violations are keyed by file, so a broken case id cannot hide them.
    """
    by_file = docs.withColumn("case_id", F.col("source_path"))
    top = _document_rules(docs)
    rows = quality_checks.schema_violations(documents.explode_rows(by_file)).withColumnRenamed("case_id", "source_path")
    bad = top.unionByName(rows)
    good = docs.join(bad.select("source_path").distinct(), "source_path", "left_anti")
    return documents.explode_landmarks(good), bad


def _document_rules(docs: DataFrame) -> DataFrame:
    out = docs.select(
        "source_path",
        F.explode(F.array_compact(F.array(
            F.when(F.coalesce(F.col("case_id"), F.lit("")) == "", F.lit("missing_case_id")),
            F.when(~F.coalesce(F.col("parent.instance_id") == documents.PARENT_ID, F.lit(False)), F.lit("parent_not_aorta")),
            F.when(F.col("daughters").isNull(), F.lit("daughters_not_a_list")),
        ))).alias("rule"),
    )
    return out.select("source_path", F.lit(None).cast("string").alias("instance_id"), "rule")


def start_landing(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends landmarks and violations of new documents below ``out``.

    Each micro-batch owns one partition folder and overwrites it, so a replayed batch leaves no
    duplicates.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.persist()
        good, bad = split_batch(batch)
        good.write.mode("overwrite").parquet(f"{out}/landmarks/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/violations/batch={number}")
        batch.unpersist()

    stream = document_stream(spark, folder)
    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
