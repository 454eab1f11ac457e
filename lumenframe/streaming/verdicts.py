"""Verdict edits as a stream: an append-only log of last edits, and the current table on top of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lumenframe.operators import review


def start_verdicts(edits: DataFrame, out: str, checkpoint: str, key: Sequence[str] = ("key",)) -> StreamingQuery:
    """Writes the last edit per key of every micro-batch to its own folder below ``out``.

    The last write by ``(edit_ts, edit_id)`` is the same however often and however late an edit
    arrives, so no state is kept and no late edit is dropped. A batch that is replayed overwrites its folder. Nothing already written is rewritten, so the
    cost of a batch follows the batch, not the table.
    """

    def save(batch: DataFrame, number: int) -> None:
        review.current_verdicts(batch, key=key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return edits.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, key: Sequence[str] = ("key",)) -> DataFrame:
    """Last write per key over all batches."""
    log = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return review.current_verdicts(log.drop("batch"), key=key)


def compact(spark: SparkSession, out: str, into: str, key: Sequence[str] = ("key",)) -> DataFrame:
    """Folds the log into one table at ``into``; later batches can be layered on it as ``base``."""
    current(spark, out, key).write.mode("overwrite").parquet(into)
    return spark.read.parquet(into)

