"""Where operators keep the tables they write between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenframe.session import shared_root


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{shared_root(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor costs a re-read, not the history."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
