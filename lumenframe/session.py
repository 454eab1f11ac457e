"""Session set-up and the durable cut points used by iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows above which a table made here isn't offered for broadcast.
BROADCAST_ROWS = 100_000

_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "lumenframe", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    parts = "8" if cores == "*" else str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder for cut points: the one the cluster names, or a scratch folder in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_ROOTS[sc.applicationId]


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has a one-node lineage and known file sizes, and losing an executor costs a
    re-read instead of the whole history of the loop. Rows are counted while they are written: files of
    cells and flags are a hundredth of their rows in memory, so their size doesn't tell what may be broadcast.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark).rstrip('/')}/lumenframe-{app}/{label}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    return unsent(spark.read.schema(df.schema).parquet(path), seen.get.get("rows") or 0)


def unsent(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, of at most ``rows`` rows; when these are many or unknown, its joins shuffle both sides (an explicit broadcast of the other side still holds).

    For rows that were multiplied by explode, which Spark takes for as many as before.
    """
    out = df.hint("merge") if rows is None or rows > BROADCAST_ROWS else df
    out.__dict__["_rows"] = rows
    return out


def known_rows(df: DataFrame) -> int | None:
    """Rows of a table that ``cut`` or ``unsent`` returned."""
    return df.__dict__.get("_rows")

