"""Row numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenframe.session import cut

WINDOW_ROWS = 200_000


def numbered(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "n", window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Adds ``out`` = 1.. per group in ``order`` (which must be total inside a group).

    Groups of ordinary size are ranked by a window. When some group exceeds ``window_rows``, rows
    are range-partitioned on (group, order) instead, ranked inside each range, and shifted by the
    group's row count in the earlier ranges, so no task ever holds one whole group.
    """
    group = list(group)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    if sizes.where(F.col("__n") > window_rows).isEmpty():
        return df.withColumn(out, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long"))
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged, "ranged")
    counts = ranged.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select(*group, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    inside = W.partitionBy(*group, "__part").orderBy(*order)
    ranked = ranged.withColumn("__rank", F.row_number().over(inside))
    return ranked.join(shift, [*group, "__part"]).withColumn(out, F.col("__shift") + F.col("__rank")).drop("__part", "__rank", "__shift")
