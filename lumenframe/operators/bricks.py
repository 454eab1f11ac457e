"""Bricks: fixed-size blocks of a voxel grid, the unit of work of dense kernels.

A brick kernel sees at most (edge + 2*halo)^3 cells, whatever the size of the case.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE = 32
KEY = ["case_id", "bz", "by", "bx"]
_FAR = 1 << 30


def layout(grid: DataFrame, edge: int = EDGE) -> DataFrame:
    """Adds, per axis, the origin ``o``, edge ``e``, and the first and last number ``f, l`` of each case's bricks.

    A case's box is cut evenly into bricks at most half as long again as ``edge``: a box a little longer than ``edge`` is one
    brick, not a brick and slivers whose halos hold most of it again. Without bounds bricks are counted from 0, ``edge`` long.
    """
    out = {}
    for a in "zyx":
        if f"{a}0" in grid.columns:
            n = F.greatest(F.col(f"{a}1") - F.col(f"{a}0") + 1, F.lit(1))
            parts = F.ceil(n / (edge + edge // 2))
            out |= {f"o{a}": F.col(f"{a}0").cast("int"), f"e{a}": F.ceil(n / parts).cast("int"), f"f{a}": F.lit(0), f"l{a}": (parts - 1).cast("int")}
        else:
            out |= {f"o{a}": F.lit(0), f"e{a}": F.lit(edge), f"f{a}": F.lit(-_FAR), f"l{a}": F.lit(_FAR)}
    return grid.withColumns(out)


LAYOUT = [f"{k}{a}" for k in "oefl" for a in "zyx"]


def brick_of(a: str, step: Column | int = 0) -> Column:
    """Number of the brick of a ``layout`` that holds place ``a`` moved by ``step``; what lies beyond the box belongs to its outermost bricks."""
    at = F.floor((F.col(a) + step - F.col(f"o{a}")) / F.col(f"e{a}")).cast("int")
    return F.when(at.isNotNull(), F.greatest(F.col(f"f{a}"), F.least(F.col(f"l{a}"), at)))


def in_reach(cells: DataFrame, reach: dict[str, Column | int]) -> DataFrame:
    """Each cell once in every brick of its ``layout`` that is at most ``reach`` away along each axis."""
    out = cells
    for a in "zyx":
        out = out.withColumn(f"b{a}", F.explode(F.sequence(brick_of(a, -reach[a]), brick_of(a, reach[a]))))
    return out


ROWS = 200_000  # rows of a task of a brick kernel, of tables whose rows are known


def spread(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """Partitions rows by the group key of a kernel into the session's full number of partitions, or into more for many ``rows``.

    Kernel input is small in bytes and heavy in work; without a fixed number AQE would merge it
    into few tasks. The following grouping on the same keys adds no shuffle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-(rows or 0) // ROWS)), *keys)
