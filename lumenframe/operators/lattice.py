"""Neighbourhood operators on sparse voxel tables ``(case_id, z, y, x, ...)``.

Shuffles move cells, not neighbourhoods: rows are first partitioned by a slab or a line, the
offsets are expanded inside the task, and the following aggregate reuses that partitioning because
its keys contain the partition keys.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import geometry as geo
from lumenframe.operators.bricks import EDGE, KEY, spread
from lumenframe.operators.percase import case_joiner
from lumenframe.session import known_rows, unsent

CELL = ["case_id", "z", "y", "x"]


def _shift(df: DataFrame, offsets, keep: Sequence[str] = ()) -> DataFrame:
    """Each row once per offset, moved by it."""
    moved = df.withColumn("__o", F.explode(geo.offset_array(offsets)))
    return moved.select(
        "case_id", (F.col("z") + F.col("__o.dz")).alias("z"), (F.col("y") + F.col("__o.dy")).alias("y"), (F.col("x") + F.col("__o.dx")).alias("x"), *keep
    )


def box_dilate(mask: DataFrame) -> DataFrame:
    """Cells of the mask and their 26 neighbours: a 3x3 pass inside z slabs, then a pass along z."""
    plane = [(0, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    column = [(a, 0, 0) for a in (-1, 0, 1)]
    slab = mask.select(*CELL).repartition("case_id", "z")
    wide = _shift(slab, plane).distinct()
    return _shift(wide.repartition("case_id", "y", "x"), column).distinct()


def face_neighbours(mask: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return _shift(mask, geo.neighbour_offsets(6), keep)


def _ball_steps(mask: DataFrame, radius_mm: float | Column, spacing: DataFrame, steps: Sequence[np.ufunc], edge: int = EDGE) -> DataFrame:
    """``steps`` (and, or) over the physical ball around every cell, one after the other.

    Cells go to the bricks that they can reach in all steps; neighbourhoods exist inside the task only.
    """
    r = F.lit(float(radius_mm)) if isinstance(radius_mm, (int, float)) else radius_mm
    reach = [F.greatest(F.lit(1), F.ceil(F.col("r") / F.col(f"s{c}")).cast("int")).alias(f"n{c}") for c in "zyx"]
    rows = case_joiner(spacing.select("case_id", "sz", "sy", "sx", r.alias("r")).select("*", *reach))(mask.select(*CELL).dropna())
    for a in "zyx":
        lo, hi = [F.floor((F.col(a) + e * len(steps) * F.col(f"n{a}")) / edge).cast("int") for e in (-1, 1)]
        rows = rows.withColumn(f"b{a}", F.explode(F.sequence(lo, hi)))
    kind = mask.schema["case_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        one = table.slice(0, 1).to_pylist()[0]
        n, sp = np.array([one[f"n{a}"] for a in "zyx"]), [one[f"s{a}"] for a in "zyx"]
        ball = [o for o in np.ndindex(*(2 * n + 1)) if sum((float(k - m) * s) ** 2 for k, m, s in zip(o, n, sp, strict=True)) <= one["r"] * one["r"] + 1e-6]
        low = np.array([one[f"b{a}"] * edge for a in "zyx"])
        block = np.zeros(edge + 2 * len(steps) * n, bool)
        block[tuple((np.stack([table[a].to_numpy().astype(np.int64) for a in "zyx"], 1) - low + len(steps) * n).T)] = True
        for step in steps:
            size = np.array(block.shape) - 2 * n
            out = np.full(size, step is np.logical_and)
            for o in ball:
                step(out, block[tuple(slice(k, k + m) for k, m in zip(o, size))], out=out)
            block = out
        place = np.stack(np.nonzero(block), 1) + low
        return pa.table({"case_id": pa.repeat(table["case_id"][0], len(place)), **{a: pa.array(place[:, i].astype(np.int32)) for i, a in enumerate("zyx")}})

    return unsent(spread(rows, KEY, known_rows(mask)).groupBy(*KEY).applyInArrow(run, f"case_id {kind}, z int, y int, x int"))


def ball_dilate(mask: DataFrame, radius_mm: float | Column, spacing: DataFrame) -> DataFrame:
    """Dilation by a physical ball; ``spacing(case_id, sz, sy, sx)``."""
    return _ball_steps(mask, radius_mm, spacing, [np.logical_or])


def ball_erode(mask: DataFrame, radius_mm: float, spacing: DataFrame) -> DataFrame:
    """Cells whose whole physical ball lies in the mask (outside the grid counts as background)."""
    return _ball_steps(mask, radius_mm, spacing, [np.logical_and])


def ball_open(mask: DataFrame, radius_mm: float, spacing: DataFrame) -> DataFrame:
    return _ball_steps(mask, radius_mm, spacing, [np.logical_and, np.logical_or])


def erode6(mask: DataFrame) -> DataFrame:
    """Cells with all six face neighbours in the mask."""
    votes = face_neighbours(mask).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    return mask.select(*CELL).join(votes.where(F.col("n") == 6), CELL, "left_semi")


def surface(mask: DataFrame) -> DataFrame:
    """Cells with at least one face neighbour outside the mask."""
    votes = face_neighbours(mask).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    return mask.select(*CELL).join(votes.where(F.col("n") == 6), CELL, "left_anti")


def touching(cells: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``cells`` that are, or have, a 26-neighbour in ``other``."""
    return cells.join(box_dilate(other), CELL, "left_semi")


def contact_cells(instances: DataFrame, parent: DataFrame) -> DataFrame:
    """Instance cells touching the parent and not in it, for all instances at once."""
    return touching(instances, parent).join(parent.select(*CELL), CELL, "left_anti")


def ostium_cells(contact: DataFrame, parent: DataFrame, key: Sequence[str] = ("case_id", "inst_id")) -> DataFrame:
    """Parent cells touching each instance's contact: ``(key, z, y, x)``."""
    extra = [k for k in key if k != "case_id"]
    near = _shift(contact, [(0, 0, 0), *geo.neighbour_offsets(26)], extra).distinct()
    return near.join(parent.select(*CELL), CELL, "left_semi")


def face_contacts(instances: DataFrame, parent: DataFrame, key: Sequence[str] = ("case_id", "inst_id")) -> DataFrame:
    """Number of (instance cell, parent cell) faces per instance."""
    extra = [k for k in key if k != "case_id"]
    faces = face_neighbours(instances, extra).join(parent.select(*CELL), CELL, "left_semi")
    return faces.groupBy(*key).agg(F.count(F.lit(1)).alias("face_contacts"))
