"""Structural checks of labelled branches: counts, pieces, parent contact, seed and centreline fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import linalg as la
from lumenframe.operators import components, features, lattice
from lumenframe.operators.percase import join_case
from lumenframe.operators.spatial import nearest

INST = features.INST


def pieces(cells: DataFrame) -> DataFrame:
    """Number of 26-connected pieces of every instance."""
    own = cells.select(F.struct(*INST).alias("case_id"), "z", "y", "x")
    lab = components.label_mask(own)
    return lab.groupBy("case_id").agg(F.max("label").alias("components_26")).select("case_id.*", "components_26")


def branch_report(cells: DataFrame, parent: DataFrame, spacing: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Per instance: voxel count, pieces, parent faces, cells shared with the parent.

    ``points(case_id, inst_id, pid, kind, z, y, x)`` adds the seed distance (``kind='seed'``) and
    the fit of the centreline (``kind='line'``): largest distance to an instance cell, and the share
    of points within half a voxel diagonal.
    """
    n = cells.groupBy(*INST).agg(F.count(F.lit(1)).alias("voxel_count"))
    shared = cells.join(parent.select(*lattice.CELL), lattice.CELL, "left_semi").groupBy(*INST).agg(F.count(F.lit(1)).alias("parent_overlap"))
    out = n.join(pieces(cells), INST).join(lattice.face_contacts(cells, parent), INST, "left").join(shared, INST, "left").fillna(0, ["face_contacts", "parent_overlap"])
    if points is None:
        return out
    mm = features.in_mm(cells, spacing).select(
        F.struct(*INST).alias("case_id"), components.cell_number().alias("cell"), F.col("pz").alias("cz"), F.col("py").alias("cy"), F.col("px").alias("cx")
    )
    at = join_case(points, spacing, "sz", "sy", "sx")
    half = 0.5 * la.norm(la.cols("sz", "sy", "sx"))
    at = at.select(F.struct(*INST).alias("case_id"), "pid", "kind", half.alias("half"), *[(F.col(c) * F.col(f"s{c}")).alias(f"p{c}") for c in "zyx"])
    near = nearest(at, mm, ["pid"], "cell", ["pz", "py", "px"], ["cz", "cy", "cx"]).select("case_id.*", "kind", "half", "dist_mm")
    seed, line = F.col("kind") == "seed", F.col("kind") == "line"
    fit = near.groupBy(*INST).agg(
        F.min(F.when(seed, F.col("dist_mm"))).alias("seed_distance_mm"),
        F.max(F.when(line, F.col("dist_mm"))).alias("centerline_max_distance_mm"),
        F.avg(F.when(line, (F.col("dist_mm") <= F.col("half")).cast("double"))).alias("centerline_covered"),
    )
    return out.join(fit, INST, "left")
