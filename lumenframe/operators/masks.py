"""Voxel masks: blood window, shell, ring and outward blood, seeds, allowed cells, cut ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.lattice import CELL, ball_dilate, box_dilate
from lumenframe.operators.percase import join_case
from lumenframe.params import DEFAULTS, Params
from lumenframe.session import unsent


def with_zone_masks(cells: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds ``blood, shell, ring, outward``; needs hu, parent, dist_mm (null = beyond the limit) and the window."""
    d = F.col("dist_mm")
    blood = F.col("hu").between(F.col("blood_low"), F.col("blood_high")) & ~F.col("parent")
    shell = F.coalesce((d > 0) & (d <= p.growth_limit_mm), F.lit(False))
    out = cells.withColumns({"blood": blood, "shell": shell})
    near = F.coalesce((d > 0) & (d <= p.near_wall_mm), F.lit(False))
    far = F.coalesce((d > p.near_wall_mm) & (d <= p.growth_limit_mm), F.lit(False))
    return out.withColumns({"ring": F.col("blood") & near, "outward": F.col("blood") & far})


def with_seed_masks(cells: DataFrame, parent: DataFrame, spacing: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds ``seed``, ``allowed`` and ``sheet``.

    A ring cell is a seed when it touches outward blood or has a strong tube response; contact
    cells that are outward blood are seeds too (this needs a voxel wider than the near-wall limit,
    so the contact dilation only runs for such cases). ``near_outward`` (see ``stencil.zone_maps``) saves the dilation.
    """
    if "near_outward" in cells.columns:
        out = cells.withColumnRenamed("near_outward", "__reach")
    else:
        reach = box_dilate(cells.where("outward")).withColumn("__reach", F.lit(True))
        out = cells.join(unsent(reach), CELL, "left")
    strong = F.col("vesselness") >= F.col("v_thresh")
    seed = F.col("ring") & (F.coalesce("__reach", F.lit(False)) | strong)
    coarse = coarse_cases(spacing, p)
    if not coarse.isEmpty():
        out = out.join(contact_ring(parent.join(coarse.select("case_id"), "case_id", "left_semi"), coarse).withColumn("__contact", F.lit(True)), CELL, "left")
        seed = seed | (F.coalesce("__contact", F.lit(False)) & F.col("outward"))
    bright = F.col("hu").between(F.col("p10"), F.col("blood_high")) & ~F.col("parent") & F.col("shell")
    dim = F.col("blood") & F.col("shell") & (F.col("vesselness") >= F.col("v_thresh") * p.dim_tube_share)
    out = out.withColumns({"seed": F.coalesce(seed, F.lit(False)), "allowed": F.coalesce(bright | dim, F.lit(False))})
    out = out.withColumn("sheet", F.col("ring") & ~F.col("seed"))
    return out.drop("__reach", "__contact")


def coarse_cases(spacing: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Cases whose seeds take the contact dilation."""
    return spacing.where(F.least("sz", "sy", "sx") * 1.1 > p.near_wall_mm)


def contact_ring(parent: DataFrame, spacing: DataFrame) -> DataFrame:
    """Cells within 1.1 of the smallest spacing of the parent, outside it."""
    out = ball_dilate(parent, F.least("sz", "sy", "sx") * 1.1, spacing)
    return out.join(parent.select(*CELL), CELL, "left_anti")


def cap_slices(voxels: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """First and last parent slice of each case and whether they are flat cut ends."""
    per = voxels.where("parent").groupBy("case_id", "z").agg(F.count(F.lit(1)).alias("n"))
    ends = per.groupBy("case_id").agg(
        F.min("z").alias("z_first"), F.max("z").alias("z_last"), F.min_by("n", "z").alias("n_first"), F.max_by("n", "z").alias("n_last")
    )
    return ends.select(
        "case_id", "z_first", "z_last",
        (F.col("n_first") >= p.cap_min_voxels).alias("lo_cap"), (F.col("n_last") >= p.cap_min_voxels).alias("hi_cap"),
    )


def drop_cap_seeds(seeds: DataFrame, caps: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Removes seeds within the margin of a flat cut end."""
    j = join_case(seeds, caps, "z_first", "z_last", "lo_cap", "hi_cap")
    low = F.col("lo_cap") & (F.col("z") < F.col("z_first") + p.cap_margin)
    high = F.col("hi_cap") & (F.col("z") >= F.col("z_last") - p.cap_margin + 1)
    return j.where(~low & ~high).drop("z_first", "z_last", "lo_cap", "hi_cap")
