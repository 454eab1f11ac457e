"""Ordered keep/reject rules. The first rule that fires names the reason; null means kept.

Unknown features are null and never fire a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.params import DEFAULTS, Params


def first_reason(*rules: tuple[str, Column]) -> Column:
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules])


def with_artifact_reason(df: DataFrame, p: Params = DEFAULTS, out: str = "reason") -> DataFrame:
    """Rules learned from adjudicated false detections.

    Needs ``bone_frac, path_mm, circularity, vesselness, adj_lumen_frac, radius_mm, radius_cv``.
    """
    v = F.col("vesselness")
    return df.withColumn(
        out,
        first_reason(
            ("bone_frac", F.col("bone_frac") >= p.bone_drop),
            ("short_flat", (F.col("path_mm") < p.short_path_mm) & (F.col("circularity") < p.short_circularity)),
            ("adj_blob", (v < p.blob_tube_max) & (F.col("adj_lumen_frac") >= p.adjacent_drop) & (F.col("radius_mm") >= p.blob_radius_mm)),
            ("smear_cv", (v < p.smear_tube_max) & (F.col("radius_cv") >= p.smear_cv)),
        ),
    )


def with_quality_reason(df: DataFrame, p: Params = DEFAULTS, out: str = "quality_reason") -> DataFrame:
    """Shape and intensity chain of an instance.

    Needs ``n_voxels, sv1, sv2, mean_hu, med_vesselness, n_contact`` per instance, the calibration
    ``p10, p50, blood_low`` and ``v_thresh`` of its case, and ``voxel_mm3``.
    """
    area_diam = contact_area_diameter(F.col("n_contact"), F.col("voxel_mm3"))
    floor = F.least(F.col("p10"), 0.45 * F.col("p50") + 0.55 * F.col("blood_low"))
    n, v, hu = F.col("n_voxels"), F.col("med_vesselness"), F.col("mean_hu")
    # Limits of the chain.
    return df.withColumn(
        out,
        first_reason(
            ("too_few_voxels", n < 4),
            ("short_axis", F.col("sv1") < 3.2),
            ("blob_aniso", F.col("sv1") / F.greatest(F.col("sv2"), F.lit(1e-3)) < 1.15),
            ("dim_hu", hu < floor),
            ("low_vesselness", (hu < 0.7 * F.col("p50")) & (v < 0.4 * F.col("v_thresh"))),
            ("smear", (v < 0.02) & (n > 400) & (area_diam < 6.5)),
            ("tiny_volume", n * F.col("voxel_mm3") < 20.0),
        ),
    )


def contact_area_diameter(n_contact: Column, voxel_mm3: Column) -> Column:
    """Diameter of the disc with the area of ``n_contact`` voxel faces."""
    return 2.0 * F.sqrt(n_contact * F.pow(voxel_mm3, F.lit(2.0 / 3.0)) / F.pi())


def with_path_reason(df: DataFrame, p: Params = DEFAULTS, out: str = "path_reason") -> DataFrame:
    """Minimum followable length; a contact reaching only along the wall must look like a tube."""
    follow = F.greatest(F.col("walk_mm"), F.col("extent_mm"), F.col("span_mm"))
    reported = F.greatest(F.col("walk_mm"), F.col("extent_mm"))
    aniso = F.col("sv1") / F.greatest(F.col("sv2"), F.lit(1e-3))
    # Tube test for span-only contacts.
    blob = (aniso < 1.50) | (F.col("sv1") < 5.0) | (F.col("med_vesselness") < 0.05)
    return df.withColumn(
        out,
        first_reason(("short_path", follow < p.min_path_mm), ("span_blob", (reported < p.min_path_mm) & blob)),
    )


def with_site_reason(df: DataFrame, p: Params = DEFAULTS, out: str = "site_reason") -> DataFrame:
    """Origins on a cut end of the parent, and the terminal split.

    Needs ``oz`` (origin slice), ``dir_z``, ``diameter_mm``, ``ostium_z_mm`` and the case columns
    ``z_first, z_last, lo_cap, hi_cap, parent_z_min_mm``.
    """
    z = F.rint("oz")
    m = p.cap_margin
    near_lo = F.col("lo_cap") & z.between(F.col("z_first") - m, F.col("z_first") + 1 + m)
    near_hi = F.col("hi_cap") & z.between(F.greatest(F.col("z_last") - 1, F.col("z_first")) - m, F.col("z_last") + m)
    cap = (near_lo | near_hi) & (F.abs(F.col("dir_z")) >= p.cap_dir_z)
    rise = F.col("ostium_z_mm") - F.col("parent_z_min_mm")
    terminal = (
        (F.col("diameter_mm") >= p.terminal_min_diameter_mm)
        & (rise <= p.terminal_window_mm)
        & (F.col("dir_z") <= p.terminal_dir_z)
        & (rise <= p.terminal_reach_mm)
    )
    return df.withColumn(out, first_reason(("crop_cap", cap), ("terminal_split", terminal)))


def with_calibre_reason(df: DataFrame, p: Params = DEFAULTS, out: str = "calibre_reason") -> DataFrame:
    tiny = (F.col("diameter_mm") < p.min_diameter_mm) & (F.col("radius_mm") < p.min_radius_mm)
    return df.withColumn(out, first_reason(("tiny_diam", tiny)))
