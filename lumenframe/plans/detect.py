"""From voxel tables to numbered branch landmarks, for a whole cohort at once.

Every stage is a set-based job over all cases. Large intermediate tables are written to the shared
folder once (``cut``), because several later stages read them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenframe.functions import geometry as geo
from lumenframe.functions import linalg as la
from lumenframe.operators import (
    calibration,
    components,
    distance,
    features,
    growth,
    lattice,
    masks,
    resolve,
    review,
    ridge,
    rules,
    sections,
    splitting,
    stencil,
)
from lumenframe.operators.percase import join_case
from lumenframe.params import DEFAULTS, Params
from lumenframe.session import cut, known_rows, unsent

CELL = lattice.CELL
INST = features.INST


@dataclass
class SearchMaps:
    """Voxel maps of the cohort, cropped to the region around each parent."""

    grid: DataFrame  # case_id, sz, sy, sx, bounds
    calib: DataFrame  # intensity window and v_thresh per case
    cells: DataFrame  # hu, parent, dist_mm, vesselness and the masks per voxel
    caps: DataFrame


@dataclass
class Detection:
    landmarks: DataFrame  # numbered branches in LPS millimetres with their features
    rejected: DataFrame  # case_id, inst_id, reason
    decisions: DataFrame  # duplicate pairs with their reason and loser
    instances: DataFrame  # labelled cells
    maps: SearchMaps


def search_maps(voxels: DataFrame, cases: DataFrame, p: Params = DEFAULTS, fill: float = 0.0) -> SearchMaps:
    calib = cut(calibration.calibrate(voxels, p), "calib")
    box = geo.roi_box(voxels, cases, p.crop_margin_mm).join(calib.select("case_id"), "case_id", "left_semi")
    spacing = cases.select("case_id", *[F.get("spacing", i).alias(f"s{c}") for c, i in (("z", 2), ("y", 1), ("x", 0))])
    grid = cut(box.join(spacing, "case_id"), "grid")
    cells = geo.crop(voxels.select(*CELL, "hu", "parent"), grid.select("case_id", *distance.BOX))
    cells = unsent(cells, known_rows(voxels))
    # all voxels are written once; masks are cheaper to read off again than to write
    zones = cut(stencil.zone_maps(cells, grid.join(calib.select("case_id", "blood_low", "blood_high"), "case_id"), p, fill), "zones")
    parent = zones.where("parent").select(*CELL)
    support = masks.with_zone_masks(join_case(zones, calib, "blood_low", "blood_high"), p).where("blood AND shell")
    calib = cut(calib.join(calibration.tube_threshold(support, grid, p=p), "case_id"), "calib")
    seeded = masks.with_zone_masks(join_case(zones, calib, "blood_low", "blood_high", "p10", "v_thresh"), p)
    keep = [*CELL, "hu", "parent", "dist_mm", "vesselness", "blood", "shell", "ring", "outward", "seed", "sheet", "allowed"]
    seeded = masks.with_seed_masks(seeded, parent, grid, p).select(*keep)
    seeded = unsent(seeded, known_rows(zones)) if masks.coarse_cases(grid, p).isEmpty() else cut(seeded, "maps")
    return SearchMaps(grid, calib, seeded, cut(masks.cap_slices(zones, p), "caps"))


def grow_instances(maps: SearchMaps, p: Params = DEFAULTS) -> DataFrame:
    """Labelled cells ``(case_id, inst_id, z, y, x, hu, vesselness, dist_mm, depth_mm)``."""
    seeds = masks.drop_cap_seeds(maps.cells.where("seed").select(*CELL), maps.caps, p)
    markers = cut(components.merged_markers(seeds, maps.grid, p.ostium_merge_mm), "markers")
    values = cut(maps.cells.where("allowed").select(*CELL, "hu", "vesselness", "dist_mm"), "allowed")
    grown = growth.grow(markers, values, maps.grid)
    depth = distance.depth_inside(maps.cells.where("blood OR parent"), maps.grid)
    cells = grown.select(*CELL, F.col("label").alias("inst_id")).join(values, CELL).join(depth, CELL, "left")
    return cut(cells.withColumn("depth_mm", F.coalesce("depth_mm", F.lit(0.0))), "instances")


def _only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the instances ``keys``; a join hides how many they can be, and files of cells look small."""
    return unsent(rows.join(keys, INST, "left_semi"), known_rows(rows))


def build_candidates(inst: DataFrame, maps: SearchMaps, cases: DataFrame, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Feature rows of surviving instances, and ``(case_id, inst_id, reason)`` of the others."""
    parent = maps.cells.where("parent").select(*CELL)
    contact = cut(lattice.contact_cells(inst, parent), "contact")
    touched = contact.select(*INST).distinct()
    untouched = inst.select(*INST).distinct().join(touched, INST, "left_anti").withColumn("reason", F.lit("no_parent_contact"))
    live = _only(inst, touched)
    ostia = cut(features.centroids(lattice.ostium_cells(contact, parent)), "ostia")
    starts = ostia.select(*INST, F.lit(0).alias("walk_id"), *[F.col(f"o{c}").alias(f"w{c}") for c in "zyx"])
    walks = cut(ridge.ridge_walks(live, starts, maps.grid, p), "walks")
    f = (
        ostia.join(features.origin_diameter(contact, maps.grid), INST)
        .join(features.reach(live, ostia, maps.grid), INST)
        .join(ridge.walk_summary(walks, maps.grid, p).drop("walk_id"), INST)
        .join(features.pca(live, maps.grid).select(*INST, "n_voxels", "sv1", "sv2"), INST)
        .join(features.intensity(live), INST)
    )
    f = cut(rules.with_path_reason(f, p), "features")
    short = f.where(F.col("path_reason").isNotNull()).select(*INST, F.col("path_reason").alias("reason"))

    # walks that fell short take a far cell as their seed
    f = f.where(F.col("path_reason").isNull())
    far = features.fallback_seeds(_only(live, f.select(*INST)), ostia, maps.grid, p)
    f = f.join(far, INST, "left")
    f = join_case(f, maps.grid, "sz", "sy", "sx")
    use = ~(F.col("seed_ok") & (F.col("walk_mm") >= p.min_path_mm)) & F.col("far_z").isNotNull()
    f = f.withColumn("path_mm", F.greatest("walk_mm", "extent_mm"))
    f = f.withColumns({f"seed_{c}": F.when(use, F.col(f"far_{c}")).otherwise(F.col(f"seed_{c}")) for c in "zyx"})
    step = [(F.col(f"seed_{c}") - F.col(f"o{c}")) * F.col(f"s{c}") for c in "zyx"]
    n = la.norm(step)
    f = f.withColumns({f"head_{c}": F.when(use & (n > 1e-6), s / n).otherwise(F.col(f"head_{c}")) for c, s in zip("zyx", step)})
    f = features.landmarks_mm(features.direction_xyz(f), cases)
    low = join_case(parent, cases, "spacing", "origin", "direction")
    low = low.groupBy("case_id").agg(F.min(geo.zyx_to_mm(F.col("z"), F.col("y"), F.col("x"))[2]).alias("parent_z_min_mm"))
    f = join_case(f, cut(maps.caps.join(low, "case_id"), "sites")).withColumn("ostium_z_mm", F.col("z"))
    f = cut(rules.with_site_reason(f, p).drop(*maps.caps.columns[1:], "parent_z_min_mm"), "sited")
    sited = f.where(F.col("site_reason").isNotNull()).select(*INST, F.col("site_reason").alias("reason"))

    # calibre and quality
    f = f.where(F.col("site_reason").isNull())
    own = cut(distance.depth_inside(_only(live, f.select(*INST)), maps.grid, key=("inst_id",)), "own-depth")
    at_seed = f.select(*INST, *[F.rint(f"seed_{c}").cast("int").alias(c) for c in "zyx"]).join(own, [*INST, "z", "y", "x"])
    f = f.join(at_seed.select(*INST, F.col("depth_mm").alias("depth_at_seed")), INST, "left")
    heads = f.select(*INST, *[f"seed_{c}" for c in "zyx"], *[f"head_{c}" for c in "zyx"])
    f = f.join(sections.plane_radius(heads, maps.cells, maps.calib, maps.grid, INST), INST)
    f = f.withColumns({"radius_mm": sections.seed_radius(f), "voxel_mm3": features.voxel_mm3()})
    f = join_case(f, maps.calib, "p10", "p50", "blood_low", "v_thresh")
    f = rules.with_quality_reason(rules.with_calibre_reason(f, p), p)
    f = cut(f.withColumn("reason", F.coalesce("calibre_reason", "quality_reason")), "judged")
    weak = f.where(F.col("reason").isNotNull()).select(*INST, "reason")

    # expensive features only for the rest
    f = f.where(F.col("reason").isNull()).drop("reason")
    keep = f.select(*INST)
    ends = [
        _only(ostia, keep).select(*INST, F.lit(-1).alias("step"), *[F.col(f"o{c}").alias(c) for c in "zyx"]),
        _only(walks, keep).select(*INST, "step", *[F.col(c).cast("double").alias(c) for c in "zyx"]),
        f.select(*INST, F.lit(1_000_000).alias("step"), *[F.col(f"seed_{c}").alias(c) for c in "zyx"]),
    ]
    points = ends[0].unionByName(ends[1]).unionByName(ends[2])
    stable = sections.path_consistency(points, _only(own, keep), maps.grid, INST, p)
    context = features.context_fractions(f.select(*INST, "oz", "oy", "ox", "head_z", "head_y", "head_x"), maps.cells, maps.calib, maps.grid, p)
    along = f.where(F.col("path_mm") < p.min_path_mm).select(*INST)
    strip = features.strip_landmarks(_only(contact, along), _only(live, along), maps.grid, p)
    f = f.join(stable, INST, "left").join(context, INST, "left").join(strip, INST, "left")
    f = f.withColumn("radius_mm", F.greatest("radius_mm", 0.5 * F.least("sz", "sy", "sx")))
    rejected = untouched.unionByName(short).unionByName(sited).unionByName(weak)
    return cut(f, "candidates"), rejected


def finish(cands: DataFrame, cases: DataFrame, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Duplicate collapse, artefact rules, final landmarks and numbering."""
    c = cands.withColumn("id", F.col("inst_id"))
    if "split_derived" not in c.columns:
        c = c.withColumn("split_derived", F.lit(False))
    points = c.withColumnsRenamed({"med_vesselness": "v"}).select(
        "case_id", "id", "x", "y", "z", F.col("seed_x_mm").alias("sx"), F.col("seed_y_mm").alias("sy"), F.col("seed_z_mm").alias("sz"),
        F.col("dir_x").alias("dx"), F.col("dir_y").alias("dy"), F.col("dir_z").alias("dz"), "path_mm", "diameter_mm", F.col("v").alias("vesselness"), "split_derived",
    )
    points = cut(points, "dup-points")
    near = cut(resolve.near_duplicate_pairs(points, p), "near-pairs")
    kept = cut(points.join(resolve.ordered_drops(near.where(F.col("loser").isNotNull())), ["case_id", "id"], "left_anti"), "near-kept")
    paths = cut(resolve.path_merge_pairs(kept, p), "path-pairs")
    kept = kept.join(resolve.ordered_drops(paths.where(F.col("loser").isNotNull())), ["case_id", "id"], "left_anti")
    decisions = near.withColumn("stage", F.lit("near_dup")).unionByName(paths.withColumn("stage", F.lit("path_merge")), allowMissingColumns=True)
    out = c.join(kept.select("case_id", "id"), ["case_id", "id"], "left_semi").withColumn("vesselness", F.col("med_vesselness"))
    out = rules.with_artifact_reason(out, p, "artifact")
    if not p.quality_filter:
        out = out.withColumn("artifact", F.lit(None).cast("string"))
    dropped = out.where(F.col("artifact").isNotNull()).select(*INST, F.concat(F.lit("quality:"), F.col("artifact")).alias("reason"))
    out = out.where(F.col("artifact").isNull())
    out = out.withColumns({f"seed_{x}": F.coalesce(f"strip_s{x}", f"seed_{x}") for x in "zyx"})
    out = out.withColumns({f"o{x}": F.coalesce(f"strip_o{x}", f"o{x}") for x in "zyx"})
    out = features.clamp_seed(out, p).drop("x", "y", "z", "seed_x_mm", "seed_y_mm", "seed_z_mm")
    out = features.landmarks_mm(features.direction_xyz(out), cases)
    final = out.select(
        "case_id", "id", "x", "y", "z", F.col("seed_x_mm").alias("sx"), F.col("seed_y_mm").alias("sy"), F.col("seed_z_mm").alias("sz"),
        F.col("dir_x").alias("dx"), F.col("dir_y").alias("dy"), F.col("dir_z").alias("dz"), "radius_mm", "path_mm", "diameter_mm",
        "n_voxels", "mean_hu", "vesselness", "extent_mm", "radius_cv", "circularity", "bone_frac", "adj_lumen_frac", "split_derived",
    )
    return review.number_branches(cut(final, "final")), dropped, decisions


def detect(voxels: DataFrame, cases: DataFrame, p: Params = DEFAULTS, fill: float = 0.0) -> Detection:
    """``voxels(case_id, z, y, x, hu, parent)`` and ``cases(case_id, size, spacing, origin, direction)``.

    Voxels without a row count as ``fill`` in the tube filter and as background elsewhere.
    """
    maps = search_maps(voxels, cases, p, fill)
    inst = grow_instances(maps, p)
    cands, rejected = build_candidates(inst, maps, cases, p)
    if p.split_contacts:
        cands, rejected = splitting.replace_split(cands, rejected, inst, maps, cases, p, build_candidates)
    landmarks, dropped, decisions = finish(cands, cases, p)
    seedless = maps.grid.select("case_id").join(maps.cells.where("seed").select("case_id").distinct(), "case_id", "left_anti")
    none = seedless.select("case_id", F.lit(None).cast("long").alias("inst_id"), F.lit("no_seeds").alias("reason"))
    return Detection(landmarks, rejected.unionByName(dropped).unionByName(none), decisions, inst, maps)


def reject_report(rejected: DataFrame, first: int = 12) -> DataFrame:
    """First reasons of each case in instance order, and how many more there are."""
    order = W.partitionBy("case_id").orderBy(F.coalesce("inst_id", F.lit(0)), "reason")
    top = rejected.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= first)
    text = F.concat(F.lit("id"), F.coalesce(F.col("inst_id").cast("string"), F.lit("-")), F.lit(":"), F.col("reason"))
    shown = top.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", text.alias("t")))), lambda s: s["t"]).alias("reasons"))
    total = rejected.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_rejected"))
    return total.join(shown, "case_id").withColumn("n_more", F.greatest(F.col("n_rejected") - first, F.lit(0)))
