"""Voxel layer on the line-item lattice: masks, distances, labels, growth, features, views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import geometry as geo
from lumenframe.functions.rounding import r6
from lumenframe.operators import calibration, components, distance, features, growth, lattice, masks, ridge, rules, sections, stencil, views3d
from lumenframe.operators.percase import join_case
from lumenframe.params import DEFAULTS
from lumenframe.plans.catalog import lattice_sql as q
from lumenframe.plans.catalog import recursive_sql as rq
from lumenframe.plans.catalog.views import SIDE, SPACING_ZYX
from lumenframe.plans.catalog.views import lattice as lattice_view
from lumenframe.session import cut

CELL = lattice.CELL


def _vox(spark, sf) -> DataFrame:
    return cut(lattice_view(spark, sf), "lat")


def _grid(vox: DataFrame) -> DataFrame:
    sz, sy, sx = SPACING_ZYX
    lit = {"sz": sz, "sy": sy, "sx": sx, "z0": 0, "z1": SIDE - 1, "y0": 0, "y1": SIDE - 1, "x0": 0, "x1": SIDE - 1}
    return vox.select("case_id").distinct().select("case_id", *[F.lit(v).alias(k) for k, v in lit.items()])


def _cases(vox: DataFrame) -> DataFrame:
    sz, sy, sx = SPACING_ZYX
    return vox.select("case_id").distinct().select(
        "case_id", F.array(*[F.lit(SIDE)] * 3).alias("size"), F.array(F.lit(sx), F.lit(sy), F.lit(sz)).alias("spacing"),
        F.array(*[F.lit(0.0)] * 3).alias("origin"), F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)]).alias("direction"),
    )


def _r(*names):
    return [r6(F.col(n)).alias(n) for n in names]


def calibrated(spark, sf):
    c = calibration.calibrate(_vox(spark, sf))
    return c.select("case_id", "n_voxels", *_r("p05", "p10", "p50", "p90", "p95", "blood_low", "blood_high", "strict_low"))


def _zones(vox, radius=14.0):
    grid = _grid(vox)
    dist = distance.distance_to_parent(vox.where("parent"), grid, radius)
    cells = vox.join(dist, CELL, "left")
    calib = calibration.calibrate(vox)

    return masks.with_zone_masks(join_case(cells, calib)), grid, calib


def blood_mask_counts(spark, sf):
    vox = _vox(spark, sf)
    z, _, _ = _zones(vox)
    return z.groupBy("case_id").agg(F.count_if("blood").alias("n_blood"), F.count(F.lit(1)).alias("n"))


def shell_ring_outward(spark, sf):
    z, _, _ = _zones(_vox(spark, sf))
    return z.groupBy("case_id").agg(*[F.count_if(c).alias(f"n_{c}") for c in ("shell", "ring", "outward")])


def roi_bbox(spark, sf):
    vox = _vox(spark, sf)
    return geo.roi_box(vox, _cases(vox), 2.0)


def roi_crop(spark, sf):
    vox = _vox(spark, sf)
    return geo.crop(vox, geo.roi_box(vox, _cases(vox), 2.0)).select(*CELL, r6(F.col("hu")).alias("hu"))


def dilate26(spark, sf):
    return lattice.box_dilate(_vox(spark, sf).where("parent"))


def erode6(spark, sf):
    return lattice.erode6(_vox(spark, sf).where("hu > 250"))


def ball_opening(spark, sf):
    vox = _vox(spark, sf)
    return lattice.ball_open(vox.where("hu > 150"), 0.9, _grid(vox))


def ball_dilation(spark, sf):
    vox = _vox(spark, sf)
    return lattice.ball_dilate(vox.where("hu > 1000"), 1.7, _grid(vox))


def surface_voxels(spark, sf):
    return lattice.surface(_vox(spark, sf).where("parent"))


def _instances(vox):
    return vox.where((F.col("hu") > 700) & ~F.col("parent")).withColumn("inst_id", F.floor(F.col("z") / 4).cast("int"))


def contact_voxels(spark, sf):
    vox = _vox(spark, sf)
    return lattice.contact_cells(_instances(vox), vox.where("parent")).select("case_id", "inst_id", "z", "y", "x")


def ostium_points(spark, sf):
    vox = _vox(spark, sf)
    contact = lattice.contact_cells(_instances(vox), vox.where("parent"))
    o = features.centroids(lattice.ostium_cells(contact, vox.where("parent")))
    return o.select("case_id", "inst_id", *_r("oz", "oy", "ox"))


def face_contacts(spark, sf):
    vox = _vox(spark, sf)
    return lattice.face_contacts(_instances(vox), vox.where("parent"))


def distance_shell(spark, sf):
    vox = _vox(spark, sf)
    dist = distance.distance_to_parent(vox.where("parent"), _grid(vox), 14.0)
    return vox.select(*CELL).join(dist, CELL).select(*CELL, *_r("dist_mm"))


def lumen_depth(spark, sf):
    vox = _vox(spark, sf)
    d = distance.depth_inside(vox.where("parent OR hu > 700"), _grid(vox))
    return d.select(*CELL, *_r("depth_mm"))


def instance_depth(spark, sf):
    vox = _vox(spark, sf)
    d = distance.depth_inside(_instances(vox), _grid(vox), key=("inst_id",))
    return d.select("case_id", "inst_id", "z", "y", "x", *_r("depth_mm"))


def _responses(vox):
    """Zone masks and the tube response of the cells of calibrated cases, the adaptive threshold, the grid and the window."""
    grid, calib = cut(_grid(vox), "grid"), cut(calibration.calibrate(vox), "calib")
    maps = stencil.zone_maps(vox, grid.join(calib.select("case_id", "blood_low", "blood_high"), "case_id"))
    z = cut(masks.with_zone_masks(join_case(maps, calib)), "zones")
    return z, calibration.tube_threshold(z.where("blood AND shell"), grid.select("case_id")), grid, calib


def _seeded(vox):
    """Seed masks by the tube response."""
    z, thr, grid, _ = _responses(vox)

    return masks.with_seed_masks(join_case(z, thr), vox.where("parent"), grid), grid


def tube_threshold(spark, sf):
    _, t, _, _ = _responses(_vox(spark, sf))
    return t.select("case_id", *_r("v_thresh"))


def seed_mask(spark, sf):
    s, _ = _seeded(_vox(spark, sf))
    return s.where("seed").select(*CELL)


def allowed_mask(spark, sf):
    s, _ = _seeded(_vox(spark, sf))
    return s.where("allowed").select(*CELL)


def sheet_counts(spark, sf):
    s, _ = _seeded(_vox(spark, sf))
    return s.groupBy("case_id").agg(F.count_if("sheet").alias("n_sheet"), F.count_if("seed").alias("n_seed"))


def cap_slices(spark, sf):
    return masks.cap_slices(_vox(spark, sf))


def cap_seed_drop(spark, sf):
    vox = _vox(spark, sf)
    s, _ = _seeded(vox)
    return masks.drop_cap_seeds(s.where("seed").select(*CELL), masks.cap_slices(vox)).select(*CELL)


def _blood(vox):
    """Cells of the calibrated blood mask."""
    seen = join_case(vox, calibration.calibrate(vox).select("case_id", "blood_low", "blood_high"))
    return seen.where(F.col("hu").between(F.col("blood_low"), F.col("blood_high")) & ~F.col("parent")).select(*CELL)


def components26(spark, sf):
    lab = components.label_mask(_blood(_vox(spark, sf)))
    return lab.select(*CELL, F.col("label").cast("long").alias("label"))


def patch_table(spark, sf):
    vox = _vox(spark, sf)
    lab = components.label_mask(_blood(vox))
    return lab.groupBy("case_id", "label").agg(
        F.count(F.lit(1)).alias("n"), *[r6(F.avg(c)).alias(f"c{c}") for c in "zyx"]
    ).select("case_id", F.col("label").cast("long").alias("label"), "n", "cz", "cy", "cx")


def _markers(vox, again=True):
    """Markers, masks and grid; masks that are read ``again`` are written."""
    s, grid = _seeded(vox)
    s = cut(s, "seeded") if again else s
    seeds = masks.drop_cap_seeds(s.where("seed").select(*CELL), masks.cap_slices(vox))
    return components.merged_markers(seeds, grid, DEFAULTS.ostium_merge_mm), s, grid


def merged_markers(spark, sf):
    m, _, _ = _markers(_vox(spark, sf), again=False)
    return m.select(*CELL, F.col("label").cast("long").alias("label"))


def grow_labels(spark, sf):
    m, s, grid = _markers(_vox(spark, sf))
    return growth.grow(m, s.where("allowed"), grid).select(*CELL, F.col("label").cast("long").alias("label"), *_r("geo_mm"))


def grow_basins(spark, sf):
    """Bright cells around the parent by the contact patch they are nearest to along the cells."""
    vox = _vox(spark, sf)
    inst = cut(_quadrants(vox), "basins")
    marks = lattice.contact_cells(inst, vox.where("parent")).withColumn("label", F.col("inst_id").cast("long"))
    return growth.grow(marks, inst, _grid(vox)).select(*CELL, "label", *_r("geo_mm"))


def ridge_walk(spark, sf):
    vox = _vox(spark, sf)
    walks, _ = _walks(vox)
    return walks.select("case_id", "inst_id", "step", "z", "y", "x", *_r("cum_mm"))


def _quadrants(vox):
    """Bright cells around the parent, split by height and quadrant."""
    block = F.floor(F.col("z") / 4) * 4 + F.when(F.col("y") >= 12, 2).otherwise(0) + F.when(F.col("x") >= 12, 1).otherwise(0)
    return vox.where((F.col("hu") > 300) & ~F.col("parent")).withColumn("inst_id", block.cast("int"))


def _walks(vox):
    grid = _grid(vox)
    dist = distance.distance_to_parent(vox.where("parent"), grid, 14.0)
    inst = _quadrants(vox)
    inst = cut(inst.join(dist, CELL), "walk-inst")
    depth = distance.depth_inside(vox.where("parent OR hu > 300"), grid)
    contact = lattice.contact_cells(inst, vox.where("parent"))
    starts = features.centroids(lattice.ostium_cells(contact, vox.where("parent")), prefix="w").withColumn("walk_id", F.lit(0))
    return cut(ridge.ridge_walks(inst.join(depth, CELL), starts, grid), "walks"), grid


def walk_summary(spark, sf):
    walks, grid = _walks(_vox(spark, sf))
    s = ridge.walk_summary(walks, grid)
    return s.select("case_id", "inst_id", "seed_ok", "fork", *_r("walk_mm", "seed_z", "seed_y", "seed_x", "head_z", "head_y", "head_x"))


def pca_shape(spark, sf):
    vox = _vox(spark, sf)
    return features.pca(_instances(vox), _grid(vox)).select("case_id", "inst_id", "n_voxels", *[F.round(c, 4).alias(c) for c in ("sv1", "sv2", "sv3")])


def contact_spread(spark, sf):
    vox = _vox(spark, sf)
    c = lattice.contact_cells(_instances(vox), vox.where("parent"))
    return features.contact_spread(c, _grid(vox)).select("case_id", "inst_id", "n_contact", *_r("contact_spread_mm"))


def origin_diameter(spark, sf):
    vox = _vox(spark, sf)
    grid = _grid(vox)
    depth = distance.depth_inside(vox.where("parent OR hu > 700"), grid)
    c = lattice.contact_cells(_instances(vox), vox.where("parent")).join(depth, CELL, "left")
    return features.origin_diameter(c, grid).select("case_id", "inst_id", "n_contact", *_r("diameter_mm"))


def _ostia(vox):
    contact = lattice.contact_cells(_instances(vox), vox.where("parent"))
    return contact, features.centroids(lattice.ostium_cells(contact, vox.where("parent")))


def ostium_span(spark, sf):
    vox = _vox(spark, sf)
    _, o = _ostia(vox)
    return features.reach(_instances(vox), o, _grid(vox)).select("case_id", "inst_id", *_r("span_mm"))


def fallback_seeds(spark, sf):
    vox = _vox(spark, sf)
    grid = _grid(vox)
    dist = distance.distance_to_parent(vox.where("parent"), grid, 14.0)
    _, o = _ostia(vox)
    out = features.fallback_seeds(_instances(vox).join(dist, CELL), o, grid)
    return out.select("case_id", "inst_id", "far_z", "far_y", "far_x")


def _headed(vox):
    _, o = _ostia(vox)
    mid = features.centroids(_instances(vox), prefix="c")
    sz, sy, sx = SPACING_ZYX
    j = o.join(mid, ["case_id", "inst_id"])
    return j.select("case_id", "inst_id", "oz", "oy", "ox", "cz", "cy", "cx",
                    ((F.col("cz") - F.col("oz")) * sz).alias("head_z"), ((F.col("cy") - F.col("oy")) * sy).alias("head_y"), ((F.col("cx") - F.col("ox")) * sx).alias("head_x"))


def context_fractions(spark, sf):
    vox = _vox(spark, sf)
    z, grid, calib = _zones(vox)
    return features.context_fractions(_headed(vox), z, calib, grid).select("case_id", "inst_id", *_r("bone_frac", "adj_lumen_frac"))


def plane_radius(spark, sf):
    vox = _vox(spark, sf)
    h = _headed(vox).select("case_id", "inst_id", F.col("cz").alias("seed_z"), F.col("cy").alias("seed_y"), F.col("cx").alias("seed_x"), "head_z", "head_y", "head_x")
    out = sections.plane_radius(h, vox, calibration.calibrate(vox), _grid(vox), ["case_id", "inst_id"])
    return out.select("case_id", "inst_id", *_r("plane_radius_mm"))


def path_consistency(spark, sf):
    vox = _vox(spark, sf)
    walks, grid = _walks(vox)
    inst = _quadrants(vox)
    depth = distance.depth_inside(inst, grid, key=("inst_id",))
    out = sections.path_consistency(walks.select("case_id", "inst_id", "step", "z", "y", "x"), depth, grid, ["case_id", "inst_id"])
    return out.select("case_id", "inst_id", *_r("radius_cv", "circularity"))


def strip_landmarks(spark, sf):
    vox = _vox(spark, sf)
    inst = vox.where((F.col("hu") > 700) & ~F.col("parent")).withColumn("inst_id", (F.col("x") > 12).cast("int"))
    contact = lattice.contact_cells(inst, vox.where("parent"))
    out = features.strip_landmarks(contact, inst, _grid(vox))
    return out.select("case_id", "inst_id", *_r(*[f"strip_{e}{c}" for e in "os" for c in "zyx"]))


def quality_reasons(spark, sf):
    vox = _vox(spark, sf)
    z, thr, grid, calib = _responses(vox)
    inst = _instances(z.select("case_id", "z", "y", "x", "hu", "parent", "vesselness")).withColumn("inst_id", F.col("inst_id") * 24 + F.col("y"))
    shape = features.pca(inst, grid)
    contact = lattice.contact_cells(inst, vox.where("parent")).groupBy("case_id", "inst_id").agg(F.count(F.lit(1)).alias("n_contact"))
    f = shape.join(features.intensity(inst), ["case_id", "inst_id"]).join(contact, ["case_id", "inst_id"], "left").fillna(0, ["n_contact"])

    f = join_case(join_case(f, calib.select("case_id", "p10", "p50", "blood_low")), thr).withColumn("voxel_mm3", F.lit(1.5 * 0.8 * 0.8))
    return rules.with_quality_reason(f).select("case_id", "inst_id", F.col("quality_reason").alias("reason"))


def tube_filter(spark, sf):
    vox = _vox(spark, sf)
    out = stencil.tube_response(vox, _grid(vox))
    return out.select(*CELL, F.round("vesselness", 5).alias("vesselness"))


def mip_slab(spark, sf):
    vox = _vox(spark, sf)
    pts = vox.where("parent").groupBy("case_id").agg(F.avg("z").alias("pz")).withColumn("id", F.lit(1))
    return views3d.slab_maximum(pts, "id", "pz", vox, 2).select("case_id", "y", "x", *_r("mip"), "parent")


def display_window(spark, sf):
    vox = _vox(spark, sf)
    w = views3d.display_window(vox)

    j = join_case(vox, w).where("parent")
    return j.select(*CELL, r6(views3d.windowed(F.col("hu"), F.col("lo"), F.col("hi"))).alias("shade"))


def plane_crops(spark, sf):
    vox = _vox(spark, sf)
    pts = vox.where("parent").groupBy("case_id").agg(*[F.avg(c).alias(f"p{c}") for c in "zyx"]).withColumn("id", F.lit(1))
    return views3d.plane_crops(pts, "id", ("pz", "py", "px"), vox, 6, ["hu", "parent"]).select("case_id", "view", "u", "v", *_r("hu"), "parent")


def _points(vox):
    return vox.select("case_id", (F.col("z") * 24 * 24 + F.col("y") * 24 + F.col("x")).alias("id"), (F.col("z") + 0.3).alias("pz"), (F.col("y") - 0.4).alias("py"), (F.col("x") + 0.2).alias("px"))


def point_samples(spark, sf):
    vox = _vox(spark, sf)
    pts = _points(vox).withColumn("py", F.col("py") + 1)
    return views3d.sample_at(pts, ("pz", "py", "px"), vox, ["hu", "parent"]).select("case_id", "id", *_r("hu"), "parent")


def ball_stats(spark, sf):
    vox = _vox(spark, sf)
    return views3d.box_stats(_points(vox), "id", ("pz", "py", "px"), vox, "hu", _grid(vox), 1.5).select("case_id", "id", "n", *_r("min", "p50", "max"))


def ball_share(spark, sf):
    vox = _vox(spark, sf)
    return views3d.box_share(_points(vox), "id", ("pz", "py", "px"), vox, "parent", _grid(vox), 1.5).select("case_id", "id", "sum", *_r("frac"))


LATTICE_QUERIES = {
    "calibration": (calibrated, q.CALIBRATION),
    "blood_mask_counts": (blood_mask_counts, q.BLOOD_COUNTS),
    "shell_ring_outward": (shell_ring_outward, q.ZONE_COUNTS),
    "roi_bbox": (roi_bbox, q.ROI_BOX),
    "roi_crop": (roi_crop, q.ROI_CROP),
    "dilate26": (dilate26, q.DILATE26),
    "erode6": (erode6, q.ERODE6),
    "ball_dilation": (ball_dilation, q.BALL_DILATION),
    "ball_opening": (ball_opening, q.BALL_OPENING),
    "surface_voxels": (surface_voxels, q.SURFACE),
    "contact_voxels": (contact_voxels, q.CONTACT),
    "ostium_points": (ostium_points, q.OSTIUM),
    "face_contacts": (face_contacts, q.FACES),
    "distance_shell": (distance_shell, q.DISTANCE),
    "lumen_depth": (lumen_depth, q.DEPTH),
    "instance_depth": (instance_depth, q.INSTANCE_DEPTH),
    "tube_threshold": (tube_threshold, q.TUBE_THRESHOLD),
    "seed_mask": (seed_mask, q.SEEDS),
    "allowed_mask": (allowed_mask, q.ALLOWED),
    "sheet_counts": (sheet_counts, q.SHEET),
    "cap_slices": (cap_slices, q.CAPS),
    "cap_seed_drop": (cap_seed_drop, q.CAP_DROP),
    "components26": (components26, q.COMPONENTS),
    "patch_table": (patch_table, q.PATCHES),
    "merged_markers": (merged_markers, rq.MARKERS),
    "grow_labels": (grow_labels, rq.GROWN),
    "grow_basins": (grow_basins, rq.BASINS),
    "ridge_walk": (ridge_walk, rq.WALKS),
    "walk_summary": (walk_summary, rq.SUMMARY),
    "pca_shape": (pca_shape, q.PCA),
    "contact_spread": (contact_spread, q.SPREAD),
    "origin_diameter": (origin_diameter, q.DIAMETER),
    "ostium_span": (ostium_span, q.SPAN),
    "fallback_seeds": (fallback_seeds, q.FALLBACK),
    "context_fractions": (context_fractions, q.CONTEXT),
    "plane_radius": (plane_radius, q.PLANE_RADIUS),
    "path_consistency": (path_consistency, None),
    "strip_landmarks": (strip_landmarks, None),
    "quality_reasons": (quality_reasons, q.QUALITY),
    "tube_filter": (tube_filter, q.TUBE_FILTER),
    "mip_slab": (mip_slab, q.MIP),
    "display_window": (display_window, q.WINDOW),
    "plane_crops": (plane_crops, q.PLANES),
    "point_samples": (point_samples, q.SAMPLES),
    "ball_stats": (ball_stats, q.BALL_STATS),
    "ball_share": (ball_share, q.BALL_SHARE),
}

