"""Per-instance features as grouped aggregates.

Instance tables: ``(case_id, inst_id, z, y, x)`` plus per-cell values; ``spacing(case_id, sz, sy, sx)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import geometry as geo
from lumenframe.functions import linalg as la
from lumenframe.operators.bricks import spread
from lumenframe.operators.percase import exact_quantiles, join_case
from lumenframe.operators.rules import contact_area_diameter
from lumenframe.params import DEFAULTS, Params
from lumenframe.session import unsent

INST = ["case_id", "inst_id"]


def in_mm(cells: DataFrame, spacing: DataFrame) -> DataFrame:
    """Adds physical offsets ``pz, py, px`` (index times spacing)."""
    j = join_case(cells, spacing, "sz", "sy", "sx")
    return j.withColumns({f"p{c}": F.col(c) * F.col(f"s{c}") for c in "zyx"})


def pca(cells: DataFrame, spacing: DataFrame, key: Sequence[str] = INST) -> DataFrame:
    """Singular values ``sv1..sv3`` of the centred cloud and its main axis, from mergeable moments."""
    g = in_mm(cells, spacing).groupBy(*key).agg(F.count(F.lit(1)).alias("n_voxels"), *la.moments(["pz", "py", "px"]))
    g = la.with_main_axis(la.with_eigenvalues(g, "m", "ev"), "m", "ev1", "axis")
    sv = {f"sv{i}": F.sqrt(F.greatest(F.col("n_voxels") * F.col(f"ev{i}"), F.lit(0.0))) for i in (1, 2, 3)}
    return g.withColumns(sv).select(*key, "n_voxels", "sv1", "sv2", "sv3", "axis_a", "axis_b", "axis_c")


def centroids(cells: DataFrame, key: Sequence[str] = INST, prefix: str = "o") -> DataFrame:
    return cells.groupBy(*key).agg(*[F.avg(c).alias(f"{prefix}{c}") for c in "zyx"])


def contact_spread(contact: DataFrame, spacing: DataFrame, key: Sequence[str] = INST) -> DataFrame:
    """Largest distance of a contact cell from the contact centroid."""
    mm = in_mm(contact, spacing)
    mid = mm.groupBy(*key).agg(*[F.avg(f"p{c}").alias(f"c{c}") for c in "zyx"])
    d = la.norm([F.col(f"p{c}") - F.col(f"c{c}") for c in "zyx"])
    return mm.join(mid, list(key)).groupBy(*key).agg(F.max(d).alias("contact_spread_mm"), F.count(F.lit(1)).alias("n_contact"))


def voxel_mm3() -> Column:
    return F.col("sz") * F.col("sy") * F.col("sx")


def origin_diameter(contact: DataFrame, spacing: DataFrame, key: Sequence[str] = INST) -> DataFrame:
    """Larger of the contact-area diameter and twice the deepest lumen radius on the contact.

    ``contact`` carries ``depth_mm``.
    """
    g = contact.groupBy(*key).agg(F.count(F.lit(1)).alias("n_contact"), F.max("depth_mm").alias("__r"))
    g = join_case(g, spacing, "sz", "sy", "sx")
    area = contact_area_diameter(F.col("n_contact"), voxel_mm3())
    return g.select(*key, "n_contact", F.greatest(area, 2.0 * F.coalesce("__r", F.lit(0.0))).alias("diameter_mm"))


def reach(cells: DataFrame, ostia: DataFrame, spacing: DataFrame, key: Sequence[str] = INST) -> DataFrame:
    """Outward extent (largest wall distance) and span (largest distance from the origin point)."""
    j = join_case(cells.join(ostia.select(*key, "oz", "oy", "ox"), list(key)), spacing, "sz", "sy", "sx")
    d = la.norm([(F.col(c) - F.col(f"o{c}")) * F.col(f"s{c}") for c in "zyx"])
    aggs = [F.max(d).alias("span_mm")]
    if "dist_mm" in cells.columns:
        aggs.append(F.max("dist_mm").alias("extent_mm"))
    return j.groupBy(*key).agg(*aggs)


def intensity(cells: DataFrame, key: Sequence[str] = INST) -> DataFrame:
    """Mean intensity and median tube response."""
    mean = cells.groupBy(*key).agg(F.avg("hu").alias("mean_hu"))
    return mean.join(exact_quantiles(cells, list(key), "vesselness", [0.5], ["med_vesselness"]), list(key))


def fallback_seeds(cells: DataFrame, ostia: DataFrame, spacing: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Seed of instances whose walk failed: the far cell best at the minimum distance.

    Far means at least ``min_path_mm`` from the wall, or, when no cell is, from the origin. The
    score prefers cells close to that distance from the origin and deep in the shell; ties go to
    the first cell in scan order.
    """
    j = join_case(cells.join(ostia.select(*INST, "oz", "oy", "ox"), INST), spacing, "sz", "sy", "sx")
    step = [(F.col(c) - F.col(f"o{c}")) * F.col(f"s{c}") for c in "zyx"]
    d2 = la.dot(step, step)
    lim = p.min_path_mm * p.min_path_mm
    score = F.struct((F.abs(d2 - lim) - 2.0 * F.col("dist_mm")).alias("s"), F.col("z"), F.col("y"), F.col("x"))
    at = F.struct("z", "y", "x")
    wall, far = F.col("dist_mm") >= p.min_path_mm, d2 >= lim
    g = j.groupBy(*INST).agg(F.min_by(at, F.when(wall, score)).alias("a"), F.min_by(at, F.when(far, score)).alias("b"))
    pick = F.coalesce("a", "b")
    return g.where(pick.isNotNull()).select(*INST, *[pick[c].cast("double").alias(f"far_{c}") for c in "zyx"])


def context_fractions(ostia: DataFrame, voxels: DataFrame, calib: DataFrame, spacing: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Bone fraction and leftover-lumen fraction in the outward half ball of each origin.

    ``ostia(case_id, inst_id, oz, oy, ox, head_z, head_y, head_x)``; ``voxels`` carries hu, parent
    and blood. Every origin probes the fixed box of lattice cells around it.
    """
    o = spread(join_case(ostia, spacing, "sz", "sy", "sx"), INST)
    r = p.context_radius_mm
    for c in "zyx":
        n = F.ceil(F.lit(r) / F.col(f"s{c}")).cast("int") + 1
        mid = F.col(f"o{c}").cast("int")
        o = o.withColumn(c, F.explode(F.sequence(mid - n, mid + n)))
    off = {c: (F.col(c) - F.col(f"o{c}")) * F.col(f"s{c}") for c in "zyx"}
    hn = la.norm([F.col(f"head_{c}") for c in "zyx"])
    o = o.withColumns({"__d2": la.dot(list(off.values()), list(off.values())), "__ax": la.dot(list(off.values()), [F.col(f"head_{c}") / hn for c in "zyx"])})
    o = o.where((F.sqrt("__d2") <= r) & (F.col("__ax") >= -1.0) & (hn >= 1e-8))
    probe = o.select(*INST, "z", "y", "x", (F.col("__d2") - F.col("__ax") * F.col("__ax")).alias("radial2"), voxel_mm3().alias("mm3"))
    near = unsent(probe).join(voxels.select("case_id", "z", "y", "x", "hu", "parent", "blood"), ["case_id", "z", "y", "x"]).where(~F.col("parent"))
    near = join_case(near, calib.select("case_id", F.greatest(F.col("blood_high"), F.col("p95") + 40.0).alias("bone_hu")))
    left = F.col("blood") & (F.col("radial2") > p.tube_clear_mm * p.tube_clear_mm)
    half_ball = max(2.0 / 3.0 * 3.141592653589793 * r**3, 1.0)
    g = near.groupBy(*INST).agg(
        F.avg((F.col("hu") >= F.col("bone_hu")).cast("double")).alias("bone_frac"),
        F.least(F.lit(1.0), F.sum(F.when(left, F.col("mm3")).otherwise(0.0)) / half_ball).alias("adj_lumen_frac"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return ostia.select(*INST).join(g, INST, "left").select(*INST, zero("bone_frac"), zero("adj_lumen_frac"))


def strip_landmarks(contact: DataFrame, cells: DataFrame, spacing: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Landmarks of contacts that run along the wall as a strip: the origin end and a seed along it.

    Only contacts of at least six cells, anisotropy 1.8 and span 5 mm qualify; others have no row.
    """
    shape = pca(contact, spacing)
    mm = in_mm(contact, spacing).join(shape, INST)
    mid = in_mm(contact, spacing).groupBy(*INST).agg(*[F.avg(f"p{c}").alias(f"c{c}") for c in "zyx"])
    proj = la.dot([F.col(f"p{c}") - F.col(f"c{c}") for c in "zyx"], la.cols("axis_a", "axis_b", "axis_c"))
    mm = mm.join(mid, INST).withColumn("t", proj)
    at = F.struct("pz", "py", "px")
    order = F.struct("t", "z", "y", "x")
    ends = mm.groupBy(*INST).agg(
        F.count(F.lit(1)).alias("n"), F.first("sv1").alias("sv1"), F.first("sv2").alias("sv2"),
        (F.max("t") - F.min("t")).alias("span"), F.min_by(at, order).alias("e0"), F.max_by(at, F.struct(F.col("t"), -F.col("z"), -F.col("y"), -F.col("x"))).alias("e1"),
    )
    # Limits of a strip.
    ok = (F.col("n") >= 6) & (F.col("sv1") / F.greatest("sv2", F.lit(1e-3)) >= 1.80) & (F.col("span") >= 5.0)
    axis = [F.col(f"e1.p{c}") - F.col(f"e0.p{c}") for c in "zyx"]
    ends = ends.where(ok & (la.norm(axis) >= 1e-6))
    ends = ends.withColumns({f"u{c}": a / la.norm(axis) for c, a in zip("zyx", axis)})
    u = la.cols("uz", "uy", "ux")
    body = in_mm(cells, spacing).select(*INST, "z", "y", "x", "pz", "py", "px").join(ends.select(*INST, "e0", "e1", "uz", "uy", "ux"), INST)
    from0 = la.dot([F.col(f"p{c}") - F.col(f"e0.p{c}") for c in "zyx"], u)
    from1 = -la.dot([F.col(f"p{c}") - F.col(f"e1.p{c}") for c in "zyx"], u)
    far = body.groupBy(*INST).agg(F.max(from0).alias("r0"), F.max(from1).alias("r1"))
    start = F.when(F.col("r0") >= F.col("r1"), F.col("e0")).otherwise(F.col("e1"))
    sign = F.when(F.col("r0") >= F.col("r1"), 1.0).otherwise(-1.0)
    o = ends.join(far, INST).select(*INST, start.alias("s"), *[(sign * F.col(f"u{c}") * p.min_path_mm).alias(f"d{c}") for c in "zyx"])
    target = body.select(*INST, "z", "y", "x", "pz", "py", "px").join(o, INST)
    gap = [F.col(f"p{c}") - (F.col(f"s.p{c}") + F.col(f"d{c}")) for c in "zyx"]
    near = target.groupBy(*INST).agg(
        F.min_by(F.struct("z", "y", "x"), F.struct(la.dot(gap, gap).alias("g"), F.col("z"), F.col("y"), F.col("x"))).alias("seed"), F.first("s").alias("s")
    )
    near = join_case(near, spacing, "sz", "sy", "sx")
    return near.select(
        *INST, *[(F.col(f"s.p{c}") / F.col(f"s{c}")).alias(f"strip_o{c}") for c in "zyx"], *[F.col(f"seed.{c}").cast("double").alias(f"strip_s{c}") for c in "zyx"]
    )


def clamp_seed(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Moves the seed to exactly ``min_path_mm`` from the origin and recomputes the heading.

    Needs oz..ox, seed_z..seed_x, head_z..head_x and sz..sx; coinciding landmarks head along +z.
    """
    step = [(F.col(f"seed_{c}") - F.col(f"o{c}")) * F.col(f"s{c}") for c in "zyx"]
    df = df.withColumn("__n", la.norm(step))
    unit = [F.when(F.col("__n") > 1e-6, s / F.col("__n")).otherwise(F.lit(f)) for s, f in zip(step, (1.0, 0.0, 0.0))]
    df = df.withColumns({f"__u{c}": u for c, u in zip("zyx", unit)})
    moved = {f"seed_{c}": F.col(f"o{c}") + F.col(f"__u{c}") * p.min_path_mm / F.col(f"s{c}") for c in "zyx"}
    heads = {f"head_{c}": F.col(f"__u{c}") for c in "zyx"}
    return df.withColumns({**moved, **heads}).drop("__n", "__uz", "__uy", "__ux")


def direction_xyz(df: DataFrame) -> DataFrame:
    """Heading as a unit (x, y, z) vector; a vanishing heading becomes +X."""
    v = la.unit_or([F.col("head_x"), F.col("head_y"), F.col("head_z")], (1.0, 0.0, 0.0))
    return df.withColumns({"dir_x": v[0], "dir_y": v[1], "dir_z": v[2]})


def landmarks_mm(df: DataFrame, cases: DataFrame) -> DataFrame:
    """Adds x, y, z and sx_mm, sy_mm, sz_mm: origin and seed in LPS millimetres."""
    j = join_case(df, cases.select("case_id", F.col("spacing"), "origin", "direction"))
    o = geo.zyx_to_mm(F.col("oz"), F.col("oy"), F.col("ox"))
    s = geo.zyx_to_mm(F.col("seed_z"), F.col("seed_y"), F.col("seed_x"))
    j = j.withColumns({"x": o[0], "y": o[1], "z": o[2], "seed_x_mm": s[0], "seed_y_mm": s[1], "seed_z_mm": s[2]})
    return j.drop("spacing", "origin", "direction")
