"""Grid geometry as Column expressions.

A case row holds ``size``, ``spacing`` and ``origin`` as arrays in (x, y, z) order and ``direction``
as a row-major 3x3 array. Lattice addresses are integer columns (z, y, x); points are LPS
millimetres.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import linalg as la
from lumenframe.operators.percase import join_case
from lumenframe.params import DEFAULTS


def _a(name: str, i: int) -> Column:
    return F.get(F.col(name), i)


def index_to_mm(index_xyz: Sequence[Column]) -> list[Column]:
    """Continuous (x, y, z) index to LPS millimetres."""
    scaled = [index_xyz[i] * _a("spacing", i) for i in range(3)]
    return [_a("origin", r) + la.dot([_a("direction", 3 * r + c) for c in range(3)], scaled) for r in range(3)]


def zyx_to_mm(z: Column, y: Column, x: Column) -> list[Column]:
    return index_to_mm([x, y, z])


def mm_to_index(point_xyz: Sequence[Column]) -> list[Column]:
    """LPS millimetres to continuous (x, y, z) index; the direction must be orthonormal."""
    shifted = [point_xyz[i] - _a("origin", i) for i in range(3)]
    back = [la.dot([_a("direction", 3 * r + c) for r in range(3)], shifted) for c in range(3)]
    return [b / _a("spacing", i) for i, b in enumerate(back)]


def mm_to_crop_zyx(point_xyz: Sequence[Column], crop_origin_zyx: Sequence[Column]) -> list[Column]:
    x, y, z = mm_to_index(point_xyz)
    return [z - crop_origin_zyx[0], y - crop_origin_zyx[1], x - crop_origin_zyx[2]]


def determinant(name: str = "direction") -> Column:
    r = [[_a(name, 3 * i + j) for j in range(3)] for i in range(3)]
    return la.dot(r[0], la.cross(r[1], r[2]))


def orthonormality(cases: DataFrame, name: str = "direction", atol: float = 1e-4) -> DataFrame:
    """Adds ``max_abs_off`` (of DtD - I), ``det`` and ``is_orthonormal``."""
    cols = [[_a(name, 3 * r + c) for r in range(3)] for c in range(3)]
    gram = {(i, j): la.dot(cols[i], cols[j]) for i in range(3) for j in range(i, 3)}
    off = [F.abs(g - (1.0 if i == j else 0.0)) for (i, j), g in gram.items()]
    # the diagonal compares against 1 and gains a relative tolerance of 1e-5
    near = F.lit(True)
    for (i, j), g in gram.items():
        near = near & (F.abs(g - (1.0 if i == j else 0.0)) <= (atol + (1e-5 if i == j else 0.0)))
    return cases.withColumns(
        {"max_abs_off": F.greatest(*off), "det": determinant(name), "is_orthonormal": near & (F.abs(determinant(name)) > 0.5)}
    )


def nearest_rotation(cases: DataFrame, name: str = "direction", out: str = "rotation", steps: int = 12) -> DataFrame:
    """Polar factor of ``direction`` by the Newton iteration X <- (X + X^-T)/2, and its distance.

    Handedness is kept; ``left_handed`` marks a negative determinant.
    """
    df = cases.withColumn(out, F.col(name))
    for _ in range(steps):
        r = [[_a(out, 3 * i + j) for j in range(3)] for i in range(3)]
        cof = [la.cross(r[1], r[2]), la.cross(r[2], r[0]), la.cross(r[0], r[1])]
        det = F.col("__det")
        df = df.withColumn("__det", la.dot(r[0], cof[0]))
        df = df.withColumn(out, F.array(*[(r[i][j] + cof[i][j] / det) / 2.0 for i in range(3) for j in range(3)]))
    gap = F.sqrt(F.aggregate(F.zip_with(name, out, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return df.drop("__det").withColumns({"frobenius": gap, "left_handed": determinant(name) < 0})


def geometry_key() -> Column:
    """Rounded grid description; equal keys mean co-registered volumes."""
    near = lambda name, d: F.transform(name, lambda v: F.bround(v, d))
    return F.struct(
        F.col("size"), near("spacing", 6).alias("spacing"), near("origin", 4).alias("origin"), near("direction", 6).alias("direction")
    )


def correct_directions(image_cases: DataFrame, mask_cases: DataFrame, atol: float = 1e-4) -> DataFrame:
    """One row per case with the corrected common grid and whether the mask needs resampling.

    A sheared image direction is replaced by its nearest rotation. The mask then shares the image
    grid when the sizes agree; otherwise it is resampled onto it.
    """
    i = orthonormality(nearest_rotation(image_cases, steps=12), atol=atol)
    m = orthonormality(nearest_rotation(mask_cases, steps=12), atol=atol)
    keep = ["size", "spacing", "origin", "direction", "rotation", "frobenius", "left_handed", "max_abs_off", "det", "is_orthonormal"]
    i = i.select("case_id", *[F.col(c) for c in keep], geometry_key().alias("key"))
    m = m.select("case_id", *[F.col(c).alias(f"mask_{c}") for c in keep], geometry_key().alias("mask_key"))
    j = i.join(m, "case_id")
    sheared = ~F.col("is_orthonormal") | ~F.col("mask_is_orthonormal") | (F.greatest("frobenius", "mask_frobenius") > atol)
    j = j.withColumn("corrected", sheared)
    return j.select(
        "case_id", "size", "spacing", "origin",
        F.when(F.col("corrected"), F.col("rotation")).otherwise(F.col("direction")).alias("direction"),
        "corrected", "left_handed", "frobenius", "max_abs_off", "det",
        "mask_size",
        *[
            F.when(F.col("corrected"), F.col(c if c != "direction" else "rotation")).otherwise(F.col(f"mask_{c}")).alias(f"mask_{c}")
            for c in ("spacing", "origin", "direction")
        ],
        F.when(F.col("corrected"), F.col("size") != F.col("mask_size")).otherwise(F.col("key") != F.col("mask_key")).alias("needs_resample"),
    )


def neighbour_offsets(connectivity: int = 26) -> list[tuple[int, int, int]]:
    """(dz, dy, dx) steps in scan order, without the centre."""
    near = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
    return [o for o in near if connectivity == 26 or sum(map(abs, o)) == 1]


def offset_array(offsets: Sequence[tuple[int, int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a, b, c in offsets])


def ball_offsets(radius_mm: float | Column, spacing: Sequence[Column]) -> Column:
    """Array of (dz, dy, dx) within a physical ball, for spacing columns in (z, y, x) order."""
    r = F.lit(radius_mm) if isinstance(radius_mm, (int, float)) else radius_mm
    reach = [F.greatest(F.lit(1), F.ceil(r / s).cast("int")) for s in spacing]
    axis = [F.sequence(-n, n) for n in reach]
    sz, sy, sx = spacing
    every = F.flatten(F.transform(axis[0], lambda a: F.flatten(F.transform(axis[1], lambda b: F.transform(axis[2], lambda c: F.struct(a.alias("dz"), b.alias("dy"), c.alias("dx")))))))
    return F.filter(
        every,
        lambda o: (o["dz"] * sz) * (o["dz"] * sz) + (o["dy"] * sy) * (o["dy"] * sy) + (o["dx"] * sx) * (o["dx"] * sx) <= r * r + 1e-6,
    )


def roi_box(voxels: DataFrame, cases: DataFrame, margin_mm: float = DEFAULTS.crop_margin_mm) -> DataFrame:
    """Bounding box of the parent plus a margin, clamped to the grid: inclusive z0..z1, y0..y1, x0..x1."""
    box = voxels.where("parent").groupBy("case_id").agg(
        *[f(c).alias(f"{c}{e}") for c in "zyx" for f, e in ((F.min, "0"), (F.max, "1"))]
    )
    j = box.join(cases.select("case_id", "size", "spacing"), "case_id")
    out = []
    for c, a in (("z", 2), ("y", 1), ("x", 0)):
        m = F.greatest(F.lit(1), F.ceil(F.lit(margin_mm) / _a("spacing", a)).cast("int"))
        out.append(F.greatest(F.col(f"{c}0") - m, F.lit(0)).alias(f"{c}0"))
        out.append(F.least(F.col(f"{c}1") + m, _a("size", a) - 1).cast("int").alias(f"{c}1"))
    return j.select("case_id", *out)


def crop(voxels: DataFrame, box: DataFrame) -> DataFrame:
    inside = F.col("z").between(F.col("z0"), F.col("z1")) & F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1"))
    return join_case(voxels, box).where(inside).drop("z0", "z1", "y0", "y1", "x0", "x1")


def resample_nearest(mask: DataFrame, grids: DataFrame) -> DataFrame:
    """Nearest-neighbour resample of ``mask(case_id, z, y, x, label)`` onto the image grid.

    ``grids`` is the output of ``correct_directions``. Instead of visiting every image voxel, each
    labelled mask voxel proposes the image voxels around it, and keeps those whose inverse image
    rounds back to it; all other image voxels are 0 and need no row.
    """
    g = grids.select("case_id", "size", "spacing", "origin", "direction", "mask_spacing", "mask_origin", "mask_direction")
    j = join_case(mask, g)
    mi = [F.col("x"), F.col("y"), F.col("z")]
    scaled = [mi[i] * _a("mask_spacing", i) for i in range(3)]
    p = [_a("mask_origin", r) + la.dot([_a("mask_direction", 3 * r + c) for c in range(3)], scaled) for r in range(3)]
    j = j.withColumns({f"__c{i}": c for i, c in enumerate(mm_to_index(p))})
    # half the diagonal of a mask voxel, in image voxels, bounds the proposal box
    half = la.norm([_a("mask_spacing", i) for i in range(3)]) / 2.0
    axis = [
        F.sequence(F.floor(F.col(f"__c{i}") - half / _a("spacing", i)).cast("int"), F.ceil(F.col(f"__c{i}") + half / _a("spacing", i)).cast("int"))
        for i in range(3)
    ]
    for i in range(3):
        j = j.withColumn(f"__a{i}", axis[i])
    for i in range(3):
        j = j.withColumn(f"__i{i}", F.explode(f"__a{i}"))
        j = j.where((F.col(f"__i{i}") >= 0) & (F.col(f"__i{i}") < _a("size", i)))
    q = index_to_mm([F.col(f"__i{i}") for i in range(3)])
    shifted = [q[i] - _a("mask_origin", i) for i in range(3)]
    back = [la.dot([_a("mask_direction", 3 * r + c) for r in range(3)], shifted) / _a("mask_spacing", c) for c in range(3)]
    hit = F.lit(True)
    for b, m in zip(back, mi):
        hit = hit & (F.floor(b + 0.5) == m)
    return j.where(hit).select("case_id", F.col("__i2").alias("z"), F.col("__i1").alias("y"), F.col("__i0").alias("x"), "label")
