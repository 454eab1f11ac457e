"""Plane sections: disc samples across a lumen, path resampling, circularity and radius stability."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenframe.functions import linalg as la
from lumenframe.operators.bricks import spread
from lumenframe.operators.percase import join_case
from lumenframe.params import DEFAULTS, Params
from lumenframe.session import unsent

HALF_MM = 4.0  # fixed value: half-width of a section


def with_plane_axes(df: DataFrame, head: Sequence[str]) -> DataFrame:
    """Adds two unit vectors ``a1*, a2*`` across the heading (z, y, x order)."""
    d = la.unit_or(la.cols(*head), (1.0, 0.0, 0.0))
    df = df.withColumns({"__dz": d[0], "__dy": d[1], "__dx": d[2]})
    dz, dy, dx = la.cols("__dz", "__dy", "__dx")
    steep = F.abs(dz) < 0.9
    helper = [F.when(steep, 1.0).otherwise(0.0), F.when(steep, 0.0).otherwise(1.0), F.lit(0.0)]
    a1 = la.cross([dz, dy, dx], helper)
    df = df.withColumns({"__q0": a1[0], "__q1": a1[1], "__q2": a1[2]})
    q = la.cols("__q0", "__q1", "__q2")
    n = la.norm(q)
    df = df.withColumns({"a1z": q[0] / n, "a1y": q[1] / n, "a1x": q[2] / n})
    a2 = la.cross([dz, dy, dx], la.cols("a1z", "a1y", "a1x"))
    return df.withColumns({"a2z": a2[0], "a2y": a2[1], "a2x": a2[2]}).drop("__dz", "__dy", "__dx", "__q0", "__q1", "__q2")


def disc_samples(points: DataFrame, at: Sequence[str], head: Sequence[str], half_mm: float = HALF_MM) -> DataFrame:
    """Grid points of a disc across each point's heading: adds u, v, step and the nearest cell z, y, x.

    ``points`` carries sz, sy, sx. The grid pitch is half the smallest spacing.
    """
    df = with_plane_axes(points, head).withColumn("step", 0.5 * F.least("sz", "sy", "sx"))
    n = F.ceil(F.lit(half_mm) / F.col("step")).cast("int")
    df = df.withColumn("__i", F.explode(F.sequence(-n, n)))
    df = df.withColumn("__j", F.explode(F.sequence(-n, n)))
    df = df.withColumns({"u": F.col("__i") * F.col("step"), "v": F.col("__j") * F.col("step")})
    df = df.where(F.col("u") * F.col("u") + F.col("v") * F.col("v") <= half_mm * half_mm)
    cells = {
        c: F.rint(F.col(a) + (F.col("u") * F.col(f"a1{c}") + F.col("v") * F.col(f"a2{c}")) / F.col(f"s{c}")).cast("int")
        for c, a in zip("zyx", at)
    }
    return unsent(df.withColumns(cells).drop("__i", "__j", "a1z", "a1y", "a1x", "a2z", "a2y", "a2x"))


def area_radius(n: Column, step: Column) -> Column:
    return F.sqrt(n * step * step / math.pi)


def plane_radius(seeds: DataFrame, voxels: DataFrame, calib: DataFrame, spacing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Radius of the disc with the area of in-window samples across the heading at each seed.

    ``seeds(key, seed_z, seed_y, seed_x, head_z, head_y, head_x)``.
    """
    s = join_case(seeds, spacing, "sz", "sy", "sx").where(la.norm(la.cols("head_z", "head_y", "head_x")) >= 1e-8)
    # points are few bytes and hundreds of samples each
    probe = disc_samples(spread(s, key), ("seed_z", "seed_y", "seed_x"), ("head_z", "head_y", "head_x")).select(*key, "z", "y", "x", "step")
    window = join_case(voxels.select("case_id", "z", "y", "x", "hu"), calib, "blood_low", "blood_high")
    window = window.where(F.col("hu").between(F.col("blood_low"), F.col("blood_high"))).select("case_id", "z", "y", "x")
    hit = probe.join(window, ["case_id", "z", "y", "x"]).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("step").alias("step"))
    r = F.coalesce(area_radius(F.col("n"), F.col("step")), F.lit(0.0))
    return seeds.select(*key).join(hit, list(key), "left").select(*key, r.alias("plane_radius_mm"))


def seed_radius(df: DataFrame) -> Column:
    """Median of the positive estimates ``depth_at_seed`` and ``plane_radius_mm``; floor when none is."""
    d, q = F.coalesce("depth_at_seed", F.lit(0.0)), F.col("plane_radius_mm")
    return (
        F.when((d > 0) & (q > 0), (d + q) / 2.0)
        .when(d > 0, d)
        .when(q > 0, q)
        .otherwise(0.5 * (F.col("sz") + F.col("sy") + F.col("sx")) / 3.0)
    )


def resample_paths(points: DataFrame, spacing: DataFrame, key: Sequence[str], step_mm: float = 1.5) -> DataFrame:
    """Evenly spaced samples of ``points(key, step, z, y, x)`` with unit segment headings.

    At least three samples per path, both ends included. Returns ``(key, k, z, y, x, tz, ty, tx)``.
    """
    key = list(key)
    j = spread(join_case(points, spacing, "sz", "sy", "sx"), key)
    order = W.partitionBy(*key).orderBy("step")
    nxt = {f"n{c}": F.lead(c).over(order) for c in "zyx"}
    seg = j.withColumns(nxt).withColumn("__last", F.col("nz").isNull())
    d = [(F.col(f"n{c}") - F.col(c)) * F.col(f"s{c}") for c in "zyx"]
    seg = seg.withColumn("len", F.coalesce(la.norm(d), F.lit(0.0)))
    run = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*key)
    seg = seg.withColumns(
        {"c0": F.coalesce(F.sum("len").over(run), F.lit(0.0)), "total": F.sum("len").over(whole), "__segs": F.count(F.lit(1)).over(whole) - 1}
    )
    seg = seg.withColumn("__i", F.row_number().over(order))
    n = F.greatest(F.lit(3), F.floor(F.col("total") / step_mm).cast("int") + 1)
    seg = seg.withColumn("n", F.when(F.col("total") < 1e-6, 1).otherwise(n))
    # segment i covers targets in [c0, c0 + len); the last segment also takes the end
    seg = seg.where(~F.col("__last") | (F.col("__segs") == 0))
    ends_here = F.col("__i") == F.col("__segs")
    pitch = F.col("total") / F.greatest(F.col("n") - 1, F.lit(1))
    many = F.sequence(F.lit(0), F.col("n") - 1)
    k = F.filter(many, lambda i: (i * pitch >= F.col("c0")) & ((i * pitch < F.col("c0") + F.col("len")) | ends_here))
    one = F.when(F.col("__i") == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    out = seg.withColumn("k", F.explode(F.when(F.col("n") == 1, one).otherwise(k)))
    t = F.col("k") * pitch
    alpha = F.when(F.col("n") == 1, 0.0).otherwise((t - F.col("c0")) / F.when(F.col("len") > 1e-9, F.col("len")).otherwise(1.0))
    pos = {c: F.col(c) + alpha * F.coalesce(F.col(f"n{c}") - F.col(c), F.lit(0.0)) for c in "zyx"}
    ok = (F.col("len") > 1e-9) & (F.col("n") > 1)
    heads = {f"t{c}": F.when(ok, e / F.col("len")).otherwise(F.lit(f)) for c, e, f in zip("zyx", d, (1.0, 0.0, 0.0))}
    out = out.withColumns(heads).withColumns({f"__{c}": v for c, v in pos.items()})
    return out.select(*key, "k", *[F.col(f"__{c}").alias(c) for c in "zyx"], "tz", "ty", "tx", "sz", "sy", "sx")


def trilinear_depth(samples: DataFrame, depth: DataFrame, key: Sequence[str]) -> DataFrame:
    """Depth at fractional cells from the eight corners; missing corners count as 0."""
    sample_key = [*key, "k"]
    s = samples.select(*sample_key, *[F.col(c).alias(f"f{c}") for c in "zyx"])
    for c in "zyx":
        s = s.withColumn(f"__c{c}", F.explode(F.array(F.struct(F.lit(0).alias("o")), F.struct(F.lit(1).alias("o")))))
        base = F.floor(f"f{c}")
        frac = F.col(f"f{c}") - base
        s = s.withColumns({c: (base + F.col(f"__c{c}.o")).cast("int"), f"w{c}": F.when(F.col(f"__c{c}.o") == 1, frac).otherwise(1.0 - frac)})
    s = s.withColumn("w", F.col("wz") * F.col("wy") * F.col("wx")).where(F.col("w") > 0)
    j = s.join(depth.select(*key, "z", "y", "x", "depth_mm"), [*key, "z", "y", "x"], "left")
    return j.groupBy(*sample_key).agg(F.sum(F.col("w") * F.coalesce("depth_mm", F.lit(0.0))).alias("depth_mm"))


def path_consistency(points: DataFrame, depth: DataFrame, spacing: DataFrame, key: Sequence[str], p: Params = DEFAULTS) -> DataFrame:
    """Radius variation and mean circularity along each path: ``(key, radius_cv, circularity)``.

    ``depth(key, z, y, x, depth_mm)`` holds the instance cells with their distance to the outside.
    """
    key = list(key)
    samples = resample_paths(points, spacing, key)
    r_dt = trilinear_depth(samples, depth, key)
    probe = disc_samples(samples.withColumnsRenamed({"z": "pz", "y": "py", "x": "px"}), ("pz", "py", "px"), ("tz", "ty", "tx"))
    hits = probe.select(*key, "k", "u", "v", "step", "z", "y", "x").join(depth.select(*key, "z", "y", "x"), [*key, "z", "y", "x"])
    sec = hits.groupBy(*key, "k").agg(
        F.count(F.lit(1)).alias("n"), F.first("step").alias("step"),
        F.covar_samp("u", "u").alias("uu"), F.covar_samp("v", "v").alias("vv"), F.covar_samp("u", "v").alias("uv"),
    )
    half, diff = (F.col("uu") + F.col("vv")) / 2.0, (F.col("uu") - F.col("vv")) / 2.0
    root = F.sqrt(diff * diff + F.col("uv") * F.col("uv"))
    lo, hi = F.greatest(half - root, F.lit(1e-8)), F.greatest(half + root, F.lit(1e-8))
    sec = sec.select(*key, "k", area_radius(F.col("n"), F.col("step")).alias("r_area"), F.when(F.col("n") >= 4, F.sqrt(lo / hi)).alias("circ"))
    j = r_dt.join(sec, [*key, "k"], "left")
    r = F.when(F.col("depth_mm") > 0.15, F.col("depth_mm")).otherwise(F.coalesce("r_area", F.lit(0.0)))
    j = j.withColumn("r", F.when(r > 0, r))
    mean = F.avg("r")
    cv = F.when((F.count("r") >= 2) & (mean >= 1e-6), F.stddev_samp("r") / mean)
    return j.groupBy(*key).agg(cv.alias("radius_cv"), F.avg("circ").alias("circularity"))
