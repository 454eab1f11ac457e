"""Profile of long wall contacts: turning, waist and end headings along the strip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenframe.functions import linalg as la
from lumenframe.operators import features

INST = features.INST
STEP_MM = 1.0  # fixed value: least spacing of kept points


def thinned_strip(contact: DataFrame, spacing: DataFrame) -> DataFrame:
    """Contact cells in order along their main axis, thinned to steps of at least 1 mm.

    ``contact`` carries ``depth_mm``. The first and last cell are always kept. Returns
    ``(case_id, inst_id, k, arc, pz, py, px, depth_mm)``. The fold runs over one contact patch.
    """
    shape = features.pca(contact, spacing)
    mm = features.in_mm(contact, spacing)
    mid = mm.groupBy(*INST).agg(*[F.avg(f"p{c}").alias(f"c{c}") for c in "zyx"])
    proj = la.dot([F.col(f"p{c}") - F.col(f"c{c}") for c in "zyx"], la.cols("axis_a", "axis_b", "axis_c"))
    mm = mm.join(mid, INST).join(shape.where(F.col("n_voxels") >= 6).select(*INST, "axis_a", "axis_b", "axis_c"), INST).withColumn("t", proj)
    g = mm.groupBy(*INST).agg(F.min("t").alias("t0"), F.sort_array(F.collect_list(F.struct("t", "z", "y", "x", "pz", "py", "px", "depth_mm"))).alias("all"))
    keep = F.aggregate(
        "all",
        F.slice("all", 1, 1),
        lambda kept, c: F.when(c["t"] - F.element_at(kept, -1)["t"] >= STEP_MM, F.array_append(kept, c)).otherwise(kept),
    )
    last = F.element_at("all", -1)
    g = g.withColumn("kept", keep)
    g = g.withColumn("kept", F.when(F.element_at("kept", -1) == last, F.col("kept")).otherwise(F.array_append("kept", last)))
    out = g.select(*INST, "t0", F.posexplode("kept").alias("k", "p"))
    return out.select(*INST, "k", (F.col("p.t") - F.col("t0")).alias("arc"), "p.pz", "p.py", "p.px", "p.depth_mm")


def strip_profile(contact: DataFrame, spacing: DataFrame) -> DataFrame:
    """End cosine, waist, turning and its concentration per instance; short strips leave waist null."""
    s = thinned_strip(contact, spacing)
    order = W.partitionBy(*INST).orderBy("k")
    whole = W.partitionBy(*INST)
    axes = ("pz", "py", "px")
    step = [F.coalesce(F.lead(a).over(order), F.col(a)) - F.coalesce(F.lag(a).over(order), F.col(a)) for a in axes]
    s = s.withColumns({**{f"d{a}": d for a, d in zip(axes, step)}, "n": F.count(F.lit(1)).over(whole)})
    d = [F.col(f"d{a}") for a in axes]
    length = la.norm(d)
    s = s.withColumns({f"t{a}": F.when(length > 1e-8, v / length).otherwise(0.0) for a, v in zip(axes, d)})
    dot = la.dot([F.col(f"t{a}") for a in axes], [F.lag(f"t{a}").over(order) for a in axes])
    s = s.withColumn("turn", F.when(F.col("k") > 0, F.degrees(F.acos(la.clip(dot, -1.0, 1.0)))))
    s = s.withColumn("place", F.row_number().over(W.partitionBy(*INST).orderBy(F.col("turn").desc_nulls_last(), "k")))
    n, k = F.col("n"), F.col("k")
    third = F.greatest(F.lit(1), F.floor(n / 3))
    head, tail = k < third, k >= n - third
    i0, i1 = F.greatest(F.lit(1), F.floor(n / 5)), F.least(n - 1, F.floor(4 * n / 5))
    spikes = F.greatest(F.lit(1), F.rint(0.15 * (n - 1)).cast("long"))
    g = s.groupBy(*INST).agg(
        F.first("n").alias("n"),
        *[F.avg(F.when(head, F.col(f"t{a}"))).alias(f"h{a}") for a in axes],
        *[F.avg(F.when(tail, F.col(f"t{a}"))).alias(f"e{a}") for a in axes],
        F.min(F.when((k >= i0) & (k < i1), F.col("depth_mm"))).alias("inner"),
        F.min("depth_mm").alias("least"),
        # a point in both end thirds counts twice
        (F.sum(F.when(k < F.floor(n / 3), F.col("depth_mm")).otherwise(0.0)) + F.sum(F.when(k >= n - F.ceil(n / 3), F.col("depth_mm")).otherwise(0.0))).alias("ends"),
        F.avg("turn").alias("mean_turn_deg"),
        F.max("turn").alias("max_turn_deg"),
        F.sum("turn").alias("sum_turn"),
        F.sum(F.when(F.col("place") <= spikes, F.col("turn"))).alias("spike"),
    )
    h, e = [F.col(f"h{a}") for a in axes], [F.col(f"e{a}") for a in axes]
    waist = F.when(F.col("n") >= 7, F.coalesce("inner", "least"))
    ends = F.when(F.col("n") >= 7, F.col("ends") / (F.floor(F.col("n") / 3) + F.ceil(F.col("n") / 3)))
    return g.select(
        *INST,
        la.dot([a / (la.norm(h) + 1e-9) for a in h], [b / (la.norm(e) + 1e-9) for b in e]).alias("end_cos"),
        waist.alias("waist_mm"),
        ends.alias("end_radius_mm"),
        (waist / (ends + 1e-6)).alias("waist_ratio"),
        F.coalesce("mean_turn_deg", F.lit(0.0)).alias("mean_turn_deg"),
        F.coalesce("max_turn_deg", F.lit(0.0)).alias("max_turn_deg"),
        F.coalesce(F.col("max_turn_deg") / (F.col("mean_turn_deg") + 1e-6), F.lit(0.0)).alias("turn_concentration"),
        F.coalesce(F.col("spike") / (F.col("sum_turn") + 1e-6), F.lit(0.0)).alias("top15_turn_share"),
    )


def pick_instance(spreads: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The wanted instance of each case where it exists, else the one with the widest contact."""
    widest = spreads.groupBy("case_id").agg(F.max_by("inst_id", F.struct("contact_spread_mm", (-F.col("inst_id")).alias("r"))).alias("widest"))
    if wanted is None:
        return widest.select("case_id", F.col("widest").alias("inst_id"))
    have = wanted.join(spreads.select(*INST), INST, "left_semi").select("case_id", F.col("inst_id").alias("asked"))
    return widest.join(have, "case_id", "left").select("case_id", F.coalesce("asked", "widest").alias("inst_id"))
