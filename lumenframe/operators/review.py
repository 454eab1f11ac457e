"""Review tables: numbering, verdict attach and upsert, worklists, side patterns, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import linalg as la
from lumenframe.operators.ranking import numbered
from lumenframe.session import cut

KEY = ["case_id", "instance_id"]


def number_branches(df: DataFrame, tie: str = "id") -> DataFrame:
    """Superior to inferior, then patient-right to left: ``branch_001``, ``branch_002``, ..."""
    ranked = numbered(df, ["case_id"], [F.col("z").desc(), F.col("x"), F.col(tie)], "__n")
    return ranked.withColumn("instance_id", F.format_string("branch_%03d", "__n")).drop("__n")


def attach_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Exact (case, instance) link; rows without a verdict stay blank.

    Of repeated keys the last edit by ``(edit_ts, edit_id)`` counts, as far as the table has these columns; else the
    greatest verdict.
    """
    order = [c for c in ("edit_ts", "edit_id") if c in verdicts.columns]
    once = verdicts.groupBy(*KEY).agg(F.max(F.struct(*order, "verdict")).getField("verdict").alias("verdict"))
    return rows.join(once, KEY, "left")


def carry_flags(rows: DataFrame, earlier: DataFrame, flag: str = "review_flag") -> DataFrame:
    old = earlier.select(*KEY, F.col(flag).alias("__old")).dropDuplicates(KEY)
    return rows.join(old, KEY, "left").withColumn(flag, F.coalesce("__old", F.lit(""))).drop("__old")


def curated_flags(rows: DataFrame, curated: DataFrame) -> DataFrame:
    """Flags by (case, instance[, status]); a curated row with null status fits every status."""
    exact = curated.filter("status is not null").groupBy(*KEY, "status").agg(F.min("review_flag").alias("__exact"))
    any_ = curated.filter("status is null").groupBy(*KEY).agg(F.min("review_flag").alias("__any"))
    joined = rows.join(exact, [*KEY, "status"], "left").join(any_, KEY, "left")
    out = joined.withColumn("review_flag", F.coalesce("__exact", "__any", F.lit(""))).drop("__exact", "__any")
    return out.select(*rows.columns, *[c for c in out.columns if c not in rows.columns])


def current_verdicts(edits: DataFrame, base: DataFrame | None = None, key: Sequence[str] = ("key",)) -> DataFrame:
    """Last write wins by (edit_ts, edit_id); keys without an edit keep their base verdict.

    ``max_by`` merges on the map side, so a hot key costs one row per task in the shuffle.
    """
    last = edits.groupBy(*key).agg(F.max_by(F.struct("verdict", "edit_id", "edit_ts"), F.struct("edit_ts", "edit_id")).alias("e"))
    last = last.select(*key, "e.verdict", "e.edit_id", "e.edit_ts")
    if base is None:
        return last
    kept = base.join(last.select(*key), list(key), "left_anti")
    return last.unionByName(kept, allowMissingColumns=True)


def lost_and_gained(baseline: DataFrame, current: DataFrame, key: Sequence[str]) -> DataFrame:
    b, c = baseline.select(*key).distinct(), current.select(*key).distinct()
    lost = b.join(c, list(key), "left_anti").withColumn("change", F.lit("lost"))
    return lost.unionByName(c.join(b, list(key), "left_anti").withColumn("change", F.lit("gained")))


def union_review_rows(new: DataFrame, existing: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """New rows, earlier rows with their verdict blanked, and table-only rows, in one schema."""
    out = new.unionByName(existing.withColumn("verdict", F.lit("")), allowMissingColumns=True)
    return out if extra is None else out.unionByName(extra, allowMissingColumns=True)


def worklist(rows: DataFrame, case: object | None = None, priority: DataFrame | None = None) -> DataFrame:
    """Rows to review, optionally of one case or of a priority list (null instance = whole case)."""
    if case is not None:
        rows = rows.where(F.col("case_id") == F.lit(case))
    if priority is not None:
        whole = priority.where(F.col("instance_id").isNull()).select("case_id").distinct()
        single = priority.where(F.col("instance_id").isNotNull()).select(*KEY).distinct()
        by_case = rows.join(whole, "case_id", "left_semi")
        by_row = rows.join(whole, "case_id", "left_anti").join(single, KEY, "left_semi")
        rows = by_case.unionByName(by_row)
    return rows


def spread_worklist(census: DataFrame, near_mm: float = 15.0) -> DataFrame:
    """Census rows near or over the split limit, in the review row layout, widest first."""
    return (
        census.where(F.col("contact_spread_mm") >= near_mm)
        .select(
            "case_id",
            "instance_id",
            F.when(F.col("over_18mm_threshold"), "over_18").otherwise("near_18").alias("status"),
            F.when(F.col("would_full_split"), "yes").otherwise("no").alias("gt_id"),
            F.col("contact_spread_mm").alias("ostium_err_mm"),
            "ostium_z",
            F.col("n_contact").alias("radius_mm"),
            F.col("cluster_cos").alias("vesselness"),
            F.col("n_instance").alias("path_length_mm"),
        )
        .orderBy(F.desc("ostium_err_mm"), "case_id", "instance_id")
    )


def verdict_counts(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by, "verdict").agg(F.count(F.lit(1)).alias("n"))


def with_side(points: DataFrame, centre_x: DataFrame) -> DataFrame:
    """Side of the parent: L when x is at or beyond the parent centroid, else R."""
    joined = points.join(centre_x, "case_id").withColumn("dx_from_centroid_mm", F.col("x") - F.col("centre_x"))
    return joined.withColumn("side", F.when(F.col("dx_from_centroid_mm") >= 0, "L").otherwise("R"))


def same_side_gaps(sided: DataFrame, tie: str = "id") -> DataFrame:
    """Drop in z to the next origin on the same side, superior to inferior."""
    ranked = cut(numbered(sided, ["case_id", "side"], [F.col("z").desc(), F.col(tie)], "__n"), "sides")
    after = ranked.select("case_id", "side", (F.col("__n") - 1).alias("__n"), F.col(tie).alias("next_id"), F.col("z").alias("__z"))
    joined = ranked.join(after, ["case_id", "side", "__n"], "left")
    return joined.withColumn("gap_mm", F.col("z") - F.col("__z")).drop("__z", "__n")


def side_sequence(sided: DataFrame, tie: str = "id", letters: int = 4096) -> DataFrame:
    """Letters of the sides from superior to inferior, and their counts.

    One row per case; a case with more than ``letters`` origins continues in further parts.
    """
    ranked = numbered(sided, ["case_id"], [F.col("z").desc(), F.col(tie)], "__n")
    ranked = ranked.withColumn("part", F.floor((F.col("__n") - 1) / letters))
    items = F.sort_array(F.collect_list(F.struct("__n", "side")))
    return ranked.groupBy("case_id", "part").agg(
        F.array_join(F.transform(items, lambda s: s["side"]), "").alias("sequence"),
        F.count_if(F.col("side") == "L").alias("n_left"),
        F.count_if(F.col("side") == "R").alias("n_right"),
    )


def opposite_pairs(sided: DataFrame, band_mm: float = 8.0, ident: str = "id") -> DataFrame:
    """Left/right pairs whose heights differ by less than ``band_mm``, joined on height buckets."""
    bucket = F.floor(F.col("z") / band_mm)
    left = sided.where(F.col("side") == "L").select(
        "case_id", F.col(ident).alias("left_id"), F.col("z").alias("lz"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("__b")
    )
    right = sided.where(F.col("side") == "R").select("case_id", F.col(ident).alias("right_id"), F.col("z").alias("rz"), bucket.alias("__b"))
    gap = F.abs(F.col("lz") - F.col("rz"))
    return left.join(right, ["case_id", "__b"]).where(gap < band_mm).select("case_id", "left_id", "right_id", gap.alias("dz_mm"))


def pair_geometry(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Full geometry of named pairs: 3-D, height and in-plane distance, seed distance, cosine."""
    names = ["x", "y", "z", "sx", "sy", "sz", "dx", "dy", "dz"]
    a = points.select("case_id", F.col("id").alias("a_id"), *[F.col(n).alias(f"a_{n}") for n in names])
    b = points.select("case_id", F.col("id").alias("b_id"), *[F.col(n).alias(f"b_{n}") for n in names])
    v = lambda s, k: [F.col(f"{s}_{n}") for n in k]
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    return (
        pairs.select("case_id", "a_id", "b_id")
        .join(a, ["case_id", "a_id"])
        .join(b, ["case_id", "b_id"])
        .select(
            "case_id",
            "a_id",
            "b_id",
            la.dist(v("a", "xyz"), v("b", "xyz")).alias("dist_mm"),
            F.abs(F.col("a_z") - F.col("b_z")).alias("dz_mm"),
            F.sqrt(dx * dx + dy * dy).alias("in_plane_mm"),
            la.dist(v("a", ("sx", "sy", "sz")), v("b", ("sx", "sy", "sz"))).alias("seed_sep_mm"),
            la.cosine(v("a", ("dx", "dy", "dz")), v("b", ("dx", "dy", "dz"))).alias("cosine"),
            (F.col("a_id") == F.col("b_id")).alias("same_instance"),
        )
    )


def spread_census_summary(census: DataFrame, near_mm: float = 15.0, over_mm: float = 18.0) -> DataFrame:
    s: Column = F.col("contact_spread_mm")
    return census.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(s).alias("min_mm"),
        F.percentile(s, 0.5).alias("p50_mm"),
        F.percentile(s, 0.9).alias("p90_mm"),
        F.percentile(s, 0.95).alias("p95_mm"),
        F.max(s).alias("max_mm"),
        F.count_if(s >= near_mm).alias("n_near"),
        F.count_if(s >= over_mm).alias("n_over"),
        F.count_if(F.col("would_full_split")).alias("n_full_split"),
    )
