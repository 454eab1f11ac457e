"""Ordered duplicate collapse over pair tables.

The rule: walk the pairs of a case in (i, j) order; skip a pair when either end is already dropped,
otherwise drop its loser. Two exact executions are used: a fold over the sorted pairs of a case
when the case has few pairs, and rounds of locally-first pairs when it has many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import linalg as la
from lumenframe.operators.spatial import pairs_within_self
from lumenframe.params import DEFAULTS, Params
from lumenframe.session import cut, known_rows, unsent

FOLD_PAIRS = 10_000


def ordered_drops(pairs: DataFrame, fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    """``pairs(case_id, i, j, loser)`` -> ``(case_id, id)`` of dropped rows."""
    pairs = cut(pairs.select("case_id", "i", "j", "loser"), "drop-pairs")
    sizes = pairs.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    few = pairs.join(sizes.where(F.col("n") <= fold_pairs), "case_id", "left_semi")
    many = pairs.join(sizes.where(F.col("n") > fold_pairs), "case_id", "left_semi")
    dropped = _fold(few)
    if not many.isEmpty():
        dropped = dropped.unionByName(_rounds(many))
    return dropped


def _fold(pairs: DataFrame) -> DataFrame:
    ordered = pairs.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("i", "j", "loser"))).alias("pairs"))
    kind = pairs.schema["loser"].dataType.simpleString()

    def visit(gone: Column, p: Column) -> Column:
        hit = F.array_contains(gone, p["i"]) | F.array_contains(gone, p["j"])
        return F.when(hit, gone).otherwise(F.array_append(gone, p["loser"]))

    gone = F.aggregate("pairs", F.array().cast(f"array<{kind}>"), visit)
    return ordered.select("case_id", F.explode(gone).alias("id"))


def _rounds(pairs: DataFrame) -> DataFrame:
    """Each round settles every pair that is the first live pair at both of its ends."""
    live, dropped = pairs, None
    while True:
        ends = live.select("case_id", F.explode(F.array("i", "j")).alias("v"), F.struct("i", "j").alias("e"))
        first = cut(ends.groupBy("case_id", "v").agg(F.min("e").alias("e")), "drop-first")
        fi = first.select("case_id", F.col("v").alias("i"), F.col("e").alias("ei"))
        fj = first.select("case_id", F.col("v").alias("j"), F.col("e").alias("ej"))
        me = F.struct("i", "j")
        ready = live.join(fi, ["case_id", "i"]).join(fj, ["case_id", "j"])
        ready = cut(ready.where((F.col("ei") == me) & (F.col("ej") == me)).select("case_id", "i", "j", "loser"), "drop-ready")
        out = ready.select("case_id", F.col("loser").alias("id"))
        dropped = out if dropped is None else dropped.unionByName(out)
        live = (
            live.join(out.select("case_id", F.col("id").alias("i")), ["case_id", "i"], "left_anti")
            .join(out.select("case_id", F.col("id").alias("j")), ["case_id", "j"], "left_anti")
        )
        live = cut(live.select("case_id", "i", "j", "loser"), "drop-live")
        if live.isEmpty():
            return dropped


# Names of pair decisions.
KEEP_SPLIT = "keep_split_derived"
MERGE_CLOSE = "close_ostium"
KEEP_FAR = "keep"
KEEP_DIVERGED = "keep_diverged"
KEEP_UNALIGNED = "keep_unaligned"
MERGE_PATH = "path_merge"


def near_duplicate_pairs(cands: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Pairs of candidates whose origins are at most ``near_dup_mm`` apart, with their loser.

    ``cands(case_id, id, x, y, z, path_mm, vesselness[, split_derived])``.
    """
    if "split_derived" not in cands.columns:
        cands = cands.withColumn("split_derived", F.lit(False))
    slim = cands.select("case_id", "id", "x", "y", "z", "split_derived", (F.col("path_mm") + 20.0 * F.col("vesselness")).alias("score"))
    slim = slim if known_rows(cands) is None else unsent(slim, known_rows(cands))
    pairs = pairs_within_self(slim, p.near_dup_mm, ["x", "y", "z"], "id")
    both_split = F.col("split_derived_i") & F.col("split_derived_j")
    return pairs.select(
        "case_id",
        F.col("id_i").alias("i"),
        F.col("id_j").alias("j"),
        "dist_mm",
        F.when(both_split, F.lit(KEEP_SPLIT)).otherwise(F.lit("near_dup")).alias("reason"),
        F.when(both_split, F.lit(None)).when(F.col("score_i") >= F.col("score_j"), F.col("id_j")).otherwise(F.col("id_i")).alias("loser"),
    )


def path_merge_pairs(cands: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Pairs inside the path-merge window with the reason to keep or merge them.

    ``cands(case_id, id, x, y, z, sx, sy, sz, dx, dy, dz, path_mm, diameter_mm[, split_derived])``.
    Pairs beyond the window never merge and are not produced.
    """
    if "split_derived" not in cands.columns:
        cands = cands.withColumn("split_derived", F.lit(False))
    slim = cands.select(
        "case_id", "id", "x", "y", "z", "sx", "sy", "sz", "dx", "dy", "dz", "split_derived",
        (F.col("path_mm") + 0.3 * F.col("diameter_mm")).alias("score"),
    )
    window = max(p.path_merge_mm, p.ostium_merge_mm)
    slim = slim if known_rows(cands) is None else unsent(slim, known_rows(cands))
    pairs = pairs_within_self(slim, window, ["x", "y", "z"], "id")
    side = lambda names, s: [F.col(f"{n}_{s}") for n in names]
    pairs = pairs.withColumns(
        {
            "seed_sep_mm": la.dist(side(("sx", "sy", "sz"), "i"), side(("sx", "sy", "sz"), "j")),
            "cosine": la.clip(la.dot(side(("dx", "dy", "dz"), "i"), side(("dx", "dy", "dz"), "j")), -1.0, 1.0),
            "dz_mm": F.abs(F.col("z_i") - F.col("z_j")),
        }
    )
    d, s, c = F.col("dist_mm"), F.col("seed_sep_mm"), F.col("cosine")
    reason = (
        F.when(F.col("split_derived_i") & F.col("split_derived_j"), KEEP_SPLIT)
        .when(d <= p.ostium_merge_mm, MERGE_CLOSE)
        .when(d > p.path_merge_mm, KEEP_FAR)
        .when((c < p.diverge_cosine) | (s > d + 2.0), KEEP_DIVERGED)
        .when((c < p.merge_min_cosine) & (s + 1.0 >= d), KEEP_UNALIGNED)
        .otherwise(MERGE_PATH)
    )
    pairs = pairs.withColumn("reason", reason)
    loser = F.when(F.col("score_i") >= F.col("score_j"), F.col("id_j")).otherwise(F.col("id_i"))
    return pairs.select(
        "case_id",
        F.col("id_i").alias("i"),
        F.col("id_j").alias("j"),
        "dist_mm",
        "seed_sep_mm",
        "cosine",
        "dz_mm",
        "reason",
        F.when(F.col("reason").isin(MERGE_CLOSE, MERGE_PATH), loser).alias("loser"),
    )


def collapse_near_duplicates(cands: DataFrame, p: Params = DEFAULTS, fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    pairs = near_duplicate_pairs(cands, p).where(F.col("loser").isNotNull())
    return cands.join(ordered_drops(pairs, fold_pairs), ["case_id", "id"], "left_anti")


def collapse_paths(cands: DataFrame, p: Params = DEFAULTS, fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    pairs = path_merge_pairs(cands, p).where(F.col("loser").isNotNull())
    return cands.join(ordered_drops(pairs, fold_pairs), ["case_id", "id"], "left_anti")
