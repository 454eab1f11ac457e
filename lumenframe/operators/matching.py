"""One-to-one matching of predicted landmarks to reference landmarks, and what follows from it.

Landmark tables: ``(case_id, id, x, y, z, sx, sy, sz, dx, dy, dz, radius_mm)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import linalg as la
from lumenframe.operators.spatial import pairs_within
from lumenframe.params import DEFAULTS, Params
from lumenframe.session import cut


TASK_ROWS = 20_000  # landmarks whose cases are solved in one call


class Distances:
    """A cost matrix of distances whose rows are computed when they are asked for: memory follows its sides, not its area."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.shape = a, b, (len(a), len(b))

    def __getitem__(self, i: int) -> np.ndarray:
        return np.sqrt(((self.b - self.a[i]) ** 2).sum(axis=1))


def min_cost_assignment(cost: np.ndarray | Distances) -> np.ndarray:
    """Column of each row in a minimum-total assignment (rows <= columns), by augmenting paths."""
    n, m = cost.shape
    row_of = np.full(m, -1)
    u, v = np.zeros(n), np.zeros(m)
    for start in range(n):
        slack = np.full(m, np.inf)
        back = np.full(m, -1)
        open_ = np.ones(m, dtype=bool)
        row, last = start, -1
        rows, columns = [start], []
        lowest = 0.0
        while True:
            trial = lowest + cost[row] - u[row] - v
            better = open_ & (trial < slack)
            slack[better] = trial[better]
            back[better] = last
            last = int(np.argmin(np.where(open_, slack, np.inf)))
            lowest = slack[last]
            open_[last] = False
            columns.append(last)
            if row_of[last] < 0:
                break
            row = int(row_of[last])
            rows.append(row)
        u[start] += lowest
        for r, c in zip(rows[1:], columns[:-1]):
            u[r] += lowest - slack[c]
            v[c] -= lowest - slack[c]
        while last >= 0:
            prev = int(back[last])
            row_of[last] = row_of[prev] if prev >= 0 else start
            last = prev
    col_of = np.empty(n, dtype=int)
    used = np.flatnonzero(row_of >= 0)
    col_of[row_of[used]] = used
    return col_of


def _solve_cases(rows: pa.Table) -> pa.Table:
    """Matches of whole cases, many in one call."""
    rows = rows.sort_by([("case_id", "ascending"), ("is_gt", "ascending"), ("id", "ascending")]).combine_chunks()
    case, is_gt = rows["case_id"].combine_chunks(), rows["is_gt"].to_numpy()
    at = np.stack([rows[c].to_numpy() for c in "xyz"], 1)
    starts = np.r_[0, np.flatnonzero(pc.not_equal(case.slice(1), case.slice(0, len(case) - 1)).to_numpy(zero_copy_only=False)) + 1]
    found = []
    for lo, hi in zip(starts, np.r_[starts[1:], len(rows)]):
        mid = hi - int(is_gt[lo:hi].sum())
        a, b = at[mid:hi], at[lo:mid]
        if len(a) <= len(b):
            i, j = np.arange(len(a)), min_cost_assignment(Distances(a, b))
        else:
            i, j = min_cost_assignment(Distances(b, a)), np.arange(len(b))
        found.append(np.stack([i + mid, j + lo]))
    i, j = np.concatenate(found, axis=1)
    gap = np.sqrt(((at[i] - at[j]) ** 2).sum(axis=1))
    ids = rows["id"].combine_chunks()
    return pa.Table.from_arrays([case.take(pa.array(i)), ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(gap)], ["case_id", "gt_id", "pred_id", "dist_mm"])


def optimal_matches(gt: DataFrame, pred: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Minimum-total matching per case, gated afterwards: ``(case_id, gt_id, pred_id, dist_mm)``.

    The gate comes after the assignment, so a far pair may displace a near one; that order is part
    of the scoring rule. A case holds tens of landmarks and is solved in one task, whose memory follows its number of
    landmarks, not of pairs.
    """
    both = gt.select("case_id", "id", "x", "y", "z", F.lit(True).alias("is_gt")).unionByName(
        pred.select("case_id", "id", "x", "y", "z", F.lit(False).alias("is_gt"))
    )
    sides = both.groupBy("case_id").agg(F.bool_or("is_gt").alias("g"), F.bool_or(~F.col("is_gt")).alias("p")).where("g AND p")
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    schema = f"case_id {kinds['case_id']}, gt_id {kinds['id']}, pred_id {kinds['id']}, dist_mm double"
    n = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-both.select("case_id").count() // TASK_ROWS))
    kept = both.join(sides, "case_id", "left_semi").withColumn("__part", F.pmod(F.xxhash64("case_id"), F.lit(n)))
    out = kept.repartition(n, "__part").groupBy("__part").applyInArrow(_solve_cases, schema)
    return out.where(F.col("dist_mm") <= p.match_mm)


def mutual_nearest_matches(gt: DataFrame, pred: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Pairs inside the gate that are each other's nearest (ties by id); no Python involved."""
    a = gt.select("case_id", F.col("id").alias("gt_id"), F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz"))
    b = pred.select("case_id", F.col("id").alias("pred_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    near = cut(
        pairs_within(a, b, p.match_mm, ["gx", "gy", "gz"], ["px", "py", "pz"]).select("case_id", "gt_id", "pred_id", "dist_mm"),
        "match-near",
    )
    of_gt = near.groupBy("case_id", "gt_id").agg(F.min(F.struct("dist_mm", "pred_id")).alias("best"))
    of_pred = near.groupBy("case_id", "pred_id").agg(F.min(F.struct("dist_mm", "gt_id")).alias("best"))
    left = of_gt.select("case_id", "gt_id", F.col("best.pred_id").alias("pred_id"), F.col("best.dist_mm").alias("dist_mm"))
    right = of_pred.select("case_id", F.col("best.gt_id").alias("gt_id"), "pred_id")
    return left.join(right, ["case_id", "gt_id", "pred_id"])


def match_attributes(matches: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Seed error, heading cosine and radius ratio of matched pairs."""
    keep = ["sx", "sy", "sz", "dx", "dy", "dz", "radius_mm"]
    g = gt.select("case_id", F.col("id").alias("gt_id"), *[F.col(c).alias(f"g_{c}") for c in keep])
    q = pred.select("case_id", F.col("id").alias("pred_id"), *[F.col(c).alias(f"p_{c}") for c in keep])
    v = lambda s, names: [F.col(f"{s}_{n}") for n in names]
    return (
        matches.join(g, ["case_id", "gt_id"])
        .join(q, ["case_id", "pred_id"])
        .select(
            "case_id",
            "gt_id",
            "pred_id",
            F.col("dist_mm").alias("ostium_err_mm"),
            la.dist(v("g", ("sx", "sy", "sz")), v("p", ("sx", "sy", "sz"))).alias("seed_err_mm"),
            la.cosine(v("g", ("dx", "dy", "dz")), v("p", ("dx", "dy", "dz"))).alias("cosine"),
            la.norm(la.unit(v("p", ("dx", "dy", "dz")))).alias("pred_norm"),
            F.col("p_radius_mm").alias("pred_radius_mm"),
            F.col("g_radius_mm").alias("gt_radius_mm"),
            (F.col("p_radius_mm") / F.greatest(F.col("g_radius_mm"), F.lit(1e-3))).alias("radius_ratio"),
        )
    )


def match_flags(attrs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row per plausibility flag of a matched pair."""
    # Flag names.
    rules = [
        ("direction_mismatch", F.col("cosine") < p.cosine_ok),
        ("implausible_radius", ~F.col("pred_radius_mm").between(*p.radius_ok)),
        ("radius_ratio", (F.col("radius_ratio") < p.ratio_ok[0]) | (F.col("radius_ratio") > p.ratio_ok[1])),
        ("not_unit_length", F.abs(F.col("pred_norm") - 1.0) > 0.05),
    ]
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return attrs.select("*", F.explode(flags).alias("flag"))


def unmatched(gt: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Missed references (``FN``) and unsupported predictions (``FP``)."""
    fn = gt.join(matches.select("case_id", F.col("gt_id").alias("id")), ["case_id", "id"], "left_anti")
    fp = pred.join(matches.select("case_id", F.col("pred_id").alias("id")), ["case_id", "id"], "left_anti")
    return fn.select("case_id", "id", F.lit("FN").alias("kind")).unionByName(fp.select("case_id", "id", F.lit("FP").alias("kind")))


def draft_status(pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Each prediction with ``draft_match``/``extra``, its reference id and its origin error."""
    m = matches.select("case_id", F.col("pred_id").alias("id"), "gt_id", F.col("dist_mm").alias("ostium_err_mm"))
    joined = pred.join(m, ["case_id", "id"], "left")
    return joined.withColumn("status", F.when(F.col("gt_id").isNotNull(), "draft_match").otherwise("extra"))


