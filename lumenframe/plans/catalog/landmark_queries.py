"""Landmark layer: distance joins, matching, scoring, duplicate collapse, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenframe.functions.rounding import r6
from lumenframe.operators import components, matching, metrics, quality_checks, resolve, review, rules, spatial
from lumenframe.params import Params
from lumenframe.plans.catalog.views import LM, landmarks, with_sql
from lumenframe.sources import documents


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lm = landmarks(spark, sf)
    return lm.where("is_gt"), lm.where(~F.col("is_gt"))


def _sides(spark, sf):
    gt, pred = _split(spark, sf)
    a = gt.select("case_id", F.col("id").alias("gt_id"), F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz"))
    b = pred.select("case_id", F.col("id").alias("pred_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    return a, b


G3, P3 = ["gx", "gy", "gz"], ["px", "py", "pz"]
DIST = "sqrt((g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y)+(g.z-p.z)*(g.z-p.z))"
PAIRS = f"pr AS (SELECT g.case_id, g.id AS gt_id, p.id AS pred_id, {DIST} AS d FROM lm g JOIN lm p ON g.case_id=p.case_id AND g.is_gt AND NOT p.is_gt)"
MUTUAL = """mm AS (SELECT case_id, gt_id, pred_id, d FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id, gt_id ORDER BY d, pred_id) AS rg,
      row_number() OVER (PARTITION BY case_id, pred_id ORDER BY d, gt_id) AS rp FROM pr WHERE d <= 10) WHERE rg = 1 AND rp = 1)"""
UNIT = "CASE WHEN sqrt({s}.dx*{s}.dx+{s}.dy*{s}.dy+{s}.dz*{s}.dz) > 1e-8 THEN {s}.{c}/sqrt({s}.dx*{s}.dx+{s}.dy*{s}.dy+{s}.dz*{s}.dz) ELSE {s}.{c} END"
COS = "least(greatest(" + "+".join(f"({UNIT.format(s='g', c=c)})*({UNIT.format(s='p', c=c)})" for c in ("dx", "dy", "dz")) + ", -1.0), 1.0)"
ATTR = f"""att AS (SELECT mm.case_id, mm.gt_id, mm.pred_id, mm.d AS ostium_err_mm,
    sqrt((g.sx-p.sx)*(g.sx-p.sx)+(g.sy-p.sy)*(g.sy-p.sy)+(g.sz-p.sz)*(g.sz-p.sz)) AS seed_err_mm, {COS} AS cosine,
    p.radius_mm AS pred_radius_mm, g.radius_mm AS gt_radius_mm, p.radius_mm/greatest(g.radius_mm, 1e-3) AS radius_ratio
  FROM mm JOIN lm g ON g.case_id=mm.case_id AND g.id=mm.gt_id JOIN lm p ON p.case_id=mm.case_id AND p.id=mm.pred_id)"""
CASES = """cm AS (SELECT c.case_id, n_gt, n_pred, coalesce(n_matched, 0) AS n_matched, mo, ms, mc FROM
    (SELECT case_id, CAST(count_if(is_gt) AS BIGINT) AS n_gt, CAST(count_if(NOT is_gt) AS BIGINT) AS n_pred FROM lm GROUP BY 1) c
    LEFT JOIN (SELECT case_id, count(*) AS n_matched, avg(ostium_err_mm) AS mo, avg(seed_err_mm) AS ms, avg(cosine) AS mc FROM att GROUP BY 1) m
    ON m.case_id = c.case_id),
 prf AS (SELECT *, CASE WHEN n_gt=0 AND n_pred=0 THEN 1.0 WHEN n_pred=0 THEN 0.0 ELSE n_matched/CAST(n_pred AS DOUBLE) END AS p,
    CASE WHEN n_gt=0 THEN 1.0 ELSE n_matched/CAST(n_gt AS DOUBLE) END AS r FROM cm)"""


def landmark_pairs_within(spark, sf):
    a, b = _sides(spark, sf)
    return spatial.pairs_within(a, b, 10.0, G3, P3).select("case_id", "gt_id", "pred_id", r6(F.col("dist_mm")).alias("dist_mm"))


def landmark_self_pairs(spark, sf):
    lm = landmarks(spark, sf).select("case_id", "id", "x", "y", "z")
    return spatial.pairs_within_self(lm, 8.0, ["x", "y", "z"], "id").select("case_id", "id_i", "id_j", r6(F.col("dist_mm")).alias("dist_mm"))


def landmark_nearest(spark, sf):
    a, b = _sides(spark, sf)
    return spatial.nearest(a, b, ["gt_id"], "pred_id", G3, P3, 1).select("case_id", "gt_id", "pred_id", r6(F.col("dist_mm")).alias("dist_mm"))


def landmark_top5(spark, sf):
    a, b = _sides(spark, sf)
    near = spatial.nearest(a, b, ["gt_id"], "pred_id", G3, P3, 5)
    return near.select("case_id", "gt_id", "pred_id", F.col("rank").cast("long").alias("rank"), r6(F.col("dist_mm")).alias("dist_mm"))


def landmark_nearest_cutoff(spark, sf):
    """Left join form: references without a prediction within 12 mm keep a null link."""
    a, b = _sides(spark, sf)
    near = spatial.nearest(a, b, ["gt_id"], "pred_id", G3, P3, 1, cutoff=12.0)
    return a.select("case_id", "gt_id").join(near.select("case_id", "gt_id", "pred_id", "dist_mm"), ["case_id", "gt_id"], "left").select(
        "case_id", "gt_id", "pred_id", r6(F.col("dist_mm")).alias("dist_mm")
    )


def mutual_nearest_matches(spark, sf):
    gt, pred = _split(spark, sf)
    m = matching.mutual_nearest_matches(gt, pred)
    return m.select("case_id", "gt_id", "pred_id", r6(F.col("dist_mm")).alias("dist_mm"))


def optimal_matches(spark, sf):
    gt, pred = _split(spark, sf)
    m = matching.optimal_matches(gt, pred)
    return m.select("case_id", "gt_id", "pred_id", r6(F.col("dist_mm")).alias("dist_mm"))


def _tens(spark, sf):
    """Landmarks in cases of ten consecutive ids, so that SQL can enumerate the assignments."""
    lm = landmarks(spark, sf).withColumn("case_id", F.floor(F.col("id") / 10).cast("long"))
    return lm.where("is_gt"), lm.where(~F.col("is_gt"))


def optimal_matches_of_ten(spark, sf):
    m = matching.optimal_matches(*_tens(spark, sf), Params(match_mm=25.0))
    return m.select("case_id", "gt_id", "pred_id", r6(F.col("dist_mm")).alias("dist_mm"))


def overall_prf_of_ten(spark, sf):
    """Scoring of the small cases with the exact assignment."""
    gt, pred = _tens(spark, sf)
    attrs = matching.match_attributes(matching.optimal_matches(gt, pred, Params(match_mm=25.0)), gt, pred)
    cases = gt.select("case_id").unionByName(pred.select("case_id")).distinct()
    m = metrics.overall_metrics(metrics.case_metrics(cases, gt, pred, attrs))
    return m.select("n_gt", "n_pred", "n_matched", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "mean_ostium_err_mm")])


def _attrs(spark, sf):
    gt, pred = _split(spark, sf)
    return gt, pred, matching.match_attributes(matching.mutual_nearest_matches(gt, pred), gt, pred)


def match_attributes(spark, sf):
    attrs = _attrs(spark, sf)[2]
    return attrs.select(
        "case_id", "gt_id", "pred_id",
        *[r6(F.col(c)).alias(c) for c in ("ostium_err_mm", "seed_err_mm", "cosine", "pred_radius_mm", "gt_radius_mm", "radius_ratio")],
    )


def match_flags(spark, sf):
    return matching.match_flags(_attrs(spark, sf)[2]).select("case_id", "gt_id", "pred_id", "flag")


def fn_fp(spark, sf):
    gt, pred = _split(spark, sf)
    return matching.unmatched(gt, pred, matching.mutual_nearest_matches(gt, pred))


def draft_status(spark, sf):
    gt, pred = _split(spark, sf)
    out = matching.draft_status(pred, matching.mutual_nearest_matches(gt, pred))
    return out.select("case_id", "id", "status", "gt_id", r6(F.col("ostium_err_mm")).alias("ostium_err_mm"))


def _case_metrics(spark, sf):
    gt, pred, attrs = _attrs(spark, sf)
    return metrics.case_metrics(landmarks(spark, sf).select("case_id"), gt, pred, attrs)


def case_prf(spark, sf):
    m = _case_metrics(spark, sf)
    return m.select(
        "case_id", "n_gt", "n_pred", "n_matched",
        *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "mean_ostium_err_mm", "mean_seed_err_mm", "mean_dir_cosine")],
    )


def overall_prf(spark, sf):
    m = metrics.overall_metrics(_case_metrics(spark, sf))
    return m.select("n_gt", "n_pred", "n_matched", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "mean_ostium_err_mm")])


def overall_prf_optimal(spark, sf):
    """Scoring with the exact assignment instead of mutual nearest pairs."""
    gt, pred = _split(spark, sf)
    attrs = matching.match_attributes(matching.optimal_matches(gt, pred), gt, pred)
    m = metrics.overall_metrics(metrics.case_metrics(landmarks(spark, sf).select("case_id"), gt, pred, attrs))
    return m.select("n_gt", "n_pred", "n_matched", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "mean_ostium_err_mm")])


def _candidates(spark, sf):
    lm = landmarks(spark, sf)
    n = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return lm.withColumns({c: F.when(n > 1e-8, F.col(c) / n).otherwise(F.col(c)) for c in ("dx", "dy", "dz")})


def near_dup_candidates(spark, sf):
    out = resolve.near_duplicate_pairs(_candidates(spark, sf))
    return out.select("case_id", "i", "j", "loser", "reason", r6(F.col("dist_mm")).alias("dist_mm"))


def near_dup_kept(spark, sf):
    return resolve.collapse_near_duplicates(_candidates(spark, sf)).select("case_id", "id")


def merge_reasons(spark, sf):
    out = resolve.path_merge_pairs(_candidates(spark, sf))
    return out.select(
        "case_id", "i", "j", "reason", "loser",
        *[r6(F.col(c)).alias(c) for c in ("dist_mm", "seed_sep_mm", "cosine", "dz_mm")],
    )


def path_merge_kept(spark, sf):
    """Near-duplicate collapse, then the path-divergence merge on its survivors."""
    kept = resolve.collapse_near_duplicates(_candidates(spark, sf))
    return resolve.collapse_paths(kept).select("case_id", "id")


def landmark_clusters(spark, sf):
    lm = landmarks(spark, sf).select("case_id", "id", "x", "y", "z")
    return components.merge_close(lm, 3.5).select("case_id", "id", "cluster")


def branch_numbering(spark, sf):
    lm = landmarks(spark, sf).where(~F.col("is_gt"))
    return review.number_branches(lm).select("case_id", "id", "instance_id")


def artifact_rules(spark, sf):
    lm = landmarks(spark, sf)
    return rules.with_artifact_reason(lm).select("case_id", "id", "reason")


def prediction_documents(spark, sf):
    lm = review.number_branches(_candidates(spark, sf).where(~F.col("is_gt")))
    docs = documents.build_documents(landmarks(spark, sf).select("case_id").distinct(), lm)
    first = F.element_at(F.col("daughters"), 1)
    return docs.select(
        F.col("case_id").cast("long").alias("case_id"),
        F.size("daughters").cast("long").alias("n_daughters"),
        first["instance_id"].alias("first_id"),
        r6(first["radius_mm"]).alias("first_radius_mm"),
        F.element_at(F.col("daughters"), -1)["instance_id"].alias("last_id"),
        F.col("parent.instance_id").alias("parent_id"),
    )


def _flat_documents(spark, sf):
    """Landmarks as raw document rows: some break the schema rules by their own values."""
    lm = review.number_branches(landmarks(spark, sf).where(~F.col("is_gt")))
    return lm.select(
        F.col("case_id").cast("string").alias("case_id"),
        F.lit("aorta").alias("document_parent"),
        "instance_id",
        F.when(F.col("vesselness") > 0.3, F.lit("other")).otherwise(F.lit("aorta")).alias("parent_instance_id"),
        F.array("x", "y", "z").alias("ostium_xyz_mm"),
        F.array("sx", "sy", "sz").alias("seed_xyz_mm"),
        (F.col("radius_mm") - 1.1).alias("radius_mm"),
        F.array(F.col("dx") * 5, F.col("dy") * 5, F.col("dz") * 5).alias("direction_xyz"),
        F.col("id"),
    )


def schema_violations(spark, sf):
    return quality_checks.schema_violations(_flat_documents(spark, sf)).select("case_id", "instance_id", "rule")


def sanity_flags(spark, sf):
    """Sanity flags of the same documents against a 64 x 64 x 64 grid of 0.8 x 0.8 x 1.5 mm."""
    flat = _flat_documents(spark, sf)
    cases = flat.select("case_id").distinct().select(
        "case_id",
        F.array(F.lit(64), F.lit(64), F.lit(64)).alias("size"),
        F.array(F.lit(0.8), F.lit(0.8), F.lit(1.5)).alias("spacing"),
        F.array(F.lit(-20.0), F.lit(-20.0), F.lit(-20.0)).alias("origin"),
        F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)]).alias("direction"),
    )
    return quality_checks.sanity_flags(cases, flat).select("case_id", "flag")


NUM = "bn AS (SELECT case_id, id, 'branch_' || lpad(CAST(row_number() OVER (PARTITION BY case_id ORDER BY z DESC, x, id) AS VARCHAR), 3, '0') AS instance_id FROM lm WHERE NOT is_gt)"
_NORM = "sqrt(dx*dx+dy*dy+dz*dz)"
CAND = f"cd AS (SELECT case_id, id, x, y, z, sx, sy, sz, path_mm, vesselness, diameter_mm, CASE WHEN {_NORM}>1e-8 THEN dx/{_NORM} ELSE dx END AS dx, CASE WHEN {_NORM}>1e-8 THEN dy/{_NORM} ELSE dy END AS dy, CASE WHEN {_NORM}>1e-8 THEN dz/{_NORM} ELSE dz END AS dz FROM lm)"
PM = """q AS (SELECT a.case_id, a.id AS i, b.id AS j,
    sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d,
    sqrt((a.sx-b.sx)*(a.sx-b.sx)+(a.sy-b.sy)*(a.sy-b.sy)+(a.sz-b.sz)*(a.sz-b.sz)) AS s,
    least(greatest(a.dx*b.dx+a.dy*b.dy+a.dz*b.dz, -1.0), 1.0) AS c, abs(a.z-b.z) AS dzm,
    CASE WHEN a.path_mm+0.3*a.diameter_mm >= b.path_mm+0.3*b.diameter_mm THEN b.id ELSE a.id END AS loser,
    CASE WHEN a.path_mm+20.0*a.vesselness >= b.path_mm+20.0*b.vesselness THEN b.id ELSE a.id END AS near_loser
  FROM cd a JOIN cd b ON a.case_id=b.case_id AND a.id<b.id),
 reasons AS (SELECT *, CASE WHEN d<=3.5 THEN 'close_ostium' WHEN c<0.25 OR s>d+2.0 THEN 'keep_diverged'
    WHEN c<0.40 AND s+1.0>=d THEN 'keep_unaligned' ELSE 'path_merge' END AS reason FROM q WHERE d <= 8.0)"""

# The ordered collapse, pair by pair: a pair both of whose ends are left drops its loser.
DROPS = "WITH RECURSIVE " + ",\n".join([LM, CAND, PM.replace("q AS (", "q AS MATERIALIZED (", 1)]) + """,
np AS MATERIALIZED (SELECT case_id, i, j, near_loser AS loser, row_number() OVER (PARTITION BY case_id ORDER BY i, j) AS n FROM q WHERE d <= 5.0),
nf(case_id, n, gone) AS (
  SELECT DISTINCT case_id, 0::BIGINT, []::BIGINT[] FROM np
  UNION ALL
  SELECT f.case_id, f.n + 1, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE list_append(gone, loser) END
  FROM nf f JOIN np ON np.case_id = f.case_id AND np.n = f.n + 1),
near_left AS MATERIALIZED (SELECT case_id, id FROM cd WHERE NOT EXISTS (SELECT 1 FROM (SELECT case_id, unnest(max_by(gone, n)) AS id FROM nf GROUP BY 1) g WHERE g.case_id = cd.case_id AND g.id = cd.id))"""
PATH_DROPS = DROPS + """,
pp AS MATERIALIZED (SELECT r.case_id, i, j, loser, row_number() OVER (PARTITION BY r.case_id ORDER BY i, j) AS n FROM reasons r
  JOIN near_left a ON a.case_id = r.case_id AND a.id = r.i JOIN near_left b ON b.case_id = r.case_id AND b.id = r.j WHERE reason IN ('close_ostium', 'path_merge')),
pf(case_id, n, gone) AS (
  SELECT DISTINCT case_id, 0::BIGINT, []::BIGINT[] FROM pp
  UNION ALL
  SELECT f.case_id, f.n + 1, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE list_append(gone, loser) END
  FROM pf f JOIN pp ON pp.case_id = f.case_id AND pp.n = f.n + 1)
SELECT case_id, id FROM near_left l WHERE NOT EXISTS (SELECT 1 FROM (SELECT case_id, unnest(max_by(gone, n)) AS id FROM pf GROUP BY 1) g WHERE g.case_id = l.case_id AND g.id = l.id)"""

_RULE = """CASE WHEN bone_frac >= 0.22 THEN 'bone_frac' WHEN path_mm < 6.0 AND circularity < 0.38 THEN 'short_flat'
  WHEN vesselness < 0.08 AND adj_lumen_frac >= 0.28 AND radius_mm >= 3.0 THEN 'adj_blob'
  WHEN vesselness < 0.02 AND radius_cv >= 0.40 THEN 'smear_cv' END"""

SANITY = """fl AS (SELECT CAST(lm.case_id AS VARCHAR) AS case_id, bn.instance_id, radius_mm - 1.1 AS r, x, y, z, sx, sy, sz
    FROM lm JOIN bn ON bn.case_id=lm.case_id AND bn.id=lm.id),
 ax AS (SELECT case_id, instance_id, k, v, (v[1]+20.0)/0.8 AS i0, (v[2]+20.0)/0.8 AS i1, (v[3]+20.0)/1.5 AS i2 FROM (
    SELECT case_id, instance_id, 'ostium_xyz_mm' AS k, [x, y, z] AS v FROM fl UNION ALL
    SELECT case_id, instance_id, 'seed_xyz_mm', [sx, sy, sz] FROM fl)),
 bad AS (SELECT *, CASE WHEN i0 < -1.0 OR i0 > 65.0 THEN 0 WHEN i1 < -1.0 OR i1 > 65.0 THEN 1 WHEN i2 < -1.0 OR i2 > 65.0 THEN 2 END AS a FROM ax)"""

TENS = "WITH RECURSIVE " + LM + """,
tg AS MATERIALIZED (SELECT floor(id / 10)::BIGINT AS case_id, id, x, y, z, row_number() OVER (PARTITION BY floor(id / 10) ORDER BY id) AS k FROM lm WHERE is_gt),
tp AS MATERIALIZED (SELECT floor(id / 10)::BIGINT AS case_id, id, x, y, z FROM lm WHERE NOT is_gt),
tn AS MATERIALIZED (SELECT g.case_id, g.n AS ng, p.n AS np FROM (SELECT case_id, count(*) AS n FROM tg GROUP BY 1) g JOIN (SELECT case_id, count(*) AS n FROM tp GROUP BY 1) p USING (case_id)),
tries(case_id, k, skipped, used, pairs, total) AS (
  SELECT case_id, 0::BIGINT, 0::BIGINT, []::BIGINT[], []::STRUCT(g BIGINT, p BIGINT, d DOUBLE)[], 0.0::DOUBLE FROM tn
  UNION ALL
  SELECT t.case_id, t.k + 1, t.skipped + (p.id IS NULL)::BIGINT, CASE WHEN p.id IS NULL THEN used ELSE list_append(used, p.id) END,
    CASE WHEN p.id IS NULL THEN pairs ELSE list_append(pairs, {'g': g.id, 'p': p.id, 'd': sqrt((g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y)+(g.z-p.z)*(g.z-p.z))}) END,
    total + coalesce(sqrt((g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y)+(g.z-p.z)*(g.z-p.z)), 0.0)
  FROM tries t JOIN tn USING (case_id) JOIN tg g ON g.case_id = t.case_id AND g.k = t.k + 1
  JOIN (SELECT * FROM tp UNION ALL SELECT case_id, NULL, NULL, NULL, NULL FROM tn) p ON p.case_id = t.case_id
  WHERE CASE WHEN p.id IS NULL THEN t.skipped < ng - np ELSE NOT list_contains(used, p.id) END),
won AS (SELECT case_id, min_by(pairs, total) AS pairs FROM tries JOIN tn USING (case_id) WHERE k = ng AND len(pairs) = least(ng, np) GROUP BY 1),
hit AS (SELECT case_id, q.g AS gt_id, q.p AS pred_id, q.d AS d FROM (SELECT case_id, unnest(pairs) AS q FROM won) WHERE q.d <= 25.0)
"""

LANDMARK_QUERIES = {
    "landmark_pairs_within": (landmark_pairs_within, with_sql(LM, PAIRS) + "SELECT case_id, gt_id, pred_id, round(d, 6) AS dist_mm FROM pr WHERE d <= 10"),
    "landmark_self_pairs": (landmark_self_pairs, with_sql(LM) + "SELECT * FROM (SELECT g.case_id, g.id AS id_i, p.id AS id_j, round(" + DIST + ", 6) AS dist_mm FROM lm g JOIN lm p ON g.case_id=p.case_id AND g.id<p.id) WHERE dist_mm <= 8.0"),
    "landmark_nearest": (landmark_nearest, with_sql(LM, PAIRS) + "SELECT case_id, gt_id, pred_id, round(d, 6) AS dist_mm FROM (SELECT *, row_number() OVER (PARTITION BY case_id, gt_id ORDER BY d, pred_id) AS rn FROM pr) WHERE rn = 1"),
    "landmark_top5": (landmark_top5, with_sql(LM, PAIRS) + 'SELECT case_id, gt_id, pred_id, rn AS "rank", round(d, 6) AS dist_mm FROM (SELECT *, row_number() OVER (PARTITION BY case_id, gt_id ORDER BY d, pred_id) AS rn FROM pr) WHERE rn <= 5'),
    "landmark_nearest_cutoff": (landmark_nearest_cutoff, with_sql(LM, PAIRS) + "SELECT g.case_id, g.id AS gt_id, n.pred_id, round(n.d, 6) AS dist_mm FROM lm g LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY case_id, gt_id ORDER BY d, pred_id) AS rn FROM pr WHERE d <= 12) n ON n.case_id=g.case_id AND n.gt_id=g.id AND n.rn=1 WHERE g.is_gt"),
    "mutual_nearest_matches": (mutual_nearest_matches, with_sql(LM, PAIRS, MUTUAL) + "SELECT case_id, gt_id, pred_id, round(d, 6) AS dist_mm FROM mm"),
    "optimal_matches": (optimal_matches, None),
    "optimal_matches_of_ten": (optimal_matches_of_ten, TENS + "SELECT case_id, gt_id, pred_id, round(d, 6) AS dist_mm FROM hit"),
    "overall_prf_of_ten": (overall_prf_of_ten, TENS + """, c AS (SELECT case_id, count(*) FILTER (is_gt) AS ng, count(*) FILTER (NOT is_gt) AS np FROM (SELECT floor(id / 10)::BIGINT AS case_id, is_gt FROM lm) GROUP BY 1),
 k AS (SELECT case_id, count(*) AS nm, avg(d) AS mo FROM hit GROUP BY 1),
 t AS (SELECT sum(ng)::BIGINT AS n_gt, sum(np)::BIGINT AS n_pred, coalesce(sum(nm), 0)::BIGINT AS n_matched, avg(mo) AS mo FROM c LEFT JOIN k USING (case_id))
SELECT n_gt, n_pred, n_matched, round(n_matched / n_pred, 6) AS "precision", round(n_matched / n_gt, 6) AS recall, round(2.0 * n_matched / (n_pred + n_gt), 6) AS f1, round(mo, 6) AS mean_ostium_err_mm FROM t"""),
    "match_attributes": (match_attributes, with_sql(LM, PAIRS, MUTUAL, ATTR) + "SELECT case_id, gt_id, pred_id, round(ostium_err_mm,6) AS ostium_err_mm, round(seed_err_mm,6) AS seed_err_mm, round(cosine,6) AS cosine, round(pred_radius_mm,6) AS pred_radius_mm, round(gt_radius_mm,6) AS gt_radius_mm, round(radius_ratio,6) AS radius_ratio FROM att"),
    "match_flags": (match_flags, with_sql(LM, PAIRS, MUTUAL, ATTR) + """SELECT case_id, gt_id, pred_id, 'direction_mismatch' AS flag FROM att WHERE cosine < 0.35
UNION ALL SELECT case_id, gt_id, pred_id, 'implausible_radius' FROM att WHERE NOT (pred_radius_mm BETWEEN 0.35 AND 8.0)
UNION ALL SELECT case_id, gt_id, pred_id, 'radius_ratio' FROM att WHERE radius_ratio < 0.35 OR radius_ratio > 2.8"""),
    "fn_fp": (fn_fp, with_sql(LM, PAIRS, MUTUAL) + "SELECT case_id, id, 'FN' AS kind FROM lm WHERE is_gt AND NOT EXISTS (SELECT 1 FROM mm WHERE mm.case_id=lm.case_id AND mm.gt_id=lm.id) UNION ALL SELECT case_id, id, 'FP' FROM lm WHERE NOT is_gt AND NOT EXISTS (SELECT 1 FROM mm WHERE mm.case_id=lm.case_id AND mm.pred_id=lm.id)"),
    "draft_status": (draft_status, with_sql(LM, PAIRS, MUTUAL) + "SELECT lm.case_id, lm.id, CASE WHEN mm.gt_id IS NULL THEN 'extra' ELSE 'draft_match' END AS status, mm.gt_id, round(mm.d,6) AS ostium_err_mm FROM lm LEFT JOIN mm ON mm.case_id=lm.case_id AND mm.pred_id=lm.id WHERE NOT is_gt"),
    "case_prf": (case_prf, with_sql(LM, PAIRS, MUTUAL, ATTR, CASES) + 'SELECT case_id, n_gt, n_pred, n_matched, round(p,6) AS "precision", round(r,6) AS recall, round(CASE WHEN n_gt=0 AND n_pred=0 THEN 1.0 WHEN n_gt=0 OR p+r=0 THEN 0.0 ELSE 2*p*r/(p+r) END,6) AS f1, round(mo,6) AS mean_ostium_err_mm, round(ms,6) AS mean_seed_err_mm, round(mc,6) AS mean_dir_cosine FROM prf'),
    "overall_prf": (overall_prf, with_sql(LM, PAIRS, MUTUAL, ATTR, CASES) + ', t AS (SELECT CAST(sum(n_gt) AS BIGINT) AS n_gt, CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(n_matched) AS BIGINT) AS n_matched, avg(mo) AS mo FROM cm), u AS (SELECT *, n_matched/CAST(n_pred AS DOUBLE) AS p, n_matched/CAST(n_gt AS DOUBLE) AS r FROM t) SELECT n_gt, n_pred, n_matched, round(p,6) AS "precision", round(r,6) AS recall, round(2*p*r/(p+r),6) AS f1, round(mo,6) AS mean_ostium_err_mm FROM u'),
    "overall_prf_optimal": (overall_prf_optimal, None),
    "near_dup_candidates": (near_dup_candidates, with_sql(LM, CAND, PM) + "SELECT case_id, i, j, near_loser AS loser, 'near_dup' AS reason, round(d,6) AS dist_mm FROM q WHERE d <= 5.0"),
    "near_dup_kept": (near_dup_kept, DROPS + "SELECT case_id, id FROM near_left"),
    "merge_reasons": (merge_reasons, with_sql(LM, CAND, PM) + "SELECT case_id, i, j, reason, CASE WHEN reason IN ('close_ostium','path_merge') THEN loser END AS loser, round(d,6) AS dist_mm, round(s,6) AS seed_sep_mm, round(c,6) AS cosine, round(dzm,6) AS dz_mm FROM reasons"),
    "path_merge_kept": (path_merge_kept, PATH_DROPS),
    "landmark_clusters": (landmark_clusters, "WITH RECURSIVE " + LM + """,
e AS (SELECT g.case_id, g.id AS a, p.id AS b FROM lm g JOIN lm p ON g.case_id=p.case_id AND g.id<>p.id AND """ + DIST + """ <= 3.5),
reach(case_id, src, node) AS (SELECT case_id, id, id FROM lm UNION SELECT r.case_id, r.src, e.b FROM reach r JOIN e ON e.case_id=r.case_id AND e.a=r.node)
SELECT case_id, src AS id, min(node) AS cluster FROM reach GROUP BY 1, 2"""),
    "branch_numbering": (branch_numbering, with_sql(LM, NUM) + "SELECT * FROM bn"),
    "artifact_rules": (artifact_rules, with_sql(LM) + f"SELECT case_id, id, {_RULE} AS reason FROM lm"),
    "prediction_documents": (prediction_documents, with_sql(LM, NUM) + "SELECT c.case_id, coalesce(n, 0) AS n_daughters, f AS first_id, fr AS first_radius_mm, l AS last_id, 'aorta' AS parent_id FROM (SELECT DISTINCT case_id FROM lm) c LEFT JOIN (SELECT bn.case_id, count(*) AS n, min(instance_id) AS f, round(round_even(min_by(lm.radius_mm, instance_id), 4),6) AS fr, max(instance_id) AS l FROM bn JOIN lm ON lm.case_id=bn.case_id AND lm.id=bn.id GROUP BY 1) d ON d.case_id=c.case_id"),
    "schema_violations": (schema_violations, with_sql(LM, NUM) + f""", v AS (SELECT CAST(lm.case_id AS VARCHAR) AS case_id, bn.instance_id, vesselness, radius_mm - 1.1 AS r, sqrt(dx*5*(dx*5)+dy*5*(dy*5)+dz*5*(dz*5)) AS nrm FROM lm JOIN bn ON bn.case_id=lm.case_id AND bn.id=lm.id)
SELECT case_id, instance_id, 'parent_not_aorta' AS rule FROM v WHERE vesselness > 0.3
UNION ALL SELECT case_id, instance_id, 'negative_radius' FROM v WHERE r < 0
UNION ALL SELECT case_id, instance_id, 'direction_not_unit' FROM v WHERE nrm < 0.5 OR nrm > 1.5"""),
    "sanity_flags": (sanity_flags, with_sql(LM, NUM, SANITY) + """SELECT case_id, 'high_count:' || CAST(count(*) AS VARCHAR) AS flag FROM fl GROUP BY case_id HAVING count(*) > 15
UNION ALL SELECT case_id, 'negative_radius:' || instance_id FROM fl WHERE r < 0
UNION ALL SELECT case_id, 'oob:' || instance_id || '.' || k || '[' || CAST(a AS VARCHAR) || ']=' || printf('%.2f', CASE a WHEN 0 THEN i0 WHEN 1 THEN i1 ELSE i2 END) FROM bad WHERE a IS NOT NULL"""),
}
