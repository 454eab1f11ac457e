"""Review layer: distributions, threshold studies, logistic gate, verdicts, side patterns, deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions.rounding import r6
from lumenframe.operators import distributions as ds
from lumenframe.operators import matching, metrics, quality_checks, quality_model, review, rules
from lumenframe.plans.catalog.landmark_queries import MUTUAL, PAIRS, _RULE
from lumenframe.plans.catalog.views import DET, LM, VERD, detections, landmarks, table, verdict_edits, with_sql

def _true():
    return F.when(F.col("verdict") == "confirmed_real", True).when(F.col("verdict") == "confirmed_false", False)

_TF = "tf AS (SELECT feature AS v, verdict = 'confirmed_real' AS t FROM det WHERE verdict <> 'uncertain')"


def distribution_by_status(spark, sf):
    out = ds.summary(detections(spark, sf), "feature", ["verdict"])
    return out.select("verdict", "n", *[r6(F.col(c)).alias(c) for c in out.columns if c not in ("verdict", "n")])


def keep_all_true(spark, sf):
    return ds.keep_all_cut(detections(spark, sf), "feature", _true()).select("cut", "n_true", "n_extra", "n_dropped")


def keep_all_true_ceiling(spark, sf):
    return ds.keep_all_cut(detections(spark, sf), "feature", _true(), higher_is_signal=False).select("cut", "n_true", "n_extra", "n_dropped")


def youden_cut(spark, sf):
    out = ds.best_youden(detections(spark, sf), "feature", _true())
    return out.select("threshold", r6(F.col("youden")).alias("youden"), "tp", "fn", "fp", "tn")


def youden_cut_ceiling(spark, sf):
    out = ds.best_youden(detections(spark, sf), "feature", _true(), higher_is_signal=False)
    return out.select("threshold", r6(F.col("youden")).alias("youden"), "tp", "fn", "fp", "tn")


def overlap_band(spark, sf):
    return ds.overlap_band(detections(spark, sf), "feature", _true())


def histogram(spark, sf):
    out = ds.histogram_over_range(detections(spark, sf), "feature", 25, ["verdict"])
    return out.select("verdict", F.col("bin").cast("long").alias("bin"), r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "n")


def short_path_audit(spark, sf):
    return ds.short_paths(landmarks(spark, sf)).select("case_id", "id", r6(F.col("path_mm")).alias("path_mm"))


def threshold_sweep(spark, sf):
    d = detections(spark, sf).where(F.col("verdict") != "uncertain").withColumn("score", F.col("feature") / (F.col("feature") + 3000.0))
    out = quality_model.threshold_sweep(d, "score", F.col("verdict") == "confirmed_real")
    return out.select(r6(F.col("threshold")).alias("threshold"), "tp", "fn", "tn", "fp", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


def safest_threshold(spark, sf):
    d = detections(spark, sf).where(F.col("verdict") != "uncertain").withColumn("score", F.col("feature") / (F.col("feature") + 3000.0))
    return quality_model.safest_threshold(quality_model.threshold_sweep(d, "score", F.col("verdict") == "confirmed_real", 0.0, 0.6, 25)).select(
        r6(F.col("threshold")).alias("threshold"), "tn"
    )


def _labelled_landmarks(spark, sf):
    lm = landmarks(spark, sf)
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    v = F.when(F.col("quality") == 1, "confirmed_real").when(F.col("quality") == 0, "confirmed_false")
    return lm.join(l, "id", "left").withColumn("verdict", v)


def rule_impact(spark, sf):
    return quality_model.rule_impact(rules.with_artifact_reason(_labelled_landmarks(spark, sf)))


def implied_scores(spark, sf):
    gt, pred = landmarks(spark, sf).where("is_gt"), landmarks(spark, sf).where(~F.col("is_gt"))
    rows = rules.with_artifact_reason(matching.draft_status(pred, matching.mutual_nearest_matches(gt, pred)))
    n_gt = gt.count()
    out = quality_model.implied_scores(rows, n_gt)
    return out.select("n_match", "n_pred", "dropped_matches", "dropped_extras", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def standardised_features(spark, sf):
    z = quality_model.standardised(quality_model.design_rows(_labelled_landmarks(spark, sf)))
    return z.select("id", *[r6(F.col(f)).alias(f) for f in quality_model.FEATURES])


def fold_scales(spark, sf):
    rows = quality_model.design_rows(_labelled_landmarks(spark, sf)).withColumn("fold", (F.col("id") % 5).cast("int"))
    out = quality_model.fold_scales(rows, quality_model.FEATURES, "fold")
    return out.select("fold", "n_train", *[r6(F.col(f"{k}_{f}")).alias(f"{k}_{f}") for f in quality_model.FEATURES for k in ("mu", "sd")])


def loocv_scores(spark, sf):
    """Held-out gate scores, one case held out at a time."""
    out = quality_model.leave_one_case_out(quality_model.design_rows(_labelled_landmarks(spark, sf)))
    return out.select("case_id", "id", "label", F.round("p_real", 4).alias("p_real"))


def verdicts_current(spark, sf):
    return review.current_verdicts(verdict_edits(spark, sf)).select("key", "verdict", "edit_id")


def verdict_counts(spark, sf):
    return review.verdict_counts(detections(spark, sf), ["case_id"]).select("case_id", "verdict", "n")


def lost_gained(spark, sf):
    """Matched references before and after tightening the gate from 10 to 6 mm and widening seeds."""
    gt, pred = landmarks(spark, sf).where("is_gt"), landmarks(spark, sf).where(~F.col("is_gt"))
    before = matching.mutual_nearest_matches(gt, pred)
    after = matching.mutual_nearest_matches(
        gt.select("case_id", "id", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z")),
        pred.select("case_id", "id", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z")),
    )
    return review.lost_and_gained(before, after, ["case_id", "gt_id"]).select("case_id", "gt_id", "change")


def metric_deltas(spark, sf):
    gt, pred = landmarks(spark, sf).where("is_gt"), landmarks(spark, sf).where(~F.col("is_gt"))
    kept = rules.with_artifact_reason(pred).where(F.col("reason").isNull()).drop("reason")
    cases = landmarks(spark, sf).select("case_id")
    snap = lambda q: metrics.case_metrics(cases, gt, q, matching.match_attributes(matching.mutual_nearest_matches(gt, q), gt, q))
    out = metrics.metric_deltas(snap(pred), snap(kept))
    return out.select("case_id", "n_pred_delta", "n_matched_delta", *[r6(F.col(f"{c}_delta")).alias(f"{c}_delta") for c in ("precision", "recall", "f1")])


def _sided(spark, sf):
    lm = landmarks(spark, sf)
    centre = lm.where("is_gt").groupBy("case_id").agg(F.avg("x").alias("centre_x"))
    return review.with_side(lm.where(~F.col("is_gt")).select("case_id", "id", "x", "z"), centre)


def same_side_gaps(spark, sf):
    return review.same_side_gaps(_sided(spark, sf)).select("case_id", "side", "id", "next_id", r6(F.col("gap_mm")).alias("gap_mm"))


def side_sequence(spark, sf):
    return review.side_sequence(_sided(spark, sf)).select("case_id", "part", "sequence", "n_left", "n_right")


def opposite_pairs(spark, sf):
    return review.opposite_pairs(_sided(spark, sf)).select("case_id", "left_id", "right_id", r6(F.col("dz_mm")).alias("dz_mm"))


def pair_geometry(spark, sf):
    lm = landmarks(spark, sf)
    pairs = matching.mutual_nearest_matches(lm.where("is_gt"), lm.where(~F.col("is_gt"))).select("case_id", F.col("gt_id").alias("a_id"), F.col("pred_id").alias("b_id"))
    out = review.pair_geometry(pairs, lm)
    return out.select("case_id", "a_id", "b_id", *[r6(F.col(c)).alias(c) for c in ("dist_mm", "dz_mm", "in_plane_mm", "seed_sep_mm", "cosine")], "same_instance")


def curated_flags(spark, sf):
    """Detections with flags from a lookup table keyed by case, instance and status."""
    gt, pred = landmarks(spark, sf).where("is_gt"), landmarks(spark, sf).where(~F.col("is_gt"))
    rows = matching.draft_status(review.number_branches(pred), matching.mutual_nearest_matches(gt, pred))
    l = table(spark, sf, "labels")
    curated = (
        review.number_branches(pred).join(l.where("toxic = 1").select(F.col("doc_id").alias("id")), "id")
        .select("case_id", "instance_id", F.lit("extra").alias("status"), F.lit("independent_extra").alias("review_flag"))
    )
    return review.curated_flags(rows, curated).select("case_id", "instance_id", "status", "review_flag")


def review_union(spark, sf):
    """Detections of this run, earlier rows with blank verdicts, and their counts by verdict."""
    d = detections(spark, sf)
    new = d.where(F.col("verdict") == "uncertain").select("case_id", F.col("id").alias("instance_id"), "feature", F.lit("").alias("verdict"))
    old = d.where(F.col("verdict") != "uncertain").select("case_id", F.col("id").alias("instance_id"), "verdict")
    return review.union_review_rows(new, old).select("case_id", "instance_id", "feature", "verdict")


def worklist(spark, sf):
    """Rows of the priority list: one whole case, and single instances of the others."""
    d = detections(spark, sf).select("case_id", F.col("id").alias("instance_id"), "verdict")
    l = table(spark, sf, "labels").where("toxic = 1")
    single = d.join(l.select(F.col("doc_id").alias("instance_id")), "instance_id").select("case_id", "instance_id")
    whole = d.where(F.col("case_id") == "src3").select("case_id", F.lit(None).cast("long").alias("instance_id")).distinct()
    return review.worklist(d, priority=single.unionByName(whole)).select("case_id", "instance_id", "verdict")


def attach_verdicts(spark, sf):
    e = verdict_edits(spark, sf)
    rows = table(spark, sf, "customer").select((F.col("c_nationkey")).cast("long").alias("case_id"), F.col("c_custkey").alias("instance_id"))
    v = review.current_verdicts(e).join(rows, F.col("key") == F.col("instance_id")).select("case_id", "instance_id", "verdict")
    return review.attach_verdicts(rows, v).select("case_id", "instance_id", "verdict")


def run_summary(spark, sf):
    """Run-log lines written from the orders, parsed back into a run table."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    case = F.col("o_custkey").cast("string")
    lines = o.select(
        case.alias("case_id"),
        F.explode(F.array(
            F.concat(F.lit("Wrote out/"), case, F.lit(".json  ("), (F.col("o_orderkey") % 19).cast("string"), F.lit(" daughter(s))")),
            F.concat(F.lit("[compute] wall_clock_s="), F.round(F.col("o_totalprice") / 1000, 2).cast("decimal(12,2)").cast("string"), F.lit(" peak_rss_mb="), (F.col("o_orderkey") % 1024).cast("string")),
            F.when(F.col("o_orderkey") % 97 == 0, F.lit("Warning: header sheared")).otherwise(F.lit("ok")),
        )).alias("line"),
    )
    logs = quality_checks.parse_run_logs(lines)
    high = logs.where(F.col("n_detections") > 15).select("case_id", F.format_string("high_count:%d", "n_detections").alias("flag"))
    return quality_checks.run_summary(logs.select("case_id"), logs, high)


def miss_mechanism(spark, sf):
    """References classified by what lies at or near their origin."""
    from lumenframe.operators import spatial

    lm = landmarks(spark, sf)
    gt = lm.where("is_gt").select("case_id", "id", F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz"), "vesselness")
    pred = lm.where(~F.col("is_gt")).select("case_id", F.col("id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    near = spatial.nearest(gt, pred, ["id"], "pid", ["gx", "gy", "gz"], ["px", "py", "pz"], 1, cutoff=6.0).select("case_id", "id", F.col("dist_mm").alias("nearest_patch_mm"))
    pts = gt.join(near, ["case_id", "id"], "left").select(
        "case_id", "id",
        F.when(F.col("vesselness") > 0.25, 1).alias("instance_label"),
        F.when(F.col("vesselness") > 0.2, 1).alias("marker_label"),
        "nearest_patch_mm",
    )
    return quality_checks.miss_mechanism(pts).select("case_id", "id", "mechanism")


_CUM = """per AS (SELECT v, CAST(count_if(t) AS BIGINT) AS nt, CAST(count_if(NOT t) AS BIGINT) AS nf FROM tf GROUP BY v),
tot AS (SELECT CAST(sum(nt) AS BIGINT) AS n1, CAST(sum(nf) AS BIGINT) AS n0 FROM per)"""
_YHI = "y AS (SELECT a.v, CAST(sum(b.nt) AS BIGINT) AS tp, CAST(sum(b.nf) AS BIGINT) AS fp FROM per a JOIN per b ON b.v >= a.v GROUP BY a.v)"
_YLO = _YHI.replace(">=", "<=")
_YEND = " SELECT v AS threshold, round(tp/CAST(n1 AS DOUBLE) - fp/CAST(n0 AS DOUBLE), 6) AS youden, tp, n1-tp AS fn, fp, n0-fp AS tn FROM y, tot ORDER BY tp/CAST(n1 AS DOUBLE) - fp/CAST(n0 AS DOUBLE) DESC, v LIMIT 1"
_SCORE = "s AS (SELECT feature/(feature+3000.0) AS score, verdict = 'confirmed_real' AS t FROM det WHERE verdict <> 'uncertain')"
_SWEEP = """sw AS (SELECT {lo} + i*({hi}-{lo})/{n} AS threshold, CAST(count_if(t AND score >= {lo} + i*({hi}-{lo})/{n}) AS BIGINT) AS tp, CAST(count_if(t AND score < {lo} + i*({hi}-{lo})/{n}) AS BIGINT) AS fn,
  CAST(count_if(NOT t AND score < {lo} + i*({hi}-{lo})/{n}) AS BIGINT) AS tn, CAST(count_if(NOT t AND score >= {lo} + i*({hi}-{lo})/{n}) AS BIGINT) AS fp FROM s, (SELECT unnest(range(0, {m})) AS i) GROUP BY i)"""
_LAB = """lab AS (SELECT lm.*, CASE WHEN l.quality = 1 THEN 'confirmed_real' WHEN l.quality = 0 THEN 'confirmed_false' END AS verdict FROM lm LEFT JOIN labels l ON l.doc_id = lm.id)"""
_SIDE = """sd AS (SELECT p.case_id, p.id, p.x, p.z, p.x - c.cx AS dx, CASE WHEN p.x - c.cx >= 0 THEN 'L' ELSE 'R' END AS side
  FROM lm p JOIN (SELECT case_id, avg(x) AS cx FROM lm WHERE is_gt GROUP BY 1) c ON c.case_id = p.case_id WHERE NOT p.is_gt)"""
_NUM = "bn AS (SELECT case_id, id, 'branch_' || lpad(CAST(row_number() OVER (PARTITION BY case_id ORDER BY z DESC, x, id) AS VARCHAR), 3, '0') AS instance_id FROM lm WHERE NOT is_gt)"
_PRF = """SELECT c.case_id, c.n_gt, c.n_pred, coalesce(m.n, 0) AS n_matched,
  CASE WHEN n_gt=0 AND n_pred=0 THEN 1.0 WHEN n_pred=0 THEN 0.0 ELSE coalesce(m.n,0)/CAST(n_pred AS DOUBLE) END AS p, CASE WHEN n_gt=0 THEN 1.0 ELSE coalesce(m.n,0)/CAST(n_gt AS DOUBLE) END AS r
  FROM (SELECT case_id, CAST(count_if(is_gt) AS BIGINT) AS n_gt, CAST(count_if({pred}) AS BIGINT) AS n_pred FROM lm GROUP BY 1) c LEFT JOIN (SELECT case_id, count(*) AS n FROM {mm} GROUP BY 1) m ON m.case_id=c.case_id"""
_KEPT = f"({_RULE}) IS NULL"
_F1 = "CASE WHEN {a}.n_gt=0 AND {a}.n_pred=0 THEN 1.0 WHEN {a}.n_gt=0 OR {a}.p+{a}.r=0 THEN 0.0 ELSE 2*{a}.p*{a}.r/({a}.p+{a}.r) END"
_FEATS = quality_model.FEATURES

REVIEW_QUERIES = {
    "distribution_by_status": (distribution_by_status, with_sql(DET) + 'SELECT verdict, count(*) AS n, round(min(feature),6) AS "min", round(max(feature),6) AS "max", round(avg(feature),6) AS mean, round(quantile_cont(feature,0.5),6) AS median, ' + ", ".join(f"round(quantile_cont(feature,{q / 100}),6) AS p{q:02d}" for q in ds.QUANTILES) + " FROM det GROUP BY verdict"),
    "keep_all_true": (keep_all_true, with_sql(DET, _TF) + "SELECT c AS cut, CAST(count_if(t) AS BIGINT) AS n_true, CAST(count_if(NOT t) AS BIGINT) AS n_extra, CAST(count_if(NOT t AND v < c) AS BIGINT) AS n_dropped FROM tf, (SELECT min(v) AS c FROM tf WHERE t) GROUP BY c"),
    "keep_all_true_ceiling": (keep_all_true_ceiling, with_sql(DET, _TF) + "SELECT c AS cut, CAST(count_if(t) AS BIGINT) AS n_true, CAST(count_if(NOT t) AS BIGINT) AS n_extra, CAST(count_if(NOT t AND v > c) AS BIGINT) AS n_dropped FROM tf, (SELECT max(v) AS c FROM tf WHERE t) GROUP BY c"),
    "youden_cut": (youden_cut, with_sql(DET, _TF, _CUM, _YHI) + _YEND),
    "youden_cut_ceiling": (youden_cut_ceiling, with_sql(DET, _TF, _CUM, _YLO) + _YEND),
    "overlap_band": (overlap_band, with_sql(DET, _TF) + ", b AS (SELECT greatest(min(v) FILTER (t), min(v) FILTER (NOT t)) AS lo, least(max(v) FILTER (t), max(v) FILTER (NOT t)) AS hi FROM tf) SELECT lo, hi, CAST(count_if(t) AS BIGINT) AS n_true, CAST(count_if(NOT t) AS BIGINT) AS n_extra, CAST(count_if(t AND v BETWEEN lo AND hi) AS BIGINT) AS n_true_in, CAST(count_if(NOT t AND v BETWEEN lo AND hi) AS BIGINT) AS n_extra_in FROM tf, b GROUP BY lo, hi"),
    "histogram": (histogram, with_sql(DET) + ", rg AS (SELECT min(feature) AS a, (max(feature)-min(feature))/25.0::DOUBLE AS w FROM det) SELECT s.verdict, i AS bin, round(a+i*w,6) AS lo, round(a+(i+1)*w,6) AS hi, coalesce(n, 0) AS n FROM (SELECT verdict, unnest(range(0, 25)) AS i FROM (SELECT DISTINCT verdict FROM det)) s CROSS JOIN rg LEFT JOIN (SELECT verdict, least(CAST(floor((feature-a)/w) AS BIGINT), 24) AS b, count(*) AS n FROM det, rg GROUP BY 1, 2) c ON c.verdict=s.verdict AND c.b=s.i"),
    "short_path_audit": (short_path_audit, with_sql(LM) + "SELECT case_id, id, round(path_mm,6) AS path_mm FROM lm WHERE path_mm < 5.0"),
    "threshold_sweep": (threshold_sweep, with_sql(DET, _SCORE, _SWEEP.format(lo="CAST(0.15 AS DOUBLE)", hi="CAST(0.75 AS DOUBLE)", n=12, m=13)) + 'SELECT round(threshold,6) AS threshold, tp, fn, tn, fp, round(tp/CAST(greatest(tp+fp,1) AS DOUBLE),6) AS "precision", round(tp/CAST(greatest(tp+fn,1) AS DOUBLE),6) AS recall FROM sw'),
    "safest_threshold": (safest_threshold, with_sql(DET, _SCORE, _SWEEP.format(lo="CAST(0.0 AS DOUBLE)", hi="CAST(0.6 AS DOUBLE)", n=24, m=25)) + "SELECT round(threshold,6) AS threshold, tn FROM sw WHERE fn = 0 ORDER BY threshold DESC LIMIT 1"),
    "rule_impact": (rule_impact, with_sql(LM, _LAB) + f"SELECT coalesce(verdict, 'unlabeled') AS verdict, count(*) AS n, CAST(count_if(({_RULE}) IS NOT NULL) AS BIGINT) AS n_dropped FROM lab GROUP BY 1"),
    "implied_scores": (implied_scores, with_sql(LM, PAIRS, MUTUAL) + f""", r AS (SELECT {_KEPT} AS k, mm.gt_id IS NOT NULL AS h FROM lm LEFT JOIN mm ON mm.case_id=lm.case_id AND mm.pred_id=lm.id WHERE NOT is_gt),
 c AS (SELECT CAST(count_if(k AND h) AS BIGINT) AS n_match, CAST(count_if(k) AS BIGINT) AS n_pred, CAST(count_if(h AND NOT k) AS BIGINT) AS dropped_matches, CAST(count_if(NOT h AND NOT k) AS BIGINT) AS dropped_extras FROM r),
 d AS (SELECT c.*, n_match/CAST(greatest(n_pred,1) AS DOUBLE) AS p, n_match/CAST((SELECT count(*) FROM lm WHERE is_gt) AS DOUBLE) AS q FROM c)
SELECT n_match, n_pred, dropped_matches, dropped_extras, round(p,6) AS "precision", round(q,6) AS recall, round(2*p*q/greatest(p+q,1e-9),6) AS f1 FROM d"""),
    "standardised_features": (standardised_features, with_sql(LM, _LAB) + "SELECT id, " + ", ".join(f"round(({f}-avg({f}) OVER ())/CASE WHEN stddev_pop({f}) OVER () < 1e-8 THEN 1.0 ELSE stddev_pop({f}) OVER () END,6) AS {f}" for f in _FEATS) + " FROM lab WHERE verdict IS NOT NULL"),
    "fold_scales": (fold_scales, with_sql(LM, _LAB) + "SELECT CAST(k AS INT) AS fold, count(*) AS n_train, " + ", ".join(f"round(avg({f}),6) AS mu_{f}, round(stddev_pop({f}),6) AS sd_{f}" for f in _FEATS) + " FROM lab JOIN (SELECT DISTINCT id % 5 AS k FROM lab WHERE verdict IS NOT NULL) f ON lab.id % 5 <> k WHERE verdict IS NOT NULL GROUP BY k"),
    "loocv_scores": (loocv_scores, None),
    "verdicts_current": (verdicts_current, with_sql(VERD) + "SELECT key, verdict, edit_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY edit_ts DESC, edit_id DESC) AS rn FROM verd) WHERE rn = 1"),
    "verdict_counts": (verdict_counts, with_sql(DET) + "SELECT case_id, verdict, count(*) AS n FROM det GROUP BY 1, 2"),
    "lost_gained": (lost_gained, with_sql(LM, PAIRS, MUTUAL, PAIRS.replace("pr AS", "pr2 AS").replace("g.x-p.x", "g.sx-p.sx").replace("g.y-p.y", "g.sy-p.sy").replace("g.z-p.z", "g.sz-p.sz"), MUTUAL.replace("mm AS", "mm2 AS").replace("FROM pr ", "FROM pr2 ")) + "SELECT case_id, gt_id, 'lost' AS change FROM mm WHERE NOT EXISTS (SELECT 1 FROM mm2 WHERE mm2.case_id=mm.case_id AND mm2.gt_id=mm.gt_id) UNION ALL SELECT case_id, gt_id, 'gained' FROM mm2 WHERE NOT EXISTS (SELECT 1 FROM mm WHERE mm2.case_id=mm.case_id AND mm2.gt_id=mm.gt_id)"),
    "metric_deltas": (metric_deltas, with_sql(LM, PAIRS, MUTUAL, f"pk AS (SELECT pr.* FROM pr JOIN (SELECT id FROM lm WHERE {_KEPT}) k ON k.id = pr.pred_id)", MUTUAL.replace("mm AS", "mk AS").replace("FROM pr ", "FROM pk "), "b AS (" + _PRF.format(pred="NOT is_gt", mm="mm") + ")", "a AS (" + _PRF.format(pred=f"NOT is_gt AND {_KEPT}", mm="mk") + ")") + f'SELECT a.case_id, a.n_pred-b.n_pred AS n_pred_delta, a.n_matched-b.n_matched AS n_matched_delta, round(a.p-b.p,6) AS precision_delta, round(a.r-b.r,6) AS recall_delta, round({_F1.format(a="a")}-{_F1.format(a="b")},6) AS f1_delta FROM a JOIN b ON a.case_id=b.case_id'),
    "same_side_gaps": (same_side_gaps, with_sql(LM, _SIDE) + "SELECT case_id, side, id, lead(id) OVER w AS next_id, round(z - lead(z) OVER w, 6) AS gap_mm FROM sd WINDOW w AS (PARTITION BY case_id, side ORDER BY z DESC, id)"),
    "side_sequence": (side_sequence, with_sql(LM, _SIDE) + "SELECT case_id, CAST(0 AS BIGINT) AS part, string_agg(side, '' ORDER BY z DESC, id) AS sequence, CAST(count_if(side='L') AS BIGINT) AS n_left, CAST(count_if(side='R') AS BIGINT) AS n_right FROM sd GROUP BY case_id"),
    "opposite_pairs": (opposite_pairs, with_sql(LM, _SIDE) + "SELECT a.case_id, a.id AS left_id, b.id AS right_id, round(abs(a.z-b.z),6) AS dz_mm FROM sd a JOIN sd b ON a.case_id=b.case_id AND a.side='L' AND b.side='R' AND abs(a.z-b.z) < 8.0"),
    "pair_geometry": (pair_geometry, with_sql(LM, PAIRS, MUTUAL) + "SELECT mm.case_id, gt_id AS a_id, pred_id AS b_id, round(d,6) AS dist_mm, round(abs(g.z-p.z),6) AS dz_mm, round(sqrt((g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y)),6) AS in_plane_mm, round(sqrt((g.sx-p.sx)*(g.sx-p.sx)+(g.sy-p.sy)*(g.sy-p.sy)+(g.sz-p.sz)*(g.sz-p.sz)),6) AS seed_sep_mm, round((g.dx*p.dx+g.dy*p.dy+g.dz*p.dz)/sqrt(g.dx*g.dx+g.dy*g.dy+g.dz*g.dz)/sqrt(p.dx*p.dx+p.dy*p.dy+p.dz*p.dz),6) AS cosine, gt_id = pred_id AS same_instance FROM mm JOIN lm g ON g.case_id=mm.case_id AND g.id=gt_id JOIN lm p ON p.case_id=mm.case_id AND p.id=pred_id"),
    "curated_flags": (curated_flags, with_sql(LM, PAIRS, MUTUAL, _NUM) + "SELECT bn.case_id, bn.instance_id, CASE WHEN mm.gt_id IS NULL THEN 'extra' ELSE 'draft_match' END AS status, CASE WHEN mm.gt_id IS NULL AND l.toxic = 1 THEN 'independent_extra' ELSE '' END AS review_flag FROM bn LEFT JOIN mm ON mm.case_id=bn.case_id AND mm.pred_id=bn.id LEFT JOIN labels l ON l.doc_id=bn.id"),
    "review_union": (review_union, with_sql(DET) + "SELECT case_id, id AS instance_id, CASE WHEN verdict='uncertain' THEN feature END AS feature, '' AS verdict FROM det"),
    "worklist": (worklist, with_sql(DET) + "SELECT case_id, id AS instance_id, verdict FROM det LEFT JOIN labels l ON l.doc_id=id WHERE case_id='src3' OR l.toxic = 1"),
    "attach_verdicts": (attach_verdicts, with_sql(VERD) + "SELECT CAST(c_nationkey AS BIGINT) AS case_id, c_custkey AS instance_id, verdict FROM customer LEFT JOIN (SELECT key, verdict, row_number() OVER (PARTITION BY key ORDER BY edit_ts DESC, edit_id DESC) AS rn FROM verd) v ON v.key=c_custkey AND rn=1"),
    "run_summary": (run_summary, """WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS case_id, CAST(max(o_orderkey % 19) AS INT) AS n_detections, max(round(o_totalprice/1000, 2)) AS runtime_s, max(o_orderkey % 1024)/1024.0 AS pk, bool_or(o_orderkey % 97 = 0) AS w FROM orders GROUP BY 1)
SELECT case_id, n_detections, round(runtime_s, 2) AS runtime_s, round(CAST(pk AS DOUBLE), 4) AS peak_mem_gb, concat_ws(';', CASE WHEN n_detections > 15 THEN 'high_count:' || CAST(n_detections AS VARCHAR) END, CASE WHEN w THEN 'warning' END) AS flag, w OR n_detections > 15 AS needs_inspection FROM g"""),
    "miss_mechanism": (miss_mechanism, with_sql(LM, PAIRS) + "SELECT g.case_id, g.id, CASE WHEN vesselness > 0.25 THEN 'covered_by_instance' WHEN vesselness > 0.2 THEN 'marker_not_grown' WHEN m.d < 6.0 THEN 'patch_nearby' ELSE 'never_triggered' END AS mechanism FROM lm g LEFT JOIN (SELECT case_id, gt_id, min(d) AS d FROM pr GROUP BY 1, 2) m ON m.case_id=g.case_id AND m.gt_id=g.id WHERE is_gt"),
}
