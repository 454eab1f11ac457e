import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import distributions as ds
from lumenframe.operators import quality_model as qm
from lumenframe.operators import review, splitting
from lumenframe.plans import review_cycle
from helpers import cells_df, grid_df

# a few stored feature rows: case, instance, verdict, then the model features
ROWS = [
    ("case_19", "b1", "confirmed_real", 0.2423, 0.2777, 0.6530, 13.91, 2.881, 0.00, 0.052),
    ("case_19", "b2", "confirmed_real", 0.4236, 0.1627, 0.6514, 13.75, 1.569, 0.00, 0.064),
    ("case_20", "b1", "confirmed_false", 0.0150, 0.5200, 0.3300, 5.20, 3.400, 0.25, 0.310),
    ("case_20", "b2", "confirmed_real", 0.1900, 0.3100, 0.5800, 11.20, 1.900, 0.01, 0.110),
    ("case_21", "b1", "confirmed_false", 0.0410, 0.4400, 0.3600, 5.60, 3.100, 0.19, 0.290),
    ("case_21", "b2", "confirmed_false", 0.0900, 0.3900, 0.5100, 7.90, 2.600, 0.11, 0.210),
    ("case_22", "b1", "confirmed_real", 0.3300, 0.2200, 0.7000, 13.10, 1.700, 0.00, 0.080),
    ("case_22", "b2", "confirmed_false", 0.0700, 0.3500, 0.4200, 8.30, 2.900, 0.07, 0.240),
    ("case_23", "b1", "confirmed_real", 0.0010, 0.3100, 0.6200, 12.40, 2.100, 0.02, 0.130),
    ("case_23", "b2", "uncertain", 0.2000, None, 0.6000, 9.00, 2.000, 0.00, 0.100),
]


def rows(spark):
    return spark.createDataFrame(ROWS, "case_id string, instance_id string, verdict string, " + ", ".join(f"{f} double" for f in qm.FEATURES))


def test_logistic_fit_is_at_the_minimum(spark):
    d = qm.standardised(qm.design_rows(rows(spark)))
    assert d.count() == 9
    m = qm.fit_gate(d)
    x = np.array([[r[f] for f in qm.FEATURES] for r in d.collect()])
    y = np.array([r.label for r in d.collect()])
    assert np.allclose(x.mean(0), 0) and np.allclose(x.std(0), 1)
    w = np.array(m.coefficients)
    p = 1 / (1 + np.exp(-(x @ w + m.intercept)))
    assert np.abs(x.T @ (p - y) / len(y) + w / len(y)).max() < 1e-4 and abs((p - y).mean()) < 1e-4


def test_held_out_scores_use_only_other_cases(spark):
    d = qm.design_rows(rows(spark))
    scored = {(r.case_id, r.instance_id): r.p_real for r in qm.leave_one_case_out(d).collect()}
    assert len(scored) == 9
    raw = [r for r in ROWS if r[2] != "uncertain"]
    x, y = np.array([r[3:] for r in raw]), np.array([float(r[2] == "confirmed_real") for r in raw])
    tr = np.array([r[0] != "case_22" for r in raw])
    mu, sd = x[tr].mean(0), x[tr].std(0)
    z = np.c_[np.ones(len(x)), (x - mu) / sd]
    w = np.zeros(8)
    for _ in range(200):  # Newton steps
        p = 1 / (1 + np.exp(-z[tr] @ w))
        pen = np.r_[0.0, np.ones(7)] / tr.sum()
        g = z[tr].T @ (p - y[tr]) / tr.sum() + pen * w
        h = (z[tr].T * (p * (1 - p))) @ z[tr] / tr.sum() + np.diag(pen + 1e-12)
        w -= np.linalg.solve(h, g)
    want = 1 / (1 + np.exp(-z @ w))
    for r, v in zip(raw, want):
        if r[0] == "case_22":
            assert abs(scored[r[0], r[1]] - v) < 1e-3


def newton_reference(x, y, l2=1.0):
    mu, sd = x.mean(0), x.std(0)
    sd = np.where(sd < 1e-8, 1.0, sd)
    z, w, pen = np.c_[np.ones(len(x)), (x - mu) / sd], np.zeros(x.shape[1] + 1), np.r_[0.0, np.full(x.shape[1], l2)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(pen), z.T @ (p - y) + pen * w)
    return lambda q: 1 / (1 + np.exp(-np.c_[np.ones(len(q)), (q - mu) / sd] @ w))


@pytest.mark.parametrize("block", [7, 1024])
def test_every_case_is_a_fold(spark, block):
    """400 cases, one of them a third of the rows, and a case whose removal leaves one label."""
    g = np.random.default_rng(21)
    n = 1500
    case = np.where(g.random(n) < 0.33, 0, g.integers(1, 400, n))
    x = g.normal(0, 1, (n, 2)) * [1.0, 40.0] + [3.0, 900.0]
    y = (x[:, 0] - 3 + g.normal(0, 1, n) > 0).astype(float)
    y[case == 3] = 1 - y[case == 3]
    df = spark.createDataFrame([(int(c), i, float(v), *map(float, q)) for i, (c, v, q) in enumerate(zip(case, y, x))], "case_id long, id long, label double, a double, b double")
    got = {r.id: r.p_real for r in qm.leave_one_case_out(df, ("a", "b"), block=block).collect()}
    assert len(got) == n
    for c in [0, 3, 17, 200, 399]:
        own = case == c
        want = newton_reference(x[~own], y[~own])(x[own]) if own.any() else []
        assert np.abs(np.array([got[i] for i in np.flatnonzero(own)]) - want).max() < 1e-8
    two = spark.createDataFrame([("p", 1.0, 0.0), ("p", 1.0, 1.0), ("q", 0.0, 2.0), ("q", 1.0, 5.0)], "case_id string, label double, a double")
    assert {(r.case_id, round(r.p_real, 6)) for r in qm.leave_one_case_out(two, ("a",)).collect() if r.case_id == "q"} == {("q", 1.0)}


def test_threshold_studies(spark):
    g = np.random.default_rng(3)
    t, f = np.round(g.normal(1, 1, 40), 1), np.round(g.normal(0, 1, 50), 1)
    df = spark.createDataFrame([(float(v), True) for v in t] + [(float(v), False) for v in f] + [(float("nan"), True), (None, False)], "v double, t boolean")
    for high in (True, False):
        best = max(
            ((((t >= c) if high else (t <= c)).mean() - ((f >= c) if high else (f <= c)).mean(), -c) for c in np.unique(np.r_[t, f])),
        )
        r = ds.best_youden(df, "v", F.col("t"), high).first()
        assert math.isclose(r.youden, best[0], abs_tol=1e-12) and r.threshold == -best[1]
        k = ds.keep_all_cut(df, "v", F.col("t"), high).first()
        assert k.n_dropped == ((f < t.min()) if high else (f > t.max())).sum()
    b = ds.overlap_band(df, "v", F.col("t")).first()
    lo, hi = max(t.min(), f.min()), min(t.max(), f.max())
    assert (b.lo, b.hi, b.n_true_in, b.n_extra_in) == (lo, hi, ((t >= lo) & (t <= hi)).sum(), ((f >= lo) & (f <= hi)).sum())
    h = ds.histogram(df, "v", -2.0, 2.0, 8, ["t"])
    got = {(r.t, r.bin): r.n for r in h.collect()}
    for flag, v in ((True, t), (False, f)):
        assert [got[flag, i] for i in range(8)] == np.histogram(v, np.linspace(-2, 2, 9))[0].tolist()
    s = ds.summary(df, "v", ["t"]).where("t").first()
    assert np.allclose([s.p10, s.median, s.p95], np.percentile(t, [10, 50, 95])) and s.n == 40


def test_sweep_and_implied_scores(spark):
    d = spark.createDataFrame([(0.2, True), (0.5, True), (0.1, False), (0.7, False)], "p double, y boolean")
    sweep = qm.threshold_sweep(d, "p", F.col("y"))
    assert sweep.count() == 13
    safe = qm.safest_threshold(sweep).first()
    assert abs(safe.threshold - 0.2) < 1e-9 and safe.tn == 1
    assert qm.safest_threshold(sweep.where("fn > 0")).count() == 0
    r = spark.createDataFrame([("draft_match", None), ("draft_match", "bone_frac"), ("extra", "smear_cv"), ("extra", None)], "status string, reason string")
    o = qm.implied_scores(r, 3).first()
    assert (o.n_match, o.n_pred, o.dropped_matches, o.dropped_extras) == (1, 2, 1, 1) and abs(o.recall - 1 / 3) < 1e-12


def test_review_tables(spark):
    det = spark.createDataFrame([("c", "b1", "extra"), ("c", "b2", "draft_match"), ("d", "b1", "extra")], "case_id string, instance_id string, status string")
    ver = spark.createDataFrame([("c", "b2", "confirmed_real"), ("x", "b9", "uncertain")], "case_id string, instance_id string, verdict string")
    got = review.attach_verdicts(det, ver)
    assert {(r.case_id, r.instance_id): r.verdict for r in got.collect()} == {("c", "b1"): None, ("c", "b2"): "confirmed_real", ("d", "b1"): None}
    cur = spark.createDataFrame([("c", "b1", None, "any"), ("c", "b2", "extra", "no")], "case_id string, instance_id string, status string, review_flag string")
    flags = {(r.case_id, r.instance_id): r.review_flag for r in review.curated_flags(det, cur).collect()}
    assert flags == {("c", "b1"): "any", ("c", "b2"): "", ("d", "b1"): ""}
    carried = review.carry_flags(det, cur)
    assert {r.review_flag for r in carried.collect()} == {"any", "no", ""}
    u = review.union_review_rows(det.withColumn("verdict", F.lit("")), ver, ver.withColumn("crop_path", F.lit("")))
    assert u.count() == 7 and u.where("verdict = 'confirmed_real'").count() == 1
    census = spark.createDataFrame([("c", "b1", 19.0, True, False, 3, 40, 0.1, 1.0), ("c", "b2", 15.5, False, False, 3, 40, None, 1.0), ("c", "b3", 3.0, False, False, 3, 40, None, 1.0)], "case_id string, instance_id string, contact_spread_mm double, over_18mm_threshold boolean, would_full_split boolean, n_contact long, n_instance long, cluster_cos double, ostium_z double")
    w = review.spread_worklist(census).collect()
    assert [r.status for r in w] == ["over_18", "near_18"]
    s = review.spread_census_summary(census).first()
    assert (s.n, s.n_near, s.n_over, s.n_full_split, s.p50_mm) == (3, 2, 1, 0, 15.5)


def test_study_end_to_end(spark):
    f = rows(spark).drop("verdict").withColumn("status", F.when(F.col("instance_id") == "b1", "draft_match").otherwise("extra"))
    f = f.withColumn("rule_drop", F.when(F.col("bone_frac") >= 0.22, "bone_frac"))
    v = rows(spark).select("case_id", "instance_id", "verdict")
    s = review_cycle.study(f, v, 6)
    assert s.scores.count() == 9 and s.sweep.count() == 13
    assert {(r.verdict, r.n_dropped) for r in s.impact.collect()} == {("confirmed_real", 0), ("confirmed_false", 1), ("uncertain", 0)}
    assert s.medians.where("verdict = 'confirmed_real' and feature = 'vesselness'").first().n == 5


def test_opposing_ridges_are_split(spark):
    shape = (5, 60, 30)
    parent = np.zeros(shape, bool)
    parent[:, :, 10:14] = True
    inst = np.zeros(shape, bool)
    inst[1:4, 2:58, 14:16] = True  # one long wall contact
    inst[1:4, 2:8, 14:26] = True  # leaves at one end
    inst[1:4, 52:58, 14:26] = True  # and at the other
    sp = (0.8, 0.8, 0.8)
    grid = grid_df(spark, {"a": shape}, sp)
    x = np.broadcast_to(np.arange(shape[2])[None, None, :], shape)
    y = np.broadcast_to(np.arange(shape[1])[None, :, None], shape)
    # wall distance rising towards both ends makes the ridges oppose
    dist = (x - 13) * 0.1 + np.abs(y - 29.5) * 0.8
    cells = cells_df(spark, {"a": inst}, dist_mm={"a": dist.astype(float)}, depth_mm={"a": np.ones(shape)}).withColumn("inst_id", F.lit(4).cast("long"))
    contact = cells.where("x = 14")
    good, lab = splitting.ridge_clusters(contact, cells, grid)
    assert good.first().cluster_cos < 0.15 and lab.select("side").distinct().count() == 2
    parts = splitting.directional_split(cells, contact, cells_df(spark, {"a": parent}), grid)
    got = {(r.z, r.y, r.x): r.part for r in parts.collect()}
    assert len(got) == inst.sum() and set(got.values()) == {1, 2}
    assert got[2, 20, 14] != got[2, 40, 14]
    two = contact.where("y < 6 or y > 16 and y < 20")
    patches = splitting.contact_patch_split(cells, two, cells_df(spark, {"a": parent}), grid, 3.5)
    assert {r.part for r in patches.select("part").distinct().collect()} == {1, 2} and patches.count() == inst.sum()


def test_curated_flags_keep_one_row_each_and_last_verdict_counts(spark):
    rows = spark.createDataFrame([("a", "i", "extra")], "case_id string, instance_id string, status string")
    curated = spark.createDataFrame([("a", "i", "extra", "x"), ("a", "i", "draft_match", "y"), ("a", "i", None, "z")], "case_id string, instance_id string, status string, review_flag string")
    assert [r.review_flag for r in review.curated_flags(rows, curated).collect()] == ["x"]
    edits = spark.createDataFrame([("a", "i", 1, "zz"), ("a", "i", 2, "aa")], "case_id string, instance_id string, edit_ts int, verdict string")
    assert [r.verdict for r in review.attach_verdicts(rows, edits).collect()] == ["aa"]
