import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import matching, metrics
from lumenframe.params import Params

LM = "case_id string, id string, x double, y double, z double, sx double, sy double, sz double, dx double, dy double, dz double, radius_mm double"


def lm(spark, rows):
    full = [(c, i, *map(float, (*p, p[0] + 5 * d[0], p[1] + 5 * d[1], p[2] + 5 * d[2], *d, r))) for c, i, p, d, r in rows]
    return spark.createDataFrame(full, LM)


def test_assignment_against_permutations():
    g = np.random.default_rng(0)
    for n, m in [(1, 1), (2, 5), (4, 4), (5, 7), (3, 3)]:
        cost = g.uniform(0, 30, (n, m))
        got = cost[np.arange(n), matching.min_cost_assignment(cost)].sum()
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert abs(got - best) < 1e-9


def test_gate_comes_after_the_assignment(spark):
    # g1-p1 lies inside the gate, but the best total gives p1 to g2 and leaves g1 with a far one
    gt = lm(spark, [("c", "g1", (0.0, 0, 0), (0, 0, 1.0), 1.0), ("c", "g2", (2.0, 0, 0), (0, 0, 1.0), 1.0)])
    pred = lm(spark, [("c", "p1", (1.2, 0, 0), (0, 0, 1.0), 1.0), ("c", "p2", (-11.0, 0, 0), (0, 0, 1.0), 1.0)])
    got = {(r.gt_id, r.pred_id) for r in matching.optimal_matches(gt, pred).collect()}
    assert got == {("g2", "p1")}


def test_large_cases_are_solved_row_by_row(spark):
    """2,600 x 2,600 costs in one case: no row of an assignment can be exchanged with others at a gain (no negative cycle)."""
    g = np.random.default_rng(8)
    a, b = g.uniform(0, 300, (2600, 3)), g.uniform(0, 300, (2600, 3))
    col = matching.min_cost_assignment(matching.Distances(a, b))
    assert sorted(col) == list(range(2600))
    cost = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    price = np.zeros(2600)  # potentials of the exchange graph exist only at an optimum
    gain = cost - cost[np.arange(2600), col][:, None]
    for _ in range(2600):
        lower = np.minimum(price, (price[:, None] + gain).min(0)[col])
        if np.allclose(lower, price, atol=1e-10):
            break
        price = lower
    else:
        raise AssertionError("a cycle of exchanges gains")
    few = lm(spark, [("c", f"g{i}", tuple(q), (0, 0, 1.0), 1.0) for i, q in enumerate(a[:70])]), lm(spark, [("c", f"p{i}", tuple(q), (0, 0, 1.0), 1.0) for i, q in enumerate(a[:90] + 0.1)])
    assert {(r.gt_id[1:], r.pred_id[1:]) for r in matching.optimal_matches(*few).collect()} == {(str(i),) * 2 for i in range(70)}


def test_empty_sides_and_flags(spark):
    cases = spark.createDataFrame([("both",), ("nopred",), ("nogt",), ("none",)], "case_id string")
    gt = lm(spark, [("both", "g", (0.0, 0, 0), (0, 0, 1.0), 1.0), ("nopred", "g", (0.0, 0, 0), (0, 0, 1.0), 1.0)])
    pred = lm(spark, [("both", "p", (3.0, 4.0, 0), (0, 0, -1.0), 9.0), ("nogt", "p", (0.0, 0, 0), (0, 0, 1.0), 1.0)])
    m = matching.optimal_matches(gt, pred)
    attrs = matching.match_attributes(m, gt, pred)
    r = {x.case_id: x for x in metrics.case_status(metrics.case_metrics(cases, gt, pred, attrs)).collect()}
    assert (r["none"].precision, r["none"].recall, r["none"].f1) == (1.0, 1.0, 1.0)
    assert (r["nopred"].precision, r["nopred"].recall, r["nopred"].f1, r["nopred"].case_flag) == (0.0, 0.0, 0.0, "no_predictions")
    assert (r["nogt"].precision, r["nogt"].recall, r["nogt"].f1, r["nogt"].case_flag) == (0.0, 1.0, 0.0, "gt_empty")
    assert r["both"].f1 == 1.0 and r["both"].mean_ostium_err_mm == 5.0 and r["both"].mean_dir_cosine == -1.0
    flags = {x.flag for x in matching.match_flags(attrs).collect()}
    assert flags == {"direction_mismatch", "implausible_radius", "radius_ratio"}
    left = {(x.case_id, x.kind) for x in matching.unmatched(gt, pred, m).collect()}
    assert left == {("nopred", "FN"), ("nogt", "FP")}


def test_golden_overall(spark):
    # stored counts and mean origin errors of five scored cases
    rows = [("case_19", 3, 4, 3, 1.615), ("case_20", 4, 3, 3, 3.884), ("case_21", 3, 9, 3, 2.584), ("case_22", 6, 11, 6, 1.845), ("case_23", 3, 2, 2, 3.88)]
    df = spark.createDataFrame(rows, "case_id string, n_gt long, n_pred long, n_matched long, mean_ostium_err_mm double")
    o = metrics.serialised(metrics.overall_metrics(df)).first()
    assert (o.n_gt, o.n_pred, o.n_matched, o.precision, o.recall, o.f1, o.mean_ostium_err_mm) == (19, 29, 17, 0.5862, 0.8947, 0.7083, 2.762)


def test_half_even(spark):
    df = spark.createDataFrame([(0.12345, 2.0005)], "precision double, mean_seed_err_mm double")
    assert df.select(F.bround(F.lit(2.5), 0), F.bround(F.lit(0.125), 2)).first()[:] == (2.0, 0.12)
    assert metrics.serialised(df).first().precision in (0.1234, 0.1235)


def test_case_order_does_not_matter(spark):
    g = np.random.default_rng(4)
    rows = [(f"c{i % 3}", f"{i:03d}", tuple(g.uniform(0, 20, 3).tolist()), (0, 0, 1.0), 1.0) for i in range(60)]
    a = lm(spark, rows[::2]), lm(spark, rows[1::2])
    b = lm(spark, rows[::2][::-1]).repartition(7), lm(spark, rows[1::2][::-1]).repartition(3)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(matching.optimal_matches(*a)) == key(matching.optimal_matches(*b))
    assert key(matching.mutual_nearest_matches(*a)) == key(matching.mutual_nearest_matches(*b))


def test_tasks_of_exact_matching_follow_the_rows(spark, monkeypatch):
    """More rows make more tasks; each case is solved as if it were alone."""
    rng = np.random.default_rng(5)
    rows = [(c, i, *map(float, rng.random(3) * 20), bool(rng.random() < 0.5)) for c in range(40) for i in range(int(rng.integers(2, 30)))]
    df = spark.createDataFrame(rows, "case_id bigint, id bigint, x double, y double, z double, is_gt boolean")
    gt, pred = df.where("is_gt").drop("is_gt"), df.where("not is_gt").drop("is_gt")
    monkeypatch.setattr(matching, "TASK_ROWS", 50)
    out = matching.optimal_matches(gt, pred, Params(match_mm=1e9))
    got = {(r.case_id, r.gt_id, r.pred_id): r.dist_mm for r in out.collect()}
    assert out.rdd.getNumPartitions() >= len(rows) // 50
    want = {}
    for c in range(40):
        g = sorted(r for r in rows if r[0] == c and r[5])
        q = sorted(r for r in rows if r[0] == c and not r[5])
        a, b = np.array([r[2:5] for r in g]).reshape(-1, 3), np.array([r[2:5] for r in q]).reshape(-1, 3)
        if len(g) and len(q):
            cost = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
            cols = matching.min_cost_assignment(cost if len(g) <= len(q) else cost.T)
            for i, j in (enumerate(cols) if len(g) <= len(q) else ((i, j) for j, i in enumerate(cols))):
                want[c, g[i][1], q[j][1]] = cost[i, j]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
