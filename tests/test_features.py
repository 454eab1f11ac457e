import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import OFFS, SP, cells_df, distance, grid_df
from lumenframe.operators import features, ridge, rules, sections, strips, structure
from lumenframe.params import DEFAULTS

SHAPE = (12, 20, 20)


def with_inst(df, i=1):
    return df.withColumn("inst_id", F.lit(i))


def test_pca_against_svd(spark):
    g = np.random.default_rng(1)
    masks = {"a": g.random(SHAPE) < 0.05, "line": np.zeros(SHAPE, bool), "one": np.zeros(SHAPE, bool)}
    masks["line"][3, 2:15, 7] = True
    masks["one"][1, 1, 1] = True
    for c, r in {r.case_id: r for r in features.pca(with_inst(cells_df(spark, masks)), grid_df(spark, {k: SHAPE for k in masks})).collect()}.items():
        pts = np.argwhere(masks[c]) * SP
        _, sv, vt = np.linalg.svd(pts - pts.mean(0), full_matrices=False)
        sv = np.pad(sv, (0, 3 - len(sv)))
        assert np.allclose([r.sv1, r.sv2, r.sv3], sv, atol=2e-5)
        if c != "one":
            assert abs(abs(np.dot([r.axis_a, r.axis_b, r.axis_c], vt[0])) - 1) < 1e-6


def walk_reference(start, cells, dist, depth, sp, max_mm=10.0, min_mm=5.0):
    """Independent walk: scores every option with arrays instead of a sorted list."""
    here = np.array(start)
    path, total, seen, fork = [here], 0.0, {tuple(here)}, False
    limit = int(max_mm / max(min(sp), 0.3)) + 8
    for _ in range(limit):
        opts = []
        for o in OFFS:
            q = tuple(here + o)
            if q in seen or q not in cells:
                continue
            rise = dist[q] - dist[tuple(here)]
            if rise < -0.35:
                continue
            opts.append((1.6 * rise + 0.5 * depth[q] - 0.05 * np.linalg.norm(np.array(o) * sp), q))
        if not opts:
            break
        opts = sorted(opts)[::-1]
        if len(opts) > 1 and total >= 3.0 and opts[0][0] - opts[1][0] < 0.25 and abs(dist[opts[0][1]] - dist[opts[1][1]]) < 1.2:
            fork = True
            break
        q = np.array(opts[0][1])
        total += np.linalg.norm((q - here) * sp)
        here = q
        seen.add(tuple(q))
        path.append(q)
        if total >= max_mm:
            break
    return np.array(path), total, fork


def test_walks_and_their_summary(spark):
    g = np.random.default_rng(2)
    parent = np.zeros(SHAPE, bool)
    parent[:, :, :3] = True
    dist = distance(parent)
    lumen, starts = {}, []
    for i in range(6):
        m = (g.random(SHAPE) < 0.55) & ~parent
        m[5, 10, 3] = True
        lumen[i] = m
        starts.append(("a", i, 0, 5.0, 10.0, 3.0 if i else 2.0))
    starts.append(("a", 99, 0, 1.0, 1.0, 1.0))
    depth = g.uniform(0.3, 2.0, SHAPE)
    rows = [("a", i, int(z), int(y), int(x), float(dist[z, y, x]), float(depth[z, y, x])) for i, m in lumen.items() for z, y, x in np.argwhere(m)]
    df = spark.createDataFrame(rows, "case_id string, inst_id int, z int, y int, x int, dist_mm double, depth_mm double")
    s = spark.createDataFrame(starts, "case_id string, inst_id int, walk_id int, wz double, wy double, wx double")
    grid = grid_df(spark, {"a": SHAPE})
    paths = ridge.ridge_walks(df, s, grid).cache()
    summary = {r.inst_id: r for r in ridge.walk_summary(paths, grid).collect()}
    for i, m in lumen.items():
        cells = set(map(tuple, np.argwhere(m)))
        start = (5, 10, 3)
        if i == 0:  # snapped: first neighbour in scan order
            start = next(tuple(np.array((5, 10, 2)) + o) for o in OFFS if tuple(np.array((5, 10, 2)) + o) in cells)
        want, total, fork = walk_reference(start, cells, dist, depth, np.array(SP))
        got = sorted((r.step, r.z, r.y, r.x) for r in paths.where(f"inst_id = {i}").collect())
        assert [list(r[1:]) for r in got] == want.tolist()
        r = summary[i]
        assert abs(r.walk_mm - total) < 1e-9 and r.fork == fork
        mm = want * SP
        cum = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(mm, axis=0), axis=1))])
        hit = np.flatnonzero(cum >= 5.0)
        seed = want[hit[0]] if len(hit) else want[-1]
        assert [r.seed_z, r.seed_y, r.seed_x] == seed.tolist()
        assert r.seed_ok == bool(len(hit) or (total > 0 and total >= 4.25))
        used = mm[: (hit[0] + 1) if len(hit) else len(mm)]
        if len(used) >= 4:
            axis = np.linalg.svd(used - used.mean(0))[2][0]
            axis *= np.sign(axis @ (used[-1] - used[0]))
            assert np.dot([r.head_z, r.head_y, r.head_x], axis) > 1 - 1e-6
    assert summary[99].walk_mm == 0.0 and not summary[99].seed_ok and summary[99].head_z == 1.0


def resample_reference(pts, step=1.5):
    mm = pts * SP
    seg = np.linalg.norm(np.diff(mm, axis=0), axis=1)
    cum = np.concatenate([[0], np.cumsum(seg)])
    n = max(3, int(cum[-1] // step) + 1)
    t = np.linspace(0, cum[-1], n)
    return np.stack([np.interp(t, cum, pts[:, i]) for i in range(3)], 1)


def test_path_resampling(spark):
    g = np.random.default_rng(3)
    paths = {"a": np.cumsum(g.uniform(0.2, 1.0, (9, 3)), axis=0), "two": np.array([[0.0, 0, 0], [0.3, 0, 0]]), "dot": np.array([[1.0, 2, 3], [1.0, 2, 3]]), "one": np.array([[4.0, 5, 6]])}
    rows = [(c, i, *map(float, q)) for c, p in paths.items() for i, q in enumerate(p)]
    df = spark.createDataFrame(rows, "case_id string, step int, z double, y double, x double")
    got = sections.resample_paths(df, grid_df(spark, {c: SHAPE for c in paths}), ["case_id"]).collect()
    for c in ("a", "two"):
        have = np.array([[r.z, r.y, r.x] for r in sorted((r for r in got if r.case_id == c), key=lambda r: r.k)])
        want = resample_reference(paths[c])
        assert have.shape == want.shape and np.abs(have - want).max() < 1e-9
    for c in ("dot", "one"):
        assert [(r.k, r.z, r.tz, r.ty) for r in got if r.case_id == c] == [(0, paths[c][0][0], 1.0, 0.0)]


def test_sections_of_a_straight_tube(spark):
    sp = (0.5, 0.5, 0.5)
    shape = (24, 25, 25)
    z, y, x = np.meshgrid(*map(np.arange, shape), indexing="ij")
    r = np.hypot((y - 12) * 0.5, (x - 12) * 0.5)
    tube = r <= 2.0
    flat = (np.abs(y - 12) * 0.5 <= 0.6) & (np.abs(x - 12) * 0.5 <= 3.0)
    masks = {"tube": tube, "flat": flat}
    depth = {c: distance(~m, sp) for c, m in masks.items()}
    grid = grid_df(spark, {c: shape for c in masks}, sp)
    cells = with_inst(cells_df(spark, masks, depth_mm=depth))
    line = spark.createDataFrame([(c, 1, i, 2.0 + 2 * i, 12.0, 12.0) for c in masks for i in range(10)], "case_id string, inst_id int, step int, z double, y double, x double")
    out = {r.case_id: r for r in sections.path_consistency(line, cells, grid, ["case_id", "inst_id"]).collect()}
    assert out["tube"].radius_cv < 1e-9 and out["tube"].circularity > 0.95
    assert out["flat"].circularity < 0.4
    hu = {"tube": np.where(tube, 300.0, 40.0), "flat": np.where(flat, 300.0, 40.0)}
    vox = cells_df(spark, {c: np.ones(shape, bool) for c in masks}, hu=hu)
    calib = spark.createDataFrame([("tube", 200.0, 400.0), ("flat", 200.0, 400.0)], "case_id string, blood_low double, blood_high double")
    seeds = spark.createDataFrame([("tube", 1, 12.0, 12.0, 12.0, 1.0, 0.0, 0.0)], "case_id string, inst_id int, seed_z double, seed_y double, seed_x double, head_z double, head_y double, head_x double")
    got = sections.plane_radius(seeds, vox, calib, grid, ["case_id", "inst_id"]).first().plane_radius_mm
    assert abs(got - 2.0) < 0.2


def test_trilinear_depth(spark):
    depth = np.random.default_rng(5).uniform(0, 3, (6, 6, 6))
    cells = with_inst(cells_df(spark, {"a": np.ones((6, 6, 6), bool)}, depth_mm={"a": depth}))
    at = np.random.default_rng(6).uniform(0, 5, (20, 3))
    s = spark.createDataFrame([("a", 1, i, *map(float, p)) for i, p in enumerate(at)], "case_id string, inst_id int, k int, z double, y double, x double")
    for r in sections.trilinear_depth(s, cells, ["case_id", "inst_id"]).collect():
        p = at[r.k]
        b = np.floor(p).astype(int)
        want = sum(np.prod(np.where(c, p - b, 1 - (p - b))) * depth[tuple(b + c)] for c in np.ndindex(2, 2, 2))
        assert abs(r.depth_mm - want) < 1e-9


def test_strip_landmarks_and_profile(spark):
    inst = np.zeros(SHAPE, bool)
    inst[1:11, 9:11, 4:6] = True  # runs along z beside the wall
    inst[1:11, 10:16, 4:6] |= np.arange(1, 11)[:, None, None] > 8
    contact = np.zeros(SHAPE, bool)
    contact[1:11, 9:11, 4] = True
    grid = grid_df(spark, {"a": SHAPE})
    depth = {"a": np.full(SHAPE, 1.0)}
    depth["a"][5, :, :] = 0.4
    c = with_inst(cells_df(spark, {"a": contact}, depth_mm=depth))
    r = features.strip_landmarks(c, with_inst(cells_df(spark, {"a": inst})), grid).first()
    assert {r.strip_oz} <= {1.0, 10.0}
    along = abs(r.strip_sz - r.strip_oz) * 1.5
    assert 3.5 <= along <= 6.5
    p = strips.strip_profile(c, grid).first()
    assert p.end_cos > 0.7 and p.waist_mm == 0.4 and abs(p.waist_ratio - 0.4) < 0.05 and 0 < p.top15_turn_share <= 1
    kept = strips.thinned_strip(c, grid).orderBy("k").collect()
    arcs = [k.arc for k in kept]
    assert arcs[0] == 0.0 and all(b - a >= 1.0 - 1e-9 for a, b in zip(arcs[:-2], arcs[1:-1]))
    ball = np.zeros(SHAPE, bool)
    ball[5:7, 5:8, 5:8] = True
    assert features.strip_landmarks(with_inst(cells_df(spark, {"a": ball})), with_inst(cells_df(spark, {"a": ball})), grid).count() == 0


def test_structural_report(spark):
    inst, parent = np.zeros(SHAPE, bool), np.zeros(SHAPE, bool)
    parent[:, :, 0:3] = True
    inst[2, 5, 3:9] = True
    inst[8, 8, 8] = True
    pts = [("a", 1, i, "line", 2.0, 5.0, 3.0 + i) for i in range(6)] + [("a", 1, 7, "line", 2.0, 12.0, 3.0), ("a", 1, 8, "seed", 2.0, 6.0, 5.0)]
    points = spark.createDataFrame(pts, "case_id string, inst_id int, pid int, kind string, z double, y double, x double")
    r = structure.branch_report(with_inst(cells_df(spark, {"a": inst})), cells_df(spark, {"a": parent}), grid_df(spark, {"a": SHAPE}), points).first()
    assert (r.voxel_count, r.components_26, r.face_contacts, r.parent_overlap) == (7, 2, 1, 0)
    assert abs(r.seed_distance_mm - 0.8) < 1e-12 and abs(r.centerline_max_distance_mm - 5.6) < 1e-9
    assert abs(r.centerline_covered - 6 / 7) < 1e-12


@pytest.mark.parametrize(
    "row,want",
    [
        (dict(bone_frac=0.22), "bone_frac"),
        (dict(path_mm=5.9, circularity=0.37), "short_flat"),
        (dict(path_mm=5.9, circularity=None), None),
        (dict(vesselness=0.07, adj_lumen_frac=0.28, radius_mm=3.0), "adj_blob"),
        (dict(vesselness=0.01, radius_cv=0.4), "smear_cv"),
        (dict(vesselness=0.01, radius_cv=None), None),
        (dict(), None),
    ],
)
def test_artifact_rules(spark, row, want):
    base = dict(bone_frac=0.0, path_mm=9.0, circularity=0.9, vesselness=0.5, adj_lumen_frac=0.0, radius_mm=1.0, radius_cv=0.1)
    base.update(row)
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} double" for k in base))
    assert rules.with_artifact_reason(df).first().reason == want


def test_site_and_path_rules(spark):
    cols = "oz double, dir_z double, diameter_mm double, ostium_z_mm double, z_first int, z_last int, lo_cap boolean, hi_cap boolean, parent_z_min_mm double"
    rows = [
        (1.0, 0.8, 2.0, 30.0, 0, 40, True, True, 0.0),
        (3.0, 0.8, 2.0, 30.0, 0, 40, True, True, 0.0),
        (4.0, 0.8, 2.0, 30.0, 0, 40, True, True, 0.0),
        (1.0, 0.8, 2.0, 30.0, 0, 40, False, True, 0.0),
        (38.0, -0.75, 2.0, 30.0, 0, 40, False, True, 0.0),
        (20.0, -0.5, 4.5, 10.0, 0, 40, True, True, 0.0),
        (20.0, -0.5, 4.4, 10.0, 0, 40, True, True, 0.0),
        (20.0, -0.3, 5.0, 10.0, 0, 40, True, True, 0.0),
    ]
    got = [r.site_reason for r in rules.with_site_reason(spark.createDataFrame(rows, cols)).collect()]
    assert got == ["crop_cap", "crop_cap", None, None, "crop_cap", "terminal_split", None, None]
    cols = "walk_mm double, extent_mm double, span_mm double, sv1 double, sv2 double, med_vesselness double"
    rows = [(1.0, 2.0, 3.0, 9.0, 1.0, 1.0), (1.0, 2.0, 6.0, 9.0, 1.0, 1.0), (1.0, 2.0, 6.0, 4.9, 1.0, 1.0), (1.0, 2.0, 6.0, 9.0, 1.0, 0.04), (5.0, 0.0, 0.0, 1.0, 1.0, 0.0)]
    got = [r.path_reason for r in rules.with_path_reason(spark.createDataFrame(rows, cols)).collect()]
    assert got == ["short_path", None, "span_blob", "span_blob", None]


def test_seed_is_clamped_to_five_millimetres(spark):
    cols = "oz double, oy double, ox double, seed_z double, seed_y double, seed_x double, head_z double, head_y double, head_x double, sz double, sy double, sx double"
    rows = [(1.0, 2.0, 3.0, 3.0, 4.0, 9.0, 0.0, 0.0, 1.0, *SP), (1.0, 2.0, 3.0, 1.0, 2.0, 3.0, 0.0, 0.0, 1.0, *SP)]
    a, b = features.clamp_seed(spark.createDataFrame(rows, cols), DEFAULTS).collect()
    step = np.array([a.seed_z - 1, a.seed_y - 2, a.seed_x - 3]) * SP
    assert abs(np.linalg.norm(step) - 5) < 1e-12
    assert np.allclose(step / 5, np.array([2, 2, 6]) * SP / np.linalg.norm(np.array([2, 2, 6]) * SP))
    assert abs((b.seed_z - 1) * 1.5 - 5) < 1e-12 and math.isclose(b.head_z, 1.0)


