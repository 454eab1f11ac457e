import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import OFFS, SP, as_array, cells_df, dilate, distance, geodesic, grid_df, label26
from lumenframe.operators import components, distance as dist, growth, lattice, masks, stencil

SHAPE = (9, 12, 11)


def random_mask(seed, share, shape=SHAPE):
    return np.random.default_rng(seed).random(shape) < share


def inside(df):
    return df.where(f"z between 0 and {SHAPE[0] - 1} and y between 0 and {SHAPE[1] - 1} and x between 0 and {SHAPE[2] - 1}").collect()


def ball(r):
    return [o for o in [(a, b, c) for a in range(-3, 4) for b in range(-5, 6) for c in range(-5, 6)] if sum((v * s) ** 2 for v, s in zip(o, SP)) <= r * r + 1e-6]


def test_dilations_and_erosions(spark):
    m = random_mask(1, 0.08)
    df, grid = cells_df(spark, {"a": m}), grid_df(spark, {"a": SHAPE})
    assert (as_array(inside(lattice.box_dilate(df)), SHAPE) == dilate(m, [(0, 0, 0), *OFFS])).all()
    assert (as_array(inside(lattice.ball_dilate(df, 1.7, grid)), SHAPE) == dilate(m, ball(1.7))).all()
    m = random_mask(2, 0.85)
    df = cells_df(spark, {"a": m})
    pad = np.pad(m, 1)
    faces = [pad[1 + a : SHAPE[0] + 1 + a, 1 + b : SHAPE[1] + 1 + b, 1 + c : SHAPE[2] + 1 + c] for a, b, c in OFFS if abs(a) + abs(b) + abs(c) == 1]
    core = m & np.logical_and.reduce(faces)
    assert (as_array(inside(lattice.erode6(df)), SHAPE) == core).all()
    assert (as_array(inside(lattice.surface(df)), SHAPE) == (m & ~core)).all()
    out = dilate(~np.pad(m, 3), ball(0.9))[3:-3, 3:-3, 3:-3]
    assert (as_array(inside(lattice.ball_erode(df, 0.9, grid)), SHAPE) == ~out).all()


def test_distance_matches_brute_force(spark):
    m = {"a": random_mask(3, 0.03), "b": random_mask(4, 0.01)}
    got = dist.distance_to_parent(cells_df(spark, m), grid_df(spark, {"a": SHAPE, "b": SHAPE}), 4.0).collect()
    for c in m:
        want = distance(m[c])
        have = as_array([r for r in got if r.case_id == c], SHAPE, "dist_mm", np.inf)
        assert np.abs(have[want <= 4.0] - want[want <= 4.0]).max() < 1e-12
        assert np.isinf(have[want > 4.0]).all()


@pytest.mark.parametrize("batch", [7, 10_000])
def test_depth_inside(spark, batch):
    m = {"a": random_mask(5, 0.93), "full": np.ones(SHAPE, bool)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = dist.depth_inside(cells_df(spark, m), grid_df(spark, {"a": SHAPE, "full": SHAPE})).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    want = distance(~m["a"])
    have = as_array([r for r in got if r.case_id == "a"], SHAPE, "depth_mm")
    assert np.abs(have - want)[m["a"]].max() < 1e-12
    assert all(r.depth_mm is None for r in got if r.case_id == "full") and len(got) == m["a"].sum() + m["full"].sum()


def test_depth_of_a_thick_body_takes_no_search_radius(spark):
    shape = (9, 60, 60)
    m = np.ones(shape, bool)
    m[4, 30, 57] = m[0, 2, 2] = False
    got = dist.depth_inside(cells_df(spark, {"a": m}), grid_df(spark, {"a": shape})).collect()
    assert np.abs(as_array(got, shape, "depth_mm") - distance(~m))[m].max() < 1e-12


def test_envelopes_against_all_pairs():
    g = np.random.default_rng(12)
    for _ in range(60):
        sizes = g.integers(1, 30, 5)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        at = np.concatenate([np.arange(n) + g.integers(-3, 9) for n in sizes])
        height = np.where(g.random(len(at)) < 0.3, np.inf, g.choice([0.0, 1.0, 4.0, 50.0, 7.3], len(at)))
        s, lo, hi = np.full(len(at), 0.7), np.full(len(at), -3), np.full(len(at), 30)
        got = dist.envelopes(at, height, starts, s, lo, hi)
        for a, n in zip(starts, sizes):
            own, h = at[a : a + n], height[a : a + n]
            if own[0] > -3:
                own, h = np.r_[own[0] - 1, own], np.r_[0.0, h]
            if at[a + n - 1] < 30:
                own, h = np.r_[own, own[-1] + 1], np.r_[h, 0.0]
            want = (h[None] + (0.7 * (at[a : a + n, None] - own[None])) ** 2).min(1)
            assert np.allclose(got[a : a + n], want, rtol=1e-12, atol=0)


def test_depth_per_instance(spark):
    m = random_mask(6, 0.9)
    df = cells_df(spark, {"a": m}).withColumn("inst_id", (F.col("x") > 5).cast("int"))
    got = dist.depth_inside(df, grid_df(spark, {"a": SHAPE}), key=("inst_id",)).collect()
    x = np.arange(SHAPE[2])[None, None, :]
    for i in (0, 1):
        own = m & ((x > 5) == bool(i))
        have = as_array([r for r in got if r.inst_id == i], SHAPE, "depth_mm")
        assert np.abs(have - distance(~own))[own].max() < 1e-12


def test_labels_follow_scan_order(spark):
    m = {"a": random_mask(7, 0.12), "b": random_mask(8, 0.06)}
    got = components.label_mask(cells_df(spark, m)).collect()
    for c in m:
        assert (as_array([r for r in got if r.case_id == c], SHAPE, "label") == label26(m[c])).all()


def test_settled_components_leave_the_edge_table(spark, monkeypatch):
    """Rows rewritten fall from round to round: pairs and stars are settled long before a path is."""
    g = np.random.default_rng(14)
    names = g.permutation(4000)
    path = [(int(names[i]), int(names[i + 1])) for i in range(600)]
    pairs = [(int(names[i]), int(names[i + 1])) for i in range(1000, 2600, 2)]
    star = [(int(names[3000]), int(names[i])) for i in range(3001, 3900)]
    edges = spark.createDataFrame([(c, u, v) for c in ("a", "b") for u, v in path + pairs + star], "case_id string, u long, v long")
    rows, wide = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df, label="": rows.append((label, kept := wide(df, label), kept.count())) or kept)
    got = {(r.case_id, r.node): r.root for r in components.connected(edges).collect()}
    root = {}
    for group in ([path], [[p] for p in pairs], [star]):
        for part in group:
            ids = {i for p in part for i in p}
            root |= {i: min(ids) for i in ids}
    assert got == {(c, i): r for c in ("a", "b") for i, r in root.items()}
    stars = [n for label, _, n in rows if label == "cc-stars"]
    assert stars[1] <= 2 * 700 and all(b <= a for a, b in zip(stars[1:], stars[2:]))


def test_merged_markers(spark):
    m = random_mask(9, 0.04)
    lab = label26(m)
    mid = [np.argwhere(lab == i).mean(0) * SP for i in range(1, lab.max() + 1)]
    root = list(range(len(mid)))
    for _ in root:
        for i in range(len(mid)):
            for j in range(len(mid)):
                if np.linalg.norm(mid[i] - mid[j]) <= 2.5:
                    root[i] = root[j] = min(root[i], root[j])
    names = {r: k + 1 for k, r in enumerate(sorted(set(root)))}
    want = np.vectorize(lambda v: names[root[v - 1]] if v else 0)(lab)
    got = components.merged_markers(cells_df(spark, {"a": m}), grid_df(spark, {"a": SHAPE}), 2.5).collect()
    assert (as_array(got, SHAPE, "label") == want).all()


@pytest.mark.parametrize("edge", [4, 32])
def test_growth_equals_dijkstra(spark, edge):
    allowed = random_mask(10, 0.45)
    marks = np.zeros(SHAPE, int)
    at = np.argwhere(allowed)
    for k, i in enumerate((3, 90, 200, 400)):
        marks[tuple(at[i % len(at)])] = k + 1
    marks[0, 0, 0] = 9  # possibly outside the allowed cells
    df = cells_df(spark, {"a": marks > 0}, label={"a": marks})
    got = growth.grow(df, cells_df(spark, {"a": allowed}), grid_df(spark, {"a": SHAPE}), edge=edge).collect()
    want = geodesic(marks, allowed)
    assert {(r.z, r.y, r.x): (round(r.geo_mm * 1000), r.label) for r in got} == want


def test_growth_rewrites_only_what_gets_better(spark, monkeypatch):
    """Labels beyond any packed width; rounds work on fewer bricks as the front leaves them behind."""
    rows = []
    wide = growth.cut
    monkeypatch.setattr(growth, "cut", lambda df, label="": rows.append((label, kept := wide(df, label), kept.count())) or kept)
    shape = (3, 4, 90)
    allowed, marks = np.ones(shape, bool), np.zeros(shape, int)
    allowed[:, :, 40] = False
    marks[1, 1, 0], marks[1, 2, 41], marks[0, 0, 89] = 2**40 + 1, 2**33, 2**40
    df = cells_df(spark, {"a": marks > 0}, label={"a": marks})
    got = growth.grow(df, cells_df(spark, {"a": allowed}), grid_df(spark, {"a": shape}), edge=4).collect()
    assert {(r.z, r.y, r.x): (round(r.geo_mm * 1000), r.label) for r in got} == geodesic(marks, allowed)
    work = [n for label, _, n in rows if label == "grow-active"]
    bricks = len({(z // 4, y // 4, x // 4) for z, y, x in np.argwhere(allowed)})
    assert max(work) <= 6 < bricks and work[-1] == 0 and work[-2] <= work[1]


def test_growth_from_nothing(spark):
    allowed = cells_df(spark, {"a": random_mask(10, 0.2)})
    none = cells_df(spark, {"a": np.zeros(SHAPE, bool)}, label={"a": np.zeros(SHAPE, int)})
    assert growth.grow(none, allowed, grid_df(spark, {"a": SHAPE})).count() == 0


def test_a_fine_grid_does_not_widen_the_halo_of_others(spark):
    shape = (6, 40, 40)
    cells = cells_df(spark, {c: np.ones(shape, bool) for c in ("a", "fine")}, hu={c: np.full(shape, 40.0) for c in ("a", "fine")})
    coarse, fine = grid_df(spark, {"a": shape}), grid_df(spark, {"fine": shape}, (0.3, 0.3, 0.3))
    alone = stencil.brick_rows(cells.where("case_id = 'a'"), coarse, edge=8)
    both = stencil.brick_rows(cells, coarse.unionByName(fine), edge=8)
    halos = {r.case_id: r.halo for r in both.select("case_id", "halo").distinct().collect()}
    assert halos == {"a": stencil.kernel_radius(1.8 / (sum(SP) / 3)), "fine": stencil.kernel_radius(1.8 / 0.3)}
    assert both.where("case_id = 'a'").count() == alone.count() < both.where("case_id = 'fine'").count()
    one = stencil.tube_response(cells.where("case_id = 'a'"), coarse, edge=8)
    assert stencil.tube_response(cells, coarse.unionByName(fine), edge=8).where("case_id = 'a'").exceptAll(one).isEmpty()


def test_contact_and_ostium_cells(spark):
    parent = np.zeros(SHAPE, bool)
    parent[:, 4:7, 4:7] = True
    inst = random_mask(11, 0.3) & ~parent
    p, i = cells_df(spark, {"a": parent}), cells_df(spark, {"a": inst}).withColumn("inst_id", F.lit(1))
    near = dilate(parent, OFFS) & inst
    got = lattice.contact_cells(i, p)
    assert (as_array(got.collect(), SHAPE) == near).all()
    assert (as_array(lattice.ostium_cells(got, p).collect(), SHAPE) == (dilate(near, OFFS) & parent)).all()


def test_caps(spark):
    parent = np.zeros(SHAPE, bool)
    parent[2:8, 3:7, 3:7] = True
    parent[8, 4, 4] = True
    df = cells_df(spark, {"a": np.ones(SHAPE, bool)}, parent={"a": parent})
    caps = masks.cap_slices(df)
    c = caps.first()
    assert (c.z_first, c.z_last, c.lo_cap, c.hi_cap) == (2, 8, True, False)
    left = {r.z for r in masks.drop_cap_seeds(df.select("case_id", "z", "y", "x"), caps).collect()}
    assert left == {4, 5, 6, 7, 8}


def whole_response(hu, sp, p):
    out = np.zeros(hu.shape)
    for mm in p.tube_scales_mm:
        s = max(p.min_scale_voxels, mm / np.mean(sp))
        halo = stencil.kernel_radius(s)
        out = np.maximum(out, stencil._response(np.pad(hu, halo, mode="symmetric"), halo, s, p.tube_alpha, p.tube_beta, p.tube_gamma))
    return out


def test_tube_filter_does_not_depend_on_bricks(spark):
    from lumenframe.params import DEFAULTS

    hu = np.random.default_rng(12).uniform(0, 300, SHAPE)
    df = cells_df(spark, {"a": np.ones(SHAPE, bool)}, hu={"a": hu})
    want = whole_response(hu, SP, DEFAULTS)
    for edge in (5, 32):
        got = as_array(stencil.tube_response(df, grid_df(spark, {"a": SHAPE}), edge=edge).collect(), SHAPE, "vesselness")
        assert np.abs(got - want).max() < 1e-9


def test_tube_filter_prefers_bright_tubes():
    from lumenframe.params import DEFAULTS

    n = 25
    z, y, x = np.meshgrid(*[np.arange(n)] * 3, indexing="ij")
    tube = np.exp(-((y - 12) ** 2 + (x - 12) ** 2) / 4.0) * 200
    plate = np.exp(-((x - 12) ** 2) / 4.0) * 200
    dark = 200 - tube
    r = [whole_response(v, (1, 1, 1), DEFAULTS)[12, 12, 12] for v in (tube, plate, dark)]
    assert r[0] > 0.5 and r[1] < 0.05 and r[2] == 0.0


def test_flat_input_has_no_tube_response():
    from lumenframe.params import DEFAULTS

    for spacing in (0.78, 1.0, 1.5):
        assert whole_response(np.full((12, 12, 12), 300.0), (spacing,) * 3, DEFAULTS).max() < 1e-9


def test_markers_take_the_tube_response(spark):
    from lumenframe.plans.catalog import lattice_queries as lq

    vox = lq._vox(spark, "/root/testdata/sf0.001")
    _, seeded, _ = lq._markers(vox)
    real = lq.tube_filter(spark, "/root/testdata/sf0.001").withColumnRenamed("vesselness", "real")
    both = seeded.join(real, lq.CELL)
    assert both.count() == vox.count() and both.where("abs(vesselness - real) > 2e-5").count() == 0
    assert both.where("seed").count() > 0


def test_components_across_bricks(spark):
    rng = np.random.default_rng(8)
    m = {"a": rng.random((13, 14, 15)) < 0.12, "b": np.ones((9, 9, 9), bool)}
    df = cells_df(spark, m).unionByName(cells_df(spark, m).where("z = 3"))  # repeated cells count once
    for edge in (4, 5, 32):
        got = components.label_mask(df, edge).collect()
        for c, mask in m.items():
            want = label26(mask)
            assert {(r.z, r.y, r.x): r.label for r in got if r.case_id == c} == {tuple(map(int, p)): want[tuple(p)] for p in np.argwhere(mask)}
            assert sum(r.case_id == c for r in got) == mask.sum()
