"""What may be broadcast, and steps that hold their size."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lumenframe import session
from lumenframe.operators import bricks, distance, growth, lattice, masks, quality_model, ridge, sections, spatial, stencil, views3d
from lumenframe.params import DEFAULTS
from lumenframe.plans import detect
from lumenframe.plans.catalog import lattice_queries, views
from lumenframe.session import cut


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def test_small_files_of_many_rows_are_not_broadcast(spark):
    rows = spark.range(300_000).select(F.lit(1).alias("case_id"), (F.col("id") % 2).alias("k"))
    many, few = cut(rows, "many"), cut(rows.limit(10), "few")
    assert "SortMergeJoin" in plan(rows.join(many, ["case_id", "k"], "left_semi"))[1]
    assert "BroadcastHashJoin" in plan(rows.join(few, ["case_id", "k"], "left_semi"))[1]


def test_exploded_samples_are_not_broadcast(spark):
    named = {"pz": 1.0, "py": 1.0, "px": 1.0, "tz": 0.0, "ty": 0.0, "tx": 1.0, "sz": 1.5, "sy": 0.8, "sx": 0.8}
    points = cut(spark.range(4).select(F.lit("a").alias("case_id"), *[F.lit(v).alias(k) for k, v in named.items()]), "points")
    probe = sections.disc_samples(points, ("pz", "py", "px"), ("tz", "ty", "tx"))
    cells = spark.range(300_000).select(F.lit("a").alias("case_id"), *[F.lit(1).alias(c) for c in "zyx"])
    assert "BroadcastHashJoin" not in plan(probe.join(cells, ["case_id", "z", "y", "x"]))[1]


def _scene(spark):
    rng = np.random.default_rng(3)
    at = np.unique(rng.integers(-3, 40, (4000, 3)), axis=0)
    rows = [(c, *map(int, a), None if i % 11 == 0 else float("nan") if i % 97 == 0 else float(rng.integers(0, 50)), None if i % 13 == 0 else bool(i % 3)) for c in "ab" for i, a in enumerate(at)]
    rows += rows[:5]  # cells that are there twice
    cells = spark.createDataFrame(rows, "case_id string, z int, y int, x int, hu double, m boolean")
    pts = [("a", i, *map(float, rng.uniform(-8, 45, 3))) for i in range(150)] + [("b", i, *map(float, rng.uniform(0, 40, 3))) for i in range(60)]
    pts += [("a", 3, 5.0, 5.0, 5.0), ("a", None, 7.0, 7.0, 7.0), ("a", None, 9.0, 9.0, 9.0), ("a", 999, None, 1.0, 1.0)]
    points = spark.createDataFrame(pts, "case_id string, id int, pz double, py double, px double")
    spacing = spark.createDataFrame([("a", 1.5, 0.8, 0.8), ("b", 1.0, 1.0, 0.5)], "case_id string, sz double, sy double, sx double")
    return cells, points, spacing


def _boxed(cells, points, spacing, radius):
    p = points.join(spacing, "case_id")
    for c in "zyx":
        n = F.greatest(F.lit(1), F.ceil(F.lit(radius) / F.col(f"s{c}")).cast("int"))
        p = p.withColumn(c, F.explode(F.sequence(F.rint(f"p{c}").cast("int") - n, F.rint(f"p{c}").cast("int") + n)))
    return p.join(cells, ["case_id", "z", "y", "x"]).groupBy("case_id", "id")


def test_boxes_equal_probing(spark, monkeypatch):
    cells, points, spacing = _scene(spark)
    key = lambda rows: sorted(map(str, rows))
    for held in (2_000_000, 500):
        monkeypatch.setattr(views3d, "HELD", held)
        want = _boxed(cells, points, spacing, 3.0).agg(F.count(F.lit(1)).alias("n"), F.min("hu").alias("min"), F.percentile("hu", 0.5).alias("p50"), F.max("hu").alias("max"))
        assert key(views3d.box_stats(points, "id", ("pz", "py", "px"), cells, "hu", spacing, 3.0).collect()) == key(want.collect())
        want = _boxed(cells, points, spacing, 3.0).agg(F.count_if("m").alias("sum"), F.avg(F.col("m").cast("double")).alias("frac"))
        assert key(views3d.box_share(points, "id", ("pz", "py", "px"), cells, "m", spacing, 3.0).collect()) == key(want.collect())


def test_boxes_have_no_row_per_probed_cell(spark):
    cells, points, spacing = _scene(spark)
    out = views3d.box_share(points.where("id > 3"), "id", ("pz", "py", "px"), cells, "m", spacing, 3.0)
    assert "CoGroup" in plan(out)[0]  # boxes meet cells inside a task; a probed cell is no row


def test_scans_of_the_detection_are_not_broadcast_as_cells(spark):
    voxels = views.phantom_voxels(spark, "/root/testdata/sf0.001")
    text = plan(voxels)[1]
    above = text[: text.index("Join")]
    assert above.count("Generate explode") >= 3  # joins come before cells do
    assert voxels.count() == voxels.select("case_id").distinct().count() * 20 * 36 * 36


def test_zone_maps_equal_separate_steps(spark):
    rng = np.random.default_rng(5)
    at = np.unique(rng.integers(0, 21, (5000, 3)), axis=0)
    rows = [(c, *map(int, a), None if i % 53 == 0 else float(rng.integers(0, 400)), bool((a[1] - 9) ** 2 + (a[2] - 11) ** 2 <= 4)) for c in "ab" for i, a in enumerate(at)]
    cells = spark.createDataFrame([r for r in rows if not (r[0] == "b" and r[5])] + [("b", 2, 3, 4, 100.0, True)], "case_id string, z int, y int, x int, hu double, parent boolean")
    bounds = {f"{a}{i}": 20 * i for a in "zyx" for i in (0, 1)}
    grid = cut(spark.createDataFrame([("a", 1.5, 0.8, 0.8), ("b", 1.0, 1.1, 2.0)], "case_id string, sz double, sy double, sx double").select("*", *[F.lit(v).alias(k) for k, v in bounds.items()]), "grid")
    window = grid.withColumns({"blood_low": F.lit(90.0), "blood_high": F.lit(250.0)})
    got = stencil.zone_maps(cells, window, edge=8)
    want = stencil.tube_response(cells, grid, keep=("parent",)).join(distance.distance_to_parent(cells.where("parent"), grid, 14.0), lattice.CELL, "left")
    want = cut(masks.with_zone_masks(want.join(window.select("case_id", "blood_low", "blood_high"), "case_id")), "zones")
    near = lattice.box_dilate(want.where("outward")).withColumn("near_outward", F.lit(True))
    want = want.join(near, lattice.CELL, "left").fillna(False, ["near_outward"])
    names = [*lattice.CELL, "hu", "parent", "dist_mm", "near_outward"]
    key = lambda df: sorted(map(str, df.select(*names, F.coalesce(F.round("vesselness", 8), F.lit(-1.0)) + 0.0).collect()))
    assert key(got) == key(want) and got.where("near_outward").count() and got.where("dist_mm is null").count()


def test_seeds_take_no_row_per_probed_cell(spark):
    assert "explode" not in plan(lattice_queries.seed_mask(spark, "/root/testdata/sf0.001"))[0]


def test_walks_end_inside_one_task(spark):
    rng = np.random.default_rng(8)
    at = np.unique(rng.integers(0, 30, (9000, 3)), axis=0)
    rows = [(c, int(a[2] > 12), *map(int, a), float(a[2] * 0.5 + rng.integers(0, 3) * 0.25), None if i % 71 == 0 else float(rng.integers(0, 5))) for c in "ab" for i, a in enumerate(at)]
    lumen = spark.createDataFrame(rows, "case_id string, inst_id int, z int, y int, x int, dist_mm double, depth_mm double")
    starts = [(c, i % 2, i, *map(float, rng.uniform(-2, 31, 3))) for c in "abc" for i in range(40)] + [("a", 7, 1, 3.0, 3.0, 3.0), ("a", 0, 99, None, 1.0, 1.0)]
    starts = spark.createDataFrame(starts, "case_id string, inst_id int, walk_id int, wz double, wy double, wx double")
    grid = spark.createDataFrame([("a", 1.5, 0.8, 0.8), ("b", 1.0, 1.1, 0.2), ("c", 1.0, 1.0, 1.0)], "case_id string, sz double, sy double, sx double")
    whole, cut_up = (ridge.ridge_walks(lumen, starts, grid, edge=edge) for edge in (64, 5))
    assert "CoGroup" in plan(whole)[0]  # a step is no join
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut_up.collect()))
    assert whole.select(*ridge.WALK).distinct().count() == 122 and whole.agg(F.max("step")).first()[0] > 5


def test_distances_and_openings_shuffle_their_cells_once(spark):
    rng = np.random.default_rng(9)
    rows = [("a", *map(int, a)) for a in np.unique(rng.integers(-6, 26, (22000, 3)), axis=0)]
    mask = spark.createDataFrame(rows, "case_id string, z int, y int, x int")
    grid = spark.createDataFrame([("a", 1.5, 0.8, 0.8)], "case_id string, sz double, sy double, sx double").select("*", *[F.lit(v).alias(f"{a}{i}") for a in "zyx" for i, v in ((0, -2), (1, 20))])
    seeds = mask.where("z % 7 = 0 and y % 9 = 0 and x % 8 = 0")
    for df in (distance.distance_from(seeds, grid, 5.0, edge=7), lattice.ball_open(mask, 0.9, grid)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    have = {r[1:] for r in rows}
    at = np.array([r[1:] for r in seeds.collect()])
    got = {(r.z, r.y, r.x): r.d2 for r in distance.distance_from(seeds, grid, 5.0, edge=7).collect()}
    box = np.stack(np.meshgrid(*[np.arange(-2, 21)] * 3, indexing="ij"), -1).reshape(-1, 3)
    d2 = (((box[:, None] - at) * [1.5, 0.8, 0.8]) ** 2).sum(axis=2).min(axis=1)
    want = {tuple(map(int, c)): d for c, d in zip(box, d2) if d <= 25.0 * (1 + 1e-12)}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9
    ball = [(a, b, c) for a in (-1, 0, 1) for b in (-2, -1, 0, 1, 2) for c in (-2, -1, 0, 1, 2) if (1.5 * a) ** 2 + (0.8 * b) ** 2 + (0.8 * c) ** 2 <= 0.81 + 1e-6]
    inner = {c for c in have if all((c[0] + o[0], c[1] + o[1], c[2] + o[2]) in have for o in ball)}
    opened = {(c[0] + o[0], c[1] + o[1], c[2] + o[2]) for c in inner for o in ball}
    assert {(r.z, r.y, r.x) for r in lattice.ball_open(mask, 0.9, grid).collect()} == opened and opened


def test_growth_solves_lone_bricks_once(spark, monkeypatch):
    """A case inside one brick has no round of its own before the last pass; two bricks beside each other have one."""
    cells = spark.range(12).selectExpr("0L AS case_id", "0 AS z", "0 AS y", "CAST(id AS INT) AS x")
    marks = cells.where("x = 0").withColumn("label", F.lit(7).cast("long"))
    grid = spark.sql("SELECT 0L AS case_id, 1.0D AS sz, 1.0D AS sy, 1.0D AS sx")
    rounds, real = [], growth.cut
    monkeypatch.setattr(growth, "cut", lambda df, label: rounds.append(label) or real(df, label))
    for edge, expected in ((32, 0), (8, 1)):
        rounds.clear()
        got = {r.x: (r.label, r.geo_mm) for r in growth.grow(marks, cells, grid, edge).collect()}
        assert got == {x: (7, float(x)) for x in range(12)}
        assert (rounds.count("grow-faces") > 0) == bool(expected)


def test_fold_sums_hold_one_chunk_as_objects():
    """A batch of many chunks costs what one of them does, besides the batch itself."""
    d, rows, rng = 3, 2000, np.random.default_rng(1)
    model = [{"__fold": str(k), "mu": [0.0] * d, "sd": [1.0] * d, "w": [0.1] * (d + 1)} for k in range(2)]
    chunk = lambda: {"folds": [str(i % 2) for i in range(rows)], "label": (rng.random(rows) > 0.5).astype(float).tolist(), "x": rng.random(rows * d).tolist(), "models": model}
    kinds = pa.struct([("__fold", pa.string()), ("mu", pa.list_(pa.float64())), ("sd", pa.list_(pa.float64())), ("w", pa.list_(pa.float64()))])
    schema = pa.schema([("folds", pa.list_(pa.string())), ("label", pa.list_(pa.float64())), ("x", pa.list_(pa.float64())), ("models", pa.list_(kinds))])
    peaks = []
    for n in (1, 40):
        batch = pa.RecordBatch.from_pylist([chunk() for _ in range(n)], schema)
        tracemalloc.start()
        found = sum(len(b) for b in quality_model._fold_sums(d)(iter([batch])))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found == 2 * n
    assert peaks[1] < 3 * peaks[0]


def test_only_cells_of_the_brick_are_decomposed(monkeypatch):
    rng = np.random.default_rng(2)
    at = np.argwhere(rng.random((8, 8, 8)) < 0.1)
    bounds = {f"{a}{i}": 7 * i for a in "zyx" for i in (0, 1)}
    pdf = pd.DataFrame({**dict(zip("zyx", at.T, strict=True)), "halo": 18, "bz": 0, "by": 0, "bx": 0, **bounds})
    brick, hu, taken, eigvalsh = stencil._Brick(pdf, 32), 1000 * rng.random(len(at)), [], np.linalg.eigvalsh
    monkeypatch.setattr(np.linalg, "eigvalsh", lambda m: taken.append(len(m)) or eigvalsh(m))
    got = brick.tube(hu, 1.0, DEFAULTS, 0.0)
    assert taken and max(taken) <= len(at)
    block, want = np.pad(brick.block(hu, 0.0), 18, mode="symmetric"), np.zeros((8, 8, 8))
    for mm in DEFAULTS.tube_scales_mm:
        want = np.maximum(want, stencil._response(block, 18, max(DEFAULTS.min_scale_voxels, mm), DEFAULTS.tube_alpha, DEFAULTS.tube_beta, DEFAULTS.tube_gamma))
    assert (got == want[tuple(at.T)]).all()


def test_markers_alone_write_no_table_of_masks(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(lattice_queries, "cut", lambda df, label="step": labels.append(label) or cut(df, label))
    lattice_queries.merged_markers(spark, "/root/testdata/sf0.001")
    assert "zones" in labels and "seeded" not in labels


def test_a_box_little_longer_than_a_brick_is_one_brick(spark):
    """No sliver of a brick whose halo brings most of the box along again."""
    cells = spark.range(20 * 36 * 36).selectExpr("0L AS case_id", "CAST(id DIV 1296 AS INT) AS z", "CAST(id DIV 36 % 36 AS INT) AS y", "CAST(id % 36 AS INT) AS x", "1.0D AS hu")
    grid = spark.sql("SELECT 0L AS case_id, 1.5D AS sz, 0.8D AS sy, 0.8D AS sx, 0 AS z0, 19 AS z1, 0 AS y0, 35 AS y1, 0 AS x0, 35 AS x1")
    rows = stencil.brick_rows(cells, grid, reach_mm=14.0)
    assert rows.count() == cells.count() and rows.select(*bricks.KEY).distinct().count() == 1


def test_bricks_of_a_layout_cover_the_box_once(spark):
    grid = spark.createDataFrame([("a", 5, 40, -3, 0, 7, 7)], "case_id string, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    box = spark.range(3, 44).select(F.lit("a").alias("case_id"), F.col("id").cast("int").alias("z"), F.lit(-2).alias("y"), F.lit(7).alias("x"))
    laid = box.join(bricks.layout(grid, 8), "case_id")
    own = {r.z: (r.b, r.oz + r.b * r.ez, r.ez) for r in laid.withColumn("b", bricks.brick_of("z")).collect()}
    assert all(low <= z < low + e <= low + 12 for z, (_, low, e) in own.items() if 5 <= z <= 40)
    assert {b for b, _, _ in own.values()} == set(range(3)) and own[3][0] == 0 and own[43][0] == 2  # beyond the box: the outermost
    seen = {}
    for r in bricks.in_reach(laid, {"z": 2, "y": 1, "x": 1}).collect():
        assert (r.by, r.bx) == (0, 0)
        seen.setdefault(r.z, []).append(r.bz)
    assert all(sorted(b) == sorted({own[min(max(z + o, 3), 43)][0] for o in range(-2, 3)}) for z, b in seen.items())


def test_detection_writes_all_voxels_once(spark, monkeypatch):
    sizes, real = {}, detect.cut

    def kept(df, label="step"):
        sizes[label] = real(df, label)
        return sizes[label]

    monkeypatch.setattr(detect, "cut", kept)
    vox = cut(views.phantom_voxels(spark, "/root/testdata/sf0.001").where("case_id = 0"), "scan")
    cases = cut(views.phantom_cases(spark, "/root/testdata/sf0.001").where("case_id = 0"), "cases")
    maps = detect.search_maps(vox, cases, fill=40.0)
    whole = [label for label, df in sizes.items() if df.count() == vox.count()]
    assert whole == ["zones"] and maps.cells.count() == vox.count() and maps.cells.where("seed").count() > 0


def test_samples_are_made_in_many_tasks(spark):
    """Points are few bytes, so they end up in one partition unless they are spread before they become samples."""
    points = cut(spark.range(40).selectExpr("'a' AS case_id", "id AS inst_id", "0 AS step", "1.0D AS z", "1.0D AS y", "CAST(id AS DOUBLE) AS x"), "points")
    spacing = spark.sql("SELECT 'a' AS case_id, 1.5D AS sz, 0.8D AS sy, 0.8D AS sx")
    made = sections.resample_paths(points, spacing, ["case_id", "inst_id"])
    assert made.select(F.spark_partition_id()).distinct().count() > 1


def test_copies_of_points_and_cells_of_few_instances_are_not_broadcast(spark, monkeypatch):
    """Points that are copied to their neighbours' cells, and cells picked by instance, are as many as they are, whatever their files weigh."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 500)
    points = cut(spark.range(100).selectExpr("0L AS case_id", "id", *[f"CAST(id AS DOUBLE) AS {c}" for c in "xyz"]), "points")
    assert "BroadcastHashJoin" not in plan(spatial.pairs_within_self(points, 1.0, ["x", "y", "z"], "id"))[1]
    cells = cut(spark.range(1000).selectExpr("0L AS case_id", "id DIV 10 AS inst_id", "CAST(id AS INT) AS z", "0 AS y", "0 AS x"), "cells")
    few = cut(cells.select("case_id", "inst_id").distinct(), "few")
    probe = cut(cells.limit(100), "probe")
    assert "BroadcastHashJoin" not in plan(probe.join(detect._only(cells, few), ["case_id", "inst_id", "z"]))[1].split("LeftSemi")[0]
