import numpy as np
from pyspark.sql import functions as F

from helpers import case_rows, cells_df
from lumenframe.functions import geometry as geo


def cases(spark, mats, size=(8, 9, 10), spacing=(0.8, 0.9, 1.5), origin=(3.0, -2.0, 7.0)):
    rows = [(k, list(size), list(spacing), list(origin), np.asarray(m, float).ravel().tolist()) for k, m in mats.items()]
    return spark.createDataFrame(rows, "case_id string, size array<int>, spacing array<double>, origin array<double>, direction array<double>")


def rotation(a, b):
    ca, sa, cb, sb = np.cos(a), np.sin(a), np.cos(b), np.sin(b)
    return np.array([[ca, -sa, 0], [sa, ca, 0], [0, 0, 1]]) @ np.array([[1, 0, 0], [0, cb, -sb], [0, sb, cb]])


def test_nearest_rotation_and_shear_report(spark):
    g = np.random.default_rng(1)
    mats = {f"r{i}": rotation(i, 2 * i) + g.normal(0, 1e-3, (3, 3)) for i in range(4)}
    mats["exact"] = rotation(0.3, 0.2)
    mats["left"] = np.diag([1.0, 1.0, -1.0])
    got = {r.case_id: r for r in geo.orthonormality(geo.nearest_rotation(cases(spark, mats))).collect()}
    for k, m in mats.items():
        u, _, vt = np.linalg.svd(m)
        assert np.allclose(np.reshape(got[k].rotation, (3, 3)), u @ vt, atol=1e-9)
        assert abs(got[k].frobenius - np.linalg.norm(m - u @ vt)) < 1e-9
        assert abs(got[k].max_abs_off - np.abs(m.T @ m - np.eye(3)).max()) < 1e-12
        assert got[k].is_orthonormal == (np.allclose(m.T @ m, np.eye(3), atol=1e-4) and abs(np.linalg.det(m)) > 0.5)
    assert got["left"].left_handed and got["left"].is_orthonormal and not got["exact"].left_handed


def test_index_round_trip(spark):
    df = cases(spark, {"a": rotation(0.7, 1.1), "b": np.diag([-1.0, -1.0, 1.0])}).withColumns({"i": F.lit(1.25), "j": F.lit(2.0), "k": F.lit(6.5)})
    mm = geo.index_to_mm([F.col("i"), F.col("j"), F.col("k")])
    df = df.withColumns({"x": mm[0], "y": mm[1], "z": mm[2]})
    back = geo.mm_to_index([F.col("x"), F.col("y"), F.col("z")])
    crop = geo.mm_to_crop_zyx([F.col("x"), F.col("y"), F.col("z")], [F.lit(1), F.lit(2), F.lit(3)])
    for r in df.select("case_id", "x", *[b.alias(f"b{n}") for n, b in enumerate(back)], *[c.alias(f"c{n}") for n, c in enumerate(crop)]).collect():
        assert np.allclose([r.b0, r.b1, r.b2], [1.25, 2.0, 6.5])
        assert np.allclose([r.c0, r.c1, r.c2], [5.5, 0.0, -1.75])
        if r.case_id == "b":
            assert abs(r.x - (3.0 - 1.25 * 0.8)) < 1e-12


def test_roi_and_crop(spark):
    shape = (10, 20, 20)
    parent = np.zeros(shape, bool)
    parent[4:6, 9:12, 1:4] = True
    vox = cells_df(spark, {"a": np.ones(shape, bool)}, parent={"a": parent})
    box = geo.roi_box(vox, case_rows(spark, {"a": shape}), 2.0)
    r = box.first()
    assert (r.z0, r.z1, r.y0, r.y1, r.x0, r.x1) == (2, 7, 6, 14, 0, 6)
    assert geo.crop(vox, box).count() == 6 * 9 * 7


def test_mask_is_resampled_onto_the_image_grid(spark):
    shape = (8, 9, 10)
    m = np.random.default_rng(2).random(shape) < 0.3
    image = cases(spark, {"a": np.eye(3)}, size=shape[::-1])
    mask = cases(spark, {"a": np.eye(3)}, size=shape[::-1], origin=(3.0 + 0.35 * 0.8, -2.0, 7.0 + 1.2 * 1.5))
    grids = geo.correct_directions(image, mask)
    assert grids.first().needs_resample and not grids.first().corrected
    got = geo.resample_nearest(cells_df(spark, {"a": m}).withColumn("label", F.lit(1)), grids)
    want = {(z, y, x) for z, y, x in np.ndindex(shape) if (lambda q: all(0 <= v < s for v, s in zip(q, shape)) and m[q])((int(np.floor(z - 1.2 + 0.5)), y, int(np.floor(x - 0.35 + 0.5))))}
    assert {(r.z, r.y, r.x) for r in got.collect()} == want


def test_sheared_pair_shares_the_corrected_grid(spark):
    shear = np.eye(3)
    shear[0, 1] = 1e-3
    grids = geo.correct_directions(cases(spark, {"a": shear}), cases(spark, {"a": shear})).first()
    assert grids.corrected and not grids.needs_resample
    d = np.reshape(grids.direction, (3, 3))
    assert np.allclose(d.T @ d, np.eye(3), atol=1e-12)
