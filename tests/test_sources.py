import gzip
import hashlib
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.operators import quality_checks, review
from lumenframe.plans import score as scoring
from lumenframe.sources import documents, tables, volumes


def nifti(data, spacing=(0.8, 0.9, 1.5), order="<", code=16, slope=1.0, inter=0.0, affine=None, quat=None, pack=False):
    """Bytes of a single-file volume; ``data`` is (z, y, x)."""
    kinds = {2: "u1", 4: "i2", 16: "f4", 64: "f8"}
    h = bytearray(352)
    nz, ny, nx = data.shape
    struct.pack_into(order + "i", h, 0, 348)
    struct.pack_into(order + "8h", h, 40, 3, nx, ny, nz, 1, 1, 1, 1)
    struct.pack_into(order + "h", h, 70, code)
    struct.pack_into(order + "8f", h, 76, 1.0, *spacing, 0, 0, 0, 0)
    struct.pack_into(order + "3f", h, 108, 352.0, slope, inter)
    if quat is not None:
        struct.pack_into(order + "h", h, 252, 1)
        struct.pack_into(order + "6f", h, 256, *quat)
    if affine is not None:
        struct.pack_into(order + "h", h, 254, 1)
        struct.pack_into(order + "12f", h, 280, *np.asarray(affine)[:3].ravel())
    raw = bytes(h) + data.astype(order + kinds[code]).tobytes()
    return gzip.compress(raw) if pack else raw


def put(path, blob):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(blob)


@pytest.fixture(scope="module")
def cohort(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("scans"))
    g = np.random.default_rng(0)
    hu = g.integers(-100, 400, (4, 5, 6))
    mask = (g.random((4, 5, 6)) < 0.3).astype(int)
    mask[0, 0, 0] = 1
    aff = np.diag([0.8, 0.9, 1.5, 1.0])
    aff[:3, 3] = (10, 20, 30)
    put(f"{root}/subject001/orig1.nii.gz", nifti(hu, code=4, affine=aff, pack=True))
    put(f"{root}/subject001/mask1.nii.gz", nifti(mask, code=2, affine=aff, pack=True))
    put(f"{root}/subject001/aorta_and_daughters1.nii.gz", nifti(mask, code=2))
    put(f"{root}/case_07/image7.nii", nifti(hu, code=64, order=">", slope=2.0, inter=5.0))
    put(f"{root}/case_07/aorta7.nii", nifti(mask, code=4, order=">"))
    put(f"{root}/subject003/orig3.nii", nifti(hu, code=4))
    put(f"{root}/subject003/mask3.nii", nifti(mask[:, :, :5], code=2))
    put(f"{root}/subject004/orig4.nii", b"short")
    put(f"{root}/subject004/mask4.nii", nifti(mask, code=2))
    put(f"{root}/subject005/orig5.nii", nifti(hu, code=4))
    put(f"{root}/subject005/mask5.nii", nifti(mask * 0, code=2))
    put(f"{root}/subject006/orig6.nii", nifti(hu, code=4))
    put(f"{root}/subject008/orig8.nii", nifti(hu, code=4)[:400])
    put(f"{root}/subject008/mask8.nii", nifti(mask, code=2))
    return root, hu, mask


def test_pairs_and_ids(spark, cohort):
    root = cohort[0]
    pairs, unpaired = volumes.pair_volumes(volumes.list_files(spark, root))
    got = {r.case_id: (r.image.rsplit("/", 1)[1], r.mask.rsplit("/", 1)[1]) for r in pairs.collect()}
    assert got["subject001"] == ("orig1.nii.gz", "mask1.nii.gz") and got["subject007"] == ("image7.nii", "aorta7.nii")
    assert [r.case_id for r in unpaired.collect()] == ["subject006"]
    names = spark.createDataFrame([("/d/other/scan12.nii.gz",), ("/d/other/vessel.nii.gz",), ("/d/case_xx/a3.nii",)], "path string")
    assert [r[0] for r in names.select(volumes.case_id_of("path")).collect()] == ["subject012", "vessel", "subject003"]


def test_cohort_load_and_errors(spark, cohort):
    root, hu, mask = cohort
    pairs, unpaired = volumes.pair_volumes(volumes.list_files(spark, root))
    lines = volumes.stage_cohort(spark, pairs)
    cases, vox, errors = volumes.load_cohort(lines)
    kinds = {r.case_id: r.kind for r in quality_checks.ingest_errors(errors).collect()}
    assert kinds == {"subject003": "size_mismatch", "subject004": "unreadable_volume", "subject005": "empty_mask", "subject008": "unreadable_volume"}
    c = {r.case_id: r for r in cases.collect()}
    assert set(c) == {"subject001", "subject007"}
    assert np.allclose(c["subject001"].spacing, (0.8, 0.9, 1.5)) and np.allclose(c["subject001"].origin, (-10, -20, 30))
    assert np.allclose(c["subject001"].direction, (-1, 0, 0, 0, -1, 0, 0, 0, 1))
    got = np.zeros((2, 4, 5, 6))
    par = np.zeros((2, 4, 5, 6), bool)
    for r in vox.collect():
        i = 0 if r.case_id == "subject001" else 1
        got[i, r.z, r.y, r.x], par[i, r.z, r.y, r.x] = r.hu, r.parent
    assert (got[0] == hu).all() and (got[1] == hu * 2 + 5).all() and (par == (mask > 0)).all()
    status = volumes.batch_status(pairs, unpaired, errors)
    n = volumes.batch_counts(status).first()
    assert (n.n_ok, n.n_failed, n.n_skipped, n.any_failed) == (2, 4, 1, True)


def test_quaternion_affine(spark, folder):
    data = np.zeros((2, 2, 2))
    s = float(np.sin(np.pi / 8))
    put(f"{folder}/q/orig9.nii", nifti(data, quat=(0, 0, s, 1, 2, 3)))
    r = volumes.decode_lines(spark, f"{folder}/q/orig9.nii").where("size is not null").first()
    c = np.cos(np.pi / 4)
    assert np.allclose(np.reshape(r.direction, (3, 3)), np.diag([-1, -1, 1]) @ np.array([[c, -c, 0], [c, c, 0], [0, 0, 1]]), atol=1e-6)
    assert np.allclose(r.origin, (-1, -2, 3)) and np.allclose(r.spacing, (0.8, 0.9, 1.5), atol=1e-6)


def doc(case, items):
    d = [{"instance_id": i, "parent_instance_id": "aorta", "ostium_xyz_mm": p, "seed_xyz_mm": [p[0], p[1], p[-1] + 5], "radius_mm": r, "direction_xyz": [0.0, 0.0, 1.0]} for i, p, r in items]
    return {"case_id": case, "parent": {"instance_id": "aorta"}, "daughters": d}


def test_document_round_trip_and_numbering(spark, folder):
    cases = spark.createDataFrame([("a",), ("none",)], "case_id string")
    cols = "case_id string, id long, x double, y double, z double, sx double, sy double, sz double, radius_mm double, dx double, dy double, dz double"
    rows = [("a", 1, 1.23456789, 0.0, 10.0, 1.23456789, 0.0, 15.0, 1.00005, 1.0, 0.0, 0.0), ("a", 2, 0.0, 0.0, 50.0, 0.0, 0.0, 50.0, 2.0, 0.0, 0.0, 0.0)]
    lm = review.number_branches(spark.createDataFrame(rows, cols))
    docs = documents.build_documents(cases, lm)
    documents.write_documents(docs, f"{folder}/out")
    back = spark.read.schema(schema.PREDICTION).json(f"{folder}/out")
    got = {r.case_id: r for r in back.collect()}
    assert got["none"].daughters == [] and got["none"].parent.instance_id == "aorta"
    first, second = got["a"].daughters
    assert first.instance_id == "branch_001" and first.ostium_xyz_mm == [0.0, 0.0, 50.0] and first.direction_xyz == [1.0, 0.0, 0.0]
    assert second.ostium_xyz_mm == [1.234568, 0.0, 10.0] and second.direction_xyz == [0.0, 0.0, 1.0]
    assert quality_checks.document_violations(back).count() == 0
    assert quality_checks.require_valid(back).count() == 2
    text = documents.pretty_documents(docs).where("case_id = 'a'").first().text
    assert json.loads(text)["daughters"][0]["instance_id"] == "branch_001"


def test_schema_rules(spark, folder):
    good = doc("ok", [("branch_001", [1.0, 2.0, 3.0], 1.0)])
    bad = doc("bad", [("b1", [1.0, 2.0], 1.0), ("b1", [1.0, 2.0, 3.0], -1.0), ("b2", [1.0, 2.0, 3.0], 1.0)])
    bad["daughters"][2]["direction_xyz"] = [3.0, 0.0, 0.0]
    bad["daughters"][2]["parent_instance_id"] = "x"
    for n, d in (("ok", good), ("bad", bad)):
        put(f"{folder}/d/{n}.json", json.dumps(d, indent=2).encode())
    put(f"{folder}/d/broken.json", b"{ not json")
    docs = documents.read_documents(spark, f"{folder}/d")
    assert {r.rule for r in quality_checks.document_violations(docs).collect()} >= {"unreadable", "daughters_not_a_list"}
    rows = documents.explode_rows(docs.where("case_id is not null"))
    got = {(r.case_id, r.instance_id, r.rule) for r in quality_checks.schema_violations(rows).collect()}
    assert got == {("bad", "b1", "bad_ostium_xyz_mm"), ("bad", "b1", "negative_radius"), ("bad", "b1", "duplicate_instance_id"), ("bad", "b2", "direction_not_unit"), ("bad", "b2", "parent_not_aorta")}
    with pytest.raises(Exception, match="duplicate instance_id"):
        quality_checks.require_valid(docs.where("case_id = 'bad'")).collect()


def test_scoring_folders(spark, folder):
    ann = doc("x", [("g1", [0.0, 0.0, 0.0], None), ("g2", [30.0, 0.0, 0.0], None)])
    ann["daughters"][0]["guide"] = {"confidence": "medium", "notes": "n"}
    put(f"{folder}/eval/case_19/annotations.json", json.dumps(ann).encode())
    put(f"{folder}/eval/case_20/annotations.json", json.dumps(ann).encode())
    put(f"{folder}/pred/subject019.json", json.dumps(doc("subject019", [("p1", [1.0, 0.0, 0.0], 1.0)]), indent=2).encode())
    put(f"{folder}/pred/case_19.json", json.dumps(doc("other", [])).encode())
    s = scoring.score_folders(spark, f"{folder}/eval", f"{folder}/pred")
    got = {r.case_id: r for r in s.cases.collect()}
    assert (got["case_19"].n_gt, got["case_19"].n_pred, got["case_19"].n_matched) == (2, 1, 1)
    assert (got["case_20"].n_gt, got["case_20"].n_pred, got["case_20"].case_flag) == (2, 0, "no_predictions")
    o = s.overall.first()
    assert (o.precision, o.recall, o.mean_ostium_err_mm) == (1.0, 0.25, 1.0)
    assert {r.confidence for r in documents.read_annotations(spark, f"{folder}/eval/*/annotations.json").collect()} == {"moderate", ""}
    t = {r.case_id: r for r in scoring.metrics_table(s).collect()}
    assert t["case_19"].matches[0].gt == "g1" and t["case_19"].overall.n_gt == 4 and t["case_20"].flags == []


def test_guides_labels_checksums_and_csv(spark, folder):
    put(f"{folder}/g/case_20/x.json", json.dumps({"points_voxel": [[1, 2, 3.5]], "confidence": "medium", "threshold_hu": 210}).encode())
    put(f"{folder}/g/case_22/x.json", json.dumps([{"instance_id": "b1", "points_voxel": [[1, 2, 3]]}, {"instance_id": "b2"}]).encode())
    ex = {(r.case_id, r.instance_id) for r in documents.read_excluded(spark, f"{folder}/g/*/x.json").collect()}
    assert ex == {("case_20", None), ("case_22", "b1"), ("case_22", "b2")}
    g = documents.read_guides(spark, f"{folder}/g/case_20/x.json").first()
    assert g.points_voxel == [[1.0, 2.0, 3.5]] and g.confidence == "moderate" and g.search_radius_mm is None
    put(f"{folder}/t/labels.txt", b'# header\n0 0 0 0 0 0 0 "Background"\n2 255 87 87 1 1 1 "branch_001 - DRAFT"\n1 0 210 235 0.35 1 1 "Parent"\n')
    lab = {r.idx: r for r in tables.read_labels(spark, f"{folder}/t/labels.txt").collect()}
    assert lab[2].label == "branch_001 - DRAFT" and lab[1].a == 0.35 and len(lab) == 3
    put(f"{folder}/m/a/f.bin", b"abc")
    put(f"{folder}/m/b.bin", b"xyz")
    put(f"{folder}/m/c.bin", b"new")
    sums = f"{hashlib.sha256(b'abc').hexdigest()}  a/f.bin\n{hashlib.sha256(b'no').hexdigest()}  b.bin\n{'0' * 64}  gone.bin\n"
    put(f"{folder}/sums.txt", sums.encode())
    got = quality_checks.check_manifest(tables.file_hashes(spark, f"{folder}/m"), tables.read_checksums(spark, f"{folder}/sums.txt"))
    assert {r.path: r.status for r in got.collect()} == {"a/f.bin": "ok", "b.bin": "sha256", "gone.bin": "missing", "c.bin": "unlisted"}
    put(f"{folder}/man.json", json.dumps({"files": [{"path": "a/f.bin", "bytes": 4, "sha256": hashlib.sha256(b"abc").hexdigest()}]}).encode())
    got = quality_checks.check_manifest(tables.file_hashes(spark, f"{folder}/m/a").withColumn("path", F.concat(F.lit("a/"), F.col("path"))), tables.read_manifest(spark, f"{folder}/man.json"))
    assert got.first().status == "bytes"
    put(f"{folder}/r.csv", b"case,instance_id,verdict,note\ncase_1,b1,confirmed_real,\"a, b\"\ncase_1,b2,,\n")
    v = tables.read_verdicts(spark, f"{folder}/r.csv").orderBy("instance_id").collect()
    assert v[0].note == "a, b" and v[1].verdict is None and v[0].case_id == "case_1"
    tables.write_rows(tables.read_verdicts(spark, f"{folder}/r.csv"), f"{folder}/w")
    again = spark.read.option("header", True).csv(f"{folder}/w").orderBy("instance_id").collect()
    assert [tuple(r) for r in again] == [("case_1", "b1", "confirmed_real", "a, b"), ("case_1", "b2", None, None)]


def test_run_logs(spark, folder):
    put(f"{folder}/logs/subject001.log", b"start\nWrote predictions/subject001.json  (17 daughter(s))\n[compute] wall_clock_s=10.994 peak_rss_mb=842.4\n")
    put(f"{folder}/logs/subject002.log", b"UserWarning: fine\n[compute] wall_clock_s=1.5 peak_rss_mb=512\nTraceback (most recent call last)\n")
    logs = quality_checks.parse_run_logs(tables.read_run_logs(spark, f"{folder}/logs"))
    cases = spark.createDataFrame([("subject001",), ("subject002",), ("subject003",)], "case_id string")
    flags = spark.createDataFrame([("subject001", "high_count:17"), ("subject003", "zero_detections")], "case_id string, flag string")
    exits = spark.createDataFrame([("subject003", 2)], "case_id string, exit_code int")
    got = {r.case_id: r for r in quality_checks.run_summary(cases, logs, flags, exits).collect()}
    assert (got["subject001"].n_detections, got["subject001"].runtime_s, got["subject001"].peak_mem_gb, got["subject001"].flag) == (17, 10.99, 0.8227, "high_count:17")
    assert got["subject002"].flag == "warning" and got["subject003"].flag == "crash:exit_2" and got["subject003"].needs_inspection


def test_prediction_files_of_four_digit_cases(spark):
    from lumenframe.sources import documents

    cases = spark.createDataFrame([("case_1000",), ("case_7",), ("odd",)], "case_id string")
    files = spark.createDataFrame([("subject100.json",), ("subject1000.json",), ("subject007.json",)], "path string")
    assert {r.case_id: r.path for r in documents.choose_prediction_files(cases, files).collect()} == {"case_1000": "subject1000.json", "case_7": "subject007.json", "odd": None}
