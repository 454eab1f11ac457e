import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import case_rows, cells_df, phantom
from lumenframe.params import Params
from lumenframe.plans import census
from lumenframe.plans.detect import detect, reject_report
from lumenframe.session import cut
from lumenframe.sources import documents
from lumenframe.operators import quality_checks


@pytest.fixture(scope="module")
def cohort(spark):
    shapes, masks, hu, parent = {}, {}, {}, {}
    for kind in ("side", "two", "bare"):
        hu[kind], parent[kind] = phantom(kind)
        shapes[kind] = hu[kind].shape
        masks[kind] = np.ones(hu[kind].shape, bool)
    vox = cut(cells_df(spark, masks, hu=hu, parent=parent))
    cases = cut(case_rows(spark, shapes))
    return vox, cases, detect(vox, cases, fill=40.0)


def test_phantom_branches_are_found(spark, cohort):
    _, cases, d = cohort
    got = {}
    for r in d.landmarks.collect():
        got.setdefault(r.case_id, []).append(r)
    assert set(got) == {"side", "two"}
    (b,) = got["side"]
    assert b.instance_id == "branch_001"
    mid = 16.5 * 0.8
    assert np.allclose([b.x, b.y, b.z], [mid + 3.6, mid, 18.0], atol=1.2)
    assert b.dx > 0.9 and 1.0 < b.radius_mm < 2.6 and b.path_mm > 8
    assert abs(np.linalg.norm([b.sx - b.x, b.sy - b.y, b.sz - b.z]) - 5.0) < 1e-6
    two = sorted(got["two"], key=lambda r: r.instance_id)
    assert [r.instance_id for r in two] == ["branch_001", "branch_002"] and two[0].z > two[1].z
    assert two[1].dx > 0.9 and np.dot([two[0].dx, two[0].dy], [np.cos(2.0), np.sin(2.0)]) > 0.9
    reasons = {(r.case_id, r.reason) for r in d.rejected.collect()}
    assert ("bare", "no_seeds") in reasons
    report = {r.case_id: r for r in reject_report(d.rejected).collect()}
    assert report["bare"].n_more == 0 and report["bare"].reasons == ["id-:no_seeds"]
    docs = documents.build_documents(cases, d.landmarks)
    assert docs.count() == 3 and quality_checks.require_valid(docs).count() == 3
    assert quality_checks.sanity_flags(cases, documents.explode_rows(docs)).where("flag like 'oob%' or flag like 'nan%'").count() == 0
    assert {r.flag for r in quality_checks.sanity_flags(cases, documents.explode_rows(docs)).collect()} == {"zero_detections"}


def test_shifted_and_renamed_case_gives_the_same_branch(spark, cohort):
    vox, cases, first = cohort
    one = vox.where("case_id = 'side'").withColumn("case_id", F.lit("moved")).repartition(5)
    moved = cases.where("case_id = 'side'").select(F.lit("moved").alias("case_id"), "size", "spacing", F.array(F.lit(100.0), F.lit(-50.0), F.lit(7.0)).alias("origin"), "direction")
    d = detect(one, moved, Params(split_contacts=True), fill=40.0)
    (a,), (b,) = d.landmarks.collect(), first.landmarks.where("case_id = 'side'").collect()
    assert np.allclose([a.x - 100, a.y + 50, a.z - 7, a.radius_mm, a.dx], [b.x, b.y, b.z, b.radius_mm, b.dx])
    assert d.rejected.count() == 0
    rows = census.contact_census(d.instances, d.maps, moved, d.landmarks).collect()
    assert len(rows) == 1 and rows[0].instance_id == "branch_001" and not rows[0].over_18mm_threshold and rows[0].contact_spread_mm < 5
