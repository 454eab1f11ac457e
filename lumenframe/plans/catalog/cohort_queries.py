"""Cohort layer: geometry, file pairing, ingest checks, rules, census, streaming, full detection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenframe.functions import geometry as geo
from lumenframe.functions.rounding import r6
from lumenframe.operators import distance, features, lattice, quality_checks, review, rules, splitting, strips, structure
from lumenframe.params import Params
from lumenframe.plans import detect as detection
from lumenframe.plans.catalog import lattice_sql as q
from lumenframe.plans.catalog.lattice_queries import CELL, _grid, _instances, _quadrants, _r, _vox
from lumenframe.plans.catalog.views import LAT, LM, VERD, landmarks, phantom_cases, phantom_voxels, table, with_sql
from lumenframe.session import cut, shared_root
from lumenframe.sources import documents, volumes
from lumenframe.streaming import verdicts


def _scans(spark, sf):
    """Suppliers as scan headers: a rotation about z by nation, sheared by the balance."""
    a = F.col("s_nationkey") * 0.25
    shear = F.col("s_acctbal") / 1e8
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("case_id"),
        F.array((F.col("s_nationkey") + 64).cast("int"), F.lit(64), F.lit(32)).alias("size"),
        F.array(F.lit(0.8), F.lit(0.9), 1.0 + F.col("s_nationkey") / 50.0).alias("spacing"),
        F.array(F.col("s_acctbal") / 100.0, F.lit(-20.0), F.lit(5.0)).alias("origin"),
        F.array(F.cos(a), -F.sin(a) + shear, F.lit(0.0), F.sin(a), F.cos(a), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("direction"),
    )


def geometry_qa(spark, sf):
    out = geo.orthonormality(_scans(spark, sf))
    return out.select("case_id", F.round("max_abs_off", 9).alias("max_abs_off"), r6(F.col("det")).alias("det"), "is_orthonormal")


def nearest_rotation(spark, sf):
    out = geo.nearest_rotation(_scans(spark, sf))
    return out.select("case_id", F.round("frobenius", 9).alias("frobenius"), "left_handed", *[r6(F.get("rotation", i)).alias(f"r{i}") for i in range(9)])


def index_to_mm(spark, sf):
    s = _scans(spark, sf)
    x, y, z = geo.index_to_mm([F.lit(3.0), F.lit(4.5), F.lit(2.0)])
    return s.select("case_id", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"))


def mm_to_index(spark, sf):
    s = _scans(spark, sf)
    i, j, k = geo.mm_to_index([F.lit(10.0), F.lit(-4.0), F.lit(9.0)])
    cz, cy, cx = geo.mm_to_crop_zyx([F.lit(10.0), F.lit(-4.0), F.lit(9.0)], [F.lit(1), F.lit(2), F.lit(3)])
    return s.select("case_id", *[r6(c).alias(n) for c, n in ((i, "i"), (j, "j"), (k, "k"), (cz, "cz"), (cy, "cy"), (cx, "cx"))])


def coregistration(spark, sf):
    """Image and mask headers of one scan: the mask origin is off by a few 1e-5 mm."""
    a = _scans(spark, sf)
    b = a.withColumn("origin", F.transform("origin", lambda v: v + (F.col("case_id") % 20) * 1.3e-5))
    ka = a.select("case_id", geo.geometry_key().alias("ka"))
    kb = b.select("case_id", geo.geometry_key().alias("kb"))
    return ka.join(kb, "case_id").select("case_id", (F.col("ka") == F.col("kb")).alias("same_grid"))


def _files(spark, sf):
    """Customers as files: a folder per five customers, names by market segment."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = F.floor(F.col("c_custkey") / 5).cast("string")
    folder = F.when(F.col("c_custkey") % 10 < 5, F.concat(F.lit("case_"), n)).otherwise(F.format_string("subject%03d", n.cast("int")))
    stem = (
        F.when(F.col("c_mktsegment") == "BUILDING", "orig").when(F.col("c_mktsegment") == "AUTOMOBILE", "image")
        .when(F.col("c_mktsegment") == "MACHINERY", "aorta").when(F.col("c_mktsegment") == "HOUSEHOLD", "mask").otherwise("aorta_and_daughters")
    )
    path = F.concat(F.lit("/scans/"), folder, F.lit("/"), stem, F.col("c_nationkey").cast("string"), F.when(F.col("c_nationkey") % 3 == 0, ".nii").otherwise(".nii.gz"))
    return c.select(path.alias("path"))


def volume_pairs(spark, sf):
    whole, _ = volumes.pair_volumes(_files(spark, sf))
    return whole.select("folder", "case_id", "image", "mask")


def unpaired_folders(spark, sf):
    _, rest = volumes.pair_volumes(_files(spark, sf))
    return rest.select("folder", "case_id", "image", "mask")


def prediction_lookup(spark, sf):
    """Cases by nation; prediction files by the customers' keys under the four conventions."""
    cases = table(spark, sf, "customer").select(F.format_string("case_%02d", F.col("c_custkey")).alias("case_id")).distinct()
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    n = F.format_string("%02d", F.col("o_custkey"))
    kind = F.col("o_orderkey") % 9
    path = (
        F.when(kind == 0, F.format_string("subject%03d.json", F.col("o_custkey")))
        .when(kind == 1, F.concat(F.lit("case_"), n, F.lit(".json")))
        .when(kind == 2, F.concat(F.lit("case_"), n, F.lit("/prediction.json")))
        .otherwise(F.concat(F.lit("other"), n, F.lit(".json")))
    )
    return documents.choose_prediction_files(cases, o.select(path.alias("path")))


def ingest_errors(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    k = F.col("page_id") % 7
    text = (
        F.when(k == 0, F.concat(F.lit("No such file: "), F.col("url"))).when(k == 1, F.concat(F.lit("File too small to be NIfTI: "), F.col("url")))
        .when(k == 2, "Image and mask have different sizes").when(k == 3, "grids are not co-registered after correction")
        .when(k == 4, F.concat(F.lit("Could not read volume\n"), F.col("url"))).when(k == 5, "mask is empty")
    )
    return quality_checks.ingest_errors(p.select(F.col("page_id").alias("case_id"), F.lit("image").alias("role"), text.alias("error")))


def manifest_check(spark, sf):
    """Documents as files against a manifest that lists some of them, with wrong hashes for toxic ones."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    path = F.col("doc_id").cast("string")
    files = d.select(path.alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.col("text"), 256).alias("sha256"))
    l = table(spark, sf, "labels").select("doc_id", "toxic")
    listed = d.join(l, "doc_id", "left").where(F.col("doc_id") % 10 != 0)
    text = F.when(F.col("toxic") == 1, F.upper("text")).otherwise(F.col("text"))
    manifest = listed.select(path.alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"))
    return quality_checks.check_manifest(files, manifest)


def path_reasons(spark, sf):
    lm = landmarks(spark, sf).select("case_id", "id", F.col("path_mm").alias("walk_mm"), (F.col("radius_mm") * 2).alias("extent_mm"), (F.col("diameter_mm") * 3).alias("span_mm"),
                                     (F.col("radius_cv") * 30).alias("sv1"), (F.col("circularity") * 30).alias("sv2"), F.col("vesselness").alias("med_vesselness"))
    return rules.with_path_reason(lm).select("case_id", "id", F.col("path_reason").alias("reason"))


def site_reasons(spark, sf):
    lm = landmarks(spark, sf)
    ends = lm.groupBy("case_id").agg(F.min("z").alias("zmin"), F.max("z").alias("zmax"))
    j = lm.join(ends, "case_id").select(
        "case_id", "id", (F.col("z") - F.col("zmin")).alias("oz"), (F.col("dz") * 4).alias("dir_z"), (F.col("diameter_mm") * 2).alias("diameter_mm"), F.col("z").alias("ostium_z_mm"),
        F.lit(0).alias("z_first"), F.floor(F.col("zmax") - F.col("zmin")).cast("int").alias("z_last"), (F.col("case_id") % 2 == 0).alias("lo_cap"), F.lit(True).alias("hi_cap"), F.col("zmin").alias("parent_z_min_mm"),
    )
    return rules.with_site_reason(j).select("case_id", "id", F.col("site_reason").alias("reason"))


def calibre_reasons(spark, sf):
    lm = landmarks(spark, sf).withColumn("radius_mm", F.col("radius_mm") - 0.8)
    return rules.with_calibre_reason(lm).select("case_id", "id", F.col("calibre_reason").alias("reason"))


def parent_centroid(spark, sf):
    vox = _vox(spark, sf)
    return vox.where("parent").groupBy("case_id").agg(*[r6(F.avg(F.col(c)) * s).alias(f"{c}_mm") for c, s in (("x", 0.8), ("y", 0.8), ("z", 1.5))])


def spread_worklist(spark, sf):
    vox = _vox(spark, sf)
    inst = _quadrants(vox)
    c = lattice.contact_cells(inst, vox.where("parent"))
    s = features.contact_spread(c, _grid(vox))
    n = inst.groupBy("case_id", "inst_id").agg(F.count(F.lit(1)).alias("n_instance"))
    census = s.join(n, ["case_id", "inst_id"]).select(
        "case_id", F.concat(F.lit("id"), F.col("inst_id").cast("string")).alias("instance_id"), r6(F.col("contact_spread_mm")).alias("contact_spread_mm"),
        (F.col("contact_spread_mm") >= 4.0).alias("over_18mm_threshold"), F.lit(False).alias("would_full_split"), F.lit(0.0).alias("ostium_z"),
        "n_contact", "n_instance", F.lit(None).cast("double").alias("cluster_cos"),
    )
    out = review.spread_worklist(census, near_mm=3.5)
    return out.select("case_id", "instance_id", "status", F.col("ostium_err_mm").alias("spread_mm"), F.col("radius_mm").alias("n_contact"), F.col("path_length_mm").alias("n_instance"))


def spread_census_summary(spark, sf):
    vox = _vox(spark, sf)
    s = features.contact_spread(lattice.contact_cells(_quadrants(vox), vox.where("parent")), _grid(vox)).withColumn("would_full_split", F.col("n_contact") > 20)
    out = review.spread_census_summary(s, 3.5, 4.0)
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("min_mm", "p50_mm", "p90_mm", "p95_mm", "max_mm")], "n_near", "n_over", "n_full_split")


def widest_instance(spark, sf):
    vox = _vox(spark, sf)
    s = features.contact_spread(lattice.contact_cells(_quadrants(vox), vox.where("parent")), _grid(vox)).withColumn("contact_spread_mm", r6(F.col("contact_spread_mm")))
    return strips.pick_instance(s)


def sampled_starts(spark, sf):
    vox = _vox(spark, sf)
    s = splitting.sampled_starts(lattice.contact_cells(_instances(vox), vox.where("parent")))
    return s.select("case_id", "inst_id", "walk_id", *[F.col(f"w{c}").alias(c) for c in "zyx"])


def strip_profile(spark, sf):
    vox = _vox(spark, sf)
    depth = distance.depth_inside(vox.where("parent OR hu > 700"), _grid(vox))
    c = lattice.contact_cells(_instances(vox), vox.where("parent")).join(depth, CELL)
    return strips.strip_profile(c, _grid(vox)).select("case_id", "inst_id", *_r("end_cos", "waist_mm", "end_radius_mm", "waist_ratio", "mean_turn_deg", "max_turn_deg", "turn_concentration", "top15_turn_share"))


def structure_report(spark, sf):
    vox = _vox(spark, sf)
    return structure.branch_report(_quadrants(vox.where("hu > 900")), vox.where("parent"), _grid(vox)).select("case_id", "inst_id", "voxel_count", F.col("components_26").cast("long").alias("components_26"), "face_contacts", "parent_overlap")


def ridge_clusters(spark, sf):
    """Contacts whose ridge walks fall into two heading clusters."""
    vox = _vox(spark, sf)
    grid = _grid(vox)
    near = distance.distance_to_parent(vox.where("parent"), grid, 14.0)
    depth = distance.depth_inside(vox.where("parent OR hu > 300"), grid)
    inst = cut(_quadrants(vox).join(near, CELL).join(depth, CELL), "cluster-inst")
    good, _ = splitting.ridge_clusters(lattice.contact_cells(inst, vox.where("parent")), inst, grid, Params(split_max_cosine=0.95))
    return good.select("case_id", "inst_id", *_r("cluster_cos"))


def stream_verdicts(spark, sf):
    """The verdict log consumed as a stream; equals the batch upsert."""


    log = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet")
    raw = spark.readStream.schema(log.schema).parquet(f"{sf.rstrip('/')}/events.parquet*")  # a file or a folder of part files
    verdict = F.when(F.col("event_type") == "purchase", "confirmed_real").when(F.col("event_type") == "error", "confirmed_false").otherwise("uncertain")
    edits = raw.select(F.col("user_id").alias("key"), F.col("event_id").alias("edit_id"), F.col("ts").cast("timestamp").alias("edit_ts"), verdict.alias("verdict"))
    base = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    verdicts.start_verdicts(edits, f"{base}/log", f"{base}/checkpoint").awaitTermination()
    return verdicts.current(spark, f"{base}/log").select("key", "verdict", "edit_id")


def detected_branches(spark, sf):
    """The whole detection on scans built from the suppliers: four side tubes per scan."""
    vox, cases = cut(phantom_voxels(spark, sf), "scan"), cut(phantom_cases(spark, sf), "scan-cases")
    lm = detection.detect(vox, cases, fill=40.0).landmarks
    return lm.select("case_id", "instance_id", *[F.round(c, 4).alias(c) for c in ("x", "y", "z", "sx", "sy", "sz", "radius_mm", "dx", "dy", "dz", "path_mm", "diameter_mm")])


_SC = """sc AS (SELECT s_suppkey AS case_id, CAST(s_nationkey AS INT)+64 AS n0, 0.8::DOUBLE AS s0, 0.9::DOUBLE AS s1, 1.0::DOUBLE + s_nationkey/50.0::DOUBLE AS s2, s_acctbal/100.0::DOUBLE AS o0, -20.0::DOUBLE AS o1, 5.0::DOUBLE AS o2,
   cos(s_nationkey*0.25::DOUBLE) AS d0, -sin(s_nationkey*0.25::DOUBLE)+s_acctbal/1e8 AS d1, sin(s_nationkey*0.25::DOUBLE) AS d3, cos(s_nationkey*0.25::DOUBLE) AS d4 FROM supplier)"""
_FILES = """fl AS (SELECT '/scans/' || CASE WHEN c_custkey % 10 < 5 THEN 'case_' || CAST(c_custkey // 5 AS VARCHAR) ELSE printf('subject%03d', c_custkey // 5) END AS folder,
   CASE c_mktsegment WHEN 'BUILDING' THEN 'orig' WHEN 'AUTOMOBILE' THEN 'image' WHEN 'MACHINERY' THEN 'aorta' WHEN 'HOUSEHOLD' THEN 'mask' ELSE 'aorta_and_daughters' END || CAST(c_nationkey AS VARCHAR) || CASE WHEN c_nationkey % 3 = 0 THEN '.nii' ELSE '.nii.gz' END AS name FROM customer),
 pp AS (SELECT folder, min(CASE WHEN name LIKE 'orig%' OR name LIKE 'image%' THEN folder || '/' || name END) AS image, min(CASE WHEN (name LIKE 'aorta%' OR name LIKE 'mask%') AND name NOT LIKE '%daughter%' AND name NOT LIKE '%and\\_%' ESCAPE '\\' THEN folder || '/' || name END) AS mask FROM fl GROUP BY 1),
 pi AS (SELECT folder, CASE WHEN folder LIKE '/scans/subject%' THEN regexp_extract(folder, '[^/]+$') ELSE printf('subject%03d', CAST(regexp_extract(folder, '\\d+$') AS BIGINT)) END AS case_id, image, mask FROM pp)"""
_QUAD = "inst AS (SELECT *, CAST(floor(z/4.0) AS INT)*4 + CASE WHEN y >= 12 THEN 2 ELSE 0 END + CASE WHEN x >= 12 THEN 1 ELSE 0 END AS inst_id FROM lat WHERE hu > 300 AND NOT parent)"
_SPR = """ms AS (SELECT case_id, inst_id, avg(z*1.5) AS a, avg(y*0.8) AS b, avg(x*0.8) AS c FROM ct GROUP BY 1,2),
 sp AS (SELECT ct.case_id, ct.inst_id, count(*) AS n_contact, max(sqrt((z*1.5-a)*(z*1.5-a)+(y*0.8-b)*(y*0.8-b)+(x*0.8-c)*(x*0.8-c))) AS s FROM ct JOIN ms ON ms.case_id=ct.case_id AND ms.inst_id=ct.inst_id GROUP BY 1,2)"""
_VCUR = "SELECT key, verdict, edit_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY edit_ts DESC, edit_id DESC) AS rn FROM verd) WHERE rn = 1"

COHORT_QUERIES = {
    "geometry_qa": (geometry_qa, with_sql(_SC) + """SELECT case_id, round(greatest(abs(d0*d0+d3*d3-1), abs(d0*d1+d3*d4), abs(d1*d1+d4*d4-1)), 9) AS max_abs_off, round(d0*d4-d1*d3, 6) AS det,
  abs(d0*d0+d3*d3-1) <= 1.1e-4 AND abs(d1*d1+d4*d4-1) <= 1.1e-4 AND abs(d0*d1+d3*d4) <= 1e-4 AND abs(d0*d4-d1*d3) > 0.5 AS is_orthonormal FROM sc"""),
    "nearest_rotation": (nearest_rotation, None),
    "index_to_mm": (index_to_mm, with_sql(_SC) + "SELECT case_id, round(o0+d0*(3.0*s0)+d1*(4.5*s1),6) AS x, round(o1+d3*(3.0*s0)+d4*(4.5*s1),6) AS y, round(o2+2.0*s2,6) AS z FROM sc"),
    "mm_to_index": (mm_to_index, with_sql(_SC) + ", ix AS (SELECT case_id, (d0*(10.0-o0)+d3*(-4.0-o1))/s0 AS i, (d1*(10.0-o0)+d4*(-4.0-o1))/s1 AS j, (9.0-o2)/s2 AS k FROM sc) SELECT case_id, round(i,6) AS i, round(j,6) AS j, round(k,6) AS k, round(k-1,6) AS cz, round(j-2,6) AS cy, round(i-3,6) AS cx FROM ix"),
    "coregistration": (coregistration, with_sql(_SC) + ", e AS (SELECT case_id, (case_id % 20)*1.3e-5 AS e, o0, o1, o2 FROM sc) SELECT case_id, round_even(o0+e,4)=round_even(o0,4) AND round_even(o1+e,4)=round_even(o1,4) AND round_even(o2+e,4)=round_even(o2,4) AS same_grid FROM e"),
    "volume_pairs": (volume_pairs, with_sql(_FILES) + "SELECT folder, case_id, image, mask FROM pi WHERE image IS NOT NULL AND mask IS NOT NULL"),
    "unpaired_folders": (unpaired_folders, with_sql(_FILES) + "SELECT folder, case_id, image, mask FROM pi WHERE image IS NULL OR mask IS NULL"),
    "prediction_lookup": (prediction_lookup, """WITH g AS (SELECT DISTINCT c_custkey AS k, printf('case_%02d', c_custkey) AS case_id FROM customer),
 h AS (SELECT CASE o_orderkey % 9 WHEN 0 THEN printf('subject%03d.json', o_custkey) WHEN 1 THEN printf('case_%02d.json', o_custkey) WHEN 2 THEN printf('case_%02d/prediction.json', o_custkey) END AS path FROM orders),
 w AS (SELECT case_id, 0 AS p, printf('subject%03d.json', k) AS path FROM g UNION ALL SELECT case_id, 1, case_id || '.json' FROM g UNION ALL SELECT case_id, 3, case_id || '/prediction.json' FROM g)
SELECT g.case_id, min_by(w.path, w.p) AS path FROM g LEFT JOIN (SELECT w.* FROM w WHERE path IN (SELECT path FROM h)) w ON w.case_id=g.case_id GROUP BY 1"""),
    "ingest_errors": (ingest_errors, "SELECT page_id AS case_id, 'image' AS role, CASE page_id % 7 WHEN 0 THEN 'missing_file' WHEN 1 THEN 'unreadable_volume' WHEN 2 THEN 'size_mismatch' WHEN 3 THEN 'not_co_registered' WHEN 4 THEN 'unreadable_volume' ELSE 'empty_mask' END AS kind, CASE page_id % 7 WHEN 0 THEN 'No such file: ' || url WHEN 1 THEN 'File too small to be NIfTI: ' || url WHEN 2 THEN 'Image and mask have different sizes' WHEN 3 THEN 'grids are not co-registered after correction' WHEN 4 THEN 'Could not read volume' ELSE 'mask is empty' END AS message FROM pages WHERE page_id % 7 < 6"),
    "manifest_check": (manifest_check, "SELECT CAST(d.doc_id AS VARCHAR) AS path, CASE WHEN d.doc_id % 10 = 0 THEN 'unlisted' WHEN toxic = 1 AND upper(text) <> text THEN 'sha256' ELSE 'ok' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id"),
    "path_reasons": (path_reasons, with_sql(LM) + "SELECT case_id, id, CASE WHEN greatest(path_mm, radius_mm*2, diameter_mm*3) < 5.0 THEN 'short_path' WHEN greatest(path_mm, radius_mm*2) < 5.0 AND (radius_cv*30/greatest(circularity*30,1e-3) < 1.5 OR radius_cv*30 < 5.0 OR vesselness < 0.05) THEN 'span_blob' END AS reason FROM lm"),
    "site_reasons": (site_reasons, with_sql(LM) + """, e AS (SELECT lm.*, lm.z-zmin AS oz, CAST(floor(zmax-zmin) AS INT) AS zl, zmin, dz*4 AS dirz FROM lm JOIN (SELECT case_id, min(z) AS zmin, max(z) AS zmax FROM lm GROUP BY 1) m ON m.case_id=lm.case_id)
SELECT case_id, id, CASE WHEN ((case_id % 2 = 0 AND round_even(oz,0) BETWEEN -2 AND 3) OR round_even(oz,0) BETWEEN greatest(zl-1,0)-2 AND zl+2) AND abs(dirz) >= 0.75 THEN 'crop_cap' WHEN diameter_mm*2 >= 4.5 AND z-zmin <= 12.0 AND dirz <= -0.40 AND z-zmin <= 10.0 THEN 'terminal_split' END AS reason FROM e"""),
    "calibre_reasons": (calibre_reasons, with_sql(LM) + "SELECT case_id, id, CASE WHEN diameter_mm < 1.6 AND radius_mm-0.8 < 0.45 THEN 'tiny_diam' END AS reason FROM lm"),
    "parent_centroid": (parent_centroid, with_sql(LAT) + "SELECT case_id, round(avg(x)*0.8,6) AS x_mm, round(avg(y)*0.8,6) AS y_mm, round(avg(z)*1.5,6) AS z_mm FROM lat WHERE parent GROUP BY 1"),
    "spread_worklist": (spread_worklist, with_sql(LAT, q.BOX27, _QUAD, q.CONT, _SPR) + "SELECT sp.case_id, 'id' || CAST(sp.inst_id AS VARCHAR) AS instance_id, CASE WHEN s >= 4.0 THEN 'over_18' ELSE 'near_18' END AS status, round(s,6) AS spread_mm, n_contact, n AS n_instance FROM sp JOIN (SELECT case_id, inst_id, count(*) AS n FROM inst GROUP BY 1,2) i ON i.case_id=sp.case_id AND i.inst_id=sp.inst_id WHERE round(s,6) >= 3.5"),
    "spread_census_summary": (spread_census_summary, with_sql(LAT, q.BOX27, _QUAD, q.CONT, _SPR) + "SELECT count(*) AS n, round(min(s),6) AS min_mm, round(quantile_cont(s,0.5),6) AS p50_mm, round(quantile_cont(s,0.9),6) AS p90_mm, round(quantile_cont(s,0.95),6) AS p95_mm, round(max(s),6) AS max_mm, CAST(count_if(s>=3.5) AS BIGINT) AS n_near, CAST(count_if(s>=4.0) AS BIGINT) AS n_over, CAST(count_if(n_contact>20) AS BIGINT) AS n_full_split FROM sp"),
    "widest_instance": (widest_instance, with_sql(LAT, q.BOX27, _QUAD, q.CONT, _SPR) + "SELECT case_id, CAST(inst_id AS INT) AS inst_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(s,6) DESC, inst_id) AS rn FROM sp) WHERE rn = 1"),
    "sampled_starts": (sampled_starts, with_sql(LAT, q.BOX27, q.INST, q.CONT) + """, rk AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY case_id, inst_id) AS n FROM ct WINDOW w AS (PARTITION BY case_id, inst_id ORDER BY z, y, x)),
 wn AS (SELECT DISTINCT case_id, inst_id, (i*(n-1))//(least(n,16)-1)+1 AS r FROM (SELECT DISTINCT case_id, inst_id, n FROM rk WHERE n >= 6), (SELECT unnest(range(0,16)) AS i) WHERE i < least(n,16))
SELECT rk.case_id, rk.inst_id, CAST(rk.r AS INT) AS walk_id, CAST(z AS DOUBLE) AS z, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x FROM rk JOIN wn ON wn.case_id=rk.case_id AND wn.inst_id=rk.inst_id AND wn.r=rk.r"""),
    "strip_profile": (strip_profile, None),
    "structure_report": (structure_report, None),
    "ridge_clusters": (ridge_clusters, None),
    "stream_verdicts": (stream_verdicts, with_sql(VERD) + _VCUR),
    "detected_branches": (detected_branches, None),
}

