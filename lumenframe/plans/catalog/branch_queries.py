"""Branch layer: radius at the seed, clamped seeds, reject report, carried flags, serialised scores, resampled masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import geometry as geo
from lumenframe.functions.rounding import r6
from lumenframe.operators import calibration, distance, features, metrics, review, rules, sections
from lumenframe.plans import detect
from lumenframe.plans.catalog import lattice_sql as q
from lumenframe.plans.catalog.landmark_queries import ATTR, CASES, MUTUAL, PAIRS, _case_metrics, _RULE
from lumenframe.plans.catalog.lattice_queries import _grid, _headed, _vox
from lumenframe.plans.catalog.views import DET, LAT, LM, SPACING_ZYX, detections, landmarks, table, with_sql


def _spaced(df):
    return df.withColumns({f"s{c}": F.lit(v) for c, v in zip("zyx", SPACING_ZYX)})


def seed_radius(spark, sf):
    """Radius at the centroid of each instance: depth of the lumen there and radius of its plane section."""
    vox = _vox(spark, sf)
    seeds = _headed(vox).select("case_id", "inst_id", *[F.col(f"c{c}").alias(f"seed_{c}") for c in "zyx"], *[f"head_{c}" for c in "zyx"])
    depth = distance.depth_inside(vox.where("parent OR hu > 700"), _grid(vox))
    at = seeds.select("case_id", "inst_id", *[F.rint(f"seed_{c}").cast("int").alias(c) for c in "zyx"]).join(depth, ["case_id", "z", "y", "x"])
    plane = sections.plane_radius(seeds, vox, calibration.calibrate(vox), _grid(vox), ["case_id", "inst_id"])
    both = plane.select("case_id", "inst_id", r6(F.col("plane_radius_mm")).alias("plane_radius_mm")).join(
        at.select("case_id", "inst_id", r6(F.col("depth_mm")).alias("depth_at_seed")), ["case_id", "inst_id"], "left"
    )
    both = _spaced(both)
    return both.select("case_id", "inst_id", r6(sections.seed_radius(both)).alias("radius_mm"))


def clamped_seeds(spark, sf):
    """Seeds at the least path length from their origin, and the direction that is put out."""
    seen = landmarks(spark, sf).select(
        "case_id", "id", *[F.col(c).alias(f"o{c}") for c in "zyx"], *[F.col(f"s{c}").alias(f"seed_{c}") for c in "zyx"], *[F.col(f"d{c}").alias(f"head_{c}") for c in "zyx"]
    )
    out = features.direction_xyz(features.clamp_seed(_spaced(seen)))
    return out.select("case_id", "id", *[r6(F.col(c)).alias(c) for c in ("seed_z", "seed_y", "seed_x", "dir_x", "dir_y", "dir_z")])


def reject_report(spark, sf):
    """First reasons of the landmarks that the artefact rules reject, per case."""
    judged = rules.with_artifact_reason(landmarks(spark, sf)).where(F.col("reason").isNotNull())
    out = detect.reject_report(judged.select("case_id", F.col("id").alias("inst_id"), "reason"), 5)
    return out.select("case_id", "n_rejected", F.col("n_more").cast("long").alias("n_more"), F.array_join("reasons", ";").alias("reasons"))


def carried_flags(spark, sf):
    """Detections with the flags that an earlier review gave them."""
    rows = detections(spark, sf).select("case_id", F.col("id").alias("instance_id"), "verdict")
    toxic = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("instance_id"))
    earlier = rows.join(toxic, "instance_id", "left_semi").select("case_id", "instance_id", F.lit("independent_extra").alias("review_flag"))
    return review.carry_flags(rows, earlier).select("case_id", "instance_id", "verdict", "review_flag")


def serialised_prf(spark, sf):
    """Case scores as they are written out: half-to-even at four and three decimals."""
    m = metrics.serialised(_case_metrics(spark, sf))
    return m.select("case_id", "precision", "recall", "f1", "mean_ostium_err_mm", "mean_seed_err_mm", "mean_dir_cosine")


def mask_resample(spark, sf):
    """The parent mask of each lattice case on a turned image grid of other spacing."""
    vox = _vox(spark, sf)
    mask = vox.where("parent").select("case_id", "z", "y", "x", F.lit(1).alias("label"))
    a = F.col("case_id") * 0.1
    turn = [F.cos(a), -F.sin(a), F.lit(0.0), F.sin(a), F.cos(a), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    grids = vox.select("case_id").distinct().select(
        "case_id", F.array(*[F.lit(v) for v in (30, 28, 20)]).alias("size"), F.array(*[F.lit(v) for v in (0.7, 0.75, 1.9)]).alias("spacing"),
        F.array(*[F.lit(v) for v in (-3.1, 2.3, 0.4)]).alias("origin"), F.array(*turn).alias("direction"),
        F.array(*[F.lit(v) for v in (0.8, 0.8, 1.5)]).alias("mask_spacing"), F.array(*[F.lit(v) for v in (-2.0, 1.0, 0.0)]).alias("mask_origin"), F.array(*turn).alias("mask_direction"),
    )
    return geo.resample_nearest(mask, grids).select("case_id", "z", "y", "x", "label")


_SEED_RADIUS = f"""WITH seeds AS (SELECT case_id, inst_id, CAST(round_even(avg(z), 0) AS INT) AS z, CAST(round_even(avg(y), 0) AS INT) AS y, CAST(round_even(avg(x), 0) AS INT) AS x
  FROM (WITH {LAT}, {q.INST} SELECT * FROM inst) GROUP BY 1, 2),
pr AS ({q.PLANE_RADIUS}), dp AS ({q.DEPTH}),
j AS (SELECT pr.case_id, pr.inst_id, plane_radius_mm AS r, coalesce(depth_mm, 0.0) AS d FROM pr JOIN seeds s ON s.case_id=pr.case_id AND s.inst_id=pr.inst_id
  LEFT JOIN dp ON dp.case_id=s.case_id AND dp.z=s.z AND dp.y=s.y AND dp.x=s.x)
SELECT case_id, inst_id, round(CASE WHEN d > 0 AND r > 0 THEN (d+r)/2.0 WHEN d > 0 THEN d WHEN r > 0 THEN r ELSE 0.5*(1.5::DOUBLE+0.8+0.8)/3.0 END, 6) AS radius_mm FROM j"""
_CLAMPED = with_sql(LM) + """, st AS (SELECT case_id, id, z, y, x, (sz-z)*1.5::DOUBLE AS a, (sy-y)*0.8::DOUBLE AS b, (sx-x)*0.8::DOUBLE AS c FROM lm),
 un AS (SELECT *, sqrt(a*a+b*b+c*c) AS n FROM st),
 uv AS (SELECT *, CASE WHEN n > 1e-6 THEN a/n ELSE 1.0 END AS ua, CASE WHEN n > 1e-6 THEN b/n ELSE 0.0 END AS ub, CASE WHEN n > 1e-6 THEN c/n ELSE 0.0 END AS uc FROM un)
SELECT case_id, id, round(z+ua*5.0/1.5, 6) AS seed_z, round(y+ub*5.0/0.8, 6) AS seed_y, round(x+uc*5.0/0.8, 6) AS seed_x,
  round(uc/sqrt(ua*ua+ub*ub+uc*uc), 6) AS dir_x, round(ub/sqrt(ua*ua+ub*ub+uc*uc), 6) AS dir_y, round(ua/sqrt(ua*ua+ub*ub+uc*uc), 6) AS dir_z FROM uv"""
_REPORT = with_sql(LM) + f""", r AS (SELECT case_id, id, {_RULE} AS reason FROM lm), k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY id, reason) AS rn FROM r WHERE reason IS NOT NULL)
SELECT case_id, count(*) AS n_rejected, greatest(count(*) - 5, 0)::BIGINT AS n_more, string_agg('id' || id || ':' || reason, ';' ORDER BY rn) FILTER (rn <= 5) AS reasons FROM k GROUP BY 1"""
_CARRIED = with_sql(DET) + """SELECT case_id, id AS instance_id, verdict, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = det.id AND l.toxic = 1) THEN 'independent_extra' ELSE '' END AS review_flag FROM det"""
_SERIALISED = with_sql(LM, PAIRS, MUTUAL, ATTR, CASES) + """SELECT case_id, round_even(p, 4) AS "precision", round_even(r, 4) AS recall, round_even(CASE WHEN n_gt=0 AND n_pred=0 THEN 1.0 WHEN n_gt=0 OR p+r=0 THEN 0.0 ELSE 2*p*r/(p+r) END, 4) AS f1,
  round_even(mo, 3) AS mean_ostium_err_mm, round_even(ms, 3) AS mean_seed_err_mm, round_even(mc, 3) AS mean_dir_cosine FROM prf"""
_RESAMPLED = with_sql(LAT) + """, im AS (SELECT case_id, cos(case_id*0.1) AS c, sin(case_id*0.1) AS s, i, j, k FROM (SELECT DISTINCT case_id FROM lat), range(30) a(i), range(28) b(j), range(20) d(k)),
 mm AS (SELECT *, -3.1::DOUBLE + c*(i*0.7::DOUBLE) - s*(j*0.75::DOUBLE) + 2.0 AS px, 2.3::DOUBLE + s*(i*0.7::DOUBLE) + c*(j*0.75::DOUBLE) - 1.0 AS py, 0.4::DOUBLE + k*1.9::DOUBLE AS pz FROM im),
 ix AS (SELECT *, CAST(floor((c*px + s*py)/0.8 + 0.5) AS INT) AS mx, CAST(floor((-s*px + c*py)/0.8 + 0.5) AS INT) AS my, CAST(floor(pz/1.5 + 0.5) AS INT) AS mz FROM mm)
SELECT ix.case_id, k::INT AS z, j::INT AS y, i::INT AS x, 1 AS label FROM ix JOIN lat ON lat.parent AND lat.case_id=ix.case_id AND lat.z=mz AND lat.y=my AND lat.x=mx"""

BRANCH_QUERIES = {
    "seed_radius": (seed_radius, _SEED_RADIUS),
    "clamped_seeds": (clamped_seeds, _CLAMPED),
    "reject_report": (reject_report, _REPORT),
    "carried_flags": (carried_flags, _CARRIED),
    "serialised_prf": (serialised_prf, _SERIALISED),
    "mask_resample": (mask_resample, _RESAMPLED),
}
