"""Landmark, lattice, detection and verdict views over the given tables, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.bricks import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def landmarks(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings read as landmarks: odd ids are references, even ids predictions.

    A case is one label within one block of 500 ids, so the number of cases grows with the table.
    """
    return table(spark, sf, "embeddings").selectExpr(
        "CAST(floor(vec_id / 500) * 10 + label AS BIGINT) AS case_id", "vec_id AS id", "vec_id % 2 = 1 AS is_gt",
        *[f"{expr.format(*[f'CAST(element_at(embedding, {i}) AS DOUBLE)' for i in range(16)])} AS {name}" for name, expr in _LM_COLUMNS],
    )


# {n} is element n of the embedding, counted from 1
_LM_COLUMNS = [
    ("x", "{1} * 100"), ("y", "{2} * 100"), ("z", "{3} * 100"),
    ("dx", "{4}"), ("dy", "{5}"), ("dz", "{6}"),
    ("radius_mm", "1 + 5 * abs({7})"), ("path_mm", "14 * abs({8})"), ("vesselness", "abs({9})"),
    ("radius_cv", "2 * abs({10})"), ("circularity", "abs({11})"), ("bone_frac", "abs({12})"), ("adj_lumen_frac", "abs({13})"),
    ("sx", "{1} * 100 + 5 * {4}"), ("sy", "{2} * 100 + 5 * {5}"), ("sz", "{3} * 100 + 5 * {6}"),
    ("diameter_mm", "1 + 10 * abs({14})"),
]

LM = """lm AS (
  SELECT CAST(floor(vec_id / 500) * 10 + label AS BIGINT) AS case_id, vec_id AS id, vec_id % 2 = 1 AS is_gt,
    CAST(embedding[1] AS DOUBLE)*100 AS x, CAST(embedding[2] AS DOUBLE)*100 AS y, CAST(embedding[3] AS DOUBLE)*100 AS z,
    CAST(embedding[4] AS DOUBLE) AS dx, CAST(embedding[5] AS DOUBLE) AS dy, CAST(embedding[6] AS DOUBLE) AS dz,
    1 + 5*abs(CAST(embedding[7] AS DOUBLE)) AS radius_mm, 14*abs(CAST(embedding[8] AS DOUBLE)) AS path_mm,
    abs(CAST(embedding[9] AS DOUBLE)) AS vesselness, 2*abs(CAST(embedding[10] AS DOUBLE)) AS radius_cv,
    abs(CAST(embedding[11] AS DOUBLE)) AS circularity, abs(CAST(embedding[12] AS DOUBLE)) AS bone_frac,
    abs(CAST(embedding[13] AS DOUBLE)) AS adj_lumen_frac,
    CAST(embedding[1] AS DOUBLE)*100 + 5*CAST(embedding[4] AS DOUBLE) AS sx,
    CAST(embedding[2] AS DOUBLE)*100 + 5*CAST(embedding[5] AS DOUBLE) AS sy,
    CAST(embedding[3] AS DOUBLE)*100 + 5*CAST(embedding[6] AS DOUBLE) AS sz,
    1 + 10*abs(CAST(embedding[14] AS DOUBLE)) AS diameter_mm
  FROM embeddings)"""


# one parent tube per case; spacing is the same for all cases of the lattice view
SPACING_ZYX = (1.5, 0.8, 0.8)
SIDE = 24


def lattice(spark: SparkSession, sf: str) -> DataFrame:
    """Line items hashed onto a 24^3 grid per 25 suppliers; a tube of radius 3 cells is the parent.

    Cases grow with the number of suppliers at constant density.
    """
    first = F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_extendedprice") / 1e7
    cells = (
        table(spark, sf, "lineitem")
        .groupBy(
            F.floor(F.col("l_suppkey") / 25).cast("long").alias("case_id"),
            (F.col("l_partkey") % SIDE).cast("int").alias("z"),
            (F.col("l_orderkey") % SIDE).cast("int").alias("y"),
            (F.floor("l_quantity") % SIDE).cast("int").alias("x"),
        )
        .agg((F.min_by("l_extendedprice", first) / 100).alias("hu"))
    )
    dy, dx = F.col("y") - 12, F.col("x") - 12
    return cells.withColumn("parent", dy * dy + dx * dx <= 9)


LAT = """lat AS (
  SELECT *, (y-12)*(y-12) + (x-12)*(x-12) <= 9 AS parent FROM (
    SELECT CAST(floor(l_suppkey / 25) AS BIGINT) AS case_id, CAST(l_partkey % 24 AS INT) AS z,
      CAST(l_orderkey % 24 AS INT) AS y, CAST(floor(l_quantity) % 24 AS INT) AS x,
      min_by(l_extendedprice, l_orderkey*10 + l_linenumber + l_extendedprice/1e7)/100 AS hu
    FROM lineitem GROUP BY 1, 2, 3, 4))"""


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as classified detections: one feature, a verdict from the labels."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    l = table(spark, sf, "labels").select("doc_id", "quality")
    verdict = F.when(F.col("quality") == 1, "confirmed_real").when(F.col("quality") == 0, "confirmed_false").otherwise("uncertain")
    return d.join(l, "doc_id", "left").select(
        F.col("source").alias("case_id"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("feature"), verdict.alias("verdict")
    )


DET = """det AS (
  SELECT d.source AS case_id, d.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS feature,
    CASE WHEN l.quality = 1 THEN 'confirmed_real' WHEN l.quality = 0 THEN 'confirmed_false' ELSE 'uncertain' END AS verdict
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def verdict_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a verdict edit log."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    verdict = F.when(F.col("event_type") == "purchase", "confirmed_real").when(F.col("event_type") == "error", "confirmed_false").otherwise("uncertain")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("edit_id"), F.col("ts").alias("edit_ts"), verdict.alias("verdict"))


VERD = """verd AS (
  SELECT user_id AS key, event_id AS edit_id, ts AS edit_ts,
    CASE event_type WHEN 'purchase' THEN 'confirmed_real' WHEN 'error' THEN 'confirmed_false' ELSE 'uncertain' END AS verdict
  FROM events)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


PHANTOM_SIZE = (20, 36, 36)  # z, y, x
PHANTOM_SPACING = (1.5, 0.8, 0.8)


def phantom_cases(spark: SparkSession, sf: str) -> DataFrame:
    """One scan per four suppliers."""
    z, y, x = PHANTOM_SIZE
    sz, sy, sx = PHANTOM_SPACING
    return table(spark, sf, "supplier").select(F.floor(F.col("s_suppkey") / 4).cast("long").alias("case_id")).distinct().select(
        "case_id",
        F.array(F.lit(x), F.lit(y), F.lit(z)).alias("size"), F.array(F.lit(sx), F.lit(sy), F.lit(sz)).alias("spacing"),
        F.array(F.lit(-14.0), F.lit(-14.0), F.lit(100.0)).alias("origin"),
        F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)]).alias("direction"),
    )


def phantom_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier as a straight side tube: height by rank in its scan, angle and radius by its columns."""
    k = F.col("s_suppkey") % 4
    angle = F.col("s_nationkey") * (2 * 3.141592653589793 / 25)
    return table(spark, sf, "supplier").select(
        F.floor(F.col("s_suppkey") / 4).cast("long").alias("case_id"), F.col("s_suppkey").alias("branch"),
        (k * 5 + 2).alias("bz"), F.cos(angle).alias("ux"), F.sin(angle).alias("uy"),
        (1.3 + F.pmod(F.abs("s_acctbal"), F.lit(700.0)) / 1000.0).alias("tube_mm"),
    )


def phantom_voxels(spark: SparkSession, sf: str) -> DataFrame:
    """Dense scans: a parent tube of 4 mm along z and the side tubes, over a dim textured background."""
    nz, ny, nx = PHANTOM_SIZE
    sz, sy, sx = PHANTOM_SPACING
    branches = phantom_branches(spark, sf).groupBy("case_id").agg(F.collect_list(F.struct("bz", "ux", "uy", "tube_mm")).alias("tubes"))  # four per scan
    # scans get their tubes before they become cells: cells of a scan are many, scans and slices few
    scans = phantom_cases(spark, sf).select("case_id").join(branches, "case_id")
    slices = scans.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(nz - 1))))
    # a tube that a slice doesn't meet is none for its cells: dz * dz alone is beyond its radius
    meets = lambda t: (F.col("z") - t["bz"]) * sz * ((F.col("z") - t["bz"]) * sz) <= t["tube_mm"] * t["tube_mm"]
    slices = spread(slices.withColumn("tubes", F.filter("tubes", meets)), ["case_id", "z"])
    cells = slices.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    px, py, pz = (F.col("x") - (nx - 1) / 2) * sx, (F.col("y") - (ny - 1) / 2) * sy, F.col("z") * sz

    def inside(t):
        along = px * t["ux"] + py * t["uy"]
        across = px * t["uy"] - py * t["ux"]
        dz = pz - t["bz"] * sz
        return (along >= 0) & (along <= 13.0) & (across * across + dz * dz <= t["tube_mm"] * t["tube_mm"])

    parent = px * px + py * py <= 16.0
    noise = F.pmod(F.xxhash64("case_id", "z", "y", "x"), F.lit(21)) - 10
    tube = F.exists("tubes", inside)
    return cells.select(
        "case_id", "z", "y", "x", (F.when(parent | tube, 320.0).otherwise(40.0) + noise).alias("hu"), parent.alias("parent")
    )
