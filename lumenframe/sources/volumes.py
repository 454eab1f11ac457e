"""Scan ingest: pair discovery, decoding of NIfTI-1 files into line rows, contract checks.

Decoding is a step of the ingest job: each file is decoded where Spark placed it and leaves the
task as one row per grid line. Everything after that is joins on (case, z, y, x).
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import geometry as geo
from lumenframe.operators.percase import join_case
from lumenframe.session import cut

# Sample types by NIfTI-1 code.
SAMPLE_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}

LINES = (
    "path string, error string, size array<int>, spacing array<double>, origin array<double>, "
    "direction array<double>, z int, y int, line array<float>"
)


def case_id_of(path: str | Column, explicit: Column | None = None) -> Column:
    """``subjectNNN`` from the folder (``subject*``, ``case_N``), else from digits in the file name."""
    c = F.col(path) if isinstance(path, str) else path
    folder = F.regexp_extract(c, r"([^/]+)/[^/]+$", 1)
    name = F.regexp_extract(c, r"([^/]+)$", 1)
    from_case = F.regexp_extract(folder, r"^case_(\d+)(?:_|$)", 1)
    digits = F.regexp_extract(name, r"(\d+)", 1)
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"\.nii", "")
    found = (
        F.when(folder.startswith("subject"), folder)
        .when(from_case != "", F.format_string("subject%03d", from_case.cast("int")))
        .when(digits != "", F.format_string("subject%03d", digits.cast("int")))
        .otherwise(stem)
    )
    return found if explicit is None else F.coalesce(F.when(explicit != "", explicit), found)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, bytes)`` of all files below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("bytes"))


def pair_volumes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(folder, case_id, image, mask)`` of complete pairs, and the folders without one.

    Images are named ``orig*`` or ``image*``, masks ``aorta*`` or ``mask*``; masks of daughters or
    of combined labels are skipped. The first name in order wins.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    f = files.where(name.rlike(r"\.nii(\.gz)?$")).select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), name.alias("name"))
    is_image = F.col("name").startswith("orig") | F.col("name").startswith("image")
    is_mask = (F.col("name").startswith("aorta") | F.col("name").startswith("mask")) & ~F.lower("name").contains("daughter") & ~F.lower("name").contains("and_")
    g = f.groupBy("folder").agg(F.min(F.when(is_image, F.col("path"))).alias("image"), F.min(F.when(is_mask, F.col("path"))).alias("mask"))
    g = g.withColumn("case_id", case_id_of(F.coalesce("image", "mask", F.concat("folder", F.lit("/x")))))
    whole = F.col("image").isNotNull() & F.col("mask").isNotNull()
    return g.where(whole).select("folder", "case_id", "image", "mask"), g.where(~whole).select("folder", "case_id", "image", "mask")


def _grid_of(head: bytes) -> tuple[str, list[int], np.dtype, float, float, float, np.ndarray]:
    """Byte order, size, sample type, offset, slope, intercept and RAS affine of a header."""
    order = "<" if int.from_bytes(head[:4], "little") == 348 else ">"
    read = lambda kind, at, n: np.frombuffer(head, np.dtype(order + kind), n, at)
    dim = read("i2", 40, 8)
    size = [int(dim[1]), int(dim[2]), int(dim[3]) if dim[0] >= 3 else 1]
    code = int(read("i2", 70, 1)[0])
    if code not in SAMPLE_TYPES:
        raise ValueError(f"Unsupported NIfTI datatype {code}")
    pix = read("f4", 76, 8).astype(float)
    offset, slope, inter = (float(v) for v in read("f4", 108, 3))
    q_code, s_code = (int(v) for v in read("i2", 252, 2))
    affine = np.eye(4)
    if s_code > 0:
        affine[:3] = read("f4", 280, 12).reshape(3, 4)
    elif q_code > 0:
        b, c, d, *shift = read("f4", 256, 6).astype(float)
        a = np.sqrt(max(0.0, 1.0 - b * b - c * c - d * d))
        v, w = np.array([b, c, d]), np.array([[0, -d, c], [d, 0, -b], [-c, b, 0]])
        turn = (a * a - v @ v) * np.eye(3) + 2 * np.outer(v, v) + 2 * a * w
        affine[:3, :3] = turn * np.array([pix[1], pix[2], pix[3] * (pix[0] or 1.0)])
        affine[:3, 3] = shift
    else:
        affine[:3, :3] = np.diag(pix[1:4])
    return order, size, np.dtype(order + SAMPLE_TYPES[code]), max(offset, 352.0), slope, inter, affine


def _decode(path: str, content: bytes) -> Iterator[pd.DataFrame]:
    """A header row, then one frame of line rows per slice; the payload is read slice by slice."""
    packed = path.endswith(".gz") or content[:2] == b"\x1f\x8b"
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if packed else io.BytesIO(content)
    head = stream.read(348)
    if len(head) < 348:
        raise ValueError(f"File too small to be NIfTI: {path}")
    _, size, kind, offset, slope, inter, affine = _grid_of(head)
    lps = np.diag([-1.0, -1.0, 1.0]) @ affine[:3]
    spacing = np.linalg.norm(lps[:, :3], axis=0)
    direction = np.where(spacing > 1e-8, lps[:, :3] / np.maximum(spacing, 1e-8), np.eye(3))
    head_row = {"path": path, "error": None, "size": size, "spacing": spacing.tolist(), "origin": lps[:, 3].tolist(), "direction": direction.ravel().tolist()}
    yield pd.DataFrame([{**head_row, "z": None, "y": None, "line": None}])
    stream.read(int(offset) - 348)
    nx, ny, nz = size
    for z in range(nz):
        raw = stream.read(nx * ny * kind.itemsize)
        if len(raw) < nx * ny * kind.itemsize:
            raise ValueError(f"Could not read NIfTI payload, truncated at slice {z}: {path}")
        plane = np.frombuffer(raw, kind).reshape(ny, nx).astype(np.float32)
        if slope != 0.0:
            plane = plane * np.float32(slope) + np.float32(inter)
        none = [None] * ny
        yield pd.DataFrame(
            {"path": [path] * ny, "error": none, "size": none, "spacing": none, "origin": none, "direction": none, "z": [z] * ny, "y": range(ny), "line": list(plane)}
        )


def _decode_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    blank = {k: None for k in ("size", "spacing", "origin", "direction", "z", "y", "line")}
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                yield from _decode(path, bytes(content))
            except Exception as exc:  # a bad file is a row, not a failed job
                text = str(exc) if "NIfTI" in str(exc) else f"Could not read NIfTI '{path}': {exc}"
                yield pd.DataFrame([{"path": path, "error": text, **blank}])


def decode_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Header, line and error rows of the named files (see ``LINES``)."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(_decode_all, LINES)


def stage_cohort(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """Line rows of every file of ``pairs`` with ``case_id`` and ``role``, written once.

    The list of paths (two per case) goes through the driver; the contents do not.
    """
    roles = pairs.select("case_id", F.explode(F.array(
        F.struct(F.lit("image").alias("role"), F.col("image").alias("path")), F.struct(F.lit("mask").alias("role"), F.col("mask").alias("path"))
    )).alias("r")).select("case_id", "r.role", "r.path")
    paths = [r["path"] for r in roles.select("path").distinct().toLocalIterator()]
    if not paths:
        empty = spark.createDataFrame([], LINES)
        return empty.withColumns({"case_id": F.lit(None).cast("string"), "role": F.lit(None).cast("string")})
    return cut(decode_lines(spark, paths).join(F.broadcast(roles) if len(paths) <= 400_000 else roles, "path"), "lines")


def headers(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("size").isNotNull()).select("case_id", "role", "size", "spacing", "origin", "direction")


def cells(lines: DataFrame, role: str) -> DataFrame:
    body = lines.where((F.col("role") == role) & F.col("z").isNotNull())
    return body.select("case_id", "z", "y", F.posexplode("line").alias("x", "value"))


def load_cohort(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(cases, voxels, errors)`` after the contract checks.

    Errors: unreadable files, different sizes, not co-registered, empty masks. Failed cases are left
    out of the other two tables. Sheared directions are replaced by the nearest rotation; a mask on
    another grid of the same size is resampled onto the image grid.
    """
    bad = lines.where(F.col("error").isNotNull()).select("case_id", "role", "error")
    h = headers(lines)
    image, mask = h.where("role = 'image'").drop("role"), h.where("role = 'mask'").drop("role")
    both = image.select("case_id", F.col("size").alias("a")).join(mask.select("case_id", F.col("size").alias("b")), "case_id")
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ", ")
    sizes = both.where(F.col("a") != F.col("b")).select(
        "case_id", F.lit("mask").alias("role"), F.concat(F.lit("Image and aorta mask have different sizes: ("), text("a"), F.lit(") vs ("), text("b"), F.lit(")")).alias("error")
    )
    failed = bad.select("case_id").unionByName(sizes.select("case_id")).distinct()
    grids = cut(geo.correct_directions(image, mask).join(failed, "case_id", "left_anti"), "grids")
    on = cells(lines, "mask").where(F.col("value") > 0).select("case_id", "z", "y", "x")
    on = on.join(grids.select("case_id"), "case_id", "left_semi")
    moved = grids.where("needs_resample")
    if moved.isEmpty():
        parent = on
    else:
        again = geo.resample_nearest(on.join(moved.select("case_id"), "case_id", "left_semi").withColumn("label", F.lit(1)), moved)
        parent = on.join(moved.select("case_id"), "case_id", "left_anti").unionByName(again.select("case_id", "z", "y", "x"))
    parent = cut(parent, "parent")
    empty = grids.select("case_id").join(parent.select("case_id").distinct(), "case_id", "left_anti")
    empty = empty.select("case_id", F.lit("mask").alias("role"), F.lit("Aorta mask is empty").alias("error"))
    off = geo.orthonormality(grids).where(~F.col("is_orthonormal"))
    off = off.select("case_id", F.lit("image").alias("role"), F.lit("direction still not orthonormal after correction").alias("error"))
    errors = bad.unionByName(sizes).unionByName(empty).unionByName(off)
    cases = grids.join(errors.select("case_id").distinct(), "case_id", "left_anti").select(
        "case_id", "size", "spacing", "origin", "direction", "corrected", "left_handed", "frobenius", "max_abs_off", "det"
    )
    cases = cut(cases, "cases")
    hu = cells(lines, "image").withColumnRenamed("value", "hu").withColumn("hu", F.col("hu").cast("double"))
    hu = join_case(hu, cases.select("case_id"))
    voxels = hu.join(parent.withColumn("parent", F.lit(True)), ["case_id", "z", "y", "x"], "left").withColumn("parent", F.coalesce("parent", F.lit(False)))
    return cases, voxels, errors


def batch_status(pairs: DataFrame, unpaired: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per case: ``ok``, ``failed`` with its first error, or ``skipped`` without a pair."""
    first = errors.groupBy("case_id").agg(F.min("error").alias("error"))
    done = pairs.select("case_id").join(first, "case_id", "left")
    done = done.select("case_id", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error")
    return done.unionByName(unpaired.select("case_id", F.lit("skipped").alias("status"), F.lit("missing file: image or mask").alias("error")))


def batch_counts(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status") == "skipped").alias("n_skipped"), F.bool_or(F.col("status") == "failed").alias("any_failed"),
    )
