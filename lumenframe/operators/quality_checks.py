"""Data-quality checks of documents, geometry, files and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import geometry as geo
from lumenframe.operators.percase import join_case

HIGH_COUNT = 15  # fixed value: more detections than this are flagged


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def _is_xyz(name: str) -> Column:
    three = F.coalesce(F.size(name) == 3, F.lit(False))
    return three & F.coalesce(F.forall(name, _finite), F.lit(False))


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def schema_violations(rows: DataFrame) -> DataFrame:
    """One row per broken rule of landmark rows: ``(case_id, instance_id, rule)``.

    ``rows`` carries the document fields plus ``document_parent``; use ``document_violations`` for
    rules about the document itself.
    """
    d = "direction_xyz"
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, c: acc + c * c))
    missing = [c for c in ("instance_id", "parent_instance_id", "ostium_xyz_mm", "seed_xyz_mm", "radius_mm", d)]
    rules = [
        *[(f"missing_{c}", F.col(c).isNull()) for c in missing],
        ("parent_not_aorta", F.col("parent_instance_id") != "aorta"),
        *[(f"bad_{c}", F.col(c).isNotNull() & ~_is_xyz(c)) for c in ("ostium_xyz_mm", "seed_xyz_mm", d)],
        ("radius_not_finite", F.col("radius_mm").isNotNull() & ~_finite(F.col("radius_mm"))),
        ("negative_radius", F.col("radius_mm") < 0),
        ("direction_not_unit", _is_xyz(d) & ((norm < 0.5) | (norm > 1.5))),
    ]
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    single = rows.select("case_id", "instance_id", F.explode(broken).alias("rule"))
    twice = (
        rows.where(F.col("instance_id").isNotNull())
        .groupBy("case_id", "instance_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("case_id", "instance_id", F.lit("duplicate_instance_id").alias("rule"))
    )
    return single.unionByName(twice)


def document_violations(docs: DataFrame) -> DataFrame:
    rules = [
        ("unreadable", F.col("_corrupt").isNotNull() if "_corrupt" in docs.columns else F.lit(False)),
        ("missing_case_id", F.coalesce(F.col("case_id"), F.lit("")) == ""),
        ("parent_not_aorta", _no(F.col("parent.instance_id") == "aorta")),
        ("daughters_not_a_list", F.col("daughters").isNull()),
    ]
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return docs.select("case_id", F.lit(None).cast("string").alias("instance_id"), F.explode(broken).alias("rule"))


def require_valid(docs: DataFrame) -> DataFrame:
    """The documents unchanged; reading a broken one fails the job with its first problem."""
    bad_item = F.exists(
        "daughters",
        lambda d: d["instance_id"].isNull()
        | F.coalesce(d["parent_instance_id"] != "aorta", F.lit(True))
        | F.coalesce(F.size(d["ostium_xyz_mm"]) != 3, F.lit(True))
        | F.coalesce(F.size(d["seed_xyz_mm"]) != 3, F.lit(True))
        | F.coalesce(F.size(d["direction_xyz"]) != 3, F.lit(True))
        | F.coalesce(F.isnan(d["radius_mm"]) | (d["radius_mm"] < 0), F.lit(True)),
    )
    ids = F.transform("daughters", lambda d: d["instance_id"])
    problem = (
        F.when(F.coalesce(F.col("case_id"), F.lit("")) == "", F.lit("missing case_id"))
        .when(_no(F.col("parent.instance_id") == "aorta"), F.lit("parent.instance_id must be 'aorta'"))
        .when(F.col("daughters").isNull(), F.lit("daughters must be a list"))
        .when(F.size(F.array_distinct(ids)) != F.size(ids), F.lit("duplicate instance_id"))
        .when(bad_item, F.lit("a daughter breaks the schema"))
    )
    text = F.concat(F.coalesce(F.col("case_id"), F.lit("?")), F.lit(": "), problem)
    checked = F.when(problem.isNotNull(), F.raise_error(text).cast("string")).otherwise(F.col("case_id"))
    return docs.withColumn("case_id", checked)


def sanity_flags(cases: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per flag: ``(case_id, flag)``.

    ``cases(case_id, size, spacing, origin, direction)``; landmarks more than one voxel outside
    the grid are flagged on their first offending axis.
    """
    counts = cases.select("case_id").join(rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")), "case_id", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    of_case = counts.select(
        "case_id",
        F.explode(F.array_compact(F.array(
            F.when(n == 0, F.lit("zero_detections")),
            F.when(n > HIGH_COUNT, F.concat(F.lit("high_count:"), n.cast("string"))),
        ))).alias("flag"),
    )
    j = join_case(rows, cases)
    rid = F.coalesce(F.col("instance_id"), F.lit("?"))
    flags = [
        F.when(~_finite(F.col("radius_mm")), F.concat(F.lit("nan_inf:"), rid, F.lit(".radius"))),
        F.when(_finite(F.col("radius_mm")) & (F.col("radius_mm") < 0), F.concat(F.lit("negative_radius:"), rid)),
    ]
    for key in ("ostium_xyz_mm", "seed_xyz_mm", "direction_xyz"):
        flags.append(F.when(~_is_xyz(key), F.concat(F.lit("nan_inf:"), rid, F.lit(f".{key}"))))
        if key == "direction_xyz":
            continue
        index = geo.mm_to_index([F.get(F.col(key), i) for i in range(3)])
        outside = [(c < -1.0) | (c > F.get(F.col("size"), a) + 1.0) for a, c in enumerate(index)]
        place = F.when(outside[0], F.format_string("0]=%.2f", index[0])).when(outside[1], F.format_string("1]=%.2f", index[1])).when(outside[2], F.format_string("2]=%.2f", index[2]))
        flags.append(F.when(_is_xyz(key) & place.isNotNull(), F.concat(F.lit("oob:"), rid, F.lit(f".{key}["), place)))
    of_row = j.select("case_id", F.explode(F.array_compact(F.array(*flags))).alias("flag"))
    return of_case.unionByName(of_row)


def parse_run_logs(lines: DataFrame) -> DataFrame:
    """``lines(case_id, line)`` -> counts, wall clock, peak memory and the warning mark per case."""
    text = F.col("line")
    # Patterns of the run log.
    count = F.when(text.contains("Wrote") & text.contains("daughter(s))"), F.regexp_extract(text, r"\((\d+) daughter\(s\)\)", 1))
    is_cost = text.startswith("[compute]")
    wall = F.when(is_cost, F.regexp_extract(text, r"wall_clock_s=([0-9.]+)", 1))
    peak = F.when(is_cost, F.regexp_extract(text, r"peak_rss_mb=([0-9.]+)", 1))
    warned = text.rlike("Traceback|Error|Warning|Exception") & ~text.contains("UserWarning")
    num = lambda c, t: F.expr("1") if c is None else F.when(c != "", c).cast(t)
    return lines.groupBy("case_id").agg(
        F.max(num(count, "int")).alias("n_detections"),
        F.max(num(wall, "double")).alias("runtime_s"),
        F.max(num(peak, "double") / 1024.0).alias("peak_mem_gb"),
        F.max(warned).alias("warned"),
    )


def run_summary(cases: DataFrame, logs: DataFrame, flags: DataFrame, exits: DataFrame | None = None) -> DataFrame:
    """Run table with joined flag text; ``needs_inspection`` marks cases with any flag."""
    extra = logs.where(F.col("warned")).select("case_id", F.lit("warning").alias("flag"))
    if exits is not None:
        crash = exits.where(F.col("exit_code") != 0).select("case_id", F.format_string("crash:exit_%d", "exit_code").alias("flag"))
        extra = crash.unionByName(extra.join(crash.select("case_id"), "case_id", "left_anti"))
        flags = flags.join(crash.select("case_id"), "case_id", "left_anti")
    every = extra.unionByName(flags.select("case_id", "flag")).groupBy("case_id").agg(F.array_join(F.sort_array(F.collect_list("flag")), ";").alias("flag"))
    out = cases.select("case_id").join(logs.drop("warned"), "case_id", "left").join(every, "case_id", "left")
    flag = F.coalesce(F.col("flag"), F.lit(""))
    return out.select(
        "case_id", "n_detections", F.round("runtime_s", 2).alias("runtime_s"), F.round("peak_mem_gb", 4).alias("peak_mem_gb"),
        flag.alias("flag"), (flag != "").alias("needs_inspection"),
    )


def ingest_errors(files: DataFrame) -> DataFrame:
    """``files(case_id, role, error)`` -> one user-readable class per failed file."""
    e = F.lower("error")
    kind = (
        F.when(e.contains("no such file") | e.contains("not found") | e.contains("missing"), "missing_file")
        .when(e.contains("file too small") | e.contains("unable to determine"), "unreadable_volume")
        .when(e.contains("different sizes"), "size_mismatch")
        .when(e.contains("not co-registered"), "not_co_registered")
        .when(e.contains("unsupported"), "unsupported_type")
        .when(e.contains("could not read"), "unreadable_volume")
        .when(e.contains("empty"), "empty_mask")
        .otherwise("other")
    )
    return files.where(F.col("error").isNotNull()).select("case_id", "role", kind.alias("kind"), F.substring_index("error", "\n", 1).alias("message"))


def check_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Full outer comparison of listed and found files: ``ok``, ``missing``, ``unlisted``, ``bytes``, ``sha256``.

    ``files(path, bytes, sha256)`` comes from ``sources.tables.file_hashes``.
    """
    f = files.select("path", F.col("bytes").alias("f_bytes"), F.col("sha256").alias("f_sha"))
    status = (
        F.when(F.col("f_sha").isNull(), "missing")
        .when(F.col("sha256").isNull(), "unlisted")
        .when(F.col("bytes").isNotNull() & (F.col("bytes") != F.col("f_bytes")), "bytes")
        .when(F.lower("sha256") != F.col("f_sha"), "sha256")
        .otherwise("ok")
    )
    return manifest.join(f, "path", "full").select("path", status.alias("status"))


def miss_mechanism(points: DataFrame) -> DataFrame:
    """Why a reference has no prediction, from looked-up labels.

    Needs ``instance_label`` and ``marker_label`` at the origin (null or 0 for none) and
    ``nearest_patch_mm``.
    """
    return points.withColumn(
        "mechanism",
        F.when(F.coalesce("instance_label", F.lit(0)) > 0, "covered_by_instance")
        .when(F.coalesce("marker_label", F.lit(0)) > 0, "marker_not_grown")
        .when(F.col("nearest_patch_mm") < 6.0, "patch_nearby")
        .otherwise("never_triggered"),
    )


