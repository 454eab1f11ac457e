"""Optional split of instances whose long contact feeds two opposing ridges (off by default)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import linalg as la
from lumenframe.operators import features, growth, lattice, ridge
from lumenframe.operators.percase import join_case
from lumenframe.operators.ranking import numbered
from lumenframe.params import DEFAULTS, Params
from lumenframe.session import cut

INST = features.INST
CELL = lattice.CELL
MAX_WALKS = 16  # fixed value: sampled walks per contact
MIN_WALK_MM = 2.5  # fixed value: shorter walks have no heading


def sampled_starts(contact: DataFrame, picks: int = MAX_WALKS) -> DataFrame:
    """Up to ``picks`` evenly spaced contact cells per instance in scan order."""
    n = contact.groupBy(*INST).agg(F.count(F.lit(1)).alias("n"))
    k = F.least(F.col("n"), F.lit(picks))
    at = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * (F.col("n") - 1) / F.greatest(k - 1, F.lit(1))) + 1)
    want = n.where(F.col("n") >= 6).select(*INST, F.explode(F.array_distinct(at)).alias("__n"))
    ranked = numbered(contact.select(*INST, "z", "y", "x"), INST, [F.col("z"), F.col("y"), F.col("x")], "__n")
    hit = ranked.join(want, [*INST, "__n"])
    return hit.select(*INST, F.col("__n").cast("int").alias("walk_id"), *[F.col(c).cast("double").alias(f"w{c}") for c in "zyx"])


def ridge_clusters(contact: DataFrame, lumen: DataFrame, spacing: DataFrame, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """``(case_id, inst_id, cluster_cos)`` of contacts with two opposing ridge clusters, and their labelled starts."""
    starts = cut(sampled_starts(contact), "split-starts")
    walks = ridge.walk_summary(ridge.ridge_walks(lumen, starts, spacing, p), spacing, p)
    d = walks.where(F.col("walk_mm") >= MIN_WALK_MM).select(*INST, "walk_id", "head_z", "head_y", "head_x")
    d = cut(d.join(starts, [*INST, "walk_id"]), "split-dirs")
    enough = d.groupBy(*INST).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= p.split_min_walks).select(*INST)
    d = d.join(enough, INST)
    heads = ("head_z", "head_y", "head_x")
    # at most sixteen walks per instance, so at most 120 pairs
    a = d.select(*INST, F.col("walk_id").alias("i"), *[F.col(h).alias(f"a_{h}") for h in heads])
    b = d.select(*INST, F.col("walk_id").alias("j"), *[F.col(h).alias(f"b_{h}") for h in heads])
    pair = a.join(b, INST).where(F.col("i") < F.col("j"))
    cos = la.dot([F.col(f"a_{h}") for h in heads], [F.col(f"b_{h}") for h in heads])
    poles = pair.groupBy(*INST).agg(
        F.min_by(F.struct(*[F.col(f"a_{h}") for h in heads], *[F.col(f"b_{h}") for h in heads]), F.struct(cos.alias("c"), F.col("i"), F.col("j"))).alias("m")
    )
    lab = d.join(poles, INST)
    me = la.cols(*heads)
    side = F.when(la.dot(me, [F.col(f"m.a_{h}") for h in heads]) >= la.dot(me, [F.col(f"m.b_{h}") for h in heads]), 0).otherwise(1)
    lab = cut(lab.select(*INST, "walk_id", *heads, "wz", "wy", "wx", side.alias("side")), "split-sides")
    means = lab.groupBy(*INST).agg(
        *[F.count_if(F.col("side") == s).alias(f"n{s}") for s in (0, 1)],
        *[F.avg(F.when(F.col("side") == s, F.col(h))).alias(f"{h}{s}") for s in (0, 1) for h in heads],
    ).where(F.least("n0", "n1") >= p.split_min_cluster)
    u = [[F.col(f"{h}{s}") / (la.norm([F.col(f"{k}{s}") for k in heads]) + 1e-9) for h in heads] for s in (0, 1)]
    means = means.withColumn("cluster_cos", la.clip(la.dot(u[0], u[1]), -1.0, 1.0)).where(F.col("cluster_cos") < p.split_max_cosine)
    good = means.select(*INST, "cluster_cos")
    return good, lab.join(good.select(*INST), INST, "left_semi")


def directional_split(inst: DataFrame, contact: DataFrame, parent: DataFrame, spacing: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Cells of accepted splits with ``part`` 1 or 2: ``(case_id, inst_id, z, y, x, part)``."""
    wide = features.contact_spread(contact, spacing).where(F.col("contact_spread_mm") >= p.split_min_spread_mm).select(*INST)
    wide = cut(wide, "split-wide")
    c, cells = contact.join(wide, INST, "left_semi"), inst.join(wide, INST, "left_semi")
    _, lab = ridge_clusters(c, cells, spacing, p)
    near = join_case(c.select(*INST, "z", "y", "x").join(lab.select(*INST, "walk_id", "side", "wz", "wy", "wx"), INST), spacing, "sz", "sy", "sx")
    gap = [(F.col(k) - F.col(f"w{k}")) * F.col(f"s{k}") for k in "zyx"]
    marks = near.groupBy(*INST, "z", "y", "x").agg(F.min_by("side", F.struct(la.dot(gap, gap).alias("d"), F.col("walk_id"))).alias("side"))
    marks = cut(marks.withColumn("label", F.col("side") + 1), "split-marks")
    return _regrow(marks, cells, parent, spacing, min_marks=3, min_cells=8, need_contact=True)


def contact_patch_split(inst: DataFrame, contact: DataFrame, parent: DataFrame, spacing: DataFrame, merge_mm: float, near_mm: float = 5.0, far_mm: float = 12.0) -> DataFrame:
    """Split of instances whose contact is exactly two patches 5 to 12 mm apart, three cells or more each."""
    from lumenframe.operators import components

    own = _as_cases(contact)
    sp = _spacing_of(contact, spacing)
    marks = cut(components.merged_markers(own, sp, merge_mm), "patch-marks")
    mid = join_case(marks.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "zyx"]), sp, "sz", "sy", "sx")
    two = mid.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("k"), F.min("n").alias("least"), *[(F.max_by(F.col(c), "label") - F.min_by(F.col(c), "label")).alias(f"d{c}") for c in "zyx"], *[F.first(f"s{c}").alias(f"s{c}") for c in "zyx"]
    )
    sep = la.norm([F.col(f"d{c}") * F.col(f"s{c}") for c in "zyx"])
    two = two.where((F.col("k") == 2) & (F.col("least") >= 3) & sep.between(near_mm, far_mm)).select("case_id")
    marks = _apart(marks.join(two, "case_id", "left_semi").select("case_id", "z", "y", "x", "label"), inst)
    return _regrow(marks, inst.join(_apart(two, inst), INST, "left_semi"), parent, spacing, min_marks=1, min_cells=1, need_contact=False)


def _as_cases(cells: DataFrame) -> DataFrame:
    """Each instance as a case of its own, so that lattice operators keep instances apart."""
    return cells.select(F.to_json(F.struct(*INST)).alias("case_id"), "z", "y", "x")


def _apart(df: DataFrame, like: DataFrame) -> DataFrame:
    """Turns the key of ``_as_cases`` back into case and instance columns."""
    kinds = ", ".join(f"{c} {like.schema[c].dataType.simpleString()}" for c in INST)
    rest = [c for c in df.columns if c != "case_id"]
    return df.select(F.from_json("case_id", kinds).alias("__k"), *rest).select("__k.*", *rest)


def _spacing_of(cells: DataFrame, spacing: DataFrame) -> DataFrame:
    own = join_case(cells.select(*INST).distinct(), spacing, "sz", "sy", "sx")
    return cut(own.select(F.to_json(F.struct(*INST)).alias("case_id"), "sz", "sy", "sx"), "split-spacing")


def _regrow(marks: DataFrame, cells: DataFrame, parent: DataFrame, spacing: DataFrame, min_marks: int, min_cells: int, need_contact: bool) -> DataFrame:
    if marks.isEmpty():
        return cells.select(*INST, "z", "y", "x", F.lit(0).alias("part")).limit(0)
    keyed = marks.select(F.to_json(F.struct(*INST)).alias("case_id"), "z", "y", "x", "label")
    grown = growth.grow(keyed, _as_cases(cells), _spacing_of(cells, spacing))
    parts = cut(_apart(grown.select("case_id", "z", "y", "x", F.col("label").cast("int").alias("part")), cells), "split-parts")
    n_marks = marks.groupBy(*INST, F.col("label").cast("int").alias("part")).agg(F.count(F.lit(1)).alias("m"))
    n_cells = parts.groupBy(*INST, "part").agg(F.count(F.lit(1)).alias("n"))
    ok = n_cells.join(n_marks, [*INST, "part"]).where((F.col("n") >= min_cells) & (F.col("m") >= min_marks))
    if need_contact:
        ok = ok.join(lattice.contact_cells(parts, parent).select(*INST, "part").distinct(), [*INST, "part"], "left_semi")
    both = ok.groupBy(*INST).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == 2).select(*INST)
    return parts.join(both, INST, "left_semi")


def replace_split(cands: DataFrame, rejected: DataFrame, inst: DataFrame, maps, cases: DataFrame, p: Params, build: Callable) -> tuple[DataFrame, DataFrame]:
    """Replaces a split instance by its two children when both survive the candidate rules.

    Children get new instance numbers above the existing ones, in (instance, part) order.
    """
    parent = maps.cells.where("parent").select(*CELL)
    contact = lattice.contact_cells(inst, parent)
    parts = directional_split(inst, contact, parent, maps.grid, p)
    parts = cut(parts, "split-accepted")
    cands = cands.withColumn("split_derived", F.lit(False))
    if parts.isEmpty():
        return cands, rejected
    top = inst.groupBy("case_id").agg(F.max("inst_id").alias("__top"))
    child = inst.join(parts, [*INST, "z", "y", "x"]).join(top, "case_id")
    child = cut(child.withColumn("__child", F.col("__top") + F.col("inst_id") * 2 + F.col("part")), "split-children")
    built, lost = build(child.withColumnRenamed("inst_id", "__from").withColumnRenamed("__child", "inst_id").select(*inst.columns), maps, cases, p)
    origin = child.select("case_id", F.col("__child").alias("inst_id"), F.col("inst_id").alias("__from")).distinct()
    pairs = built.select(*INST).join(origin, INST)
    whole = pairs.groupBy("case_id", "__from").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == 2).select("case_id", F.col("__from").alias("inst_id"))
    ok = origin.join(whole.withColumnRenamed("inst_id", "__from"), ["case_id", "__from"], "left_semi").select(*INST)
    children = built.join(ok, INST, "left_semi").withColumn("split_derived", F.lit(True))
    out = cands.join(whole, INST, "left_anti").unionByName(children)
    return cut(out, "split-candidates"), rejected.join(whole, INST, "left_anti").unionByName(lost)
