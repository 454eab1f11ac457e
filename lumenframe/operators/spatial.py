"""Distance joins inside a case: all pairs within a radius, and exact nearest neighbours.

Both run as equi-joins on a spatial hash cell, so Spark never falls back to comparing every pair of
a case. The fullest cell is counted first; when it is crowded, such cells are cut into blocks on
both sides before the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenframe.functions import linalg as la
from lumenframe.session import cut, known_rows, unsent

CELL = ("__cx", "__cy", "__cz")
# rows of one side of one hash cell that a single join key may carry
BLOCK_ROWS = 4096


def _cell(xyz: Sequence[str], size: float | Column) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("long").alias(k) for c, k in zip(xyz, CELL)]


def _around(forward_only: bool = False) -> Column:
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    if forward_only:
        steps = [s for s in steps if s >= (0, 0, 0)]
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in steps])


def _blocked(probe: DataFrame, build: DataFrame, keys: list[str], block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Give both sides block numbers so that no join key holds more than ``block_rows`` per side.

    Cells at or below the limit keep block (0, 0) and are not copied. A crowded cell with p x b
    blocks sends each of its rows to the blocks of the other side only. The table of crowded cells
    has at most rows/block_rows entries.
    """

    def crowded(df: DataFrame, name: str) -> DataFrame:
        return (
            df.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("__n"))
            .where(F.col("__n") > block_rows)
            .select(*keys, F.ceil(F.col("__n") / block_rows).cast("int").alias(name))
        )

    cells = crowded(probe, "__pb").join(crowded(build, "__bb"), keys, "full")
    out = []
    for side, own, other in ((probe, "__pb", "__bb"), (build, "__bb", "__pb")):
        df = side.join(cells, keys, "left")
        mine = F.coalesce(F.col(own), F.lit(1))
        theirs = F.coalesce(F.col(other), F.lit(1))
        # hashed from the row itself, so a recomputed task puts every row in the same block
        spread = F.pmod(F.xxhash64(*side.columns), mine).cast("int")
        df = df.withColumn(f"{own}i", F.when(mine > 1, spread).otherwise(F.lit(0)))
        df = df.withColumn(f"{other}i", F.explode(F.sequence(F.lit(0), theirs - 1)))
        out.append(df.drop("__pb", "__bb"))
    return out[0], out[1]


def pairs_within(
    left: DataFrame,
    right: DataFrame,
    radius: float | Column,
    left_xyz: Sequence[str],
    right_xyz: Sequence[str],
    on: Sequence[str] = ("case_id",),
    distance: str = "dist_mm",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every (left, right) pair of a case at most ``radius`` apart.

    Apart from ``on``, the column names of the two sides must be disjoint. ``radius`` may be made of
    ``on`` columns, so that each case has its own.
    """
    on = list(on)
    probe = left.select("*", *_cell(left_xyz, radius)).withColumn("__o", F.explode(_around()))
    probe = _copied(probe.withColumns({k: F.col(k) + F.col(f"__o.{o}") for k, o in zip(CELL, "abc")}).drop("__o"), left, 27)
    build = right.select("*", *_cell(right_xyz, radius))
    return _join_cells(probe, build, on, left_xyz, right_xyz, radius, distance, block_rows)


def pairs_within_self(
    points: DataFrame,
    radius: float,
    xyz: Sequence[str],
    ident: str,
    on: Sequence[str] = ("case_id",),
    distance: str = "dist_mm",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every unordered pair of one table once, as columns ``*_i`` and ``*_j`` with id_i < id_j.

    Only the 14 cells at or after the own cell are probed; pairs inside one cell are kept in id
    order, pairs across cells are turned around when needed.
    """
    on = list(on)
    rest = [c for c in points.columns if c not in on]
    a = points.select(*on, *[F.col(c).alias(f"{c}_i") for c in rest])
    b = points.select(*on, *[F.col(c).alias(f"{c}_j") for c in rest])
    axyz, bxyz = [f"{c}_i" for c in xyz], [f"{c}_j" for c in xyz]
    probe = a.select("*", *_cell(axyz, radius)).withColumn("__o", F.explode(_around(True)))
    same = (F.col("__o.a") == 0) & (F.col("__o.b") == 0) & (F.col("__o.c") == 0)
    probe = probe.withColumn("__same", same)
    probe = _copied(probe.withColumns({k: F.col(k) + F.col(f"__o.{o}") for k, o in zip(CELL, "abc")}).drop("__o"), points, 14)
    build = b.select("*", *_cell(bxyz, radius))
    pairs = _join_cells(probe, build, on, axyz, bxyz, radius, distance, block_rows)
    ordered = F.col(f"{ident}_i") < F.col(f"{ident}_j")
    pairs = pairs.where(~F.col("__same") | ordered)
    lo = [F.when(ordered, F.col(f"{c}_i")).otherwise(F.col(f"{c}_j")).alias(f"{c}_i") for c in rest]
    hi = [F.when(ordered, F.col(f"{c}_j")).otherwise(F.col(f"{c}_i")).alias(f"{c}_j") for c in rest]
    return pairs.select(*on, *lo, *hi, distance)


def _copied(probe: DataFrame, points: DataFrame, copies: int) -> DataFrame:
    """``probe``, which holds the rows of ``points`` so many times; Spark takes it for as small as the points."""
    rows = known_rows(points)
    return probe if rows is None else unsent(probe, copies * rows)


def _join_cells(probe, build, on, lxyz, rxyz, radius, distance, block_rows) -> DataFrame:
    keys = [*on, *CELL]
    crowd = build.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (crowd or 0) > block_rows:
        probe, build = _blocked(probe, build, keys, block_rows)
        keys = [*keys, "__pbi", "__bbi"]
    gap = la.dist(la.cols(*lxyz), la.cols(*rxyz))
    return (
        probe.join(build, keys)
        .withColumn(distance, gap)
        .where(F.col(distance) <= radius)
        .drop(*CELL, "__pbi", "__bbi")
    )


def nearest(
    left: DataFrame,
    right: DataFrame,
    left_id: Sequence[str],
    right_id: str,
    left_xyz: Sequence[str],
    right_xyz: Sequence[str],
    k: int = 1,
    on: Sequence[str] = ("case_id",),
    cutoff: float | None = None,
    distance: str = "dist_mm",
    first_radius: float | None = None,
) -> DataFrame:
    """The ``k`` nearest right rows of every left row (ties by ``right_id``), exactly.

    The search radius starts at what the density of the case suggests and doubles; a left row is
    finished once ``k`` neighbours lie inside the radius, because nothing outside it can be closer,
    or once the radius spans its case. Every case has its own radii, so neither a sparse case nor one
    far point makes the others' search wider or longer. A round reads only cases that still have
    open rows. Left rows with no right row are not returned, nor are rows without coordinates.
    """
    on = list(on)
    key = [*on, *left_id]
    # copies at one location: only the first k of them can ever be returned
    same_place = W.partitionBy(*on, *right_xyz).orderBy(right_id)
    right = right.withColumn("__copy", F.row_number().over(same_place)).where(F.col("__copy") <= k).drop("__copy")
    right = cut(right, "nearest-right")
    box = right.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(right_xyz)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(right_xyz)],
    )
    joined = left.select(*on, *left_xyz).join(right.select(*on).distinct(), on, "left_semi")
    span_left = joined.groupBy(*on).agg(
        *[F.min(c).alias(f"llo{i}") for i, c in enumerate(left_xyz)],
        *[F.max(c).alias(f"lhi{i}") for i, c in enumerate(left_xyz)],
    )
    both = box.join(span_left, on)
    reach = [F.greatest(F.col(f"hi{i}"), F.col(f"lhi{i}")) - F.least(F.col(f"lo{i}"), F.col(f"llo{i}")) for i in range(3)]
    side = [F.greatest(F.col(f"hi{i}") - F.col(f"lo{i}"), F.lit(1e-3)) for i in range(3)]
    pitch = F.pow(side[0] * side[1] * side[2] / F.col("n"), F.lit(1.0 / 3.0))
    far = F.greatest(la.norm(reach), F.lit(1e-6)) * (1 + 1e-9)
    far = far if cutoff is None else F.least(far, F.lit(float(cutoff)))
    first = pitch * (1.5 * k ** (1 / 3)) if first_radius is None else F.lit(float(first_radius))
    sizes = both.select(*on, far.alias("__far"), F.greatest(first, far / 4096).alias("__first"))
    sizes = cut(sizes.where(F.col("__far").isNotNull()), "nearest-sizes")
    build, pending = right.join(sizes, on), cut(left.join(sizes, on), "nearest-pending")

    done, turn = None, 0
    while True:
        reach = F.least(F.col("__first") * 2.0**turn, F.col("__far"))
        sides = [df.withColumn("__reach", reach).drop("__first") for df in (pending, build.join(pending.select(*on).distinct(), on, "left_semi"))]
        near = pairs_within(*sides, F.col("__reach"), left_xyz, right_xyz, [*on, "__far", "__reach"], distance)
        order = W.partitionBy(*key).orderBy(distance, right_id)
        near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        near = cut(near, "nearest-round")
        full = near.where(F.col("rank") == k).select(*key)
        last = F.col("__reach") >= F.col("__far")
        found = near.where(last).unionByName(near.where(~last).join(full, key, "left_semi")).drop("__far", "__reach")
        done = found if done is None else done.unionByName(found)
        pending = cut(pending.where(reach < F.col("__far")).join(full, key, "left_anti"), "nearest-pending")
        if pending.isEmpty():
            return done
        turn += 1
