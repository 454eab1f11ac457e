"""Ridge walks from an origin into a lumen, and what is read off the walked path.

A walk can't leave the box that its greatest length spans around its start, so every walk is taken to its end inside
one task: starts go to their brick, and cells of the lumen to the bricks whose walks can touch them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from lumenframe.functions import geometry as geo
from lumenframe.functions import linalg as la
from lumenframe.operators.bricks import EDGE, KEY, LAYOUT, brick_of, in_reach, layout, spread
from lumenframe.operators.percase import case_joiner, join_case
from lumenframe.params import DEFAULTS, Params
from lumenframe.session import known_rows

WALK = ["case_id", "inst_id", "walk_id"]
_AT = ["z", "y", "x"]
#: Walks of a brick that advance together.
HELD_WALKS = 20_000

# Weights of the walk score (gain in distance, depth, length), the loss of distance that a step may
# have, and the fork test (share of the shortest path, difference of scores, difference of distances).
GAIN, DEEP, LONG, MAX_LOSS = 1.6, 0.5, 0.05, 0.35
FORK_FROM, FORK_SCORES, FORK_LEVELS = 0.6, 0.25, 1.2
EXTRA_STEPS, LEAST_STEP_MM = 8, 0.3


class _Lumen:
    """Cells of one brick and its halo, looked up by instance and place. A cell given twice counts once, with its greatest values."""

    def __init__(self, cells: pa.Table):
        self.names = pc.unique(cells["inst_id"])
        at = _places(cells)
        self.low = at.min(axis=0) - 2
        self.shape = at.max(axis=0) - self.low + 3
        level, depth = (_floats(cells[c]) for c in ("dist_mm", "depth_mm"))
        key = self.key(self.codes(cells), at)
        order = np.lexsort((depth, level, key))
        order = order[key[order] >= 0]
        order = order[np.r_[key[order][1:] != key[order][:-1], True][: len(order)]]
        self.keys, self.level, self.depth = key[order], level[order], depth[order]

    def codes(self, rows: pa.Table) -> np.ndarray:
        return pc.fill_null(pc.index_in(rows["inst_id"], value_set=self.names, skip_nulls=True), -1).to_numpy().astype(np.int64)

    def key(self, inst: np.ndarray, at: np.ndarray) -> np.ndarray:
        q = at - self.low
        inside = ((q >= 0) & (q < self.shape)).all(axis=-1) & (inst >= 0)
        return np.where(inside, ((inst * self.shape[0] + q[..., 0]) * self.shape[1] + q[..., 1]) * self.shape[2] + q[..., 2], -1)

    def find(self, inst: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether cells are there, their level and their depth."""
        key = self.key(inst, at)
        ix = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        met = (self.keys[ix] == key) & (key >= 0)
        return met, np.where(met, self.level[ix], np.nan), np.where(met, self.depth[ix], np.nan)


_NOWHERE = -(1 << 24)


def _places(rows: pa.Table) -> np.ndarray:
    return np.stack([pc.fill_null(rows[c], _NOWHERE).to_numpy().astype(np.int64) for c in _AT], -1)


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column.cast(pa.float64()), float("nan")).to_numpy()


def _walked(lumen: _Lumen | None, inst: np.ndarray, start: np.ndarray, sp: np.ndarray, most: int, p: Params) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    """Steps of all walks of a brick: per step the walks that take it, their cells and lengths; and which of them fork."""
    n = len(start)
    pos, total, fork = start.copy(), np.zeros(n), np.zeros(n, bool)
    if lumen is None:
        return [(np.arange(n), pos, total)], fork
    steps = np.array(geo.neighbour_offsets(26))
    length = np.sqrt((steps[:, 0] * sp[0]) ** 2 + (steps[:, 1] * sp[1]) ** 2 + (steps[:, 2] * sp[2]) ** 2)
    # the start's own cell, else its first neighbour in scan order
    home = np.concatenate([np.zeros((1, 3), np.int64), steps])
    met, found, _ = lumen.find(inst[:, None], start[:, None, :] + home)
    first, alive = met.argmax(axis=1), met.any(axis=1)
    pos[alive] += home[first[alive]]
    level = found[np.arange(n), first]
    out, path = [(np.arange(n), pos.copy(), total.copy())], [pos.copy()]
    live = np.flatnonzero(alive)
    while len(live):
        to = pos[live, None, :] + steps
        met, there, depth = lumen.find(inst[live, None], to)
        free = met & (there >= level[live, None] - MAX_LOSS)
        for was in path:  # some dozens at most
            free &= (to != was[live, None, :]).any(axis=2)
        score = GAIN * (there - level[live, None]) + DEEP * depth - LONG * length
        # a cell without a depth comes behind all others; ties go to the greatest z, y, x
        rank = np.where(free, np.where(np.isnan(score), -np.finfo(float).max, score), -np.inf)
        last = len(steps) - 1
        one = last - rank[:, ::-1].argmax(axis=1)
        at = np.arange(len(live))
        any_ = free[at, one]
        left = rank.copy()
        left[at, one] = -np.inf
        two = last - left[:, ::-1].argmax(axis=1)
        split = any_ & (left[at, two] > -np.inf) & (total[live] >= FORK_FROM * p.min_path_mm)
        split &= (score[at, one] - score[at, two] < FORK_SCORES) & (np.abs(there[at, one] - there[at, two]) < FORK_LEVELS)
        fork[live[split]] = True
        goes = any_ & ~split
        walks = live[goes]
        pos[walks] = to[at[goes], one[goes]]
        level[walks] = there[at[goes], one[goes]]
        total[walks] += length[one[goes]]
        out.append((walks, pos[walks], total[walks]))
        live = walks[(total[walks] < p.max_trace_mm) & (len(path) < most)]
        path.append(pos.copy())
    return out, fork


def _walk_brick(p: Params, schema: pa.Schema):
    def run(starts: pa.Table, cells: pa.Table) -> pa.Table:
        lumen = _Lumen(cells) if len(cells) and len(starts) else None
        parts = []
        for i in range(0, len(starts), HELD_WALKS):
            rows = starts.slice(i, HELD_WALKS)
            at, sp = _places(rows), np.array([rows[f"s{c}"][0].as_py() for c in "zyx"], float)
            inst = lumen.codes(rows) if lumen else np.zeros(len(rows), np.int64)
            taken, fork = _walked(lumen, inst, at, sp, int(rows["most"][0].as_py()), p)
            walk = np.concatenate([t[0] for t in taken])
            step = np.repeat(np.arange(len(taken)), [len(t[0]) for t in taken])
            place, total = np.concatenate([t[1] for t in taken]), np.concatenate([t[2] for t in taken])
            ends = np.zeros(len(rows), np.int64)
            np.maximum.at(ends, walk, step)
            none = at[walk] == _NOWHERE
            columns = [*[rows[c].combine_chunks().take(pa.array(walk)) for c in WALK], pa.array(step)]
            columns += [pa.array(place[:, k], mask=none[:, k]) for k in range(3)]
            columns += [pa.array(total), pa.array(fork[walk] & (step == ends[walk]))]
            parts.append(pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def ridge_walks(lumen: DataFrame, starts: DataFrame, spacing: DataFrame, p: Params = DEFAULTS, edge: int = EDGE) -> DataFrame:
    """``lumen(case_id, inst_id, z, y, x, dist_mm, depth_mm)`` and ``starts(case_id, inst_id,
    walk_id, wz, wy, wx)`` -> path rows ``(walk key, step, z, y, x, cum_mm, fork)``.

    A step goes to the neighbour with the best score that the walk hasn't been to (ties: the greatest z, y, x); a walk ends
    at a fork, without a neighbour, or at its greatest length. Every start yields at least its own point.
    """
    most = F.floor(p.max_trace_mm / F.greatest(F.least("sz", "sy", "sx"), F.lit(LEAST_STEP_MM))).cast("int") + EXTRA_STEPS
    # one step to the first cell, the walk, and a last step or look beyond
    reach = [F.least(F.ceil(p.max_trace_mm / F.col(f"s{c}")).cast("int"), F.col("most")) + 3 for c in "zyx"]
    bricks = layout(spacing, edge).select("case_id", "sz", "sy", "sx", *LAYOUT, most.alias("most"))
    attach = case_joiner(bricks.select("*", *[r.alias(f"n{c}") for r, c in zip(reach, "zyx")]))
    s = attach(starts.select(*WALK, *[F.rint(f"w{c}").cast("int").alias(c) for c in "zyx"]))
    s = s.withColumns({f"b{a}": brick_of(a) for a in "zyx"})
    c = attach(lumen.select("case_id", "inst_id", *_AT, "dist_mm", "depth_mm").dropna(subset=["case_id", "inst_id", *_AT]))
    c = in_reach(c, {a: F.col(f"n{a}") for a in "zyx"})
    s = s.select(*[F.col(k).alias(k) for k in (*KEY, "inst_id", "walk_id", *_AT, "sz", "sy", "sx", "most")])
    c = c.select(*[F.col(k).alias(k) for k in (*KEY, "inst_id", *_AT, "dist_mm", "depth_mm")])
    kinds = {f.name: f.dataType for f in s.schema}
    shape = StructType([StructField(k, kinds[k]) for k in WALK] + [StructField(k, IntegerType()) for k in ("step", *_AT)] + [StructField("cum_mm", DoubleType()), StructField("fork", BooleanType())])
    rows = known_rows(lumen)
    return spread(s, KEY, rows).groupBy(*KEY).cogroup(spread(c, KEY, rows).groupBy(*KEY)).applyInArrow(_walk_brick(p, to_arrow_schema(shape)), shape)


def walk_summary(paths: DataFrame, spacing: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Length, seed, seed validity, fork mark and outward heading of each walk.

    The seed is the first point at or beyond the minimum length, else the end of the walk, which is
    valid from 85 % of that length. The heading is the main axis of the first ~5 mm (chord below
    four points), pointing along the path.
    """
    j = join_case(paths, spacing, "sz", "sy", "sx")
    mm = j.withColumns({"pz": F.col("z") * F.col("sz"), "py": F.col("y") * F.col("sy"), "px": F.col("x") * F.col("sx")})
    # a walk has a few dozen points at most
    before = W.partitionBy(*WALK).orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    mm = mm.withColumn("__used", F.coalesce(F.max("cum_mm").over(before), F.lit(0.0)) < 5.0)
    pt = F.struct("pz", "py", "px")
    used = F.col("__used")
    covs = []
    for name, a, b in (("aa", "pz", "pz"), ("bb", "py", "py"), ("cc", "px", "px"), ("ab", "pz", "py"), ("ac", "pz", "px"), ("bc", "py", "px")):
        covs.append(F.covar_pop(F.when(used, F.col(a)), F.when(used, F.col(b))).alias(f"m_{name}"))
    reached = F.when(F.col("cum_mm") >= p.min_path_mm, F.col("step"))
    g = mm.groupBy(*WALK).agg(
        F.max("cum_mm").alias("walk_mm"),
        F.bool_or("fork").alias("fork"),
        F.min(reached).alias("__hit"),
        F.min_by(F.struct("z", "y", "x"), reached).alias("__at"),
        F.max_by(F.struct("z", "y", "x"), "step").alias("__end"),
        F.count_if(used).alias("__n"),
        F.min_by(pt, "step").alias("__p0"),
        F.max_by(pt, F.when(used, F.col("step"))).alias("__p1"),
        *covs,
    )
    g = la.with_main_axis(la.with_eigenvalues(g, "m", "__e"), "m", "__e1", "__a")
    chord = [F.col(f"__p1.{c}") - F.col(f"__p0.{c}") for c in ("pz", "py", "px")]
    axis = [F.col(f"__a_{c}") for c in "abc"]
    flip = F.when(la.dot(axis, chord) < 0, -1.0).otherwise(1.0)
    unit = la.unit_or(chord, (1.0, 0.0, 0.0))
    heads = [F.when(F.col("__n") >= 4, a * flip).otherwise(u) for a, u in zip(axis, unit)]
    hit = F.col("__hit").isNotNull()
    seed = F.when(hit, F.col("__at")).otherwise(F.col("__end"))
    return g.select(
        *WALK,
        "walk_mm",
        "fork",
        *[seed[c].cast("double").alias(f"seed_{c}") for c in "zyx"],
        (hit | ((F.col("walk_mm") > 0) & (F.col("walk_mm") >= 0.85 * p.min_path_mm))).alias("seed_ok"),
        *[h.alias(f"head_{c}") for h, c in zip(heads, "zyx")],
    )
