"""Point lookups and image views as tables: samples, boxes, planes, slabs, display windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.bricks import EDGE, KEY, spread
from lumenframe.operators.lattice import CELL
from lumenframe.operators.percase import case_joiner, exact_quantiles, join_case
from lumenframe.session import cut, known_rows, unsent

HELD = 2_000_000  # values of boxes that a task looks at together


def sample_at(points: DataFrame, at: Sequence[str], cells: DataFrame, values: Sequence[str]) -> DataFrame:
    """Values of the nearest cell of each point; null outside the table."""
    p = points.withColumns({f"__{c}": F.rint(F.col(a)).cast("int") for c, a in zip("zyx", at)})
    v = cells.select("case_id", *[F.col(c).alias(f"__{c}") for c in "zyx"], *values)
    return p.join(v, ["case_id", "__z", "__y", "__x"], "left").drop("__z", "__y", "__x")


def _reach(spacing: DataFrame, radius_mm: float) -> DataFrame:
    """Cells that a box reaches from its middle along each axis, per case."""
    return spacing.select("case_id", *[F.greatest(F.lit(1), F.ceil(F.lit(radius_mm) / F.col(f"s{c}")).cast("int")).alias(f"n{c}") for c in "zyx"])


def _middles(points: DataFrame, ident: str, at: Sequence[str]) -> DataFrame:
    mid = {c: F.rint(F.col(a)).cast("int") for c, a in zip("zyx", at)}
    return points.select("case_id", ident, *[m.alias(c) for c, m in mid.items()]).dropna(subset=["case_id", "z", "y", "x"])


def _repeated(points: DataFrame, ident: str) -> tuple[DataFrame, DataFrame | None]:
    """Points whose id is theirs alone, and the others, which share one box result; None when there are none."""
    copies = points.groupBy("case_id", F.col(ident).alias("__id")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    copies = cut(copies.withColumnRenamed("case_id", "__case"), "box-repeated")
    if not known_rows(copies):
        return points, None
    same = (F.col("case_id") == F.col("__case")) & F.col(ident).eqNullSafe(F.col("__id"))
    return points.join(copies, same, "left_anti"), points.join(copies, same, "left_semi")


def _probes(middles: DataFrame, spacing: DataFrame, radius_mm: float) -> DataFrame:
    """A row per cell of every box."""
    p = join_case(middles, _reach(spacing, radius_mm))
    for c in "zyx":
        p = p.withColumn(c, F.explode(F.sequence(F.col(c) - F.col(f"n{c}"), F.col(c) + F.col(f"n{c}"))))
    return unsent(p.drop("nz", "ny", "nx"))


def _over_boxes(
    middles: DataFrame, ident: str, cells: DataFrame, spacing: DataFrame, radius_mm: float,
    fold: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], out: str, edge: int = EDGE,
) -> DataFrame:
    """``fold`` of the values ``__v`` in the box around each point, without a row per cell of a box.

    A point goes to the brick of its middle, a cell to the bricks whose points can reach it; boxes exist inside the task
    only, ``HELD`` values at a time. ``fold`` gets a row of values per point, sorted, nulls last, and the numbers of
    cells and of values that aren't null; ``out`` is the schema of what it returns.
    """
    attach = case_joiner(_reach(spacing, radius_mm), "nz", "ny", "nx")
    p = attach(middles).withColumns({f"b{a}": F.floor(F.col(a) / edge).cast("int") for a in "zyx"})
    c = attach(cells.select(*CELL, "__v"))
    for a in "zyx":
        lo, hi = [F.floor((F.col(a) + e * F.col(f"n{a}")) / edge).cast("int") for e in (-1, 1)]
        c = c.withColumn(f"b{a}", F.explode(F.sequence(lo, hi)))
    c = c.select(*[F.col(k).alias(k) for k in (*KEY, *"zyx", "__v")])  # names of its own, as both sides may come from one table
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}
    names = [x.split()[0] for x in out.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.select(["case_id", ident])
        if not len(left) or not len(right):
            return _with(ids.slice(0, 0), names, [np.zeros(0, np.int64 if "bigint" in x else float) for x in out.split(", ")], None)
        n = [int(left[f"n{a}"][0].as_py()) for a in "zyx"]
        steps = np.stack(np.meshgrid(*[np.arange(-k, k + 1) for k in n], indexing="ij"), -1).reshape(-1, 3)
        mid, at = (np.stack([t[a].to_numpy().astype(np.int64) for a in "zyx"], 1) for t in (left, right))
        low = at.min(axis=0)
        shape = at.max(axis=0) - low + 1
        address = np.ravel_multi_index(tuple((at - low).T), shape)
        order = np.argsort(address, kind="stable")
        held = np.bincount(address, minlength=int(shape.prod()))
        first = np.cumsum(held) - held
        null = right["__v"].is_null().to_numpy()[order]
        value = right["__v"].fill_null(float("nan")).to_numpy()[order]
        found, rows = [], []
        for k in range(0, len(mid), max(1, HELD // len(steps))):
            q = mid[k : k + max(1, HELD // len(steps)), None, :] + steps - low
            inside = ((q >= 0) & (q < shape)).all(axis=2)
            a = np.where(inside, (q[..., 0] * shape[1] + q[..., 1]) * shape[2] + q[..., 2], 0)
            met = np.where(inside, held[a], 0)
            n_cells = met.sum(axis=1)
            here = max(1, HELD // max(1, int(n_cells.max())))
            for i in range(0, len(a), here):
                total, m = n_cells[i : i + here], met[i : i + here].ravel()
                ix = np.repeat(first[a[i : i + here]].ravel() - (np.cumsum(m) - m), m) + np.arange(m.sum())
                row = np.repeat(np.arange(len(total)), total)
                block = np.full((len(total), max(1, int(total.max()))), np.nan)
                block[row, np.arange(len(ix)) - np.repeat(np.cumsum(total) - total, total)] = value[ix]
                block.sort(axis=1)  # NaN is the greatest value, and behind the known ones there is nothing else
                found.append(fold(block, total, np.bincount(row[~null[ix]], minlength=len(total))))
                rows.append(total > 0)
        return _with(ids, names, [np.ma.concatenate(x) for x in zip(*found)], np.concatenate(rows))

    rows = known_rows(cells)
    schema = f"case_id {kinds['case_id']}, {ident} {kinds[ident]}, {out}"
    return spread(p, KEY, rows).groupBy(*KEY).cogroup(spread(c, KEY, rows).groupBy(*KEY)).applyInArrow(run, schema)


def _with(ids: pa.Table, names: list[str], columns: list[np.ndarray], keep: np.ndarray | None) -> pa.Table:
    for name, values in zip(names, columns, strict=True):
        mask = np.ma.getmaskarray(values)
        ids = ids.append_column(name, pa.array(np.ma.getdata(values), mask=mask))
    return ids if keep is None else ids.filter(pa.array(keep))


def _order_statistics(block: np.ndarray, total: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
    at, none = np.arange(len(block)), known == 0
    middle = 0.5 * np.maximum(known - 1, 0)
    low, high = np.floor(middle).astype(int), np.ceil(middle).astype(int)
    a, b = block[at, low], block[at, high]
    with np.errstate(invalid="ignore"):
        p50 = np.where((low == high) | (a == b), a, (high - middle) * a + (middle - low) * b)
    return [total.astype(np.int64), *[np.ma.array(v, mask=none) for v in (block[:, 0], p50, block[at, np.maximum(known - 1, 0)])]]


def _shares(block: np.ndarray, total: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
    hits = (block == 1.0).sum(axis=1)
    return [hits.astype(np.int64), np.ma.array(hits / np.maximum(known, 1), mask=known == 0)]


def box_stats(points: DataFrame, ident: str, at: Sequence[str], cells: DataFrame, value: str, spacing: DataFrame, radius_mm: float = 3.0) -> DataFrame:
    """Minimum, median and maximum of ``value`` over the box around each point.

    Every point looks at a box whose size is fixed by the radius and the spacing.
    """
    valued = unsent(cells.select(*CELL, F.col(value).cast("double").alias("__v")), known_rows(cells))
    single, shared = _repeated(_middles(points, ident, at), ident)
    found = _over_boxes(single, ident, valued, spacing, radius_mm, _order_statistics, "n bigint, min double, p50 double, max double")
    if shared is None:
        return found
    return found.unionByName(_probes(shared, spacing, radius_mm).join(valued, CELL).groupBy("case_id", ident).agg(
        F.count(F.lit(1)).alias("n"), F.min("__v").alias("min"), F.percentile("__v", 0.5).alias("p50"), F.max("__v").alias("max")
    ))


def box_share(points: DataFrame, ident: str, at: Sequence[str], cells: DataFrame, mask: str, spacing: DataFrame, radius_mm: float = 3.0) -> DataFrame:
    """Count and fraction of mask cells in the box around each point."""
    valued = unsent(cells.select(*CELL, F.col(mask).cast("double").alias("__v")), known_rows(cells))
    single, shared = _repeated(_middles(points, ident, at), ident)
    found = _over_boxes(single, ident, valued, spacing, radius_mm, _shares, "sum bigint, frac double")
    if shared is None:
        return found
    return found.unionByName(_probes(shared, spacing, radius_mm).join(valued, CELL).groupBy("case_id", ident).agg(F.count_if(F.col("__v") == 1.0).alias("sum"), F.avg("__v").alias("frac")))


def plane_crops(points: DataFrame, ident: str, at: Sequence[str], cells: DataFrame, half: int, values: Sequence[str]) -> DataFrame:
    """Axial, coronal and sagittal crops of ``half`` cells around each point as (view, u, v) rows."""
    p = points.select("case_id", ident, *[F.rint(F.col(a)).cast("int").alias(f"m{c}") for c, a in zip("zyx", at)])
    run = lambda c: F.sequence(F.col(f"m{c}") - half, F.col(f"m{c}") + half)
    parts = []
    # Names of the three views.
    for view, flat, (v, u) in (("axial", "z", ("y", "x")), ("coronal", "y", ("z", "x")), ("sagittal", "x", ("z", "y"))):
        q = p.withColumn(flat, F.col(f"m{flat}")).withColumn(v, F.explode(run(v))).withColumn(u, F.explode(run(u)))
        parts.append(q.select("case_id", ident, F.lit(view).alias("view"), "z", "y", "x", (F.col(u) - F.col(f"m{u}")).alias("u"), (F.col(v) - F.col(f"m{v}")).alias("v")))
    probe = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return unsent(probe).join(cells.select(*CELL, *values), CELL).select("case_id", ident, "view", "u", "v", *values)


def slab_maximum(points: DataFrame, ident: str, at_z: str, cells: DataFrame, half: int) -> DataFrame:
    """Maximum intensity and parent mark over ``half`` slices on both sides of each point's slice."""
    mid = F.rint(F.col(at_z)).cast("int")
    slices = points.select("case_id", ident, F.explode(F.sequence(mid - half, mid + half)).alias("z"))
    j = cells.select(*CELL, "hu", "parent").join(slices, ["case_id", "z"])
    return j.groupBy("case_id", ident, "y", "x").agg(F.max("hu").alias("mip"), F.bool_or("parent").alias("parent"))


def display_window(voxels: DataFrame) -> DataFrame:
    """Display range of each case: 5th percentile - 80 to 95th percentile + 80 of the parent."""
    # Percentiles and margin.
    q = exact_quantiles(voxels.where("parent").select("case_id", "hu"), ["case_id"], "hu", [0.05, 0.95], ["a", "b"])
    return q.select("case_id", (F.col("a") - 80.0).alias("lo"), (F.col("b") + 80.0).alias("hi"))


def windowed(value: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest((value - lo) / F.greatest(hi - lo, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))


def thinned_surface(surface: DataFrame, limit: int = 25_000) -> DataFrame:
    """Surface cells for display; cases above ``limit`` cells keep every second cell per axis."""
    n = surface.groupBy("case_id").agg(F.count(F.lit(1)).alias("__n"))
    even = (F.col("z") % 2 == 0) & (F.col("y") % 2 == 0) & (F.col("x") % 2 == 0)
    return join_case(surface, n).where((F.col("__n") <= limit) | even).drop("__n")
