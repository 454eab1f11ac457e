"""Exact Euclidean distance transforms by separable passes: bounded ones outwards, unbounded ones inwards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.bricks import EDGE, KEY, spread
from lumenframe.operators.lattice import CELL
from lumenframe.operators.percase import case_joiner
from lumenframe.session import known_rows, unsent

_AXES = ["z", "y", "x"]
BOX = ["z0", "z1", "y0", "y1", "x0", "x1"]


def distance_from(seeds: DataFrame, grid: DataFrame, radius_mm: float, edge: int = EDGE) -> DataFrame:
    """Squared distance to the nearest seed for every grid cell within ``radius_mm``.

    ``grid(case_id, sz, sy, sx, z0, z1, y0, y1, x0, x1)`` gives spacing and inclusive bounds. Seeds go to the bricks
    that they reach, nothing else is shuffled; three passes run inside the brick. Returns ``(case_id, z, y, x, d2)``.
    """
    reach = [(F.floor(F.lit(radius_mm) / F.col(f"s{c}")).cast("int") + 1).alias(f"n{c}") for c in "zyx"]
    rows = case_joiner(grid.select("case_id", "sz", "sy", "sx", *BOX, *reach))(seeds.select(*CELL).dropna())
    for a in "zyx":
        lo = F.floor(F.greatest(F.col(a) - F.col(f"n{a}"), F.col(f"{a}0")) / edge).cast("int")
        hi = F.floor(F.least(F.col(a) + F.col(f"n{a}"), F.col(f"{a}1")) / edge).cast("int")
        rows = rows.withColumn(f"b{a}", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    kind = seeds.schema["case_id"].dataType.simpleString()
    limit = radius_mm * radius_mm * (1 + 1e-12)

    def run(table: pa.Table) -> pa.Table:
        one = table.slice(0, 1).to_pylist()[0]
        low = np.array([max(one[f"b{a}"] * edge, one[f"{a}0"]) for a in "zyx"])
        high = np.array([min(one[f"b{a}"] * edge + edge - 1, one[f"{a}1"]) for a in "zyx"])
        halo = np.array([one[f"n{a}"] for a in "zyx"])
        at = np.stack([table[a].to_numpy().astype(np.int64) for a in "zyx"], 1) - (low - halo)
        shape = high - low + 1 + 2 * halo
        d2 = np.full(shape, np.inf)
        d2[tuple(at[((at >= 0) & (at < shape)).all(axis=1)].T)] = 0.0
        for axis, a in enumerate("zyx"):
            n, k, s = shape[axis] - 2 * halo[axis], halo[axis], one[f"s{a}"]
            part = lambda i: d2[tuple(slice(i, i + n) if d == axis else slice(None) for d in range(3))]  # noqa: B023, E731
            out = part(k).copy()
            for o in range(1, k + 1):
                step = (o * s) * (o * s)
                np.minimum(out, part(k - o) + step, out=out)
                np.minimum(out, part(k + o) + step, out=out)
            d2 = out
        near = d2 <= limit
        place = np.stack(np.nonzero(near), 1) + low
        case = pa.repeat(table["case_id"][0], len(place))
        return pa.table({"case_id": case, **{a: pa.array(place[:, i].astype(np.int32)) for i, a in enumerate("zyx")}, "d2": pa.array(d2[near])})

    found = spread(rows, KEY, known_rows(seeds)).groupBy(*KEY).applyInArrow(run, f"case_id {kind}, z int, y int, x int, d2 double")
    return unsent(found)


def distance_to_parent(parent: DataFrame, grid: DataFrame, radius_mm: float) -> DataFrame:
    """``dist_mm`` of every grid cell within ``radius_mm`` of the parent (0 inside)."""
    return distance_from(parent, grid, radius_mm).select(*CELL, F.sqrt("d2").alias("dist_mm"))


def depth_inside(cells: DataFrame, grid: DataFrame, key: tuple[str, ...] = (), out: str = "depth_mm") -> DataFrame:
    """Distance of each set cell to the nearest grid cell outside the set, at any depth.

    Three passes along lines, each of which shuffles the set's cells once. Beyond the cell that ends a run of set cells
    nothing can be nearer than that cell, so a run and its two ends are on their own: the squared distance after a pass is the lower envelope of the run's
    parabolas. Cells beyond the grid are not outside. ``key`` names extra columns (such as an instance id) that separate independent
    sets. Cells of a set that fills its grid stay null.
    """
    attach = case_joiner(grid, "sz", "sy", "sx", *BOX)
    held = ["case_id", *key]
    state = cells.select(*held, *_AXES).distinct().withColumn("d2", F.lit(float("inf")))
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*held, *_AXES, "d2"])
    for axis in _AXES:
        line = [*held, *[c for c in _AXES if c != axis]]
        rows = attach(state).select(*held, *_AXES, "d2", F.col(f"s{axis}").alias("s"), F.col(f"{axis}0").alias("lo"), F.col(f"{axis}1").alias("hi"))
        state = rows.repartition(*line).sortWithinPartitions(*line, axis).mapInArrow(_line_pass(line, axis, [*held, *_AXES]), schema)
    return state.select(*held, *_AXES, F.when(F.col("d2") < float("inf"), F.sqrt("d2")).alias(out))


def _line_pass(line: list[str], axis: str, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over rows sorted by line and axis; a run that goes on in the next batch waits for it."""

    def solve(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        at, s = table[axis].to_numpy().astype(np.int64), table["s"].to_numpy()
        d2 = envelopes(at, table["d2"].to_numpy(), starts, s, table["lo"].to_numpy(), table["hi"].to_numpy())
        return pa.RecordBatch.from_arrays([*[table[c].combine_chunks() for c in columns], pa.array(d2)], [*columns, "d2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            at = table[axis].to_numpy().astype(np.int64)
            new = np.r_[True, np.diff(at) != 1]
            for c in line:
                values = table[c].combine_chunks()
                new[1:] |= pc.fill_null(pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)), False).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            rest = table.slice(starts[-1])
            if starts[-1]:
                yield solve(table.slice(0, starts[-1]), starts[:-1])
        if rest is not None and len(rest):
            yield solve(rest, np.zeros(1, np.int64))

    return run


def envelopes(at: np.ndarray, height: np.ndarray, starts: np.ndarray, s: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Lower envelopes of parabolas ``height + (distance)^2`` along runs of neighbouring cells, at each cell.

    Runs begin at ``starts``; a cell before and one behind each run, if within ``lo`` and ``hi``, has height 0. All runs are swept
    together, cell by cell: the sweep keeps, per run, the parabolas that are lowest somewhere and where each begins to be.
    """
    ends = np.r_[starts[1:], len(at)]
    first, last = starts[at[starts] > lo[starts]], ends[at[ends - 1] < hi[ends - 1]] - 1
    run = np.repeat(np.arange(len(starts)), ends - starts)
    at = np.r_[at, at[first] - 1, at[last] + 1]
    height = np.r_[height, np.zeros(len(first) + len(last))]
    run, s = np.r_[run, run[first], run[last]], np.r_[s, s[first], s[last]]
    order = np.lexsort((at, run))
    sizes = np.bincount(run, minlength=len(starts))
    found = np.empty(len(at))
    found[order] = _swept(at[order], s[order], height[order], sizes)
    return found[: len(found) - len(first) - len(last)]


def _swept(at: np.ndarray, s: np.ndarray, height: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    place = at * s
    begin = np.cumsum(sizes) - sizes
    by_size = np.argsort(-sizes, kind="stable")
    longest, base = sizes[by_size], begin[by_size]
    lowest = np.zeros(len(place), np.int64)  # per run: the parabolas kept, from its first place on
    since = np.empty(len(place))  # where each kept one begins to be lowest
    kept = np.zeros(len(sizes), np.int64)
    for t in range(longest[0] if len(longest) else 0):
        runs = np.arange(np.searchsorted(-longest, -t, "left"))
        runs = runs[np.isfinite(height[base[runs] + t])]
        new = base[runs] + t
        from_here = np.full(len(runs), -np.inf)
        open_ = np.flatnonzero(kept[runs] > 0)
        while len(open_):
            r, q = runs[open_], new[open_]
            top = base[r] + kept[r] - 1
            v = lowest[top]
            cross = ((height[q] + place[q] ** 2) - (height[v] + place[v] ** 2)) / (2.0 * (place[q] - place[v]))
            hidden = cross <= since[top]
            from_here[open_[~hidden]] = cross[~hidden]
            kept[r[hidden]] -= 1
            open_ = open_[hidden]
            open_ = open_[kept[runs[open_]] > 0]
        slot = base[runs] + kept[runs]
        lowest[slot], since[slot] = new, from_here
        kept[runs] += 1
    out = np.full(len(place), np.inf)
    now = np.zeros(len(sizes), np.int64)
    for t in range(longest[0] if len(longest) else 0):
        runs = np.arange(np.searchsorted(-longest, -t, "left"))
        runs = runs[kept[runs] > 0]
        here = base[runs] + t
        while True:
            ahead = now[runs] + 1 < kept[runs]
            ahead[ahead] = since[base[runs[ahead]] + now[runs[ahead]] + 1] <= place[here[ahead]]
            if not ahead.any():
                break
            now[runs[ahead]] += 1
        for step in (-1, 0, 1):  # a crossing is rounded: its neighbours may be lower by a last digit
            k = np.clip(now[runs] + step, 0, kept[runs] - 1)
            v = lowest[base[runs] + k]
            out[here] = np.minimum(out[here], height[v] + ((at[here] - at[v]) * s[here]) ** 2)
    return out
