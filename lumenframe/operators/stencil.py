"""Multi-scale tube response (Frangi et al. 1998) over dense regions.

One shuffle brings every brick its cells and a halo as wide as the largest kernel; the separable
derivative passes then run as array operations inside the task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.bricks import EDGE, KEY, LAYOUT, in_reach, layout, spread
from lumenframe.operators.percase import case_joiner
from lumenframe.params import DEFAULTS, Params
from lumenframe.session import known_rows, unsent

TRUNCATE = 5.0  # half-width of a pass in standard deviations of that pass


def kernel_radius(sigma: float) -> int:
    """Half-width of the kernels of ``derivative_kernels``."""
    return 2 * max(int(TRUNCATE * sigma / np.sqrt(2.0) + 0.5), 2)


def derivative_kernels(sigma: float) -> list[np.ndarray]:
    """Smoothing, first and second derivative, for correlation: two passes of width sigma / sqrt(2) each.

    The second derivative is the antisymmetric first-order kernel applied twice, so its taps sum to zero
    at every width; a sampled second derivative would answer to flat input where sigma is below a voxel.
    """
    r, s = kernel_radius(sigma) // 2, sigma / np.sqrt(2.0)
    t = np.arange(-r, r + 1, dtype=float)
    g = np.exp(-0.5 * (t / s) ** 2)
    g /= g.sum()
    d = g * t / s**2
    return [np.convolve(g, g), np.convolve(g, d), np.convolve(d, d)]


def _correlate(a: np.ndarray, k: np.ndarray, axis: int) -> np.ndarray:
    n = a.shape[axis] - len(k) + 1
    at = lambda i: tuple(slice(i, i + n) if d == axis else slice(None) for d in range(3))
    out = k[0] * a[at(0)]
    term = np.empty_like(out)
    for i in range(1, len(k)):
        out += np.multiply(k[i], a[at(i)], out=term)
    return out


def _response(block: np.ndarray, halo: int, sigma: float, alpha: float, beta: float, gamma: float, wanted: np.ndarray | None = None) -> np.ndarray:
    """The response inside the halo; 0 where ``wanted`` is false."""
    ks = derivative_kernels(sigma)
    trim = halo - (len(ks[0]) - 1) // 2
    if trim:
        block = block[trim:-trim, trim:-trim, trim:-trim]
    along_x = [_correlate(block, k, 2) for k in ks]
    h = {}
    for oz, oy, ox in ((2, 0, 0), (0, 2, 0), (0, 0, 2), (1, 1, 0), (1, 0, 1), (0, 1, 1)):
        h[oz, oy, ox] = _correlate(_correlate(along_x[ox], ks[oy], 1), ks[oz], 0)
    out = np.zeros(h[2, 0, 0].shape)
    # two dominant negative eigenvalues need a negative trace, and a product of the three sums of two of them that isn't
    # above 0; only those cells are decomposed
    zz, yy, xx, zy, zx, yx = (h[o] for o in ((2, 0, 0), (0, 2, 0), (0, 0, 2), (1, 1, 0), (1, 0, 1), (0, 1, 1)))
    trace = zz + yy + xx
    live = trace < 0
    off = zy * zy + zx * zx + yx * yx
    det = zz * (yy * xx - yx * yx) - zy * (zy * xx - yx * zx) + zx * (zy * yx - yy * zx)
    size = np.sqrt(zz * zz + yy * yy + xx * xx + 2 * off)
    live &= trace * (zz * yy + zz * xx + yy * xx - off) - det <= 1e-9 * size**3
    if wanted is not None:
        live &= wanted
    m = np.empty((int(live.sum()), 3, 3))
    m[:, 0, 0], m[:, 1, 1], m[:, 2, 2] = h[2, 0, 0][live], h[0, 2, 0][live], h[0, 0, 2][live]
    m[:, 0, 1] = m[:, 1, 0] = h[1, 1, 0][live]
    m[:, 0, 2] = m[:, 2, 0] = h[1, 0, 1][live]
    m[:, 1, 2] = m[:, 2, 1] = h[0, 1, 1][live]
    ev = np.linalg.eigvalsh(m)
    ev = np.take_along_axis(ev, np.argsort(np.abs(ev), axis=-1), axis=-1)
    l1, l2, l3 = ev[:, 0], ev[:, 1], ev[:, 2]
    tube = (l2 < 0) & (l3 < 0)
    a2, a3 = np.where(tube, np.abs(l2), 1.0), np.where(tube, np.abs(l3), 1.0)
    plate, blob2 = (a2 / a3) ** 2, l1**2 / (a2 * a3)
    s2 = l1**2 + l2**2 + l3**2
    v = (1 - np.exp(-plate / (2 * alpha**2))) * np.exp(-blob2 / (2 * beta**2)) * (1 - np.exp(-s2 / (2 * gamma**2)))
    out[live] = np.where(tube, v, 0.0)
    return out


def _parent_d2(parent: np.ndarray, spacing: Sequence[float], limit_mm: float) -> np.ndarray:
    """Squared distance of every cell of a block to the nearest set one, along one axis after the other; right up to ``limit_mm``."""
    d2 = np.where(parent, 0.0, np.inf)
    for axis, s in enumerate(spacing):
        out, n = d2.copy(), d2.shape[axis]
        at = lambda a, b: tuple(slice(a, b) if d == axis else slice(None) for d in range(3))  # noqa: B023, E731
        for o in range(1, min(int(limit_mm / s) + 1, n - 1) + 1):
            low, high, step = at(0, n - o), at(o, n), (o * s) * (o * s)
            np.minimum(out[low], d2[high] + step, out=out[low])
            np.minimum(out[high], d2[low] + step, out=out[high])
        d2 = out
    return d2


def _grown(mask: np.ndarray) -> np.ndarray:
    """A mask and its 26 neighbours."""
    for axis in range(3):
        out = mask.copy()
        low, high = [tuple(s if d == axis else slice(None) for d in range(3)) for s in (slice(None, -1), slice(1, None))]
        out[low] |= mask[high]
        out[high] |= mask[low]
        mask = out
    return mask


def brick_rows(
    cells: DataFrame, grid: DataFrame, p: Params = DEFAULTS, edge: int = EDGE, keep: Sequence[str] = (), reach_mm: float | None = None
) -> DataFrame:
    """Every cell once per brick that needs it, with its case's ``halo``.

    A case's halo is the half-width of its own widest kernel, so a fine grid doesn't widen the halo of the others; with
    ``reach_mm`` it also holds what lies within that distance of the brick's cells and of their neighbours.
    """
    sized = case_joiner(_sized(grid, p, edge, reach_mm), "halo", *LAYOUT)(cells.select("case_id", "z", "y", "x", F.col("hu").cast("double").alias("hu"), *keep))
    return in_reach(sized, dict.fromkeys("zyx", F.col("halo"))).select(*KEY, "z", "y", "x", "hu", *keep, "halo")


def _sized(grid: DataFrame, p: Params, edge: int, reach_mm: float | None) -> DataFrame:
    """The grid with the bricks, mean spacing and halo of each case."""
    mean_sp = (F.col("sz") + F.col("sy") + F.col("sx")) / 3.0
    widest = F.greatest(F.lit(p.min_scale_voxels), F.lit(max(p.tube_scales_mm)) / mean_sp)
    half = F.floor(TRUNCATE * widest / F.sqrt(F.lit(2.0)) + 0.5)  # ``kernel_radius`` of the widest scale
    halo = (2 * F.greatest(half, F.lit(2))).cast("int")
    if reach_mm is not None:
        halo = F.greatest(halo, F.ceil(F.lit(reach_mm) / F.least("sz", "sy", "sx")).cast("int") + 1)
    return layout(grid, edge).withColumns({"mean_sp": mean_sp, "halo": halo})


def _per_brick(
    cells: DataFrame, grid: DataFrame, p: Params, edge: int, keep: Sequence[str], reach_mm: float | None, kernel: Callable[[pd.DataFrame, pd.Series], pd.DataFrame], schema: str
) -> DataFrame:
    """``kernel`` of the rows of each brick; what a brick knows of its case comes in one row of its own, not with every cell."""
    rows = known_rows(cells)
    bricks = _sized(grid, p, edge, reach_mm)
    for a in "zyx":
        bricks = bricks.withColumn(f"b{a}", F.explode(F.sequence(f"f{a}", f"l{a}")))
    bricked = brick_rows(cells, grid, p, edge, keep, reach_mm).drop("halo")
    # the grid may be read off the cells: each side gets columns of its own
    bricks, bricked = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (bricks, bricked))

    def run(pdf: pd.DataFrame, brick: pd.DataFrame) -> pd.DataFrame:
        return kernel(pdf, brick.iloc[0]) if len(pdf) and len(brick) else pd.DataFrame()

    return spread(bricked, KEY, rows).groupBy(*KEY).cogroup(spread(bricks, KEY, rows).groupBy(*KEY)).applyInPandas(run, schema)


class _Brick:
    """Rows of one brick and its halo as a block."""

    def __init__(self, pdf: pd.DataFrame, edge: int | np.ndarray, one: pd.Series | None = None):
        one = pdf.iloc[0] if one is None else one
        self.halo = int(one["halo"])
        lo = np.array([int(one[f"{a}0"]) for a in "zyx"])
        hi = np.array([int(one[f"{a}1"]) for a in "zyx"])
        corner = lo + np.array([int(one[f"b{a}"]) for a in "zyx"]) * edge
        self.own_lo, self.own_hi = np.maximum(corner, lo), np.minimum(corner + edge - 1, hi)
        self.start, self.stop = np.maximum(self.own_lo - self.halo, lo), np.minimum(self.own_hi + self.halo, hi)
        at = pdf[["z", "y", "x"]].to_numpy()
        self.seen = ((at >= self.start) & (at <= self.stop)).all(axis=1)
        self.own = ((at >= self.own_lo) & (at <= self.own_hi)).all(axis=1)
        self.place = tuple((at[self.seen] - self.start).T)
        self.mine = at[self.own]

    @classmethod
    def of(cls, pdf: pd.DataFrame, one: pd.Series) -> _Brick:
        """The brick of rows without columns of their case; ``one`` is the row of the brick."""
        return cls(pdf, np.array([int(one[f"e{a}"]) for a in "zyx"]), one)

    def block(self, values: np.ndarray, fill) -> np.ndarray:
        out = np.full(self.stop - self.start + 1, fill)
        out[self.place] = values[self.seen]
        return out

    def of_mine(self, block: np.ndarray) -> np.ndarray:
        return block[tuple((self.mine - self.start).T)]

    def tube(self, hu: np.ndarray, mean_sp: float, p: Params, fill: float) -> np.ndarray:
        """The response of the brick's own cells."""
        start, stop, lo, hi = self.start, self.stop, self.own_lo, self.own_hi
        block = np.pad(self.block(hu, fill), [(int(start[i] - lo[i] + self.halo), int(hi[i] + self.halo - stop[i])) for i in range(3)], mode="symmetric")
        best, place = np.zeros(hi - lo + 1), tuple((self.mine - lo).T)
        wanted = np.zeros(best.shape, bool)
        wanted[place] = True
        for mm in p.tube_scales_mm:
            best = np.maximum(best, _response(block, self.halo, max(p.min_scale_voxels, mm / mean_sp), p.tube_alpha, p.tube_beta, p.tube_gamma, wanted))
        return best[place]


def tube_response(
    cells: DataFrame, grid: DataFrame, p: Params = DEFAULTS, fill: float = 0.0, edge: int = EDGE, keep: Sequence[str] = ()
) -> DataFrame:
    """``vesselness`` of every cell of ``cells(case_id, z, y, x, hu)``, with hu and ``keep`` passed through.

    ``grid`` is as in ``distance_from``. Beyond the grid the volume is mirrored; grid cells without
    a row count as ``fill``.
    """
    kind = cells.schema["case_id"].dataType.simpleString()

    def kernel(pdf: pd.DataFrame, one: pd.Series) -> pd.DataFrame:
        brick = _Brick.of(pdf, one)
        out = pdf.loc[brick.own, ["case_id", "z", "y", "x", "hu", *keep]].copy()
        out["vesselness"] = brick.tube(pdf["hu"].to_numpy(), one["mean_sp"], p, fill)
        return out

    extra = "".join(f", {k} {cells.schema[k].dataType.simpleString()}" for k in keep)
    return _per_brick(cells, grid, p, edge, keep, None, kernel, f"case_id {kind}, z int, y int, x int, hu double{extra}, vesselness double")


def zone_maps(cells: DataFrame, grid: DataFrame, p: Params = DEFAULTS, fill: float = 0.0, edge: int = EDGE) -> DataFrame:
    """``tube_response`` of ``cells(case_id, z, y, x, hu, parent)`` and, from the same bricks, ``dist_mm`` and ``near_outward``.

    ``dist_mm`` is as in ``distance_to_parent`` up to the growth limit; ``near_outward`` marks outward blood (see ``masks``)
    and its 26 neighbours. ``grid`` also has the window ``blood_low, blood_high``. All three take one shuffle of the cells.
    """
    kind = cells.schema["case_id"].dataType.simpleString()
    limit = p.growth_limit_mm * p.growth_limit_mm * (1 + 1e-12)

    def kernel(pdf: pd.DataFrame, one: pd.Series) -> pd.DataFrame:
        brick = _Brick.of(pdf, one)
        hu, parent = pdf["hu"].to_numpy(float), pdf["parent"].to_numpy()
        inside, outside = parent == True, parent == False  # noqa: E712  a null is neither
        held = np.zeros(brick.stop - brick.start + 1, bool)
        held[tuple(i[inside[brick.seen]] for i in brick.place)] = True
        d2 = _parent_d2(held, [one["sz"], one["sy"], one["sx"]], p.growth_limit_mm)
        dist = np.sqrt(np.where(d2 <= limit, d2, np.inf))
        blood = ((hu >= one["blood_low"]) & (hu <= one["blood_high"]) & outside)[brick.seen]
        far = blood & (dist[brick.place] > p.near_wall_mm) & (dist[brick.place] <= p.growth_limit_mm)
        outward = np.zeros(held.shape, bool)
        outward[tuple(i[far] for i in brick.place)] = True
        out = pdf.loc[brick.own, ["case_id", "z", "y", "x", "hu", "parent"]].copy()
        out["vesselness"] = brick.tube(hu, one["mean_sp"], p, fill)
        mine = brick.of_mine(dist)
        out["dist_mm"] = pd.Series(pd.arrays.FloatingArray(np.where(np.isfinite(mine), mine, 0.0), ~np.isfinite(mine)), index=out.index)
        out["near_outward"] = brick.of_mine(_grown(outward))
        return out

    schema = f"case_id {kind}, z int, y int, x int, hu double, parent boolean, vesselness double, dist_mm double, near_outward boolean"
    return unsent(_per_brick(cells, grid, p, edge, ("parent",), p.growth_limit_mm, kernel, schema), known_rows(cells))
