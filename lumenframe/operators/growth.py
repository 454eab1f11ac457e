"""Seeded growth: every allowed cell joins the marker with the least geodesic distance.

Ties go to the lowest label. Distances are whole micrometres, so sums do not depend on the order
in which bricks are visited.

What a brick ends as is settled by its own cells and markers and the best distances that ever arrived at its faces. So
the cells are written once, by brick, and only arrivals at faces are state: a round works on the bricks whose faces got
something better, and writes what gets better on theirs. Bricks that stand alone are solved once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import geometry as geo
from lumenframe.operators.bricks import EDGE, KEY, LAYOUT, brick_of, in_reach, layout, spread
from lumenframe.operators.lattice import CELL
from lumenframe.operators.percase import case_joiner
from lumenframe.session import cut

_FAR = np.iinfo(np.int64).max


def relaxed(at: np.ndarray, free: np.ndarray, dist: np.ndarray, label: np.ndarray, costs: list[tuple[tuple[int, int, int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """Least (distance, label) of the places ``at``, from those with a distance, over steps into free ones.

    ``dist`` is ``_FAR`` where nothing has arrived. A sweep looks around the places that changed in the last one only.
    """
    low = at.min(axis=0) - 1
    shape = at.max(axis=0) - low + 2
    place = np.ravel_multi_index(tuple((at - low).T), shape)
    index = np.full(int(np.prod(shape)), -1)
    index[place[free]] = np.flatnonzero(free)
    steps = np.array([(dz * shape[1] + dy) * shape[2] + dx for (dz, dy, dx), _ in costs])
    cost = np.array([c for _, c in costs])
    live = np.flatnonzero(dist < _FAR)
    while len(live):
        to = index[place[live, None] + steps]
        far, name = dist[live, None] + cost, np.broadcast_to(label[live, None], to.shape)
        met = to >= 0
        to, far, name = to[met], far[met], name[met]
        better = (far < dist[to]) | ((far == dist[to]) & (name < label[to]))
        to, far, name = to[better], far[better], name[better]
        order = np.lexsort((name, far, to))
        order = order[np.r_[True, to[order][1:] != to[order][:-1]][: len(order)]]
        live = to[order]
        dist[live], label[live] = far[order], name[order]
    return dist, label


def _relax_brick(faces_only: bool):
    """Cells, markers and arrivals of one brick -> its reached cells, or those of them that another brick can see."""
    steps = geo.neighbour_offsets(26)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        edge = np.array([int(one[f"e{a}"]) for a in "zyx"])
        lo = np.array([int(one[f"o{a}"]) + int(one[f"b{a}"]) * int(one[f"e{a}"]) for a in "zyx"])
        sp = np.array([one["sz"], one["sy"], one["sx"]])
        costs = [(o, int(round(float(np.linalg.norm(np.array(o) * sp)) * 1000.0))) for o in steps]
        at = pdf[["z", "y", "x"]].to_numpy()
        own = pdf["own"].to_numpy(bool)
        dist, label = np.full(len(at), _FAR), np.full(len(at), _FAR)
        known = pdf["dist"].notna().to_numpy()
        # a brick's rows hold a cell of its own and an arrival at its face once each
        dist[known], label[known] = pdf["dist"][known].to_numpy(np.int64), pdf["label"][known].to_numpy(np.int64)
        dist, label = relaxed(at.astype(np.int64), own, dist, label, costs)
        mine, dist, label = at[own], dist[own], label[own]
        out = pd.DataFrame({"case_id": one["case_id"], **{c: mine[:, i] for i, c in enumerate("zyx")}, "dist": dist, "label": label})
        keep = dist < _FAR
        if faces_only:
            keep &= ((mine == lo) | (mine == lo + edge - 1)).any(axis=1)
        return out[keep]

    return run


def grow(markers: DataFrame, allowed: DataFrame, spacing: DataFrame, edge: int = EDGE) -> DataFrame:
    """``markers(case_id, z, y, x, label)`` over ``allowed(case_id, z, y, x)`` -> labels of reached cells.

    Returns ``(case_id, z, y, x, label, geo_mm)``. Markers outside ``allowed`` are dropped. Each
    round relaxes the bricks at whose faces something better arrived to their own fixpoint, so the number
    of rounds follows the number of bricks a path crosses, not its number of steps.
    """
    own = [brick_of(a).alias(f"b{a}") for a in "zyx"]
    attach = case_joiner(layout(spacing, edge), "sz", "sy", "sx", *LAYOUT)
    start = allowed.select(*CELL).distinct().join(markers.groupBy(*CELL).agg(F.min("label").cast("long").alias("label")), CELL, "left")
    dist = F.when(F.col("label").isNotNull(), F.lit(0).cast("long")).alias("dist")
    known = ["sz", "sy", "sx", *[f"{k}{a}" for k in "oe" for a in "zyx"]]
    cells = cut(attach(start).select(*CELL, *own, *known, F.lit(True).alias("own"), dist, "label"), "grow-cells")
    kind = allowed.schema["case_id"].dataType.simpleString()
    schema = f"case_id {kind}, z int, y int, x int, dist bigint, label bigint"
    sizes = cut(cells.select(*KEY, *known).distinct(), "grow-bricks")
    best = F.min(F.struct("dist", "label")).alias("best")

    def seen(faces: DataFrame) -> DataFrame:
        """Cells at faces, once in every other brick that sees them."""
        moved = in_reach(attach(faces), dict.fromkeys("zyx", 1))
        return moved.where(F.array(*[F.col(f"b{a}") for a in "zyx"]) != F.array(*own)).select(*faces.columns, *KEY[1:])

    def solve(rows: DataFrame, arrivals: DataFrame | None, active: DataFrame | None, faces_only: bool) -> DataFrame:
        if arrivals is not None:
            met = seen(arrivals.groupBy(*CELL).agg(best).select(*CELL, "best.*")).join(sizes, KEY)
            rows = rows.unionByName(met.withColumn("own", F.lit(False)))
        if active is not None:
            rows = rows.join(active, KEY, "left_semi")
        return spread(rows, KEY).groupBy(*KEY).applyInPandas(_relax_brick(faces_only), schema)

    # a brick without a brick beside it has nothing to tell or to hear: the last pass is its only one
    beside = sizes.select("case_id", *[F.col(f"b{a}").alias(f"__{a}") for a in "zyx"], F.explode(geo.offset_array(geo.neighbour_offsets(26))).alias("o"))
    beside = beside.select("case_id", *[(F.col(f"__{a}") + F.col(f"o.d{a}")).cast("int").alias(f"b{a}") for a in "zyx"]).distinct()
    met = cells.where("label is not null").select(*KEY).distinct().join(beside, KEY, "left_semi")
    active = cut(met, "grow-active")
    arrivals, fresh = None, None
    while not active.isEmpty():
        out = solve(cells, arrivals, active, True)
        if arrivals is not None:
            before = arrivals.groupBy(*CELL).agg(best)
            out = out.join(before, CELL, "left").where(F.col("best").isNull() | (F.struct("dist", "label") < F.col("best"))).select(*CELL, "dist", "label")
        fresh = cut(out, "grow-faces")
        arrivals = fresh if arrivals is None else arrivals.unionByName(fresh)
        active = cut(seen(fresh).select(*KEY).distinct().join(sizes, KEY, "left_semi"), "grow-active")
    reached = solve(cells, arrivals, None, False)
    return reached.select(*CELL, "label", (F.col("dist") / 1000.0).alias("geo_mm"))
