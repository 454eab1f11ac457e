"""Connected components: of a graph, of a 26-neighbour lattice mask, of close points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lumenframe.functions import geometry as geo
from lumenframe.operators.bricks import EDGE, KEY, spread
from lumenframe.operators.lattice import CELL
from lumenframe.operators.percase import join_case
from lumenframe.operators.ranking import numbered
from lumenframe.operators.spatial import pairs_within_self
from lumenframe.session import cut, known_rows, unsent


def connected(edges: DataFrame) -> DataFrame:
    """``edges(case_id, u, v)`` -> ``(case_id, node, root)`` with root the least node reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Each step finds the least
    neighbour with a mergeable aggregate and joins it back, so a hub is never gathered in one task;
    AQE splits the join when one hub dominates. Components that have become a star leave the edge table, so a round
    only rewrites what isn't settled. Nodes without an edge are not returned.
    """
    e = edges.where(F.col("u") != F.col("v")).select(
        "case_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    e, stars = cut(e.distinct(), "cc-edges"), []
    rows, total = known_rows(e), 0
    while True:
        # a union hides what its parts say about their size
        both = unsent(e.unionByName(e.select("case_id", F.col("v").alias("u"), F.col("u").alias("v"))), 2 * rows)
        least = both.groupBy("case_id", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # large star: neighbours above a node move to the least node around it
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(least, ["case_id", "u"])
            .select("case_id", F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # small star: a node and its lower neighbours move to the least of them
        low = large.groupBy("case_id", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["case_id", "u"]).select("case_id", F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where(F.col("u") != F.col("v")).distinct(), "cc-stars")
        rows, total = known_rows(e), total + known_rows(e)
        open_ = cut(_open_centres(e), "cc-open")
        if open_.isEmpty():
            stars.append(e)
            break
        stars.append(e.join(open_, ["case_id", "v"], "left_anti"))
        e = e.join(open_, ["case_id", "v"], "left_semi").select("case_id", "u", "v")
    settled = stars[0]
    for part in stars[1:]:
        settled = settled.unionByName(part)
    nodes = settled.select("case_id", F.col("u").alias("node"), F.col("v").alias("root"))
    roots = settled.select("case_id", F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return unsent(nodes.unionByName(roots), 2 * total)


def _open_centres(e: DataFrame) -> DataFrame:
    """Centres ``(case_id, v)`` that aren't yet the centre of a star on its own.

    A star's centre points nowhere, and each of its leaves points to it only and isn't a centre itself.
    """
    one, none = F.lit(1), F.lit(0)
    ends = F.array(F.struct(F.col("u").alias("n"), one.alias("a"), none.alias("b")), F.struct(F.col("v").alias("n"), none.alias("a"), one.alias("b")))
    roles = e.select("case_id", F.explode(ends).alias("r")).groupBy("case_id", "r.n").agg(F.sum("r.a").alias("a"), F.max("r.b").alias("b"))
    loose = roles.where((F.col("a") > 1) | ((F.col("a") > 0) & (F.col("b") > 0))).select("case_id", "n")
    of_leaf = e.join(loose.withColumnRenamed("n", "u"), ["case_id", "u"], "left_semi").select("case_id", "v")
    return of_leaf.unionByName(e.join(loose.withColumnRenamed("n", "v"), ["case_id", "v"], "left_semi").select("case_id", "v")).distinct()


def merge_close(points: DataFrame, radius: float, ident: str = "id", xyz=("x", "y", "z")) -> DataFrame:
    """Single-linkage clusters of points at most ``radius`` apart: adds ``cluster`` (least id)."""
    slim = points.select("case_id", F.col(ident).alias("id"), *xyz)
    slim = slim if known_rows(points) is None else unsent(slim, known_rows(points))
    pairs = pairs_within_self(slim, radius, list(xyz), "id")
    roots = connected(pairs.select("case_id", F.col("id_i").alias("u"), F.col("id_j").alias("v")))
    roots = roots.select("case_id", F.col("node").alias(ident), F.col("root").alias("cluster"))
    return points.join(roots, ["case_id", ident], "left").withColumn("cluster", F.coalesce("cluster", ident))


# a cell address as one number: 2^20 cells per axis
_BITS = 1 << 20


def cell_number(z="z", y="y", x="x"):
    return (F.col(z).cast("long") * _BITS + F.col(y)) * _BITS + F.col(x)


#: Steps to the neighbours that come later in (z, y, x) order.
_AHEAD = [o for o in geo.neighbour_offsets(26) if o > (0, 0, 0)]


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least node that each of ``n`` nodes reaches over the edges (u, v)."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    return root


def _fold_brick(cells: pa.Table) -> pa.Table:
    """Cells of one brick -> each once, with the number of the first cell of its piece inside the brick."""
    at, rows = np.unique(np.stack([cells[a].to_numpy() for a in "zyx"], 1).astype(np.int64), axis=0, return_index=True)
    low = at.min(axis=0) - 1
    index = np.full(at.max(axis=0) - low + 2, -1)
    index[tuple((at - low).T)] = np.arange(len(at))
    met = [index[tuple((at - low + o).T)] for o in np.array(_AHEAD)]
    root = _roots(len(at), np.concatenate([np.flatnonzero(m >= 0) for m in met]), np.concatenate([m[m >= 0] for m in met]))
    first = at[root]
    number = (first[:, 0] * _BITS + first[:, 1]) * _BITS + first[:, 2]
    return cells.select(["case_id", "z", "y", "x"]).take(pa.array(rows)).append_column("root", pa.array(number))


def label_mask(mask: DataFrame, edge: int = EDGE) -> DataFrame:
    """26-connected labels of ``mask(case_id, z, y, x)``: adds ``first_cell`` and dense ``label``.

    Cells are first folded into pieces inside bricks; pieces that touch across the faces of bricks become the
    edges of a graph, which has no node for what lies in one brick. Labels count components of a
    case by their first cell in (z, y, x) order.
    """
    own = {f"b{a}": F.floor(F.col(a) / edge).cast("int") for a in "zyx"}
    # a case may be a struct: its fields say whether they may be null, which a type's name doesn't
    shape = StructType([StructField("case_id", mask.schema["case_id"].dataType)] + [StructField(a, IntegerType()) for a in "zyx"] + [StructField("root", LongType())])
    bricks = spread(mask.select(*CELL).dropna().withColumns(own), KEY, known_rows(mask))
    pieces = bricks.groupBy(*KEY).applyInArrow(_fold_brick, shape)
    pieces = cut(pieces, "cc-pieces")
    # only cells at a face can have a neighbour in another brick
    at_face = F.greatest(*[F.pmod(F.col(a), F.lit(edge)).isin(0, edge - 1).cast("int") for a in "zyx"]) == 1
    faces = pieces.where(at_face)
    there = {a: F.col(a) + F.col(f"o.d{a}") for a in "zyx"}
    leaves = F.array(*[F.floor(v / edge) for v in there.values()]) != F.array(*[F.floor(F.col(a) / edge) for a in "zyx"])
    a = faces.withColumn("o", F.explode(geo.offset_array(_AHEAD))).where(leaves)
    a = a.select("case_id", *[v.alias(c) for c, v in there.items()], F.col("root").alias("u"))
    edges = cut(a.join(faces.withColumnRenamed("root", "v"), CELL).select("case_id", "u", "v").distinct(), "cc-touching")
    named = pieces.select("case_id", "root").distinct()
    if known_rows(edges):
        roots = connected(edges).select("case_id", F.col("node").alias("root"), F.col("root").alias("__least"))
        named = named.join(roots, ["case_id", "root"], "left").select("case_id", "root", F.coalesce("__least", "root").alias("first_cell"))
    else:
        named = named.withColumn("first_cell", F.col("root"))
    named = cut(named, "cc-named")
    firsts = numbered(named.select("case_id", "first_cell").distinct(), ["case_id"], [F.col("first_cell")], "label")
    named = named.join(firsts, ["case_id", "first_cell"])
    return pieces.join(named, ["case_id", "root"]).select(*CELL, "first_cell", "label")


def merged_markers(seeds: DataFrame, spacing: DataFrame, merge_mm: float) -> DataFrame:
    """Seed patches, those with centroids at most ``merge_mm`` apart joined, numbered densely.

    Labels follow the first cell of the merged group in scan order.
    """
    patches = cut(label_mask(seeds), "patches")
    mid = patches.groupBy("case_id", F.col("label").alias("id")).agg(*[F.avg(c).alias(f"c{c}") for c in "zyx"])
    mid = join_case(mid, spacing, "sz", "sy", "sx")
    mid = mid.select("case_id", "id", *[(F.col(f"c{c}") * F.col(f"s{c}")).alias(f"p{c}") for c in "zyx"])
    merged = cut(merge_close(cut(mid, "patch-centres"), merge_mm, xyz=("pz", "py", "px")), "patch-groups")
    names = numbered(merged.select("case_id", "cluster").distinct(), ["case_id"], [F.col("cluster")], "label")
    groups = merged.select("case_id", "id", "cluster").join(names, ["case_id", "cluster"]).select("case_id", "id", "label")
    return patches.withColumnRenamed("label", "id").join(groups, ["case_id", "id"]).select("case_id", "z", "y", "x", "label")
