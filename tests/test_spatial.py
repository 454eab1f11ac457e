import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import components, percase, ranking, resolve, spatial


def cloud(spark, n, seed, scale=20.0, copies=0):
    g = np.random.default_rng(seed)
    rows = [(f"c{i % 3}", i, *(g.uniform(-scale, scale, 3).tolist())) for i in range(n)]
    rows += [("c0", n + i, 1.0, 1.0, 1.0) for i in range(copies)]
    return rows, spark.createDataFrame(rows, "case_id string, id long, x double, y double, z double")


def gap(a, b):
    return float(np.sqrt(sum((p - q) ** 2 for p, q in zip(a[2:5], b[2:5]))))


@pytest.mark.parametrize("block", [4096, 5])
def test_pairs_match_brute_force_even_when_cells_are_split(spark, block):
    rows, df = cloud(spark, 120, 1, copies=17)
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and gap(a, b) <= 7}
    got = spatial.pairs_within_self(df, 7.0, ["x", "y", "z"], "id", block_rows=block).collect()
    assert len(got) == len(want) and {(r.id_i, r.id_j) for r in got} == want
    right = df.select("case_id", F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"))
    both = spatial.pairs_within(df, right, 7.0, ["x", "y", "z"], ["rx", "ry", "rz"], block_rows=block)
    assert both.count() == 2 * len(want) + len(rows)


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_is_exact_with_clusters_copies_and_outliers(spark, k):
    rows, df = cloud(spark, 60, 2, copies=9)
    rows2 = [("c0", 900, 4000.0, 0.0, 0.0), ("c1", 901, -50.0, 80.0, 3.0), ("zz", 902, 0.0, 0.0, 0.0)]
    left = spark.createDataFrame(rows[:20] + rows2, df.schema).select("case_id", F.col("id").alias("lid"), F.col("x").alias("a"), F.col("y").alias("b"), F.col("z").alias("c"))
    got = spatial.nearest(left, df, ["lid"], "id", ["a", "b", "c"], ["x", "y", "z"], k).collect()
    want = set()
    for a in rows[:20] + rows2:
        near = sorted((gap(a, b), b[1]) for b in rows if b[0] == a[0])[:k]
        want |= {(a[1], i, r + 1) for r, (_, i) in enumerate(near)}
    assert {(r.lid, r.id, r["rank"]) for r in got} == want


def test_nearest_searches_every_case_at_its_own_scale(spark):
    g = np.random.default_rng(5)
    scales = {"fine": 0.01, "wide": 5000.0, "far": 1.0}
    rows = [(c, i, *(s * g.normal(size=3)).tolist()) for c, s in scales.items() for i in range(60)] + [("far", 60, 9e5, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "case_id string, id long, x double, y double, z double")
    ask = [(c, 100 + i, *(s * g.normal(size=3)).tolist()) for c, s in scales.items() for i in range(15)] + [("far", 200, -7e5, 1.0, 1.0), ("far", 201, None, 1.0, 1.0)]
    left = spark.createDataFrame(ask, df.schema).select("case_id", F.col("id").alias("lid"), F.col("x").alias("a"), F.col("y").alias("b"), F.col("z").alias("c"))
    got = spatial.nearest(left, df, ["lid"], "id", ["a", "b", "c"], ["x", "y", "z"], 3)
    assert got.columns == ["case_id", "lid", "a", "b", "c", "id", "x", "y", "z", "dist_mm", "rank"]
    want = {(a[0], a[1], i, r + 1) for a in ask[:-1] for r, (_, i) in enumerate(sorted((gap(a, b), b[1]) for b in rows if b[0] == a[0])[:3])}
    assert {(r.case_id, r.lid, r.id, r["rank"]) for r in got.collect()} == want


def test_nearest_cutoff(spark):
    rows, df = cloud(spark, 40, 3)
    left = df.where("id < 10").select("case_id", F.col("id").alias("lid"), F.col("x").alias("a"), F.col("y").alias("b"), F.col("z").alias("c"))
    got = spatial.nearest(left, df.where("id >= 10"), ["lid"], "id", ["a", "b", "c"], ["x", "y", "z"], 1, cutoff=9.0).collect()
    want = {}
    for a in rows[:10]:
        near = [(gap(a, b), b[1]) for b in rows[10:] if b[0] == a[0] and gap(a, b) <= 9]
        if near:
            want[a[1]] = min(near)[1]
    assert {r.lid: r.id for r in got} == want


def test_clusters_are_single_linkage(spark):
    rows, df = cloud(spark, 90, 4, scale=15.0)
    got = {r.id: r.cluster for r in components.merge_close(df, 6.0).collect()}
    root = {r[1]: r[1] for r in rows}
    change = True
    while change:
        change = False
        for a in rows:
            for b in rows:
                if a[0] == b[0] and gap(a, b) <= 6.0 and root[a[1]] != root[b[1]]:
                    root[a[1]] = root[b[1]] = min(root[a[1]], root[b[1]])
                    change = True
    assert got == root


def test_long_chain_component(spark):
    edges = spark.createDataFrame([("c", i, i + 1) for i in range(300)] + [("d", 5, 2), ("d", 7, 5)], "case_id string, u long, v long")
    got = components.connected(edges)
    assert {(r.case_id, r.root) for r in got.collect()} == {("c", 0), ("d", 2)}
    assert got.count() == 304


@pytest.mark.parametrize("limit", [10_000, 0])
def test_ordered_drops_equal_the_sequential_walk(spark, limit):
    g = np.random.default_rng(5)
    rows = []
    for c in ("a", "b"):
        seen = {tuple(sorted(g.choice(25, 2, replace=False).tolist())) for _ in range(60)}
        rows += [(c, i, j, int(g.choice([i, j]))) for i, j in seen]
    want = set()
    for c, i, j, loser in sorted(rows):
        if (c, i) not in want and (c, j) not in want:
            want.add((c, loser))
    df = spark.createDataFrame(rows, "case_id string, i long, j long, loser long")
    assert {(r.case_id, r.id) for r in resolve.ordered_drops(df, limit).collect()} == want


@pytest.mark.parametrize("limit", [1000, 3])
def test_numbered(spark, limit):
    g = np.random.default_rng(6)
    rows = [("a" if i % 4 else "b", i, float(g.integers(0, 9))) for i in range(200)]
    df = spark.createDataFrame(rows, "case_id string, id long, v double")
    got = ranking.numbered(df, ["case_id"], [F.col("v").desc(), F.col("id")], "n", limit).collect()
    for c in "ab":
        order = sorted((r for r in rows if r[0] == c), key=lambda r: (-r[2], r[1]))
        assert {(r.id, r.n) for r in got if r.case_id == c} == {(r[1], i + 1) for i, r in enumerate(order)}


@pytest.mark.parametrize("held", [1000, 4])
def test_exact_quantiles(spark, held):
    g = np.random.default_rng(7)
    vals = {c: np.round(g.normal(size=n), 1) for c, n in (("a", 301), ("b", 40), ("c", 1))}
    df = spark.createDataFrame([(c, float(v)) for c, a in vals.items() for v in a], "case_id string, v double")
    qs = [0.0, 0.08, 0.5, 0.7, 0.95, 1.0]
    got = percase.exact_quantiles(df, ["case_id"], "v", qs, [f"q{i}" for i in range(6)], held).collect()
    assert len(got) == 3
    for r in got:
        assert np.allclose([r[f"q{i}"] for i in range(6)], np.percentile(vals[r.case_id], np.array(qs) * 100))


def test_case_join_falls_back_to_salts(spark, monkeypatch):
    monkeypatch.setattr(percase, "BROADCAST_CASES", 1)
    big = spark.range(1000).select(F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("case_id"), "id")
    small = spark.createDataFrame([("c0", 1.0), ("c1", 2.0)], "case_id string, w double")
    assert percase.join_case(big, small).groupBy().sum("w").first()[0] == 1500.0
