"""Small fixtures and brute-force references."""

from __future__ import annotations

import heapq

import numpy as np

SP = (1.5, 0.8, 0.8)
OFFS = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]


def grid_df(spark, shapes, sp=SP):
    rows = [(c, *map(float, sp), 0, s[0] - 1, 0, s[1] - 1, 0, s[2] - 1) for c, s in shapes.items()]
    return spark.createDataFrame(rows, "case_id string, sz double, sy double, sx double, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")


def cells_df(spark, masks, **values):
    """``masks``: case -> bool array; ``values``: name -> (case -> array)."""
    rows = []
    for case, m in masks.items():
        for z, y, x in np.argwhere(m):
            rows.append((case, int(z), int(y), int(x), *[v[case][z, y, x].item() for v in values.values()]))
    kinds = []
    for n, v in values.items():
        k = next(iter(v.values())).dtype.kind
        kinds.append(f"{n} {'double' if k == 'f' else 'boolean' if k == 'b' else 'bigint'}")
    return spark.createDataFrame(rows, ", ".join(["case_id string, z int, y int, x int", *kinds]))


def as_array(rows, shape, value=None, fill=0):
    out = np.full(shape, fill, dtype=float if value else bool)
    for r in rows:
        out[r.z, r.y, r.x] = r[value] if value else True
    return out


def dilate(m, offs):
    out = np.zeros_like(m)
    for z, y, x in np.argwhere(m):
        for a, b, c in offs:
            p = (z + a, y + b, x + c)
            if all(0 <= v < s for v, s in zip(p, m.shape)):
                out[p] = True
    return out


def distance(seeds, sp=SP):
    at = np.argwhere(seeds) * np.array(sp)
    idx = np.argwhere(np.ones(seeds.shape, bool))
    d = np.sqrt(((idx[:, None, :] * np.array(sp) - at[None]) ** 2).sum(-1)).min(1)
    return d.reshape(seeds.shape)


def label26(m):
    out, n = np.zeros(m.shape, int), 0
    for p in map(tuple, np.argwhere(m)):
        if out[p]:
            continue
        n += 1
        stack = [p]
        out[p] = n
        while stack:
            q = stack.pop()
            for o in OFFS:
                r = tuple(a + b for a, b in zip(q, o))
                if all(0 <= v < s for v, s in zip(r, m.shape)) and m[r] and not out[r]:
                    out[r] = n
                    stack.append(r)
    return out


def geodesic(markers, allowed, sp=SP):
    """Least (distance in micrometres, label) per allowed cell."""
    best, heap = {}, []
    for p in map(tuple, np.argwhere((markers > 0) & allowed)):
        heapq.heappush(heap, (0, int(markers[p]), p))
    while heap:
        d, lab, p = heapq.heappop(heap)
        if p in best:
            continue
        best[p] = (d, lab)
        for o in OFFS:
            q = tuple(a + b for a, b in zip(p, o))
            if all(0 <= v < s for v, s in zip(q, allowed.shape)) and allowed[q] and q not in best:
                heapq.heappush(heap, (d + round(float(np.linalg.norm(np.array(o) * sp)) * 1000), lab, q))
    return best


def phantom(kind="side", shape=(24, 34, 34), sp=SP, seed=0):
    """Parent tube along z of 4 mm radius with tubes; returns hu and parent arrays."""
    z, y, x = np.meshgrid(*map(np.arange, shape), indexing="ij")
    pz, py, px = z * sp[0], (y - (shape[1] - 1) / 2) * sp[1], (x - (shape[2] - 1) / 2) * sp[2]
    parent = px**2 + py**2 <= 16.0
    hu = np.full(shape, 40.0)

    def tube(zc, ang, r=1.8, length=12.5, tilt=0.0):
        d = np.array([np.sin(tilt), np.cos(tilt) * np.sin(ang), np.cos(tilt) * np.cos(ang)])
        v = np.stack([pz - zc, py, px], -1)
        t = v @ d
        r2 = (v**2).sum(-1) - t**2
        hu[(t >= 0) & (t <= length) & (r2 <= r * r)] = 320.0

    if kind == "side":
        tube(18.0, 0.0)
    elif kind == "two":
        tube(12.0, 0.0)
        tube(24.0, 2.0)
    elif kind == "bare":
        pass
    hu[parent] = 320.0
    hu += np.random.default_rng(seed).uniform(-5, 5, shape)
    return hu, parent


def case_rows(spark, cases, sp=SP):
    eye = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    rows = [(c, [int(v) for v in s[::-1]], list(map(float, sp[::-1])), [0.0, 0.0, 0.0], list(map(float, eye))) for c, s in cases.items()]
    return spark.createDataFrame(rows, "case_id string, size array<int>, spacing array<double>, origin array<double>, direction array<double>")
