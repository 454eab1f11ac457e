"""SQL twin of the tube response: separable passes with the taps as values, eigenvalues in closed form."""

from __future__ import annotations

from lumenframe.operators.stencil import derivative_kernels
from lumenframe.params import DEFAULTS
from lumenframe.plans.catalog.views import SIDE, SPACING_ZYX


def _taps() -> str:
    """``(scale, t, k0, k1, k2)``: smoothing, first and second derivative at offset ``t``."""
    mean = sum(SPACING_ZYX) / 3.0
    rows = []
    for i, mm in enumerate(DEFAULTS.tube_scales_mm):
        kernels = derivative_kernels(max(DEFAULTS.min_scale_voxels, mm / mean))
        half = (len(kernels[0]) - 1) // 2
        rows += [f"({i}, {t - half}, " + ", ".join(f"{float(k[t])!r}::DOUBLE" for k in kernels) + ")" for t in range(len(kernels[0]))]
    return ", ".join(rows)


def _pass(name: str, source: str, axis: str, sums: dict[str, tuple[str, str]], scaled: bool) -> str:
    """One pass along an axis: each sum is a column of the source under one kernel; beyond the grid the line is mirrored."""
    others = [c for c in "zyx" if c != axis]
    at = f"((g.{axis} + k.t) % {2 * SIDE} + {2 * SIDE}) % {2 * SIDE}"
    mirrored = f"CASE WHEN {at} >= {SIDE} THEN {2 * SIDE - 1} - ({at}) ELSE {at} END"
    columns = ", ".join(f"sum(s.{column} * k.{kernel}) AS {out}" for out, (column, kernel) in sums.items())
    same = " AND ".join([f"s.{c} = g.{c}" for c in others] + (["s.scale = k.scale"] if scaled else []))
    return f"""{name} AS MATERIALIZED (SELECT g.case_id, k.scale, g.z, g.y, g.x, {columns}
  FROM gc g, taps k JOIN {source} s ON s.case_id = g.case_id AND {same} AND s.{axis} = {mirrored} GROUP BY ALL)"""


#: ``tube(case_id, z, y, x, v)`` over the cells of ``lat``.
TUBE = ",\n".join([
    f"gc AS MATERIALIZED (SELECT case_id, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT DISTINCT case_id FROM lat), range({SIDE}) a(z), range({SIDE}) b(y), range({SIDE}) c(x))",
    f"taps(scale, t, k0, k1, k2) AS MATERIALIZED (VALUES {_taps()})",
    "full_hu AS MATERIALIZED (SELECT g.*, coalesce(lat.hu, 0.0)::DOUBLE AS hu FROM gc g LEFT JOIN lat USING (case_id, z, y, x))",
    _pass("tx", "full_hu", "x", {"x0": ("hu", "k0"), "x1": ("hu", "k1"), "x2": ("hu", "k2")}, False),
    _pass("ty", "tx", "y", {"y0x0": ("x0", "k0"), "y1x0": ("x0", "k1"), "y2x0": ("x0", "k2"), "y0x1": ("x1", "k0"), "y1x1": ("x1", "k1"), "y0x2": ("x2", "k0")}, True),
    _pass("tz", "ty", "z", {"aa": ("y0x0", "k2"), "bb": ("y2x0", "k0"), "cc": ("y0x2", "k0"), "ab": ("y1x0", "k1"), "ac": ("y0x1", "k1"), "bc": ("y1x1", "k0")}, True),
    "t1 AS (SELECT *, (aa+bb+cc)/3 AS q FROM tz)",
    "t2 AS (SELECT *, sqrt(((aa-q)*(aa-q)+(bb-q)*(bb-q)+(cc-q)*(cc-q)+2*(ab*ab+ac*ac+bc*bc))/6) AS p FROM t1)",
    "t3 AS (SELECT *, CASE WHEN p > 1e-300 THEN acos(least(greatest(((aa-q)*((bb-q)*(cc-q)-bc*bc)-ab*(ab*(cc-q)-bc*ac)+ac*(ab*bc-(bb-q)*ac))/(2*p*p*p), -1.0), 1.0))/3 ELSE 0.0 END AS f FROM t2)",
    "t4 AS (SELECT *, q+2*p*cos(f) AS e1, q+2*p*cos(f+2.0943951023931953) AS e3 FROM t3)",
    "t5 AS (SELECT case_id, z, y, x, list_sort([{'m': abs(e1), 'e': e1}, {'m': abs(3*q-e1-e3), 'e': 3*q-e1-e3}, {'m': abs(e3), 'e': e3}]) AS l FROM t4 WHERE q < 0)",
    f"""t6 AS (SELECT case_id, z, y, x, max((1 - exp(-(l[2].e/l[3].e)*(l[2].e/l[3].e)/{2 * DEFAULTS.tube_alpha**2}::DOUBLE)) * exp(-l[1].e*l[1].e/(l[2].e*l[3].e)/{2 * DEFAULTS.tube_beta**2}::DOUBLE)
    * (1 - exp(-(l[1].e*l[1].e+l[2].e*l[2].e+l[3].e*l[3].e)/{2 * DEFAULTS.tube_gamma**2}::DOUBLE))) AS v FROM t5 WHERE l[2].e < 0 AND l[3].e < 0 GROUP BY ALL)""",
    "tube AS MATERIALIZED (SELECT lat.case_id, lat.z, lat.y, lat.x, coalesce(t6.v, 0.0) AS v FROM lat LEFT JOIN t6 USING (case_id, z, y, x))",
])
