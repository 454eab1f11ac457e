"""SQL twins of the queries that advance in rounds, as recursive queries."""

from __future__ import annotations

from lumenframe.plans.catalog.lattice_sql import _LAT, BOX27, CAL, CAPC, CONT, DIST, FACE6, GRIDC, OST, RIM, SEEDED, THR, TUBED, _depth
from lumenframe.plans.catalog.views import LAT

QUADRANTS = """inst AS MATERIALIZED (SELECT *, CAST(floor(z/4.0) AS INT)*4 + CASE WHEN y >= 12 THEN 2 ELSE 0 END + CASE WHEN x >= 12 THEN 1 ELSE 0 END AS inst_id
  FROM lat WHERE hu > 300 AND NOT parent)"""
_START = "WITH RECURSIVE " + ",\n".join([LAT, BOX27, QUADRANTS, CONT])

BASINS = _START + """,
steps AS (SELECT *, CAST(round(sqrt((dz*1.5)*(dz*1.5)+(dy*0.8)*(dy*0.8)+(dx*0.8)*(dx*0.8))*1000) AS BIGINT) AS cost FROM o27 WHERE NOT (dz = 0 AND dy = 0 AND dx = 0)),
reach(case_id, z, y, x, d, label) USING KEY (case_id, z, y, x) AS (
  SELECT case_id, z, y, x, 0::BIGINT, min(inst_id)::BIGINT FROM ct GROUP BY ALL
  UNION
  SELECT c.case_id, c.z, c.y, c.x, c.b.d, c.b.label FROM (
    SELECT i.case_id, i.z, i.y, i.x, min({'d': r.d + o.cost, 'label': r.label}) AS b
    FROM reach r, steps o JOIN inst i ON i.case_id = r.case_id AND i.z = r.z + o.dz AND i.y = r.y + o.dy AND i.x = r.x + o.dx GROUP BY ALL) c
  LEFT JOIN recurring.reach k ON k.case_id = c.case_id AND k.z = c.z AND k.y = c.y AND k.x = c.x
  WHERE k.d IS NULL OR c.b.d < k.d OR (c.b.d = k.d AND c.b.label < k.label))
SELECT case_id, z, y, x, label, round(d / 1000.0, 6) AS geo_mm FROM reach
"""

_WALKS = _START + ",\n" + ",\n".join([OST, DIST, FACE6, GRIDC, "st AS (SELECT * FROM lat WHERE parent OR hu > 300)", RIM, "dp AS (" + _depth("st") + ")"]) + """,
cells AS MATERIALIZED (SELECT i.case_id, i.inst_id, i.z, i.y, i.x, ds.d, dp.dp FROM inst i
  JOIN ds ON ds.case_id=i.case_id AND ds.z=i.z AND ds.y=i.y AND ds.x=i.x JOIN dp ON dp.case_id=i.case_id AND dp.z=i.z AND dp.y=i.y AND dp.x=i.x WHERE ds.d <= 14.0),
steps AS (SELECT *, row_number() OVER (ORDER BY (dz <> 0 OR dy <> 0 OR dx <> 0), dz, dy, dx) AS rank, sqrt((dz*1.5)*(dz*1.5)+(dy*0.8)*(dy*0.8)+(dx*0.8)*(dx*0.8)) AS len FROM o27),
st0 AS (SELECT case_id, inst_id, CAST(round_even(oz, 0) AS INT) AS z, CAST(round_even(oy, 0) AS INT) AS y, CAST(round_even(ox, 0) AS INT) AS x FROM os),
home AS (SELECT s.case_id, s.inst_id, min_by({'z': c.z, 'y': c.y, 'x': c.x, 'd': c.d}, rank) AS h FROM st0 s, steps o
  JOIN cells c ON c.case_id=s.case_id AND c.inst_id=s.inst_id AND c.z=s.z+o.dz AND c.y=s.y+o.dy AND c.x=s.x+o.dx GROUP BY ALL),
w(case_id, inst_id, step, z, y, x, level, total, path, fork, live) AS (
  SELECT s.case_id, s.inst_id, 0, coalesce(h.z, s.z), coalesce(h.y, s.y), coalesce(h.x, s.x), h.d, 0.0::DOUBLE,
    [{'z': coalesce(h.z, s.z), 'y': coalesce(h.y, s.y), 'x': coalesce(h.x, s.x)}], false, h IS NOT NULL
  FROM st0 s LEFT JOIN home ON home.case_id=s.case_id AND home.inst_id=s.inst_id
  UNION ALL
  SELECT case_id, inst_id, CASE WHEN f THEN step ELSE step + 1 END, CASE WHEN f THEN z ELSE b[1].z END, CASE WHEN f THEN y ELSE b[1].y END, CASE WHEN f THEN x ELSE b[1].x END,
    CASE WHEN f THEN level ELSE b[1].d END, CASE WHEN f THEN total ELSE total + b[1].len END,
    CASE WHEN f THEN path ELSE list_append(path, {'z': b[1].z, 'y': b[1].y, 'x': b[1].x}) END, f, NOT f AND total + b[1].len < 10.0 AND step + 1 < 20
  FROM (SELECT *, coalesce(total >= 3.0 AND b[1].score - b[2].score < 0.25 AND abs(b[1].d - b[2].d) < 1.2, false) AS f FROM (
    SELECT w.case_id, w.inst_id, w.step, w.z, w.y, w.x, w.level, w.total, w.path,
      list_sort(list({'score': 1.6*(c.d - w.level) + 0.5*c.dp - 0.05*o.len, 'z': c.z, 'y': c.y, 'x': c.x, 'd': c.d, 'len': o.len}), 'DESC') AS b
    FROM w, steps o JOIN cells c ON c.case_id=w.case_id AND c.inst_id=w.inst_id AND c.z=w.z+o.dz AND c.y=w.y+o.dy AND c.x=w.x+o.dx
    WHERE w.live AND o.rank > 1 AND c.d >= w.level - 0.35 AND NOT list_contains(w.path, {'z': c.z, 'y': c.y, 'x': c.x}) GROUP BY ALL))),
points AS (SELECT case_id, inst_id, step, z, y, x, total, bool_or(fork) AS fork FROM w GROUP BY ALL)
"""

WALKS = _WALKS + "SELECT case_id, inst_id, step, z, y, x, round(total, 6) AS cum_mm FROM points"
SUMMARY = _WALKS + """,
used AS (SELECT *, coalesce(max(total) OVER (PARTITION BY case_id, inst_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) < 5.0 AS u,
  z*1.5::DOUBLE AS pz, y*0.8::DOUBLE AS py, x*0.8::DOUBLE AS px FROM points),
g AS (SELECT case_id, inst_id, max(total) AS walk_mm, bool_or(fork) AS fork, min(step) FILTER (total >= 5.0) AS hit,
    min_by({'z': z, 'y': y, 'x': x}, step) FILTER (total >= 5.0) AS seed, max_by({'z': z, 'y': y, 'x': x}, step) AS tip, count(*) FILTER (u) AS n,
    min_by({'z': pz, 'y': py, 'x': px}, step) AS p0, max_by({'z': pz, 'y': py, 'x': px}, step) FILTER (u) AS p1,
    covar_pop(pz,pz) FILTER (u) AS aa, covar_pop(py,py) FILTER (u) AS bb, covar_pop(px,px) FILTER (u) AS cc, covar_pop(pz,py) FILTER (u) AS ab, covar_pop(pz,px) FILTER (u) AS ac, covar_pop(py,px) FILTER (u) AS bc
  FROM used GROUP BY 1, 2),
e1 AS (SELECT *, (aa+bb+cc)/3 AS q, p1.z-p0.z AS tz, p1.y-p0.y AS ty, p1.x-p0.x AS tx FROM g),
e2 AS (SELECT *, sqrt(((aa-q)*(aa-q)+(bb-q)*(bb-q)+(cc-q)*(cc-q)+2*(ab*ab+ac*ac+bc*bc))/6) AS p, sqrt(tz*tz+ty*ty+tx*tx) AS tn FROM e1),
e3 AS (SELECT *, CASE WHEN p > 1e-300 THEN q+2*p*cos(acos(least(greatest(((aa-q)*((bb-q)*(cc-q)-bc*bc)-ab*(ab*(cc-q)-bc*ac)+ac*(ab*bc-(bb-q)*ac))/(2*p*p*p), -1.0), 1.0))/3) ELSE q END AS e FROM e2),
e4 AS (SELECT *,
  [{'a': ab*bc-ac*(bb-e), 'b': ac*ab-(aa-e)*bc, 'c': (aa-e)*(bb-e)-ab*ab}, {'a': ab*(cc-e)-ac*bc, 'b': ac*ac-(aa-e)*(cc-e), 'c': (aa-e)*bc-ab*ac},
   {'a': (bb-e)*(cc-e)-bc*bc, 'b': bc*ac-ab*(cc-e), 'c': ab*bc-(bb-e)*ac}] AS v FROM e3),
e5 AS (SELECT *, list_sort([{'n': i.a*i.a+i.b*i.b+i.c*i.c, 'a': i.a, 'b': i.b, 'c': i.c} FOR i IN v], 'DESC')[1] AS m FROM e4),
e6 AS (SELECT *, CASE WHEN m.a*tz+m.b*ty+m.c*tx < 0 THEN -1.0 ELSE 1.0 END / sqrt(m.n) AS s FROM e5)
SELECT case_id, inst_id, hit IS NOT NULL OR (walk_mm > 0 AND walk_mm >= 4.25) AS seed_ok, fork, round(walk_mm, 6) AS walk_mm,
  CASE WHEN hit IS NULL THEN tip.z ELSE seed.z END::DOUBLE AS seed_z, CASE WHEN hit IS NULL THEN tip.y ELSE seed.y END::DOUBLE AS seed_y, CASE WHEN hit IS NULL THEN tip.x ELSE seed.x END::DOUBLE AS seed_x,
  round(CASE WHEN n >= 4 THEN m.a*s WHEN tn > 1e-8 THEN tz/tn ELSE 1.0 END, 6) + 0.0 AS head_z, round(CASE WHEN n >= 4 THEN m.b*s WHEN tn > 1e-8 THEN ty/tn ELSE 0.0 END, 6) + 0.0 AS head_y,
  round(CASE WHEN n >= 4 THEN m.c*s WHEN tn > 1e-8 THEN tx/tn ELSE 0.0 END, 6) + 0.0 AS head_x
FROM e6
"""

_MARKERS = "WITH RECURSIVE " + ",\n".join([_LAT, BOX27, CAL, DIST, TUBED, THR, SEEDED.replace("sd AS (", "sd AS MATERIALIZED (", 1), CAPC]) + """,
mk AS MATERIALIZED (SELECT sd.case_id, (CAST(z AS BIGINT)*1048576+y)*1048576+x AS k, z, y, x FROM sd JOIN cp ON cp.case_id=sd.case_id
  WHERE seed AND NOT (lo_cap AND z < z_first+2) AND NOT (hi_cap AND z >= z_last-1)),
me AS MATERIALIZED (SELECT a.case_id, a.k AS a, b.k AS b FROM mk a, o27 o JOIN mk b ON b.case_id=a.case_id AND b.z=a.z+o.dz AND b.y=a.y+o.dy AND b.x=a.x+o.dx AND b.k <> a.k),
mr(case_id, k, root) USING KEY (case_id, k) AS (
  SELECT case_id, k, k FROM mk
  UNION
  SELECT c.case_id, c.b, c.root FROM (SELECT r.case_id, me.b, min(r.root) AS root FROM mr r JOIN me ON me.case_id=r.case_id AND me.a=r.k GROUP BY 1, 2) c
  JOIN recurring.mr o ON o.case_id=c.case_id AND o.k=c.b WHERE c.root < o.root),
mp AS MATERIALIZED (SELECT mr.case_id, mr.root, avg(z)*1.5 AS pz, avg(y)*0.8 AS py, avg(x)*0.8 AS px FROM mr JOIN mk ON mk.case_id=mr.case_id AND mk.k=mr.k GROUP BY 1, 2),
mc(case_id, root, cluster) USING KEY (case_id, root) AS (
  SELECT case_id, root, root FROM mp
  UNION
  SELECT c.case_id, c.b, c.cluster FROM (SELECT r.case_id, b.root AS b, min(r.cluster) AS cluster FROM mc r JOIN mp a ON a.case_id=r.case_id AND a.root=r.root
    JOIN mp b ON b.case_id=a.case_id AND b.root <> a.root AND sqrt((a.pz-b.pz)*(a.pz-b.pz)+(a.py-b.py)*(a.py-b.py)+(a.px-b.px)*(a.px-b.px)) <= 3.5 GROUP BY 1, 2) c
  JOIN recurring.mc o ON o.case_id=c.case_id AND o.root=c.b WHERE c.cluster < o.cluster),
ml AS MATERIALIZED (SELECT mk.case_id, mk.z, mk.y, mk.x, dense_rank() OVER (PARTITION BY mk.case_id ORDER BY cluster) AS label
  FROM mk JOIN mr ON mr.case_id=mk.case_id AND mr.k=mk.k JOIN mc ON mc.case_id=mr.case_id AND mc.root=mr.root)"""
MARKERS = _MARKERS + "SELECT case_id, z, y, x, label FROM ml"
GROWN = _MARKERS + """,
free AS MATERIALIZED (SELECT case_id, z, y, x FROM sd WHERE allowed),
steps AS MATERIALIZED (SELECT *, CAST(round(sqrt((dz*1.5)*(dz*1.5)+(dy*0.8)*(dy*0.8)+(dx*0.8)*(dx*0.8))*1000) AS BIGINT) AS cost FROM o27 WHERE NOT (dz = 0 AND dy = 0 AND dx = 0)),
gw(case_id, z, y, x, d, label) USING KEY (case_id, z, y, x) AS (
  SELECT ml.case_id, ml.z, ml.y, ml.x, 0::BIGINT, label FROM ml JOIN free USING (case_id, z, y, x)
  UNION
  SELECT c.case_id, c.z, c.y, c.x, c.b.d, c.b.label FROM (
    SELECT i.case_id, i.z, i.y, i.x, min({'d': r.d + o.cost, 'label': r.label}) AS b
    FROM gw r, steps o JOIN free i ON i.case_id = r.case_id AND i.z = r.z + o.dz AND i.y = r.y + o.dy AND i.x = r.x + o.dx GROUP BY ALL) c
  LEFT JOIN recurring.gw k ON k.case_id = c.case_id AND k.z = c.z AND k.y = c.y AND k.x = c.x
  WHERE k.d IS NULL OR c.b.d < k.d OR (c.b.d = k.d AND c.b.label < k.label))
SELECT case_id, z, y, x, label, round(d / 1000.0, 6) AS geo_mm FROM gw"""
