"""SQL twins of the voxel queries."""

from __future__ import annotations

from lumenframe.plans.catalog.tube_sql import TUBE
from lumenframe.plans.catalog.views import LAT, with_sql

BOX27 = "o27 AS (SELECT dz, dy, dx FROM (SELECT unnest(range(-1,2)) AS dz), (SELECT unnest(range(-1,2)) AS dy), (SELECT unnest(range(-1,2)) AS dx))"
FACE6 = "o6 AS (SELECT * FROM (VALUES (-1,0,0),(1,0,0),(0,-1,0),(0,1,0),(0,0,-1),(0,0,1)) t(dz,dy,dx))"
INST = "inst AS (SELECT *, CAST(floor(z/4.0) AS INT) AS inst_id FROM lat WHERE hu > 700 AND NOT parent)"


def _cell(e="", a="a", o="o"):
    return f"CAST({a}.z+{o}.dz AS INT) AS z, CAST({a}.y+{o}.dy AS INT) AS y, CAST({a}.x+{o}.dx AS INT) AS x"


CAL = """cq AS (SELECT case_id, count(*) AS n_voxels, max(hu) AS mx, quantile_cont(hu,0.05) AS p05, quantile_cont(hu,0.10) AS p10, quantile_cont(hu,0.50) AS p50,
    quantile_cont(hu,0.90) AS p90, quantile_cont(hu,0.95) AS p95, quantile_cont(hu,0.08) AS lo8, quantile_cont(hu,0.92) AS hi92 FROM lat WHERE parent GROUP BY 1 HAVING count(*) >= 10),
 cl AS (SELECT *, greatest(lo8 - 0.2*greatest(p50-p10, 20.0), least(p05, 0.35*p50)) AS blood_low FROM cq),
 cal AS (SELECT *, CASE WHEN least(hi92+80.0, 850.0) <= blood_low+20.0 THEN least(mx, 850.0) ELSE least(hi92+80.0, 850.0) END AS blood_high FROM cl)"""
DIST = """ds AS (SELECT c.case_id, c.z, c.y, c.x, min(sqrt(((c.z-p.z)*1.5)*((c.z-p.z)*1.5) + ((c.y-p.y)*0.8)*((c.y-p.y)*0.8) + ((c.x-p.x)*0.8)*((c.x-p.x)*0.8))) AS d
   FROM lat c JOIN (SELECT * FROM lat WHERE parent) p ON p.case_id=c.case_id GROUP BY 1,2,3,4)"""
ZONES = """zn AS (SELECT lat.*, ds.d, cal.p10, cal.p50, cal.p95, cal.blood_low, cal.blood_high, hu BETWEEN blood_low AND blood_high AND NOT parent AS blood, d > 0 AND d <= 14.0 AS shell, 0.0::DOUBLE AS v
   FROM lat JOIN ds ON ds.case_id=lat.case_id AND ds.z=lat.z AND ds.y=lat.y AND ds.x=lat.x JOIN cal ON cal.case_id=lat.case_id),
 zm AS (SELECT *, blood AND d > 0 AND d <= 2.5 AS ring, blood AND d > 2.5 AND d <= 14.0 AS outward FROM zn)"""
#: Zones with the tube response, and what they need before them.
_LAT = LAT.replace("lat AS (", "lat AS MATERIALIZED (", 1)
TUBED = TUBE + ",\n" + ZONES.replace("0.0::DOUBLE AS v", "tube.v").replace("JOIN cal ON", "JOIN tube ON tube.case_id=lat.case_id AND tube.z=lat.z AND tube.y=lat.y AND tube.x=lat.x JOIN cal ON", 1)
THR = "th AS (SELECT c.case_id, greatest(CAST(0.015 AS DOUBLE), 0.35*coalesce(q, 0.0)) AS t FROM (SELECT DISTINCT case_id FROM lat) c LEFT JOIN (SELECT case_id, quantile_cont(CAST(v AS DOUBLE), 0.7) AS q FROM zm WHERE blood AND shell GROUP BY 1) s ON s.case_id=c.case_id)"
SEEDED = """rc AS (SELECT DISTINCT a.case_id, a.z+o.dz AS z, a.y+o.dy AS y, a.x+o.dx AS x FROM zm a, o27 o WHERE a.outward),
 sd AS (SELECT zm.*, th.t, ring AND (rc.z IS NOT NULL OR v >= t) AS seed, (hu BETWEEN p10 AND blood_high AND NOT parent AND shell) OR (blood AND shell AND v >= t*0.6) AS allowed
   FROM zm JOIN th ON th.case_id=zm.case_id LEFT JOIN rc ON rc.case_id=zm.case_id AND rc.z=zm.z AND rc.y=zm.y AND rc.x=zm.x)"""
CAPC = """cp AS (SELECT case_id, min(z) AS z_first, max(z) AS z_last, min_by(n, z) >= 8 AS lo_cap, max_by(n, z) >= 8 AS hi_cap FROM (SELECT case_id, z, count(*) AS n FROM lat WHERE parent GROUP BY 1,2) GROUP BY 1)"""
GRIDC = "gr AS (SELECT case_id, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT DISTINCT case_id FROM lat), (SELECT unnest(range(0,24)) AS z), (SELECT unnest(range(0,24)) AS y), (SELECT unnest(range(0,24)) AS x))"
CONT = """pd AS (SELECT DISTINCT a.case_id, a.z+o.dz AS z, a.y+o.dy AS y, a.x+o.dx AS x FROM lat a, o27 o WHERE a.parent),
 ct AS (SELECT i.* FROM inst i JOIN pd ON pd.case_id=i.case_id AND pd.z=i.z AND pd.y=i.y AND pd.x=i.x)"""
OST = """oc AS (SELECT DISTINCT c.case_id, c.inst_id, p.z, p.y, p.x FROM ct c, o27 o JOIN lat p ON p.parent AND p.case_id=c.case_id AND p.z=c.z+o.dz AND p.y=c.y+o.dy AND p.x=c.x+o.dx),
 os AS (SELECT case_id, inst_id, avg(z) AS oz, avg(y) AS oy, avg(x) AS ox FROM oc GROUP BY 1,2)"""
HEAD = """hd AS (SELECT os.*, c.cz, c.cy, c.cx, (cz-oz)*1.5 AS hz, (cy-oy)*0.8 AS hy, (cx-ox)*0.8 AS hx FROM os JOIN (SELECT case_id, inst_id, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx FROM inst GROUP BY 1,2) c ON c.case_id=os.case_id AND c.inst_id=os.inst_id)"""


def _depth(sets: str, key: str = "") -> str:
    k = "".join(f" AND g.{c}=s.{c}" for c in key.split(",") if c)
    cols = ("s.case_id, " + "".join(f"s.{c}, " for c in key.split(",") if c)) + "s.z, s.y, s.x"
    return f"""SELECT {cols}, min(sqrt(((s.z-g.z)*1.5)*((s.z-g.z)*1.5)+((s.y-g.y)*0.8)*((s.y-g.y)*0.8)+((s.x-g.x)*0.8)*((s.x-g.x)*0.8))) AS dp
  FROM {sets} s JOIN rim g ON g.case_id=s.case_id{k} GROUP BY ALL"""


RIM = """rim AS (SELECT DISTINCT g.case_id, g.z, g.y, g.x FROM st a, o6 o JOIN gr g ON g.case_id=a.case_id AND g.z=a.z+o.dz AND g.y=a.y+o.dy AND g.x=a.x+o.dx
   WHERE NOT EXISTS (SELECT 1 FROM st b WHERE b.case_id=g.case_id AND b.z=g.z AND b.y=g.y AND b.x=g.x))"""
RIM_I = """rim AS (SELECT DISTINCT g.case_id, a.inst_id, g.z, g.y, g.x FROM inst a, o6 o JOIN gr g ON g.case_id=a.case_id AND g.z=a.z+o.dz AND g.y=a.y+o.dy AND g.x=a.x+o.dx
   WHERE NOT EXISTS (SELECT 1 FROM inst b WHERE b.case_id=g.case_id AND b.inst_id=a.inst_id AND b.z=g.z AND b.y=g.y AND b.x=g.x))"""
EIG = """mo AS (SELECT case_id, inst_id, count(*) AS n, covar_pop(pz,pz) AS aa, covar_pop(py,py) AS bb, covar_pop(px,px) AS cc, covar_pop(pz,py) AS ab, covar_pop(pz,px) AS ac, covar_pop(py,px) AS bc
    FROM (SELECT case_id, inst_id, z*1.5::DOUBLE AS pz, y*0.8::DOUBLE AS py, x*0.8::DOUBLE AS px FROM inst) GROUP BY 1,2),
 m1 AS (SELECT *, (aa+bb+cc)/3 AS q, ab*ab+ac*ac+bc*bc AS f FROM mo),
 m2 AS (SELECT *, sqrt(((aa-q)*(aa-q)+(bb-q)*(bb-q)+(cc-q)*(cc-q)+2*f)/6) AS p FROM m1),
 m3 AS (SELECT *, CASE WHEN p > 1e-300 THEN least(greatest(((aa-q)*((bb-q)*(cc-q)-bc*bc)-ab*(ab*(cc-q)-bc*ac)+ac*(ab*bc-(bb-q)*ac))/(2*p*p*p), -1.0), 1.0) ELSE 1.0 END AS r FROM m2),
 m4 AS (SELECT *, q+2*p*cos(acos(r)/3) AS e1, q+2*p*cos(acos(r)/3+2.0943951023931953) AS e3 FROM m3),
 sv AS (SELECT case_id, inst_id, n, sqrt(greatest(n*e1,0)) AS sv1, sqrt(greatest(n*(3*q-e1-e3),0)) AS sv2, sqrt(greatest(n*e3,0)) AS sv3 FROM m4)"""

TUBE_FILTER = with_sql(_LAT, TUBE) + "SELECT case_id, z, y, x, round(v, 5) AS vesselness FROM tube"
CALIBRATION = with_sql(LAT, CAL) + "SELECT case_id, n_voxels, " + ", ".join(f"round({c},6) AS {c}" for c in ("p05", "p10", "p50", "p90", "p95", "blood_low", "blood_high")) + ", round(0.55*p50+0.45*blood_low,6) AS strict_low FROM cal"
BLOOD_COUNTS = with_sql(LAT, CAL) + "SELECT lat.case_id, CAST(count_if(hu BETWEEN blood_low AND blood_high AND NOT parent) AS BIGINT) AS n_blood, count(*) AS n FROM lat JOIN cal ON cal.case_id=lat.case_id GROUP BY 1"
ZONE_COUNTS = with_sql(LAT, CAL, DIST, ZONES) + "SELECT case_id, CAST(count_if(shell) AS BIGINT) AS n_shell, CAST(count_if(ring) AS BIGINT) AS n_ring, CAST(count_if(outward) AS BIGINT) AS n_outward FROM zm GROUP BY 1"
_BOX = "bx AS (SELECT case_id, CAST(greatest(min(z)-2,0) AS INT) AS z0, CAST(least(max(z)+2,23) AS INT) AS z1, CAST(greatest(min(y)-3,0) AS INT) AS y0, CAST(least(max(y)+3,23) AS INT) AS y1, CAST(greatest(min(x)-3,0) AS INT) AS x0, CAST(least(max(x)+3,23) AS INT) AS x1 FROM lat WHERE parent GROUP BY 1)"
ROI_BOX = with_sql(LAT, _BOX) + "SELECT * FROM bx"
ROI_CROP = with_sql(LAT, _BOX) + "SELECT lat.case_id, z, y, x, round(hu,6) AS hu FROM lat JOIN bx ON bx.case_id=lat.case_id WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1"
DILATE26 = with_sql(LAT, BOX27) + f"SELECT DISTINCT a.case_id, {_cell()} FROM lat a, o27 o WHERE a.parent"
ERODE6 = with_sql(LAT, FACE6, "m AS (SELECT * FROM lat WHERE hu > 250)") + "SELECT a.case_id, a.z, a.y, a.x FROM m a, o6 o JOIN m b ON b.case_id=a.case_id AND b.z=a.z+o.dz AND b.y=a.y+o.dy AND b.x=a.x+o.dx GROUP BY ALL HAVING count(*) = 6"
_BALL = "bl AS (SELECT dz, dy, dx FROM (SELECT unnest(range(-3,4)) AS dz), (SELECT unnest(range(-3,4)) AS dy), (SELECT unnest(range(-3,4)) AS dx) WHERE (dz*1.5)*(dz*1.5)+(dy*0.8)*(dy*0.8)+(dx*0.8)*(dx*0.8) <= {r}*{r}+1e-6)"
BALL_DILATION = with_sql(LAT, _BALL.format(r="1.7")) + f"SELECT DISTINCT a.case_id, {_cell()} FROM lat a, bl o WHERE a.hu > 1000"
BALL_OPENING = with_sql(LAT, _BALL.format(r="0.9"), "m AS (SELECT * FROM lat WHERE hu > 150)", "er AS (SELECT a.case_id, a.z, a.y, a.x FROM m a, bl o JOIN m b ON b.case_id=a.case_id AND b.z=a.z+o.dz AND b.y=a.y+o.dy AND b.x=a.x+o.dx GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM bl))") + f"SELECT DISTINCT a.case_id, {_cell()} FROM er a, bl o"
SURFACE = with_sql(LAT, FACE6) + "SELECT case_id, z, y, x FROM lat WHERE parent EXCEPT SELECT a.case_id, a.z, a.y, a.x FROM lat a, o6 o JOIN lat b ON b.parent AND b.case_id=a.case_id AND b.z=a.z+o.dz AND b.y=a.y+o.dy AND b.x=a.x+o.dx WHERE a.parent GROUP BY ALL HAVING count(*) = 6"
CONTACT = with_sql(LAT, BOX27, INST, CONT) + "SELECT case_id, inst_id, z, y, x FROM ct"
OSTIUM = with_sql(LAT, BOX27, INST, CONT, OST) + "SELECT case_id, inst_id, round(oz,6) AS oz, round(oy,6) AS oy, round(ox,6) AS ox FROM os"
FACES = with_sql(LAT, FACE6, INST) + "SELECT a.case_id, a.inst_id, count(*) AS face_contacts FROM inst a, o6 o JOIN lat p ON p.parent AND p.case_id=a.case_id AND p.z=a.z+o.dz AND p.y=a.y+o.dy AND p.x=a.x+o.dx GROUP BY 1,2"
DISTANCE = with_sql(LAT, DIST) + "SELECT case_id, z, y, x, round(d,6) AS dist_mm FROM ds WHERE d <= 14.0"
DEPTH = with_sql(LAT, FACE6, GRIDC, "st AS (SELECT * FROM lat WHERE parent OR hu > 700)", RIM) + "SELECT case_id, z, y, x, round(dp,6) AS depth_mm FROM (" + _depth("st") + ")"
INSTANCE_DEPTH = with_sql(LAT, FACE6, GRIDC, INST, RIM_I) + "SELECT case_id, inst_id, z, y, x, round(dp,6) AS depth_mm FROM (" + _depth("inst", "inst_id") + ")"
TUBE_THRESHOLD = with_sql(_LAT, CAL, DIST, TUBED, THR) + "SELECT case_id, round(t,6) AS v_thresh FROM th"
SEEDS = with_sql(_LAT, BOX27, CAL, DIST, TUBED, THR, SEEDED) + "SELECT case_id, z, y, x FROM sd WHERE seed"
ALLOWED = with_sql(_LAT, BOX27, CAL, DIST, TUBED, THR, SEEDED) + "SELECT case_id, z, y, x FROM sd WHERE allowed"
SHEET = with_sql(_LAT, BOX27, CAL, DIST, TUBED, THR, SEEDED) + "SELECT case_id, CAST(count_if(ring AND NOT seed) AS BIGINT) AS n_sheet, CAST(count_if(seed) AS BIGINT) AS n_seed FROM sd GROUP BY 1"
CAPS = with_sql(LAT, CAPC) + "SELECT * FROM cp"
CAP_DROP = with_sql(_LAT, BOX27, CAL, DIST, TUBED, THR, SEEDED, CAPC) + "SELECT sd.case_id, z, y, x FROM sd JOIN cp ON cp.case_id=sd.case_id WHERE seed AND NOT (lo_cap AND z < z_first+2) AND NOT (hi_cap AND z >= z_last-1)"


_COMPONENTS = "WITH RECURSIVE " + LAT + ",\n" + CAL + ",\n" + BOX27 + """,
 m AS MATERIALIZED (SELECT lat.case_id, (CAST(z AS BIGINT)*1048576+y)*1048576+x AS k, z, y, x FROM lat JOIN cal ON cal.case_id=lat.case_id WHERE hu BETWEEN blood_low AND blood_high AND NOT parent),
 e AS MATERIALIZED (SELECT a.case_id, a.k AS a, b.k AS b FROM m a, o27 o JOIN m b ON b.case_id=a.case_id AND b.z=a.z+o.dz AND b.y=a.y+o.dy AND b.x=a.x+o.dx AND b.k <> a.k),
 reach(case_id, k, root) USING KEY (case_id, k) AS (
  SELECT case_id, k, k FROM m
  UNION
  SELECT c.case_id, c.b, c.root FROM (SELECT r.case_id, e.b, min(r.root) AS root FROM reach r JOIN e ON e.case_id=r.case_id AND e.a=r.k GROUP BY 1, 2) c
  JOIN recurring.reach o ON o.case_id=c.case_id AND o.k=c.b WHERE c.root < o.root),
 lb AS (SELECT m.case_id, m.z, m.y, m.x, dense_rank() OVER (PARTITION BY m.case_id ORDER BY root) AS label FROM m JOIN reach ON reach.case_id=m.case_id AND reach.k=m.k)
"""


COMPONENTS = _COMPONENTS + "SELECT case_id, z, y, x, label FROM lb"
PATCHES = _COMPONENTS + "SELECT case_id, label, count(*) AS n, round(avg(z),6) AS cz, round(avg(y),6) AS cy, round(avg(x),6) AS cx FROM lb GROUP BY 1,2"
PCA = with_sql(LAT, INST, EIG) + "SELECT case_id, inst_id, n AS n_voxels, round(sv1,4) AS sv1, round(sv2,4) AS sv2, round(sv3,4) AS sv3 FROM sv"
SPREAD = with_sql(LAT, BOX27, INST, CONT) + ", m AS (SELECT case_id, inst_id, avg(z*1.5) AS a, avg(y*0.8) AS b, avg(x*0.8) AS c, count(*) AS n FROM ct GROUP BY 1,2) SELECT ct.case_id, ct.inst_id, any_value(n) AS n_contact, round(max(sqrt((z*1.5-a)*(z*1.5-a)+(y*0.8-b)*(y*0.8-b)+(x*0.8-c)*(x*0.8-c))),6) AS contact_spread_mm FROM ct JOIN m ON m.case_id=ct.case_id AND m.inst_id=ct.inst_id GROUP BY 1,2"
DIAMETER = with_sql(LAT, BOX27, FACE6, GRIDC, "st AS (SELECT * FROM lat WHERE parent OR hu > 700)", RIM, INST, CONT, "dp AS (" + _depth("st") + ")") + "SELECT ct.case_id, inst_id, count(*) AS n_contact, round(greatest(2*sqrt(count(*)*pow(CAST(1.5*0.8*0.8 AS DOUBLE), 2.0/3.0)/pi()), 2*max(dp)),6) AS diameter_mm FROM ct JOIN dp ON dp.case_id=ct.case_id AND dp.z=ct.z AND dp.y=ct.y AND dp.x=ct.x GROUP BY 1,2"
SPAN = with_sql(LAT, BOX27, INST, CONT, OST) + "SELECT i.case_id, i.inst_id, round(max(sqrt(((z-oz)*1.5)*((z-oz)*1.5)+((y-oy)*0.8)*((y-oy)*0.8)+((x-ox)*0.8)*((x-ox)*0.8))),6) AS span_mm FROM inst i JOIN os ON os.case_id=i.case_id AND os.inst_id=i.inst_id GROUP BY 1,2"
FALLBACK = with_sql(LAT, BOX27, DIST, INST, CONT, OST) + """, f AS (SELECT i.case_id, i.inst_id, i.z, i.y, i.x, ds.d, ((i.z-oz)*1.5)*((i.z-oz)*1.5)+((i.y-oy)*0.8)*((i.y-oy)*0.8)+((i.x-ox)*0.8)*((i.x-ox)*0.8) AS d2
  FROM inst i JOIN os ON os.case_id=i.case_id AND os.inst_id=i.inst_id JOIN ds ON ds.case_id=i.case_id AND ds.z=i.z AND ds.y=i.y AND ds.x=i.x WHERE ds.d <= 14.0),
 g AS (SELECT *, row_number() OVER (PARTITION BY case_id, inst_id ORDER BY CASE WHEN d >= 5.0 THEN 0 WHEN d2 >= 25.0 THEN 1 ELSE 2 END, abs(d2-25.0)-2*d, z, y, x) AS rn FROM f)
SELECT case_id, inst_id, CAST(z AS DOUBLE) AS far_z, CAST(y AS DOUBLE) AS far_y, CAST(x AS DOUBLE) AS far_x FROM g WHERE rn = 1 AND (d >= 5.0 OR d2 >= 25.0)"""
CONTEXT = with_sql(LAT, BOX27, CAL, DIST, ZONES, INST, CONT, OST, HEAD) + """, hn AS (SELECT *, sqrt(hz*hz+hy*hy+hx*hx) AS n FROM hd),
 cx AS (SELECT h.case_id, h.inst_id, z.hu, z.blood, greatest(blood_high, p95+40.0) AS bone, ((z.z-oz)*1.5)*((z.z-oz)*1.5)+((z.y-oy)*0.8)*((z.y-oy)*0.8)+((z.x-ox)*0.8)*((z.x-ox)*0.8) AS d2, (z.z-oz)*1.5*(hz/n)+(z.y-oy)*0.8*(hy/n)+(z.x-ox)*0.8*(hx/n) AS ax
   FROM hn h JOIN zm z ON z.case_id=h.case_id AND NOT z.parent WHERE n >= 1e-8),
 cc AS (SELECT case_id, inst_id, avg(CASE WHEN hu >= bone THEN 1.0 ELSE 0.0 END) AS b, least(1.0, sum(CASE WHEN blood AND d2-ax*ax > 2.6*2.6 THEN 1.5*0.8*0.8 ELSE 0 END)/(2.0/3.0*pi()*125)) AS a FROM cx WHERE sqrt(d2) <= 5.0 AND ax >= -1.0 GROUP BY 1,2)
SELECT os.case_id, os.inst_id, round(coalesce(b,0.0),6) AS bone_frac, round(coalesce(a,0.0),6) AS adj_lumen_frac FROM os LEFT JOIN cc ON cc.case_id=os.case_id AND cc.inst_id=os.inst_id"""
PLANE_RADIUS = with_sql(LAT, BOX27, CAL, INST, CONT, OST, HEAD) + """, hn AS (SELECT *, sqrt(hz*hz+hy*hy+hx*hx) AS n FROM hd),
 h2 AS (SELECT case_id, inst_id, cz, cy, cx, hz/n AS dz, hy/n AS dy, hx/n AS dx FROM hn WHERE n >= 1e-8),
 h3 AS (SELECT *, CASE WHEN abs(dz)<0.9 THEN dy*0.0-dx*0.0 ELSE dy*0.0-dx*1.0 END AS q0, CASE WHEN abs(dz)<0.9 THEN dx*1.0-dz*0.0 ELSE dx*0.0-dz*0.0 END AS q1, CASE WHEN abs(dz)<0.9 THEN dz*0.0-dy*1.0 ELSE dz*1.0-dy*0.0 END AS q2 FROM h2),
 h4 AS (SELECT *, q0/sqrt(q0*q0+q1*q1+q2*q2) AS a1z, q1/sqrt(q0*q0+q1*q1+q2*q2) AS a1y, q2/sqrt(q0*q0+q1*q1+q2*q2) AS a1x FROM h3),
 h5 AS (SELECT *, dy*a1x-dx*a1y AS a2z, dx*a1z-dz*a1x AS a2y, dz*a1y-dy*a1z AS a2x FROM h4),
 sm AS (SELECT h5.*, i*0.4::DOUBLE AS u, j*0.4::DOUBLE AS v FROM h5, (SELECT unnest(range(-10,11)) AS i), (SELECT unnest(range(-10,11)) AS j) WHERE (i*0.4::DOUBLE)*(i*0.4::DOUBLE)+(j*0.4::DOUBLE)*(j*0.4::DOUBLE) <= 16.0),
 sn AS (SELECT case_id, inst_id, CAST(round_even(cz+(u*a1z+v*a2z)/1.5, 0) AS INT) AS z, CAST(round_even(cy+(u*a1y+v*a2y)/0.8, 0) AS INT) AS y, CAST(round_even(cx+(u*a1x+v*a2x)/0.8, 0) AS INT) AS x FROM sm),
 ht AS (SELECT sn.case_id, inst_id, count(*) AS n FROM sn JOIN lat ON lat.case_id=sn.case_id AND lat.z=sn.z AND lat.y=sn.y AND lat.x=sn.x JOIN cal ON cal.case_id=sn.case_id WHERE hu BETWEEN blood_low AND blood_high GROUP BY 1,2)
SELECT hd.case_id, hd.inst_id, round(coalesce(sqrt(ht.n*0.4*0.4/pi()), 0.0),6) AS plane_radius_mm FROM hd LEFT JOIN ht ON ht.case_id=hd.case_id AND ht.inst_id=hd.inst_id"""
QUALITY = with_sql(_LAT, BOX27, CAL, DIST, TUBED, THR, "inst AS (SELECT case_id, z, y, x, hu, v, CAST(floor(z/4.0) AS INT)*24+y AS inst_id FROM zm WHERE hu > 700 AND NOT parent)", CONT, EIG) + """,
 iv AS (SELECT case_id, inst_id, avg(hu) AS mh, quantile_cont(CAST(v AS DOUBLE), 0.5) AS mv FROM inst GROUP BY 1,2),
 nc AS (SELECT case_id, inst_id, count(*) AS k FROM ct GROUP BY 1,2),
 fe AS (SELECT sv.case_id, sv.inst_id, sv.n, sv1, sv2, mh, mv, coalesce(k,0) AS k, p10, p50, blood_low, t FROM sv JOIN iv ON iv.case_id=sv.case_id AND iv.inst_id=sv.inst_id LEFT JOIN nc ON nc.case_id=sv.case_id AND nc.inst_id=sv.inst_id JOIN cal ON cal.case_id=sv.case_id JOIN th ON th.case_id=sv.case_id)
SELECT case_id, CAST(inst_id AS INT) AS inst_id, CASE WHEN n < 4 THEN 'too_few_voxels' WHEN sv1 < 3.2 THEN 'short_axis' WHEN sv1/greatest(sv2,1e-3) < 1.15 THEN 'blob_aniso' WHEN mh < least(p10, 0.45*p50+0.55*blood_low) THEN 'dim_hu'
  WHEN mh < 0.7*p50 AND mv < 0.4*t THEN 'low_vesselness' WHEN mv < 0.02 AND n > 400 AND 2*sqrt(k*pow(CAST(0.96 AS DOUBLE), 2.0/3.0)/pi()) < 6.5 THEN 'smear' WHEN n*0.96 < 20.0 THEN 'tiny_volume' END AS reason FROM fe"""
MIP = with_sql(LAT) + ", c AS (SELECT case_id, CAST(round_even(avg(z),0) AS INT) AS m FROM lat WHERE parent GROUP BY 1) SELECT lat.case_id, y, x, round(max(hu),6) AS mip, bool_or(parent) AS parent FROM lat JOIN c ON c.case_id=lat.case_id AND z BETWEEN m-2 AND m+2 GROUP BY 1,2,3"
WINDOW = with_sql(LAT) + ", w AS (SELECT case_id, quantile_cont(hu,0.05)-80.0 AS lo, quantile_cont(hu,0.95)+80.0 AS hi FROM lat WHERE parent GROUP BY 1) SELECT lat.case_id, z, y, x, round(least(greatest((hu-lo)/greatest(hi-lo,1.0),0.0),1.0),6) AS shade FROM lat JOIN w ON w.case_id=lat.case_id WHERE parent"
PLANES = with_sql(LAT) + """, c AS (SELECT case_id, CAST(round_even(avg(z),0) AS INT) AS mz, CAST(round_even(avg(y),0) AS INT) AS my, CAST(round_even(avg(x),0) AS INT) AS mx FROM lat WHERE parent GROUP BY 1)
SELECT lat.case_id, 'axial' AS view, x-mx AS u, y-my AS v, round(hu,6) AS hu, parent FROM lat JOIN c ON c.case_id=lat.case_id WHERE z=mz AND abs(y-my)<=6 AND abs(x-mx)<=6
UNION ALL SELECT lat.case_id, 'coronal', x-mx, z-mz, round(hu,6), parent FROM lat JOIN c ON c.case_id=lat.case_id WHERE y=my AND abs(z-mz)<=6 AND abs(x-mx)<=6
UNION ALL SELECT lat.case_id, 'sagittal', y-my, z-mz, round(hu,6), parent FROM lat JOIN c ON c.case_id=lat.case_id WHERE x=mx AND abs(z-mz)<=6 AND abs(y-my)<=6"""
_PTS = "pt AS (SELECT case_id, CAST(z*24*24+y*24+x AS INT) AS id, z, y, x FROM lat)"
SAMPLES = with_sql(LAT, _PTS) + "SELECT pt.case_id, id, round(hu,6) AS hu, parent FROM pt LEFT JOIN lat ON lat.case_id=pt.case_id AND lat.z=pt.z AND lat.y=pt.y+1 AND lat.x=pt.x"
_B75 = "b75 AS (SELECT dz, dy, dx FROM (SELECT unnest(range(-1,2)) AS dz), (SELECT unnest(range(-2,3)) AS dy), (SELECT unnest(range(-2,3)) AS dx))"
BALL_STATS = with_sql(LAT.replace("lat AS (", "lat AS MATERIALIZED (", 1), _PTS, _B75) + 'SELECT pt.case_id, id, count(*) AS n, round(min(hu),6) AS "min", round(quantile_cont(hu,0.5),6) AS p50, round(max(hu),6) AS "max" FROM pt, b75 JOIN lat ON lat.case_id=pt.case_id AND lat.z=pt.z+dz AND lat.y=pt.y+dy AND lat.x=pt.x+dx GROUP BY 1,2'
BALL_SHARE = with_sql(LAT.replace("lat AS (", "lat AS MATERIALIZED (", 1), _PTS, _B75) + 'SELECT pt.case_id, id, CAST(count_if(parent) AS BIGINT) AS "sum", round(avg(CASE WHEN parent THEN 1.0 ELSE 0.0 END),6) AS frac FROM pt, b75 JOIN lat ON lat.case_id=pt.case_id AND lat.z=pt.z+dz AND lat.y=pt.y+dy AND lat.x=pt.x+dx GROUP BY 1,2'
