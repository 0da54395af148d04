"""DuckDB SQL that tells the registered queries' rows in its own terms: nested loops where Spark joins on keys."""

from __future__ import annotations

import math

from ..params import CameraParams, FusionParams
from ..sources.fixtures import cte
from ..sources.poses import FLIGHT

HF, VF = math.radians(106.0), math.radians(86.0)
CAM, FUS = CameraParams(), FusionParams()


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


FILTERED = f"""{cte("fx_points")},
flt AS (SELECT *, x*x + y*y + z*z AS r_sq, atan2(y, x) AS yaw, atan2(z, sqrt(x*x + y*y)) AS pitch FROM fx_points
  WHERE x*x + y*y + z*z BETWEEN 0.1::DOUBLE*0.1::DOUBLE AND 100 AND z + 1.5 >= 0.2
    AND atan2(y, x) BETWEEN {-HF / 2}::DOUBLE AND {HF / 2}::DOUBLE AND atan2(z, sqrt(x*x + y*y)) BETWEEN {-VF / 2}::DOUBLE AND {VF / 2}::DOUBLE)"""
U = f"trunc((yaw + {HF / 2}::DOUBLE) * ({59 / HF}::DOUBLE) + 0.5)::INT"
V = f"trunc((pitch + {VF / 2}::DOUBLE) * ({44 / VF}::DOUBLE) + 0.5)::INT"
GRID = f"""{FILTERED},
cells AS (SELECT *, {U} AS u, {V} AS v FROM flt),
grid AS (SELECT scan_id, u, v, point_idx, x, y, z, r_sq, sqrt(r_sq) AS range FROM cells WHERE u < 60 AND v < 45
  QUALIFY row_number() OVER (PARTITION BY scan_id, u, v ORDER BY r_sq, point_idx) = 1)"""


def _near(alias: str) -> str:
    return f"{alias}.scan_id IS NOT NULL"


def smoothed(back: int, first: int) -> str:
    """Three bilateral passes along rows, then columns, by self-joins of neighbours at most 3 cells apart."""
    out, at = f"{GRID},\ns0 AS MATERIALIZED (SELECT scan_id, u, v, range AS g FROM grid)", 0
    for _ in range(3):
        for i, j in (("u", "v"), ("v", "u")):
            out += f""",
s{at + 1} AS MATERIALIZED (SELECT c.scan_id, c.u, c.v, CASE WHEN c.{i} < {first} THEN any_value(c.g) ELSE sum(n.g * exp(-(n.{i}-c.{i})*(n.{i}-c.{i})/2.0::DOUBLE) * exp(-(n.g-c.g)*(n.g-c.g)/{2 * 0.05**2}::DOUBLE))
    / sum(exp(-(n.{i}-c.{i})*(n.{i}-c.{i})/2.0::DOUBLE) * exp(-(n.g-c.g)*(n.g-c.g)/{2 * 0.05**2}::DOUBLE)) END AS g
  FROM s{at} c JOIN s{at} n ON n.scan_id = c.scan_id AND n.{j} = c.{j} AND n.{i} BETWEEN c.{i} - {back} AND c.{i} + 3 AND abs(n.g - c.g) <= 0.1::DOUBLE GROUP BY c.scan_id, c.u, c.v)"""
            at += 1
    return out


NORMALS = f"""{GRID},
nb AS (SELECT c.*, {", ".join(f"{n}.{a} AS {n}{a}" for n in "lrtd" for a in "xyz")}, {", ".join(f"{n}.u IS NOT NULL AS ok{n}" for n in "lrtd")}
  FROM grid c
  LEFT JOIN grid l ON l.scan_id = c.scan_id AND l.v = c.v AND l.u = c.u - 1 AND abs(l.range - c.range) <= 0.1
  LEFT JOIN grid r ON r.scan_id = c.scan_id AND r.v = c.v AND r.u = c.u + 1 AND abs(r.range - c.range) <= 0.1
  LEFT JOIN grid t ON t.scan_id = c.scan_id AND t.u = c.u AND t.v = c.v - 1 AND abs(t.range - c.range) <= 0.1
  LEFT JOIN grid d ON d.scan_id = c.scan_id AND d.u = c.u AND d.v = c.v + 1 AND abs(d.range - c.range) <= 0.1),
tg AS (SELECT scan_id, u, v, x, y, z,
  {", ".join(f"CASE WHEN okl AND okr THEN r{a} - l{a} WHEN okr THEN r{a} - {a} WHEN okl THEN {a} - l{a} END AS p{a}" for a in "xyz")},
  {", ".join(f"CASE WHEN okt AND okd THEN d{a} - t{a} WHEN okd THEN d{a} - {a} WHEN okt THEN {a} - t{a} END AS q{a}" for a in "xyz")} FROM nb),
cr AS (SELECT *, py*qz - pz*qy AS cx, pz*qx - px*qz AS cy, px*qy - py*qx AS cz FROM tg),
ln AS (SELECT *, sqrt(cx*cx + cy*cy + cz*cz) AS len, CASE WHEN cx*x + cy*y + cz*z > 0 THEN -1.0 ELSE 1.0 END AS s FROM cr),
nm AS (SELECT *, s*cx/len AS nx, s*cy/len AS ny, s*cz/len AS nz, len / (sqrt(px*px + py*py + pz*pz) * sqrt(qx*qx + qy*qy + qz*qz)) AS st FROM ln WHERE len >= 1e-6),
nw AS (SELECT *, 1/(1 + 0.01*(x*x + y*y + z*z)) * pow(abs((nx*x + ny*y + nz*z)/sqrt(x*x + y*y + z*z)), 1.5) * greatest(0, least(1, st)) AS w FROM nm)"""


def surfels(least: int) -> str:
    return f"""{cte("fx_pwn")},
k AS (SELECT *, floor(x/0.3::DOUBLE)::INT AS vx, floor(y/0.3::DOUBLE)::INT AS vy, floor(z/0.3::DOUBLE)::INT AS vz FROM fx_pwn),
o AS (SELECT *, x - (vx + 0.5)*0.3 AS dx, y - (vy + 0.5)*0.3 AS dy, z - (vz + 0.5)*0.3 AS dz, CASE WHEN w > 0.1 THEN w ELSE 0 END AS g FROM k),
mo AS (SELECT vx, vy, vz, count(*) FILTER (WHERE w > 0.1) AS count, count(*) AS n_points, sum(g) AS sum_w,
  sum(g*dx) AS wx, sum(g*dy) AS wy, sum(g*dz) AS wz, sum(g*dx*dx) AS wxx, sum(g*dx*dy) AS wxy, sum(g*dx*dz) AS wxz, sum(g*dy*dy) AS wyy, sum(g*dy*dz) AS wyz, sum(g*dz*dz) AS wzz,
  sum(g*nx) AS wnx, sum(g*ny) AS wny, sum(g*nz) AS wnz FROM o GROUP BY vx, vy, vz),
me AS (SELECT *, count >= {least} AND sum_w >= 1e-6 AS ok, wx/nullif(sum_w, 0) + (vx + 0.5)*0.3 AS mx, wy/nullif(sum_w, 0) + (vy + 0.5)*0.3 AS my, wz/nullif(sum_w, 0) + (vz + 0.5)*0.3 AS mz,
  {", ".join(f"w{a}{b} - w{a}*w{b}/nullif(sum_w, 0) AS s{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM mo),
co AS (SELECT *, {", ".join(f"CASE WHEN ok THEN s{q} / CASE WHEN sum_w > 1 THEN sum_w - 1 ELSE 1 END END AS c{q}" for q in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM me),
e1_ AS (SELECT *, (cxx + cyy + czz)/3 AS q FROM co),
e2_ AS (SELECT *, cxx - q AS a_, cyy - q AS b_, czz - q AS c_, cxy*cxy + cxz*cxz + cyz*cyz AS f_ FROM e1_),
e3_ AS (SELECT *, sqrt((a_*a_ + b_*b_ + c_*c_ + 2*f_)/6) AS p_, a_*(b_*c_ - cyz*cyz) - cxy*(cxy*c_ - cyz*cxz) + cxz*(cxy*cyz - b_*cxz) AS d_ FROM e2_),
e4_ AS (SELECT *, acos(greatest(-1, least(1, CASE WHEN p_ > 0 THEN d_/(2*p_*p_*p_) ELSE 0 END)))/3 AS h_ FROM e3_),
e5_ AS (SELECT *, q + 2*p_*cos(h_) AS l2, q + 2*p_*cos(h_ + {2 * math.pi / 3}::DOUBLE) AS l0 FROM e4_),
e6_ AS (SELECT *, CASE WHEN ok THEN greatest(0, l0) END AS e0, CASE WHEN ok THEN greatest(0, 3*q - l2 - l0) END AS e1, CASE WHEN ok THEN greatest(0, l2) END AS e2 FROM e5_),
sf AS (SELECT *, coalesce(ok AND greatest(e0, e1, e2) <= 5 AND (e0 > 1e-6)::INT + (e1 > 1e-6)::INT + (e2 > 1e-6)::INT >= 2
    AND CASE WHEN e1 > 1e-6 THEN e0/e1 < 1 ELSE true END, false) AS is_valid,
  coalesce(e0 < 0.01*e1, false) AS is_planar, coalesce(e1 < 0.1*e2, false) AS is_degenerate,
  cxx - e0 AS rxx, cyy - e0 AS ryy, czz - e0 AS rzz FROM e6_),
x1 AS (SELECT *, cxy*cyz - cxz*ryy AS ax, cxz*cxy - rxx*cyz AS ay, rxx*ryy - cxy*cxy AS az,
  cxy*rzz - cxz*cyz AS jx, cxz*cxz - rxx*rzz AS jy, rxx*cyz - cxy*cxz AS jz,
  ryy*rzz - cyz*cyz AS gx, cyz*cxz - cxy*rzz AS gy, cxy*cyz - ryy*cxz AS gz FROM sf),
x2 AS (SELECT *, ax*ax + ay*ay + az*az AS la, jx*jx + jy*jy + jz*jz AS lb, gx*gx + gy*gy + gz*gz AS lg FROM x1),
x3 AS (SELECT *, greatest(la, lb, lg) AS lm FROM x2),
x4 AS (SELECT *, {", ".join(f"CASE WHEN lm > 0 THEN CASE WHEN la = lm THEN a{a} WHEN lb = lm THEN j{a} ELSE g{a} END / sqrt(lm) ELSE {1 if a == 'x' else 0} END AS h{a}" for a in "xyz")} FROM x3),
su AS (SELECT *, CASE WHEN hx*wnx + hy*wny + hz*wnz < 0 THEN -hx ELSE hx END AS nx, CASE WHEN hx*wnx + hy*wny + hz*wnz < 0 THEN -hy ELSE hy END AS ny,
  CASE WHEN hx*wnx + hy*wny + hz*wnz < 0 THEN -hz ELSE hz END AS nz FROM x4)"""


MAP = surfels(10)
EDGES = """ed AS (SELECT a.vx, a.vy, a.vz, b.vx AS qx, b.vy AS qy, b.vz AS qz FROM su a JOIN su b
  ON b.vx = floor((a.mx - a.nx*0.3)/0.3::DOUBLE)::INT AND b.vy = floor((a.my - a.ny*0.3)/0.3::DOUBLE)::INT AND b.vz = floor((a.mz - a.nz*0.3)/0.3::DOUBLE)::INT
  WHERE a.is_valid AND b.is_valid AND NOT (a.vx = b.vx AND a.vy = b.vy AND a.vz = b.vz)
    AND a.nx*b.nx + a.ny*b.ny + a.nz*b.nz >= 0.85 AND a.nx*(b.mx - a.mx) + a.ny*(b.my - a.my) + a.nz*(b.mz - a.mz) < 0)"""
TH, TV = CAM.tan_h, CAM.tan_v
SEES = f"""d2 BETWEEN 0.1::DOUBLE*0.1::DOUBLE AND 64 AND fc > 0 AND fc*fc >= d2*{CAM.cos2_incidence}::DOUBLE
  AND fw >= 0.1 AND fw <= 8 AND abs(rt) <= fw*{TH}::DOUBLE + 1e-12 AND abs(up) <= fw*{TV}::DOUBLE + 1e-12"""
CAMERA = """(s.mx - p.x)*cos(p.yaw) + (s.my - p.y)*sin(p.yaw) AS fw, (s.mx - p.x)*sin(p.yaw) - (s.my - p.y)*cos(p.yaw) AS rt, s.mz - p.z AS up,
  (s.mx - p.x)*(s.mx - p.x) + (s.my - p.y)*(s.my - p.y) + (s.mz - p.z)*(s.mz - p.z) AS d2,
  s.nx*(p.x - s.mx) + s.ny*(p.y - s.my) + s.nz*(p.z - s.mz) AS fc"""
CELL = """((s.vx + 0.5)*0.3 - p.x)*cos(p.yaw) + ((s.vy + 0.5)*0.3 - p.y)*sin(p.yaw) AS kf, ((s.vx + 0.5)*0.3 - p.x)*sin(p.yaw) - ((s.vy + 0.5)*0.3 - p.y)*cos(p.yaw) AS kr,
  (s.vz + 0.5)*0.3 - p.z AS ku, 0.15*(abs(cos(p.yaw)) + abs(sin(p.yaw))) AS ext"""
ORTHO = f"""kf - 0.1 + ext >= 0 AND 8 - kf + ext >= 0
  AND kf*{TH}::DOUBLE + kr + 0.15*(abs(cos(yaw)*{TH}::DOUBLE + sin(yaw)) + abs(sin(yaw)*{TH}::DOUBLE - cos(yaw))) >= 0
  AND kf*{TH}::DOUBLE - kr + 0.15*(abs(cos(yaw)*{TH}::DOUBLE - sin(yaw)) + abs(sin(yaw)*{TH}::DOUBLE + cos(yaw))) >= 0
  AND kf*{TV}::DOUBLE + ku + {TV}::DOUBLE*ext + 0.15 >= 0 AND kf*{TV}::DOUBLE - ku + {TV}::DOUBLE*ext + 0.15 >= 0"""
def cell(x: str, y: str, z: str) -> str:
    """One number for a voxel within a million voxels of the origin."""
    return f"(({x})::BIGINT * 4398046511104 + ({y})::BIGINT * 2097152 + ({z})::BIGINT)"


VIEW = f"""{MAP}, {cte("fx_viewpoints")},
vs AS MATERIALIZED (SELECT p.vp_id, p.x AS ex, p.y AS ey, p.z AS ez, p.yaw, s.vx, s.vy, s.vz, s.mx, s.my, s.mz, {CAMERA}, {CELL} FROM fx_viewpoints p, su s WHERE s.is_valid),
vv AS (SELECT * FROM vs WHERE {SEES}),
dv AS (SELECT * FROM vv WHERE {ORTHO}),
vis AS (SELECT vp_id, vx, vy, vz FROM dv UNION
  SELECT n.vp_id, n.vx, n.vy, n.vz FROM vv n JOIN dv d ON d.vp_id = n.vp_id AND abs(d.vx - n.vx) <= 1 AND abs(d.vy - n.vy) <= 1 AND abs(d.vz - n.vz) <= 1)"""
COVER = f"{VIEW},\ncv AS (SELECT DISTINCT vx, vy, vz FROM vis WHERE vp_id % 10 = 0)"
FRONT = f"""{MAP},
cv AS (SELECT vx, vy, vz FROM su WHERE is_valid AND vy < 0),
op AS (SELECT s.* FROM su s WHERE s.is_valid AND NOT EXISTS (SELECT 1 FROM cv c WHERE c.vx = s.vx AND c.vy = s.vy AND c.vz = s.vz)),
fr AS (SELECT o.vx, o.vy, o.vz, sqrt(((o.vx + 0.5)*0.3 - 2)*((o.vx + 0.5)*0.3 - 2) + ((o.vy + 0.5)*0.3)*((o.vy + 0.5)*0.3) + ((o.vz + 0.5)*0.3 - 1.5)*((o.vz + 0.5)*0.3 - 1.5)) AS dist,
    1.0 + (SELECT count(*) FROM op n WHERE abs(n.vx - o.vx) <= 1 AND abs(n.vy - o.vy) <= 1 AND abs(n.vz - o.vz) <= 1) - 1 AS score
  FROM op o WHERE EXISTS (SELECT 1 FROM cv c WHERE abs(c.vx - o.vx) <= 1 AND abs(c.vy - o.vy) <= 1 AND abs(c.vz - o.vz) <= 1))"""


SUMMARY = """sb AS (SELECT *, sx/sqrt(sx*sx + sy*sy + sz*sz) AS nx, sy/sqrt(sx*sx + sy*sy + sz*sz) AS ny, sz/sqrt(sx*sx + sy*sy + sz*sz) AS nz FROM sa),
sc AS (SELECT *, nx/sqrt(nx*nx + ny*ny + 0.09*nz*nz) AS wx, ny/sqrt(nx*nx + ny*ny + 0.09*nz*nz) AS wy, 0.3*nz/sqrt(nx*nx + ny*ny + 0.09*nz*nz) AS wz FROM sb),
sg AS (SELECT *, cx + wx*1.5 AS vx, cy + wy*1.5 AS vy, cz + wz*1.5 AS vz FROM sc)"""
SUGGEST = f"""{FRONT},
sa AS (SELECT vz // 3 AS cluster, count(*) AS members, sum(score) AS priority, avg((vx + 0.5)*0.3) AS cx, avg((vy + 0.5)*0.3) AS cy, avg((vz + 0.5)*0.3) AS cz, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz
  FROM fr JOIN (SELECT vx, vy, vz, nx, ny, nz FROM su) USING (vx, vy, vz) WHERE dist <= 10 GROUP BY 1),
{SUMMARY}"""
# Greedy leaders one by one: the points in order, each with the list of leaders before it.
CLUSTERS = f"""{FRONT.replace("vy < 0", "vy % 4 = 0")},
fo AS MATERIALIZED (SELECT *, (vx + 0.5)*0.3 AS x, (vy + 0.5)*0.3 AS y, (vz + 0.5)*0.3 AS z, row_number() OVER (ORDER BY round(dist, 9), vx, vy, vz) AS i FROM fr WHERE dist <= 10 AND dist <= (SELECT min(dist) FROM fr) + 2.0),
go AS (SELECT 0::BIGINT AS i, []::STRUCT(i BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[] AS led
  UNION ALL SELECT f.i, CASE WHEN len(list_filter(led, lambda l: (l.x-f.x)*(l.x-f.x) + (l.y-f.y)*(l.y-f.y) + (l.z-f.z)*(l.z-f.z) <= 1.0)) = 0 THEN list_append(led, {{'i': f.i, 'x': f.x, 'y': f.y, 'z': f.z}}) ELSE led END
  FROM go JOIN fo f ON f.i = go.i + 1),
le AS (SELECT unnest(led) AS l FROM go QUALIFY row_number() OVER (ORDER BY i DESC) = 1),
mb AS (SELECT f.*, min(l.i) AS leader FROM fo f JOIN le ON (l.x-f.x)*(l.x-f.x) + (l.y-f.y)*(l.y-f.y) + (l.z-f.z)*(l.z-f.z) <= 1.0 GROUP BY ALL),
sa AS (SELECT row_number() OVER (ORDER BY leader) - 1 AS cluster, count(*) AS members, sum(score) AS priority, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz
  FROM mb JOIN (SELECT vx, vy, vz, nx, ny, nz FROM su) USING (vx, vy, vz) GROUP BY leader HAVING count(*) >= 5),
{SUMMARY}"""



def near(p: str, s: str, radius: float) -> str:
    return f"(({s}.vx + 0.5)*0.3 - {p}.x)*(({s}.vx + 0.5)*0.3 - {p}.x) + (({s}.vy + 0.5)*0.3 - {p}.y)*(({s}.vy + 0.5)*0.3 - {p}.y) + (({s}.vz + 0.5)*0.3 - {p}.z)*(({s}.vz + 0.5)*0.3 - {p}.z) <= {radius * radius}::DOUBLE"


LEGS = f"""{MAP}, {cte("fx_viewpoints")},
lg AS (SELECT vp_id // 5 AS plan_id, (vp_id % 5)::INT AS seq, x + 1.2 AS x, y, z, yaw FROM fx_viewpoints),
eg AS (SELECT plan_id, seq, x AS ax, y AS ay, z AS az, lead(x) OVER w AS ex, lead(y) OVER w AS ey, lead(z) OVER w AS ez FROM lg WINDOW w AS (PARTITION BY plan_id ORDER BY seq)),
en AS (SELECT *, ceil(sqrt((ex-ax)*(ex-ax) + (ey-ay)*(ey-ay) + (ez-az)*(ez-az))/0.3::DOUBLE)::INT AS n FROM eg WHERE ex IS NOT NULL),
sm AS (SELECT plan_id, seq, n, unnest(range(0, n + 1)) AS i, ax, ay, az, ex, ey, ez FROM en),
sp AS (SELECT plan_id, seq, ax + ex*t - ax*t AS x, ay + ey*t - ay*t AS y, az + ez*t - az*t AS z FROM (SELECT *, CASE WHEN n > 0 THEN i::DOUBLE/n ELSE 0 END AS t FROM sm)),
ht AS (SELECT DISTINCT q.plan_id, q.seq FROM sp q JOIN su s ON s.count > 0 AND {near("q", "s", 0.8)})"""
PB = f"""{cte("fx_pwn")}, {cte("fx_surfels_b")},
pb AS (SELECT DISTINCT ON (point_id) * FROM (SELECT l_orderkey*10000000 + l_partkey*100 + scan_id AS point_id, x, y, z, nx AS pnx, ny AS pny, nz AS pnz FROM fx_pwn) ORDER BY point_id, x, y, z)"""
TANGENT = """tb AS (SELECT *, -ny/sqrt(nx*nx + ny*ny)*-1 AS ux, -nx/sqrt(nx*nx + ny*ny) AS uy, 0.0 AS uz FROM fx_surfels_b),
tc AS (SELECT *, ny*uz - nz*uy AS tx, nz*ux - nx*uz AS ty, nx*uy - ny*ux AS tz FROM tb)"""
FRAMED = f"""{TANGENT}, an AS (SELECT *, cos(idx % 7 * 0.3::DOUBLE + 0.1) AS c, sin(idx % 7 * 0.3::DOUBLE + 0.1) AS s, (idx % 5 - 2)*0.01::DOUBLE/2.5 AS mu, (idx % 3 - 1)*0.015::DOUBLE/2.5 AS mv FROM tc),
fb AS (SELECT *, l0*c*c + l1*s*s AS suu, l0*s*s + l1*c*c AS svv, (l0 - l1)*c*s AS suv FROM an)"""
# The squared Mahalanobis distance by the inverse of the covariance, which needs no eigenvectors.
ASSOC = f"""{PB}, {FRAMED},
cu AS (SELECT p.point_id, s.idx, (p.x-cx)*nx + (p.y-cy)*ny + (p.z-cz)*nz AS normal_dist, suu, svv, suv,
    (p.x-cx)*ux + (p.y-cy)*uy + (p.z-cz)*uz - mu AS du, (p.x-cx)*tx + (p.y-cy)*ty + (p.z-cz)*tz - mv AS dv
  FROM pb p JOIN fb s ON abs(floor(p.x/0.3::DOUBLE) - floor(cx/0.3::DOUBLE)) <= 1 AND abs(floor(p.y/0.3::DOUBLE) - floor(cy/0.3::DOUBLE)) <= 1 AND abs(floor(p.z/0.3::DOUBLE) - floor(cz/0.3::DOUBLE)) <= 1
  WHERE abs(pnx*nx + pny*ny + pnz*nz) >= {math.cos(math.radians(30))}::DOUBLE),
ca AS (SELECT *, (svv*du*du - 2*suv*du*dv + suu*dv*dv)/(suu*svv - suv*suv) AS mahalanobis FROM cu),
cb AS (SELECT * FROM ca WHERE abs(normal_dist) <= 0.05 AND mahalanobis < 9.21)"""
WAIT = f"""{ASSOC}, pw AS (SELECT *, point_id % 100 AS stamp FROM pb WHERE point_id NOT IN (SELECT point_id FROM cb) ORDER BY point_id % 100 DESC, point_id DESC LIMIT 5000),
g AS (SELECT *, floor(x/0.6::DOUBLE)::INT AS gx, floor(y/0.6::DOUBLE)::INT AS gy, floor(z/0.6::DOUBLE)::INT AS gz FROM pw),
m AS (SELECT gx, gy, gz, count(*) AS members, avg(x) AS ox, avg(y) AS oy, avg(z) AS oz FROM g GROUP BY gx, gy, gz HAVING count(*) >= 5),
cl AS (SELECT gx, gy, gz, members, ox, oy, oz, avg(1 - pnx*pnx) AS spread FROM g JOIN m USING (gx, gy, gz) GROUP BY ALL HAVING max((x-ox)*(x-ox) + (y-oy)*(y-oy) + (z-oz)*(z-oz)) <= 0.36)"""
K = "vx, vy, vz"
BK = "floor(cx/0.3::DOUBLE)::INT AS vx, floor(cy/0.3::DOUBLE)::INT AS vy, floor(cz/0.3::DOUBLE)::INT AS vz"

WB = f"{cte('fx_surfels_b')}, wb AS (SELECT *, {BK}, idx % 90 + 3 AS point_count, idx % 9 + 1 AS observations, (idx % 90 + 3)*0.5::DOUBLE + 0.0137 AS w FROM fx_surfels_b)"

# Cells of rays and solid voxels meet by one number each, so that every join hashes; seen6 has what isn't hidden.
HIDDEN = f"""dd AS MATERIALIZED (SELECT vp_id, vx, vy, vz, {cell("vx", "vy", "vz")} AS own, ex, ey, ez, mx, my, mz, sqrt(d2) AS dist FROM dv),
      va AS MATERIALIZED (SELECT DISTINCT {cell("vx", "vy", "vz")} AS cell FROM su WHERE is_valid),
      ks AS MATERIALIZED (SELECT vp_id, own, ex, ey, ez, mx, my, mz, dist, unnest(range(1, greatest(2, ceil(dist/0.15::DOUBLE)::INT))) AS k FROM dd),
      ce AS MATERIALIZED (SELECT vp_id, own, {cell(*[f"floor((e{a} + (m{a}-e{a})/dist*(k*0.15::DOUBLE))/0.3::DOUBLE)" for a in "xyz"])} AS cell FROM ks WHERE k*0.15::DOUBLE < dist),
      hi AS MATERIALIZED (SELECT DISTINCT vp_id, own, true AS hidden FROM (SELECT vp_id, own, cell FROM ce WHERE cell <> own) JOIN va USING (cell)),
      seen6 AS (SELECT vp_id, vx, vy, vz FROM dd LEFT JOIN hi USING (vp_id, own) WHERE hidden IS NULL)"""
POSES = f"""ps AS (SELECT cluster, 0 AS tier, 0 AS "offset", vx AS x, vy AS y, vz AS z, cx, cy FROM sg UNION ALL
        SELECT cluster, tier, o, cx + wx*far + ox, cy + wy*far + oy, cz + wz*far + oz, cx, cy FROM sg, (VALUES (1, 1.5::DOUBLE), (2, 1.0)) t(tier, far),
          (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.5, 0, 0), (2, -0.5, 0, 0), (3, 0, 0.5, 0), (4, 0, -0.5, 0), (5, 0, 0, 0.3), (6, 0, 0, -0.3)) q(o, ox, oy, oz))"""
# The poses that V19 leaves, seen through like viewpoints.
CHOICE = f"""{SUGGEST}, {POSES}, {cte("fx_viewpoints")},
      pq AS (SELECT *, cluster*100 + tier*10 + "offset" AS vp_id, atan2(cy - y, cx - x) AS yaw FROM ps),
      okp AS MATERIALIZED (SELECT * FROM pq q WHERE z >= 0.5 AND NOT EXISTS (SELECT 1 FROM su s WHERE s.count > 0 AND {near("q", "s", 0.8)})
        AND NOT EXISTS (SELECT 1 FROM fx_viewpoints b WHERE b.vp_id % 10 = 0 AND (q.x-b.x)*(q.x-b.x) + (q.y-b.y)*(q.y-b.y) + (q.z-b.z)*(q.z-b.z) <= 0.25 AND abs(atan2(sin(q.yaw - b.yaw), cos(q.yaw - b.yaw))) <= radians(15))),
      {VIEW.split(cte("fx_viewpoints") + ",")[1].replace("fx_viewpoints", "okp").rsplit("vis AS (", 1)[0]}{HIDDEN},
      vis AS (SELECT * FROM seen6 UNION SELECT n.vp_id, n.vx, n.vy, n.vz FROM vv n JOIN seen6 d ON d.vp_id = n.vp_id AND abs(d.vx - n.vx) <= 1 AND abs(d.vy - n.vy) <= 1 AND abs(d.vz - n.vz) <= 1),
      nv AS (SELECT vp_id, count(*) AS n_visible FROM vis GROUP BY vp_id)"""

ORACLE_SQL = {
    "p1_p4_filter_project": f"WITH {FILTERED} SELECT scan_id, point_idx, {rs('r_sq', 'yaw', 'pitch')} FROM flt",
    "p5_grid_downsample": f"WITH {GRID} SELECT scan_id, u, v, point_idx, {rs('x', 'y', 'z', 'r_sq')} FROM grid",
    "p6_grid_blocks": f"WITH {GRID} SELECT scan_id, u // 3 AS u, v // 3 AS v, point_idx, {rs('r_sq')} FROM grid QUALIFY row_number() OVER (PARTITION BY scan_id, u // 3, v // 3 ORDER BY r_sq, v, u) = 1".replace("SELECT scan_id, u // 3 AS u, v // 3 AS v", "SELECT scan_id, (u // 3)::INT AS u, (v // 3)::INT AS v").replace("FROM grid QUALIFY row_number() OVER (PARTITION BY scan_id, u // 3, v // 3 ORDER BY r_sq, v, u)", "FROM grid g QUALIFY row_number() OVER (PARTITION BY scan_id, g.u // 3, g.v // 3 ORDER BY g.r_sq, g.v, g.u)"),
    "p7_range_image": f"WITH {GRID} SELECT scan_id, u, v, {rs('range')} FROM grid",
    "p8_smooth_forward": f"WITH {smoothed(0, 3)} SELECT scan_id, u, v, {r('g', 'range_smooth')} FROM s6",
    "p9_smooth_symmetric": f"WITH {smoothed(3, 0)} SELECT scan_id, u, v, {r('g', 'range_smooth')} FROM s6",
    "p10_smooth_identity": f"WITH {GRID} SELECT scan_id, u, v, {r('range', 'range_smooth')} FROM grid",
    "p11_p15_normals": f"WITH {NORMALS} SELECT scan_id, u, v, {rs('nx', 'ny', 'nz', 'w')} FROM nw",
    "p14_normals_kept": f"WITH {NORMALS} SELECT g.scan_id, count(*) AS cells, count(n.nx) AS with_normal FROM grid g LEFT JOIN nm n USING (scan_id, u, v) GROUP BY g.scan_id",
    # Neighbours are gated by smoothed ranges, positions stay raw.
    "p16_pipeline": "WITH "
    + NORMALS.replace(GRID, smoothed(0, 3) + ",\ngs AS (SELECT grid.* REPLACE (g AS range) FROM grid JOIN s6 USING (scan_id, u, v))").replace("FROM grid c", "FROM gs c").replace("JOIN grid ", "JOIN gs ")
    + f" SELECT scan_id, u, v, {rs('nx', 'ny', 'nz', 'w')} FROM nw",
    "p17_to_world": f"WITH {cte('fx_points')} SELECT scan_id, point_idx, {r('cos(scan_id*0.1::DOUBLE)*x - sin(scan_id*0.1::DOUBLE)*y', 'x')}, {r('sin(scan_id*0.1::DOUBLE)*x + cos(scan_id*0.1::DOUBLE)*y', 'y')}, {r('z + 1.5', 'z')} FROM fx_points",
    "m2_m3_voxel_counts": f"WITH {MAP} SELECT {K}, count(*) AS n FROM k GROUP BY {K}",
    "m1_in_range": f"WITH {cte('fx_points')} SELECT scan_id, count(*) AS n, {r('sum(x)', 'sx', 4)} FROM fx_points WHERE x*x + y*y + z*z BETWEEN 4.0 AND 6.25 GROUP BY scan_id",
    "m9_remove": f"WITH {MAP}, cv AS (SELECT vx, vy, vz FROM su WHERE is_valid AND vy < 0) SELECT s.vx, s.vy, s.vz FROM su s WHERE NOT EXISTS (SELECT 1 FROM cv c WHERE c.vx = s.vx AND c.vy = s.vy AND c.vz = s.vz)",
    "m5_corners": f"WITH {MAP} SELECT DISTINCT {K}, {r('(vx + 0.5)*0.3', 'cx')}, {r('(vy + 0.5)*0.3', 'cy')}, {r('(vz + 0.5)*0.3', 'cz')}, {r('vx*0.3::DOUBLE', 'lox')}, {r('(vz + 1)*0.3::DOUBLE', 'hiz')} FROM k",
    "m10_moments": f"WITH {MAP} SELECT {K}, count, n_points, {rs('sum_w', 'mx', 'my', 'mz', 'sxx', 'sxy', 'sxz', 'syy', 'syz', 'szz')} FROM su",
    "m6_merge_scans": f"WITH {MAP} SELECT {K}, count, {rs('sum_w', 'mx', 'my', 'mz', 'sxx', 'syy', 'szz', digits=4)} FROM su",
    "m12_m14_surfels": f"WITH {surfels(50)} SELECT {K}, count, is_valid, is_planar, is_degenerate, {rs('e0', 'e1', 'e2')} FROM su",
    "m11_normals": f"WITH {MAP} SELECT {K}, {rs('nx', 'ny', 'nz', digits=3)} FROM su WHERE is_valid",
    "valid_surfels": f"WITH {surfels(50)} SELECT {K}, count, {rs('mx', 'my', 'mz', 'e0', 'e1', 'e2')} FROM su WHERE is_valid",
    "m15_shadow_edges": f"WITH {MAP}, {EDGES} SELECT {K}, qx, qy, qz FROM ed",
    "m15_shadow_prune": f"WITH {MAP}, {EDGES} SELECT {K}, is_valid FROM su WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.qx = su.vx AND ed.qy = su.vy AND ed.qz = su.vz)",
    "m10_stream_sums": f"WITH {MAP} SELECT {K}, count, n_points, {rs('sum_w', 'mx', 'my', 'mz', 'sxx', 'sxy', 'sxz', 'syy', 'syz', 'szz')} FROM su",
    "m4_cell_keys": f"WITH {cte('fx_pwn')} SELECT {', '.join(f'floor({a}::FLOAT * (1.0::FLOAT / 0.3::FLOAT))::INT AS v{a}' for a in 'xyz')}, {', '.join(f'floor({a} / 0.3::DOUBLE)::INT AS w{a}' for a in 'xyz')}, count(*) AS n FROM fx_pwn GROUP BY ALL",
    "m5_inside": f"WITH {cte('fx_pwn')}, c AS (SELECT x, y, z, {', '.join(f'floor({a}::FLOAT * (1.0::FLOAT / 0.3::FLOAT))::INT AS v{a}' for a in 'xyz')} FROM fx_pwn) SELECT {K}, count(*) AS n, count(*) FILTER (WHERE {' AND '.join(f'{a} >= v{a}*0.3::DOUBLE AND {a} < (v{a} + 1)*0.3::DOUBLE' for a in 'xyz')}) AS inside FROM c GROUP BY ALL",
    "m14_covariance": f"WITH {MAP} SELECT {K}, {', '.join(r(f's{q} / CASE WHEN sum_w > 1 THEN sum_w - 1 ELSE 1 END', f'c{q}') for q in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM su",
    "m16_valid_keys": f"WITH {MAP} SELECT {K}, count FROM su WHERE is_valid",
    "m17_lookup": f"WITH {MAP}, {cte('fx_viewpoints')}, q AS (SELECT vp_id, floor(2.0/0.3::DOUBLE)::INT AS vx, floor(y/0.3::DOUBLE)::INT AS vy, floor(z/0.3::DOUBLE)::INT AS vz FROM fx_viewpoints) SELECT q.*, su.is_valid, su.count FROM q LEFT JOIN su USING ({K})",
    "m18_box": f"WITH {MAP} SELECT {K} FROM su WHERE is_valid AND vx BETWEEN floor(1.8/0.3::DOUBLE) AND floor(2.4/0.3::DOUBLE) AND vy BETWEEN floor(-1.0/0.3::DOUBLE) AND floor(1.0/0.3::DOUBLE) AND vz BETWEEN floor(0.5/0.3::DOUBLE) AND floor(1.5/0.3::DOUBLE)",
    "m19_radius": f"WITH {MAP}, {cte('fx_viewpoints')} SELECT p.vp_id, count(*) AS n, {r(near('p', 's', 2.5).split(' <=')[0].join(['min(', ')']), 'least')} FROM fx_viewpoints p JOIN su s ON s.count > 0 AND {near('p', 's', 2.5)} GROUP BY p.vp_id",
    "m20_neighbours": f"WITH {MAP}, a AS (SELECT {K} FROM su WHERE is_valid) SELECT a.vx, a.vy, a.vz, count(*) AS n FROM a JOIN a b ON abs(a.vx-b.vx) <= 1 AND abs(a.vy-b.vy) <= 1 AND abs(a.vz-b.vz) <= 1 AND (a.vx, a.vy, a.vz) <> (b.vx, b.vy, b.vz) GROUP BY ALL",
    "m20_faces": f"WITH {MAP}, a AS (SELECT {K} FROM su WHERE is_valid) SELECT a.vx, a.vy, a.vz, count(*) AS n FROM a JOIN a b ON abs(a.vx-b.vx) + abs(a.vy-b.vy) + abs(a.vz-b.vz) = 1 GROUP BY ALL",
    "m21_prune_outside": f"WITH {MAP} SELECT {K}, count FROM su WHERE (vx + 0.5)*0.3 BETWEEN 1.5 AND 2.2 AND (vy + 0.5)*0.3 BETWEEN -1 AND 1 AND (vz + 0.5)*0.3 BETWEEN 0.4 AND 2",
    "m22_statistics": f"WITH {MAP} SELECT count(*) AS num_voxels, count(*) FILTER (WHERE is_valid) AS num_valid, count(*) FILTER (WHERE NOT is_valid) AS num_invalid, sum(count)::BIGINT AS total_points, "
    + ", ".join(r(f"{f}((v{a} + 0.5)*0.3)", f"{f}_{a}") for a in "xyz" for f in ("min", "max"))
    + " FROM su",
    "v1_frustum_boxes": f"WITH {cte('fx_viewpoints')}, c AS (SELECT vp_id, x + f*cos(yaw) + s*f*{TH}::DOUBLE*sin(yaw) AS px, y + f*sin(yaw) - s*f*{TH}::DOUBLE*cos(yaw) AS py, z + t*f*{TV}::DOUBLE AS pz FROM fx_viewpoints, (VALUES (0.1::DOUBLE), (8.0)) n(f), (VALUES (-1), (1)) a(s), (VALUES (-1), (1)) b(t)) SELECT vp_id, {r('min(px)', 'lox')}, {r('max(px)', 'hix')}, {r('min(py)', 'loy')}, {r('max(py)', 'hiy')}, {r('min(pz)', 'loz')}, {r('max(pz)', 'hiz')} FROM c GROUP BY vp_id",
    "v3_v5_direct": f"WITH {VIEW} SELECT vp_id, {K} FROM dv",
    "v4_visibility": f"WITH {VIEW} SELECT vp_id, {K} FROM vis",
    "v6_occlusion": f"WITH {VIEW}, {HIDDEN} SELECT vp_id, {K} FROM seen6",
    "v7_coverage": f"WITH {COVER}, j AS (SELECT v.vp_id, c.vx IS NULL AS new FROM vis v LEFT JOIN cv c USING ({K})) SELECT vp_id, count(*) AS n_visible, count(*) FILTER (WHERE new) AS n_new, {r('count(*) FILTER (WHERE new)::DOUBLE/count(*)', 'coverage')} FROM j GROUP BY vp_id",
    "v8_similar": f"WITH {cte('fx_viewpoints')} SELECT a.vp_id AS vp_a, b.vp_id AS vp_b FROM fx_viewpoints a JOIN fx_viewpoints b ON a.vp_id < b.vp_id WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.25 AND abs(a.yaw - b.yaw) <= 0.2618::DOUBLE",
    "v9_collision": f"WITH {MAP}, {cte('fx_viewpoints')}, q AS (SELECT vp_id, x + 1.5 AS x, y, z FROM fx_viewpoints) SELECT vp_id, EXISTS (SELECT 1 FROM su s WHERE s.count > 0 AND {near('q', 's', 0.8)}) AS in_collision FROM q",
    "v10_distance": f"WITH {MAP}, {cte('fx_viewpoints')}, q AS (SELECT p.vp_id, (SELECT min({near('p', 's', 2).split(' <=')[0]}) FROM su s WHERE s.count > 0 AND {near('p', 's', 2)}) AS d FROM fx_viewpoints p) SELECT vp_id, {r('coalesce(least(2.0, greatest(0, sqrt(d) - 0.15)), 2.0)', 'distance')} FROM q",
    "v11_frontiers": f"WITH {FRONT} SELECT {K}, {rs('dist', 'score')} FROM fr WHERE dist <= 10",
    "v13_clusters": f"WITH RECURSIVE {CLUSTERS} SELECT cluster, members, {rs('priority', 'cx', 'cy', 'cz', 'vx', 'vy', 'vz')}, {r('atan2(cy - vy, cx - vx)', 'yaw')} FROM sg",
    "v14_v15_suggestions": f"WITH {SUGGEST} SELECT cluster, members, {rs('priority', 'cx', 'cy', 'cz', 'nx', 'vx', 'vy', 'vz')}, {r('atan2(cy - vy, cx - vx)', 'yaw')} FROM sg",
    "v18_candidates": f"""WITH {SUGGEST},
      {POSES}
      SELECT cluster, tier::INT AS tier, "offset"::INT AS "offset", {rs("x", "y", "z")}, {r("atan2(cy - y, cx - x)", "yaw")} FROM ps""",
    "v18_choice": f"""WITH {CHOICE} SELECT cluster, tier::INT AS tier, "offset"::INT AS "offset", n_visible, {rs("x", "y", "z", "yaw")} FROM okp JOIN nv USING (vp_id)
      QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY tier, n_visible DESC, "offset") = 1""",
    "v19_valid_viewpoints": f"WITH {MAP}, {cte('fx_viewpoints')}, q AS (SELECT vp_id, x, y, z - 0.15::DOUBLE AS z, yaw FROM fx_viewpoints) SELECT vp_id FROM q WHERE z >= 0.5 AND NOT EXISTS (SELECT 1 FROM su s WHERE s.count > 0 AND {near('q', 's', 0.8)}) AND NOT EXISTS (SELECT 1 FROM fx_viewpoints b WHERE b.vp_id % 10 = 0 AND (q.x-b.x)*(q.x-b.x) + (q.y-b.y)*(q.y-b.y) + (q.z-b.z)*(q.z-b.z) <= 0.25 AND abs(q.yaw - b.yaw) <= radians(15))",
    "v17_expansion_center": f"WITH {COVER}, j AS (SELECT DISTINCT v.vx, v.vy, v.vz, c.vx IS NULL AS new FROM vis v LEFT JOIN cv c USING ({K})) SELECT "
    + ", ".join(r(f"coalesce(avg((v{a} + 0.5)*0.3) FILTER (WHERE new), avg((v{a} + 0.5)*0.3), 0)", f"c{a}") for a in "xyz")
    + " FROM j",
    "v20_selection": f"""WITH {COVER}, j AS (SELECT v.vp_id, avg((c.vx IS NULL)::INT) AS cov FROM vis v LEFT JOIN cv c USING ({K}) GROUP BY v.vp_id)
      SELECT p.vp_id, {r("(0.7*cov + 0.3*(1 - least(sqrt(p.x*p.x + p.y*p.y + (p.z-1)*(p.z-1))/6, 1))) * CASE WHEN EXISTS (SELECT 1 FROM fx_viewpoints h WHERE h.vp_id IN (1, 2, 3) AND (h.x-p.x)*(h.x-p.x) + (h.y-p.y)*(h.y-p.y) + (h.z-p.z)*(h.z-p.z) <= 1) THEN 0.2 ELSE 1 END", "score")} FROM j JOIN fx_viewpoints p USING (vp_id)""",
    "c1_stream_observations": f"WITH {VIEW} SELECT {K}, count(*) AS observations FROM vis GROUP BY {K}",
    "v21_multi_score": f"""WITH {COVER}, j AS (SELECT v.vp_id, count(*) FILTER (WHERE c.vx IS NULL)::DOUBLE/count(*) AS c FROM vis v LEFT JOIN cv c USING ({K}) GROUP BY v.vp_id)
      SELECT vp_id, {r("(0.5*c + 0.3*(vp_id % 7)*1.5/9 + 0.2*(1 - least((vp_id % 12)/10.0, 1))) * CASE WHEN vp_id % 10 > 8 THEN 0.5 WHEN vp_id % 10 > 5 THEN 0.7 ELSE 1 END", "score")} FROM j""",
    "i7_yaw_steps": f"WITH {cte('fx_viewpoints')}, c AS (SELECT vp_id, yaw*6 AS a, yaw + 3 AS b, unnest([0.25, 0.5, 0.75])::DOUBLE AS t FROM fx_viewpoints), d AS (SELECT *, a + t*atan2(sin(b - a), cos(b - a)) AS h FROM c) SELECT vp_id, t, {r('atan2(sin(h), cos(h))', 'heading')} FROM d",
    "t5_rotations": f"WITH {cte('fx_viewpoints')} SELECT vp_id, {r('cos(yaw) - 2*sin(yaw)', 'x')}, {r('sin(yaw) + 2*cos(yaw)', 'y')}, 3.0::DOUBLE AS z, {r('cos(yaw/2)', 'qw')}, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, {r('sin(yaw/2)', 'qz')}, 1.0::DOUBLE AS det, {rs('yaw')} FROM fx_viewpoints",
    "c1_observations": f"WITH {VIEW} SELECT {K}, count(*) AS observations FROM vis GROUP BY {K}",
    "c2_visited_log": f"WITH {cte('fx_viewpoints')} SELECT vp_id, 'visited' AS status, {rs('x', 'y', 'z', 'yaw')}, {r('vp_id*0.5::DOUBLE', 'visited_at')} FROM (SELECT * FROM fx_viewpoints UNION ALL SELECT * FROM fx_viewpoints WHERE vp_id % 10 = 0)",
    "c4_local_coverage": f"WITH {VIEW}, cv AS (SELECT vx, vy, vz FROM su WHERE is_valid AND vy < 0) SELECT v.vp_id AS region_id, count(*) AS total, {r('count(c.vx)::DOUBLE/count(*)', 'ratio')} FROM vis v LEFT JOIN cv c USING ({K}) GROUP BY v.vp_id",
    "c3_visited": f"WITH {cte('fx_viewpoints')} SELECT a.vp_id FROM fx_viewpoints a WHERE EXISTS (SELECT 1 FROM fx_viewpoints b WHERE b.vp_id % 10 = 0 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.25 AND abs(a.yaw - b.yaw) <= radians(15))",
    "c5_coverage_ratio": f"WITH {COVER}, n AS (SELECT count(*) AS total FROM su WHERE is_valid) SELECT (SELECT count(*) FROM cv) AS observed, total, {r('(SELECT count(*) FROM cv)::DOUBLE/total', 'coverage')}, {r('(SELECT count(*) FROM cv)::DOUBLE/total', 'coverage_live')} FROM n",
    "i4_travel_order": f"WITH {cte('fx_viewpoints')}, c AS (SELECT vp_id, sqrt(x*x + y*y + (z-1)*(z-1)) + abs(yaw) AS path_cost FROM fx_viewpoints) SELECT vp_id, (row_number() OVER (ORDER BY path_cost, vp_id))::INT AS rank, {rs('path_cost')} FROM c",
    "i1_back_off": f"""WITH {MAP}, {cte("fx_viewpoints")}, t AS (SELECT vp_id, step::INT AS step, x + 1.6 - cos(yaw)*(step*0.3::DOUBLE) AS x, y - sin(yaw)*(step*0.3::DOUBLE) AS y, z FROM fx_viewpoints, range(0, 3) g(step)),
      f AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM su s WHERE s.count > 0 AND {near("t", "s", 0.8)}) QUALIFY row_number() OVER (PARTITION BY vp_id ORDER BY step) = 1)
      SELECT v.vp_id, f.step, {r("f.x", "x")}, {r("f.y", "y")}, {r("f.z", "z")} FROM fx_viewpoints v LEFT JOIN f USING (vp_id)""",
    "i8_mission_states": f"""WITH {VIEW}, {cte("fx_scan_events")}, e AS (SELECT drone_id AS plan_id, ts, (scan_id % 9)::INT AS a FROM fx_scan_events),
      m AS (SELECT *, coalesce(lag(a) OVER (PARTITION BY plan_id ORDER BY ts), 0) AS b FROM e),
      re AS (SELECT DISTINCT plan_id, s + 1 AS vp_id FROM m, range(0, 9) g(s) WHERE a > b AND s >= b AND s < a),
      ob AS (SELECT plan_id, count(DISTINCT (vx, vy, vz)) AS covered FROM re JOIN vis USING (vp_id) GROUP BY plan_id),
      tt AS (SELECT count(*) AS total FROM su WHERE is_valid)
      SELECT plan_id, count(*) AS visited, coalesce(covered, 0) AS covered, total, {r("coalesce(covered, 0)/total", "coverage")}, coalesce(covered, 0)/total >= 0.99::DOUBLE AS complete FROM re LEFT JOIN ob USING (plan_id), tt GROUP BY ALL""",
    "i10_progress": f"""WITH {cte("fx_scan_events")}, e AS (SELECT drone_id AS plan_id, ts, (scan_id % 12)::INT AS a FROM fx_scan_events),
      m AS (SELECT *, coalesce(lag(a) OVER (PARTITION BY plan_id ORDER BY ts), 0) AS b FROM e)
      SELECT plan_id, s + 100 AS vp_id, min(ts) AS reached_at FROM m, range(0, 12) g(s) WHERE a > b AND s >= b AND s < a GROUP BY ALL""",
    "r6_free_edges": f"WITH {LEGS} SELECT plan_id*10 + seq AS edge_id, ht.seq IS NULL AS is_free FROM en LEFT JOIN ht USING (plan_id, seq)",
    "r5_first_invalid": f"WITH {LEGS}, h AS (SELECT plan_id, min(seq) AS f FROM ht GROUP BY plan_id) SELECT plan_id, coalesce(f, -1) AS first_invalid FROM (SELECT DISTINCT plan_id FROM lg) LEFT JOIN h USING (plan_id)",
    "i5_headings": f"WITH {LEGS}, n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM lg WINDOW w AS (PARTITION BY plan_id ORDER BY seq)) SELECT plan_id, seq, {r('CASE WHEN seq % 2 = 0 OR nx IS NULL THEN yaw ELSE atan2(ny - y, nx - x) END', 'yaw')} FROM n",
    "b2_candidates": f"WITH {ASSOC} SELECT point_id, idx, {rs('mahalanobis', 'normal_dist')} FROM cb",
    "b3_association": f"WITH {ASSOC} SELECT point_id, {r('m', 'mahalanobis')} FROM pb LEFT JOIN (SELECT point_id, min(mahalanobis) AS m FROM cb GROUP BY point_id) USING (point_id)",
    "b10_eigenframe": f"WITH {cte('fx_surfels_b')}, {FRAMED} SELECT idx, {rs('l0', 'l1', 'mu', 'mv')}, {r('1 - l0/l1', 'planarity')} FROM fb",
    "b6_tangents": f"WITH {cte('fx_surfels_b')}, {TANGENT} SELECT idx, {rs('ux', 'uy', 'uz', 'tx', 'ty', 'tz')} FROM tc",
    "b11_confidence": f"WITH {cte('fx_surfels_b')}, n AS (SELECT *, (idx % 90 + 3)::DOUBLE AS n, (idx % 9 + 1)::DOUBLE AS o FROM fx_surfels_b) SELECT idx, {r('(l1 - l0)/l1', 'planarity')}, "
    + r(f"(1 - exp(-n/100)) * exp(-(l0*0.1/(n*n))/{0.02**2}::DOUBLE) * 0.98 * (0.7 + 0.3*(1 - exp(-o/5))) * (1 - exp(-(pi()*sqrt(l0)*sqrt(l1))/0.05::DOUBLE))", "confidence")
    + " FROM n",
    "b13_waiting": f"WITH {WAIT} SELECT point_id, stamp FROM pw",
    "b14_clusters": f"WITH {WAIT} SELECT gx, gy, gz, members, {r('ox', 'cx')}, {r('oy', 'cy')}, {r('oz', 'cz')}, -1.0::DOUBLE AS nx, 0.0::DOUBLE AS ny, 0.0::DOUBLE AS nz, {rs('spread')} FROM cl",
    "b27_flush": f"""WITH {WAIT}, sd AS (SELECT *, row_number() OVER (ORDER BY gx, gy, gz) AS seed_id FROM cl),
      tg AS (SELECT seed_id, idx FROM sd JOIN fx_surfels_b ON abs(floor(ox/0.3::DOUBLE) - floor(cx/0.3::DOUBLE)) <= 1 AND abs(floor(oy/0.3::DOUBLE) - floor(cy/0.3::DOUBLE)) <= 1 AND abs(floor(oz/0.3::DOUBLE) - floor(cz/0.3::DOUBLE)) <= 1
        WHERE abs(nx) >= 0.95 AND sqrt((ox-cx)*(ox-cx) + (oy-cy)*(oy-cy) + (oz-cz)*(oz-cz)) <= 2*sqrt(l1) + 0.1
        QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY abs(nx)*confidence/(1 + sqrt((ox-cx)*(ox-cx) + (oy-cy)*(oy-cy) + (oz-cz)*(oz-cz))) DESC, idx) = 1)
      SELECT point_id, seed_id, idx FROM g LEFT JOIN sd USING (gx, gy, gz) LEFT JOIN tg USING (seed_id)""",
    "b16_merge_targets": f"""WITH {cte("fx_surfels_b")}, q AS (SELECT idx AS seed_id, cx + 0.02::DOUBLE AS qx, cy + 0.013::DOUBLE AS qy, cz AS qz, nx AS ax, ny AS ay FROM fx_surfels_b),
      c AS (SELECT seed_id, idx, sqrt((qx-cx)*(qx-cx) + (qy-cy)*(qy-cy) + (qz-cz)*(qz-cz)) AS d, abs(ax*nx + ay*ny) AS t, confidence, l1 FROM q JOIN fx_surfels_b
        ON abs(floor(qx/0.3::DOUBLE) - floor(cx/0.3::DOUBLE)) <= 1 AND abs(floor(qy/0.3::DOUBLE) - floor(cy/0.3::DOUBLE)) <= 1 AND abs(floor(qz/0.3::DOUBLE) - floor(cz/0.3::DOUBLE)) <= 1),
      b AS (SELECT seed_id, idx, t*confidence/(1 + d) AS score FROM c WHERE t >= 0.95 AND d <= 2*sqrt(l1) + 0.1 QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY t*confidence/(1 + d) DESC, idx) = 1)
      SELECT seed_id, idx, {rs("score")} FROM q LEFT JOIN b USING (seed_id)""",
    "b18_capacity": f"WITH {cte('fx_surfels_b')} SELECT {BK}, idx FROM fx_surfels_b QUALIFY row_number() OVER (PARTITION BY floor(cx/0.3::DOUBLE), floor(cy/0.3::DOUBLE), floor(cz/0.3::DOUBLE) ORDER BY confidence DESC, idx) <= 6",
    "b17_create": f"""WITH {cte("fx_surfels_b")}, q AS (SELECT idx AS seed_id, cx + CASE WHEN idx % 3 = 0 THEN 5.0 ELSE 0.02 END::DOUBLE AS qx, cy + 0.013::DOUBLE AS qy, cz AS qz, nx AS ax, ny AS ay FROM fx_surfels_b),
      c AS (SELECT seed_id, idx, sqrt((qx-cx)*(qx-cx) + (qy-cy)*(qy-cy) + (qz-cz)*(qz-cz)) AS d, abs(ax*nx + ay*ny) AS t, confidence, l1 FROM q JOIN fx_surfels_b
        ON abs(floor(qx/0.3::DOUBLE) - floor(cx/0.3::DOUBLE)) <= 1 AND abs(floor(qy/0.3::DOUBLE) - floor(cy/0.3::DOUBLE)) <= 1 AND abs(floor(qz/0.3::DOUBLE) - floor(cz/0.3::DOUBLE)) <= 1),
      b AS (SELECT seed_id, idx FROM c WHERE t >= 0.95 AND d <= 2*sqrt(l1) + 0.1 QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY t*confidence/(1 + d) DESC, idx) = 1)
      SELECT seed_id, coalesce(idx, -1) AS idx, idx IS NULL AS is_new, {r("qx", "cx")}, CASE WHEN idx IS NULL THEN round(0.0001::DOUBLE, 6) ELSE 0 END AS l1, CASE WHEN idx IS NULL THEN 1.0::DOUBLE ELSE 0 END AS total_weight, CASE WHEN idx IS NULL THEN round(ax, 6) ELSE 0 END AS sum_nx FROM q LEFT JOIN b USING (seed_id)""",
    "b22_merge_map": f"""WITH RECURSIVE {WB}, pr AS (SELECT a.idx AS a, b.idx AS b FROM wb a JOIN wb b USING ({K}) WHERE a.idx <> b.idx AND abs(a.nx*b.nx + a.ny*b.ny) >= 0.95
        AND sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) + (a.cz-b.cz)*(a.cz-b.cz)) <= sqrt(a.l1) + sqrt(b.l1) + 0.1),
      re AS (SELECT idx, idx AS far FROM wb UNION SELECT re.idx, pr.b FROM re JOIN pr ON re.far = pr.a),
      ro AS (SELECT idx, min(far) AS root FROM re GROUP BY idx),
      gr AS (SELECT root, sum(cx*w)/sum(w) AS ox, sum(cy*w)/sum(w) AS oy, sum(cz*w)/sum(w) AS oz, max(sqrt(l1)) AS wide, max(confidence) AS confidence, sum(w) AS total_weight, sum(point_count)::BIGINT AS point_count, sum(observations)::BIGINT AS observations,
        sum(l0*point_count) AS sum_sq, count(*) AS parts FROM wb JOIN ro USING (idx) GROUP BY root),
      fa AS (SELECT root, max(sqrt((cx-ox)*(cx-ox) + (cy-oy)*(cy-oy) + (cz-oz)*(cz-oz))) AS far FROM wb JOIN ro USING (idx) JOIN gr USING (root) WHERE idx <> root GROUP BY root),
      al AS (SELECT g.*, CASE WHEN parts > 1 THEN ox ELSE s.cx END AS cx, CASE WHEN parts > 1 THEN oy ELSE s.cy END AS cy, CASE WHEN parts > 1 THEN oz ELSE s.cz END AS cz, greatest(wide, coalesce((wide + far)*0.6, 0)) AS radius FROM gr g LEFT JOIN fa USING (root) JOIN wb s ON s.idx = g.root)
      SELECT root AS idx, {rs("cx", "cy", "cz", "radius", "confidence", "total_weight", "sum_sq")}, parts, point_count, observations, {BK} FROM al""",
    "b18_add_surfels": f"""WITH {WB}, t AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY confidence DESC, idx) <= 6 AS stays FROM wb),
      p AS (SELECT o.idx, s.idx AS target, sqrt((o.cx-s.cx)*(o.cx-s.cx) + (o.cy-s.cy)*(o.cy-s.cy) + (o.cz-s.cz)*(o.cz-s.cz)) AS d, abs(o.nx*s.nx + o.ny*s.ny) AS m, sqrt(o.l1) + sqrt(s.l1) AS reach
        FROM t o JOIN t s USING ({K}) WHERE NOT o.stays AND s.stays),
      h AS (SELECT idx, target FROM p WHERE m >= 0.95 AND d <= reach + 0.1 QUALIFY row_number() OVER (PARTITION BY idx ORDER BY m/(1 + 10*d) DESC, target) = 1),
      a AS (SELECT coalesce(h.target, t.idx) AS idx, t.* EXCLUDE (idx), h.target IS NOT NULL AS taken FROM t LEFT JOIN h ON t.idx = h.idx WHERE t.stays OR h.target IS NOT NULL),
      g AS (SELECT idx, count(*) FILTER (WHERE taken) AS merged, sum(point_count)::BIGINT AS point_count, sum(observations)::BIGINT AS observations, sum(cx*w)/sum(w) AS cx, sum(cy*w)/sum(w) AS cy, sum(cz*w)/sum(w) AS cz,
        sum(nx*point_count) AS sx, sum(ny*point_count) AS sy, max(confidence) AS confidence, sum(w) AS total_weight FROM a GROUP BY idx)
      SELECT idx, merged, point_count, observations, {rs("cx", "cy", "cz", "confidence", "total_weight")}, {r("sx/sqrt(sx*sx + sy*sy)", "nx")}, {r("sy/sqrt(sx*sx + sy*sy)", "ny")} FROM g""",
    "b21_merge": f"""WITH {WB}, j AS (SELECT a.idx AS a, b.idx AS b, b.w/(a.w + b.w) AS f, a.cx AS x, a.cy AS y, a.cz AS z, b.cx AS bx, b.cy AS by_, b.cz AS bz, greatest(sqrt(a.l1), sqrt(b.l1)) AS wide, greatest(a.confidence, b.confidence) AS confidence,
        a.w + b.w AS total_weight, a.point_count + b.point_count AS point_count, a.observations + b.observations AS observations, a.l0*a.point_count + b.l0*b.point_count AS sum_sq, sqrt(a.l1) + sqrt(b.l1) AS reach, abs(a.nx*b.nx + a.ny*b.ny) AS m
        FROM wb a JOIN wb b USING ({K}) WHERE a.idx < b.idx),
      o AS (SELECT *, x + f*(bx - x) AS cx, y + f*(by_ - y) AS cy, z + f*(bz - z) AS cz FROM j WHERE m >= 0.95 AND sqrt((x-bx)*(x-bx) + (y-by_)*(y-by_) + (z-bz)*(z-bz)) <= reach + 0.1)
      SELECT a, b, point_count, observations, {rs("cx", "cy", "cz", "confidence", "total_weight", "sum_sq")}, {r("greatest(wide, 0.6*(wide + sqrt((cx-bx)*(cx-bx) + (cy-by_)*(cy-by_) + (cz-bz)*(cz-bz))))", "radius")} FROM o""",
    "b28_aspect": f"WITH {cte('fx_surfels_b')} SELECT idx, {r('sqrt(l0/l1)', 'aspect')} FROM fx_surfels_b",
    "b19_merge_pairs": f"WITH {cte('fx_surfels_b')}, s AS (SELECT *, {BK} FROM fx_surfels_b) SELECT a.idx AS a, b.idx AS b FROM s a JOIN s b USING ({K}) WHERE a.idx < b.idx AND abs(a.nx*b.nx + a.ny*b.ny) >= 0.95 AND sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) + (a.cz-b.cz)*(a.cz-b.cz)) <= sqrt(a.l1) + sqrt(b.l1) + 0.1",
    "b23_b25_statistics": f"WITH {cte('fx_surfels_b')}, s AS (SELECT *, {BK}, sqrt(l1) >= 0.05 AS m FROM fx_surfels_b) SELECT count(*) AS total, count(*) FILTER (WHERE m) AS mature, count(DISTINCT ({K})) AS voxels, {r('avg(confidence*0.99::DOUBLE) FILTER (WHERE m)', 'mean_confidence')}, {r('avg(sqrt(l1)) FILTER (WHERE m)', 'mean_radius')} FROM s",
    "s5_pose_as_of": f"""WITH {cte("fx_scan_events")}, {cte("fx_pose_events")}
      SELECT drone_id, scan_id, event_id, {rs("px")} FROM (SELECT s.drone_id, s.scan_id, p.event_id, p.px FROM fx_scan_events s JOIN fx_pose_events p ON p.drone_id = s.drone_id AND p.ts <= s.ts
        QUALIFY row_number() OVER (PARTITION BY s.drone_id, s.scan_id ORDER BY p.ts DESC, p.event_id DESC) = 1)""",
    "s7_pose_kept": f"WITH {cte('fx_scan_events')}, {cte('fx_pose_events')} SELECT count(*) AS scans, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM fx_pose_events p WHERE p.drone_id = s.drone_id AND p.ts <= s.ts)) AS with_pose FROM fx_scan_events s",
    "s7_stream_kept_pose": f"""WITH {cte("fx_scan_events")}, {cte("fx_pose_events")}
      SELECT drone_id, scan_id, coalesce(event_id, -1) AS event_id, {r("coalesce(px, -1.0)", "px")} FROM (SELECT s.drone_id, s.scan_id, p.event_id, p.px FROM fx_scan_events s LEFT JOIN fx_pose_events p ON p.drone_id = s.drone_id AND p.ts <= s.ts
        QUALIFY row_number() OVER (PARTITION BY s.drone_id, s.scan_id ORDER BY p.ts DESC NULLS LAST, p.event_id DESC) = 1)""",
    "s8_latest_pose": f"WITH {cte('fx_pose_events')} SELECT drone_id, event_id, {rs('px', 'yaw')} FROM fx_pose_events QUALIFY row_number() OVER (PARTITION BY drone_id ORDER BY ts DESC, event_id DESC) = 1",
    # v v' of the largest eigenvalue is (A - e0)(A - e1) but for a factor, so its product with a side vector has that axis' way and sign.
    "s9_surfel_markers": f"""WITH {MAP}, {EDGES}, li AS (SELECT *, 0.2672612419124244 AS i, 0.5345224838248488 AS j, 0.8017837257372732 AS k FROM su
        WHERE is_valid AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.qx = su.vx AND ed.qy = su.vy AND ed.qz = su.vz)),
      m1 AS (SELECT *, (cxx-e1)*i + cxy*j + cxz*k AS ti, cxy*i + (cyy-e1)*j + cyz*k AS tj, cxz*i + cyz*j + (czz-e1)*k AS tk FROM li),
      m2 AS (SELECT *, (cxx-e0)*ti + cxy*tj + cxz*tk AS bi, cxy*ti + (cyy-e0)*tj + cyz*tk AS bj, cxz*ti + cyz*tj + (czz-e0)*tk AS bk FROM m1),
      m3 AS (SELECT * EXCLUDE (bi, bj, bk), bi/sqrt(bi*bi+bj*bj+bk*bk) AS bi, bj/sqrt(bi*bi+bj*bj+bk*bk) AS bj, bk/sqrt(bi*bi+bj*bj+bk*bk) AS bk FROM m2),
      m4 AS (SELECT *, ny*bk - nz*bj AS oi, nz*bi - nx*bk AS oj, nx*bj - ny*bi AS ok_ FROM m3),
      m5 AS (SELECT *, CASE WHEN oi*i + oj*j + ok_*k < 0 THEN -1 ELSE 1 END AS sg FROM m4),
      m6 AS (SELECT *, oi*sg AS pi_, oj*sg AS pj, ok_*sg AS pk FROM m5),
      m7 AS (SELECT *, CASE WHEN nx*(pj*bk - pk*bj) + ny*(pk*bi - pi_*bk) + nz*(pi_*bj - pj*bi) < 0 THEN -1 ELSE 1 END AS f FROM m6),
      m8 AS (SELECT *, 1 + pi_ + bj*f + nz AS qa, 1 + pi_ - bj*f - nz AS qb, 1 - pi_ + bj*f - nz AS qc, 1 - pi_ - bj*f + nz AS qd, bk*f - ny AS dx, nx - pk AS dy, pj - bi*f AS dz FROM m7)
      SELECT vx, vy, vz, {rs("mx", "my", "mz", digits=4)}, {r("sqrt(greatest(0, qa))/2", "qw", 4)}, {r("sign(dx)*sqrt(greatest(0, qb))/2", "qx", 4)}, {r("sign(dy)*sqrt(greatest(0, qc))/2", "qy", 4)}, {r("sign(dz)*sqrt(greatest(0, qd))/2", "qz", 4)},
        {r("2*sqrt(greatest(e1, 1e-6))", "scale_x", 4)}, {r("2*sqrt(greatest(e2, 1e-6))", "scale_y", 4)} FROM m8""",
    "s10_coverage_markers": f"WITH {COVER} SELECT s.vx, s.vy, s.vz, {r('(s.vx + 0.5)*0.3', 'x')}, {r('(s.vy + 0.5)*0.3', 'y')}, {r('(s.vz + 0.5)*0.3', 'z')}, CASE WHEN c.vx IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS g, CASE WHEN c.vx IS NULL THEN 0.4 ELSE 0.8 END::DOUBLE AS alpha FROM su s LEFT JOIN cv c USING ({K}) WHERE s.is_valid",
    "s11_view_cloud": f"WITH {COVER} SELECT v.vp_id, CASE WHEN c.vx IS NULL THEN 0 ELSE 255 END::INT AS r, 255::INT AS g, {r('(v.vx + 0.5)*0.3', 'x')}, {r('(v.vy + 0.5)*0.3', 'y')}, {r('(v.vz + 0.5)*0.3', 'z')} FROM vis v LEFT JOIN cv c USING ({K})",
    "s12_fusion_markers": f"WITH {cte('fx_surfels_b')} SELECT idx, {r('cx + 0.1*nx', 'tx')}, {r('cy + 0.1*ny', 'ty')}, {r('cz + 0.1*nz', 'tz')}, {r('1 - least(1.0, confidence)', 'r')}, {r('least(1.0, confidence)', 'g')} FROM fx_surfels_b WHERE sqrt(l1) >= 0.05",
    "s12_counted_markers": f"WITH {cte('fx_surfels_b')} SELECT idx, {r('cx + 0.1*nx', 'tx')}, {r('1 - least(1, (idx % 300)/200.0)', 'r')}, {r('least(1, (idx % 300)/200.0)', 'g')}, 0.0::DOUBLE AS b FROM fx_surfels_b WHERE sqrt(l1) >= 0.05",
    "s12_normal_markers": f"WITH {cte('fx_surfels_b')} SELECT idx, {r('cx + 0.1*nx', 'tx')}, {r('abs(nx)', 'r')}, {r('abs(ny)', 'g')}, {r('abs(nz)', 'b')} FROM fx_surfels_b WHERE sqrt(l1) >= 0.05",
    "s13_s14_clouds": f"WITH {FILTERED} SELECT scan_id, {rs('x', 'y', 'z')} FROM flt",
    "s18_remaining_path": f"WITH {LEGS} SELECT plan_id, seq, {r('x - 1.2', 'x')}, {rs('y', 'z')} FROM lg WHERE seq >= plan_id % 5",
    "s17_active_goals": "SELECT drone_id, goal_id FROM (SELECT user_id AS drone_id, event_id AS goal_id, event_type FROM events WHERE event_type = 'click' OR event_id % 4 > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'click'",
    "s19_path_poses": f"WITH {cte('fx_viewpoints')} SELECT vp_id // 5 AS plan_id, (vp_id % 5)::INT AS seq, {r('cos(yaw/2)', 'qw')}, {r('sin(yaw/2)', 'qz')} FROM fx_viewpoints",
    "s20_scripted_flight": "SELECT 0::BIGINT AS plan_id, * FROM (VALUES " + ", ".join(f"({i}::INT, {', '.join(f'round({float(v)!r}::DOUBLE, 6)' for v in q)})" for i, q in enumerate(FLIGHT)) + ") t(seq, x, y, z, yaw)",
}
