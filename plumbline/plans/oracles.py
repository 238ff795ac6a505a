"""DuckDB SQL for the queries of ``plumbline.plans.queries``."""

from __future__ import annotations

import math
import re

from plumbline.plans import scene

S = repr(scene.S)

#: The demo scene.
PTS = f"""pts AS (
  SELECT k AS facade_id, point_id,
    CASE WHEN k = 1 THEN 30 + w ELSE u END AS x,
    CASE k WHEN 0 THEN w WHEN 1 THEN u WHEN 2 THEN 0.3::DOUBLE * v ELSE 0.5::DOUBLE * v + w END AS y,
    CASE WHEN k <= 1 THEN v WHEN k = 2 THEN w ELSE 0.5::DOUBLE * v END AS z,
    CASE WHEN l_returnflag = 'R' THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END AS cr, CASE WHEN l_returnflag = 'A' THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS cg, l_linenumber / 7::DOUBLE AS cb,
    n1 / sqrt(n1 * n1 + n2 * n2 + n3 * n3) AS nx, n2 / sqrt(n1 * n1 + n2 * n2 + n3 * n3) AS ny, n3 / sqrt(n1 * n1 + n2 * n2 + n3 * n3) AS nz, l_suppkey, l_linenumber
  FROM (SELECT CAST(l_suppkey % 4 AS INTEGER) AS k, (((l_orderkey * 8 + l_linenumber) * 32768 + l_partkey) * 1024 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS point_id,
      l_quantity * 0.5::DOUBLE + l_tax AS u, l_extendedprice / 2000::DOUBLE AS v, (l_discount - 0.05::DOUBLE) * 0.1::DOUBLE AS w,
      (l_discount - 0.05::DOUBLE) * 0.4::DOUBLE + CASE WHEN k = 1 THEN 1 ELSE 0 END AS n1,
      (l_tax - 0.04::DOUBLE) * 0.4::DOUBLE + CASE k WHEN 0 THEN 1 WHEN 3 THEN {S}::DOUBLE ELSE 0 END AS n2,
      (l_linenumber - 4) * 0.02::DOUBLE + CASE k WHEN 2 THEN 1 WHEN 3 THEN -{S}::DOUBLE ELSE 0 END AS n3,
      l_returnflag, l_suppkey, l_linenumber FROM lineitem))"""
FAC = "fac AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if i else str(v) for i, v in enumerate(f)) + ")" for f in scene.FACADES) + ") AS t(" + ", ".join(c.split()[0].removeprefix("n") for c in scene.FACADE_COLUMNS.split(", ")) + "))"

SQL: dict[str, str] = {}


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {name}"


def rs(names: str, digits: int = 6) -> str:
    """Rounded columns; a, b, c, d of planes print as na to nd."""
    return ", ".join(r(n, "n" + n if n in "abcd" else n, digits) for n in names.split())


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def fit(name: str, src: str, keys: str) -> str:
    """A CTE of fitted planes, one row a group."""
    cr = lambda i, a, b: f"{a}2*{b}3 - {a}3*{b}2 AS {i}x, {a}3*{b}1 - {a}1*{b}3 AS {i}y, {a}1*{b}2 - {a}2*{b}1 AS {i}z, {i}x*{i}x + {i}y*{i}y + {i}z*{i}z AS {i}n"
    pick = lambda c: f"CASE WHEN p IS NULL OR p <= 0 OR n < 3 OR greatest(in_, jn, kn) <= 0 THEN {1.0 if c == 'z' else 0.0} WHEN in_ >= jn AND in_ >= kn THEN i{c}/sqrt(in_) WHEN jn >= kn THEN j{c}/sqrt(jn) ELSE k{c}/sqrt(kn) END AS v{c}"
    return f"""{name}_s AS (SELECT {keys}, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, covar_pop(x,x) AS xx, covar_pop(x,y) AS xy, covar_pop(x,z) AS xz, covar_pop(y,y) AS yy, covar_pop(y,z) AS yz, covar_pop(z,z) AS zz FROM {src} GROUP BY {keys}),
{name}_e AS (SELECT *, (xx+yy+zz)/3 AS q, sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*(xy*xy+xz*xz+yz*yz))/6) AS p,
  CASE WHEN p > 0 THEN ((xx-q)*((yy-q)*(zz-q)-yz*yz) - xy*(xy*(zz-q)-yz*xz) + xz*(xy*yz-(yy-q)*xz)) / (p*p*p) END AS det,
  q + 2*p*cos(acos(greatest(-1, least(1, det/2)))/3 + 2*pi()/3) AS low FROM {name}_s),
{name}_c AS (SELECT *, xx-low AS a1, xy AS a2, xz AS a3, xy AS b1, yy-low AS b2, yz AS b3, xz AS c1, yz AS c2, zz-low AS c3, {cr('i', 'a', 'b').replace('AS in', 'AS in_')}, {cr('j', 'a', 'c')}, {cr('k', 'b', 'c')} FROM {name}_e),
{name}_v AS (SELECT *, {pick('x')}, {pick('y')}, {pick('z')}, CASE WHEN abs(vz) >= abs(vx) AND abs(vz) >= abs(vy) THEN vz WHEN abs(vy) >= abs(vx) THEN vy ELSE vx END AS big, CASE WHEN big < 0 THEN -1 ELSE 1 END AS sgn FROM {name}_c),
{name} AS (SELECT {keys}, n, cx, cy, cz, vx*sgn AS a, vy*sgn AS b, vz*sgn AS c, CASE WHEN n < 3 THEN 0 ELSE -(a*cx + b*cy + c*cz) END AS d FROM {name}_v)"""


DIST = "(a*x + b*y + c*z + d) / sqrt(a*a + b*b + c*c)"
#: Axes and plane coordinates of rows with a, b, c, the centre and a point; to follow a SELECT list.
UV = """abs(c) < 0.45::DOUBLE AS steep, sqrt(a*a + b*b) AS flat,
  CASE WHEN abs(c) < 0.9::DOUBLE THEN b ELSE 0.0::DOUBLE END AS lx, CASE WHEN abs(c) < 0.9::DOUBLE THEN -a ELSE c END AS ly, CASE WHEN abs(c) < 0.9::DOUBLE THEN 0.0::DOUBLE ELSE -b END AS lz, sqrt(lx*lx + ly*ly + lz*lz) AS ln,
  CASE WHEN steep THEN CASE WHEN flat < 1e-8 THEN 1 ELSE -b/flat END ELSE lx/ln END AS ux, CASE WHEN steep THEN CASE WHEN flat < 1e-8 THEN 0 ELSE a/flat END ELSE ly/ln END AS uy, CASE WHEN steep THEN 0 ELSE lz/ln END AS uz,
  CASE WHEN steep THEN 0 ELSE b*uz - c*uy END AS vx, CASE WHEN steep THEN 0 ELSE c*ux - a*uz END AS vy, CASE WHEN steep THEN 1 ELSE a*uy - b*ux END AS vz,
  (x-cx)*ux + (y-cy)*uy + (z-cz)*uz AS u, (x-cx)*vx + (y-cy)*vy + (z-cz)*vz AS v"""
TYPE = "CASE WHEN abs(c) <= 0.25 THEN 'vertical_facade' WHEN abs(c) >= 0.85 THEN 'horizontal' ELSE 'inclined' END"
VERT = "degrees(asin(least(abs(c), 1.0::DOUBLE)))"
DEV = "CASE WHEN verticality >= 89.9 THEN 'inf'::DOUBLE ELSE 2 * tan(radians(verticality)) END"

SQL["to_zup"] = with_(PTS) + f"SELECT point_id, {r('x', 'x', 7)}, {r('-z', 'y', 7)}, {r('y', 'z', 7)} FROM pts"
SQL["to_yup"] = with_(PTS) + f"SELECT point_id, {r('x', 'x', 7)}, {r('z', 'y', 7)}, {r('-y', 'z', 7)} FROM pts"
SQL["signed_distance"] = with_(PTS, FAC) + f"SELECT point_id, {r(DIST, 'signed')}, {r(f'abs({DIST})', 'distance')} FROM pts JOIN fac USING (facade_id)"
FITTED = fit("fitted", "pts", "facade_id, l_linenumber")
WALLS = fit("walls", "pts", "facade_id")
SQL["plane_fit"] = with_(PTS, FITTED) + f"SELECT CAST(facade_id AS BIGINT) AS facade_id, CAST(l_linenumber AS BIGINT) AS l_linenumber, n, {rs('cx cy cz a b c d', 8)} FROM fitted"
SQL["classify_planes"] = with_(PTS, FITTED) + f"SELECT CAST(facade_id AS BIGINT) AS facade_id, CAST(l_linenumber AS BIGINT) AS l_linenumber, type, {rs('verticality horizontality deviation')} FROM (SELECT *, {TYPE} AS type, {VERT} AS verticality, degrees(acos(least(abs(c), 1.0::DOUBLE))) AS horizontality, {DEV} AS deviation FROM fitted)"
SQL["plane_axes_uv"] = with_(PTS, WALLS) + f"SELECT point_id, {rs('u v')} FROM (SELECT point_id, {UV} FROM pts JOIN walls USING (facade_id))"
SQL["bbox"] = with_(PTS) + "SELECT CAST(facade_id AS BIGINT) AS facade_id, " + ", ".join(f"{r(f'min({p})', p + '_min')}, {r(f'max({p})', p + '_max')}, {r(f'(min({p}) + max({p})) / 2', p + '_centre')}, {r(f'max({p}) - min({p})', p + '_size')}" for p in "xyz") + " FROM pts GROUP BY facade_id"
SQL["voxel_downsample"] = (
    with_(PTS, "o AS (SELECT facade_id, min(x) - 0.25::DOUBLE AS x0, min(y) - 0.25::DOUBLE AS y0, min(z) - 0.25::DOUBLE AS z0 FROM pts GROUP BY facade_id)")
    + f"SELECT CAST(facade_id AS BIGINT) AS facade_id, CAST(floor((x - x0) / 0.5::DOUBLE) AS BIGINT) AS vx, CAST(floor((y - y0) / 0.5::DOUBLE) AS BIGINT) AS vy, CAST(floor((z - z0) / 0.5::DOUBLE) AS BIGINT) AS vz, {', '.join(r(f'avg({c})', c[-1], 9) for c in ('x', 'y', 'z', 'cr', 'cg', 'cb'))}, count(*) AS points FROM pts JOIN o USING (facade_id) GROUP BY facade_id, vx, vy, vz"
)


def records(key: str, fitted: str) -> str:
    return f"""rec AS (SELECT {key}, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, any_value(cx) AS cx, any_value(cy) AS cy, any_value(cz) AS cz, count(*) AS point_count, avg(s) AS flatness_mean, sqrt(avg(s*s)) AS flatness_rmse, max(s) AS flatness_max, stddev_pop(s) AS flatness,
  min(u) AS u_min, max(u) AS u_max, min(v) AS v_min, max(v) AS v_max FROM (SELECT *, abs({DIST}) AS s, {UV} FROM pts JOIN {fitted} USING ({key})) GROUP BY {key}),
recs AS (SELECT *, {TYPE} AS type, {VERT} AS verticality, degrees(acos(least(abs(c), 1.0::DOUBLE))) AS horizontality, (u_max - u_min) * (v_max - v_min) AS area_bbox FROM rec)"""


SQL["facade_stats"] = with_(PTS, WALLS, records("facade_id", "walls")) + f"SELECT CAST(facade_id AS BIGINT) AS facade_id, type, point_count, {rs('a b c d cx cy cz verticality horizontality flatness_mean flatness_rmse flatness_max flatness u_min u_max v_min v_max area_bbox')} FROM recs"


SQL["points_near_facade"] = (
    with_(PTS, WALLS, records("facade_id", "walls"), "one AS (SELECT a, b, c, d, cx, cy, cz, u_min, u_max, v_min, v_max FROM recs WHERE facade_id = 0)", "xyz AS (SELECT point_id, x, y, z FROM pts)")
    + f"SELECT point_id FROM (SELECT *, abs({DIST}) AS s, {UV} FROM xyz, one) WHERE s <= 0.1::DOUBLE AND u BETWEEN u_min + 5 AND u_max - 5 AND v BETWEEN v_min + 5 AND v_max - 5"
)


def near(name: str, left: str, right: str, radius: float, keys: str, op: str = "<=") -> str:
    """Pairs within a radius, by cells."""
    on = " AND ".join(f"l.{k} = r.{k}" for k in keys.split(", "))
    cell = lambda p, t: f"CAST(floor({t}{p} / {radius}::DOUBLE) AS BIGINT)"
    return f"""{name} AS (SELECT {', '.join('l.' + k for k in keys.split(', '))}, l.point_id AS left_id, r.point_id AS right_id, r.x, r.y, r.z,
  sqrt((l.x-r.x)*(l.x-r.x) + (l.y-r.y)*(l.y-r.y) + (l.z-r.z)*(l.z-r.z)) AS dist
  FROM {left} l JOIN (SELECT *, {cell('x', '')} + ox AS ix, {cell('y', '')} + oy AS iy, {cell('z', '')} + oz AS iz FROM {right}, (SELECT unnest([-1,0,1]) AS ox), (SELECT unnest([-1,0,1]) AS oy), (SELECT unnest([-1,0,1]) AS oz)) r
  ON {on} AND {cell('x', 'l.')} = r.ix AND {cell('y', 'l.')} = r.iy AND {cell('z', 'l.')} = r.iz WHERE dist {op} {radius}::DOUBLE)"""


SQL["normals_hybrid_knn"] = (
    with_(PTS, near("nb", "pts", "pts", 0.35, "facade_id"), "few AS (SELECT left_id AS point_id, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY facade_id, left_id ORDER BY dist, right_id) AS rn FROM nb) WHERE rn <= 20)", fit("nrm", "few", "point_id"))
    + f"SELECT point_id, n AS normal_points, {r('a', 'nx', 3)}, {r('b', 'ny', 3)}, {r('c', 'nz', 3)} FROM nrm WHERE n >= 10"
)
SQL["radius_outlier"] = with_(PTS, near("nb", "pts", "pts", 0.2, "facade_id"), "good AS (SELECT left_id AS point_id FROM nb WHERE left_id <> right_id GROUP BY left_id HAVING count(*) >= 2)") + "SELECT point_id FROM pts WHERE (SELECT count(*) FROM good) < 0.1 * (SELECT count(*) FROM pts) OR point_id IN (SELECT point_id FROM good)"
SQL["statistical_outlier"] = (
    with_(
        PTS,
        "pr AS (SELECT l.l_suppkey, l.point_id, sqrt((l.x-r.x)*(l.x-r.x) + (l.y-r.y)*(l.y-r.y) + (l.z-r.z)*(l.z-r.z)) AS dist, row_number() OVER (PARTITION BY l.l_suppkey, l.point_id ORDER BY dist, r.point_id) AS rn FROM pts l JOIN pts r ON l.l_suppkey = r.l_suppkey AND l.point_id <> r.point_id)",
        "m AS (SELECT p.l_suppkey, p.point_id, coalesce(avg(dist), 0) AS md FROM pts p LEFT JOIN (SELECT * FROM pr WHERE rn <= 8) k ON p.l_suppkey = k.l_suppkey AND p.point_id = k.point_id GROUP BY p.l_suppkey, p.point_id)",
        "lim AS (SELECT l_suppkey, avg(md) + 1.5::DOUBLE * coalesce(stddev_samp(md), 0) AS lim FROM m GROUP BY l_suppkey)",
    )
    + "SELECT point_id FROM m JOIN lim USING (l_suppkey) WHERE md <= lim"
)
SQL["registration_error"] = (
    with_(PTS, "src AS (SELECT * FROM pts WHERE l_linenumber % 2 = 1)", "tgt AS (SELECT * FROM pts WHERE l_linenumber % 2 = 0)", near("nb", "src", "tgt", 0.2, "facade_id", "<"), "best AS (SELECT facade_id, left_id, min(dist) AS dist FROM nb GROUP BY facade_id, left_id)", "h AS (SELECT facade_id, count(*) AS matched, sqrt(avg(dist*dist)) AS rmse FROM best GROUP BY facade_id)")
    + f"SELECT CAST(facade_id AS BIGINT) AS facade_id, points, coalesce(matched, 0) AS matched, {r("coalesce(rmse, 'inf'::DOUBLE)", 'rmse')}, {r('coalesce(matched, 0) / points', 'overlap')} FROM (SELECT facade_id, count(*) AS points FROM src GROUP BY facade_id) LEFT JOIN h USING (facade_id)"
)
SQL["ransac_seed"] = (
    with_(
        PTS,
        "drawn AS (SELECT *, row_number() OVER (ORDER BY h, point_id) - 1 AS rn FROM (SELECT point_id, x, y, z, ((point_id % 2147483647) * 48271 + 17 * 40503) % 2147483647 AS p, (p * p) % 2147483647 AS h FROM pts) ORDER BY h, point_id LIMIT 192)",
        "tri AS (SELECT p.rn // 3 AS t, p.x AS x1, p.y AS y1, p.z AS z1, q.x - p.x AS ax, q.y - p.y AS ay, q.z - p.z AS az, s.x - p.x AS bx, s.y - p.y AS by_, s.z - p.z AS bz, ay*bz - az*by_ AS n1, az*bx - ax*bz AS n2, ax*by_ - ay*bx AS n3, sqrt(n1*n1 + n2*n2 + n3*n3) AS size FROM drawn p JOIN drawn q ON q.rn = p.rn + 1 JOIN drawn s ON s.rn = p.rn + 2 WHERE p.rn % 3 = 0)",
        "hyp AS (SELECT row_number() OVER (ORDER BY t) - 1 AS trial, n1/size AS a, n2/size AS b, n3/size AS c, -(a*x1 + b*y1 + c*z1) AS d FROM tri WHERE size >= 1e-12)",
        f"sc AS (SELECT trial, a, b, c, d, count(*) FILTER (abs({DIST}) <= 0.05::DOUBLE) AS inliers FROM hyp, pts GROUP BY trial, a, b, c, d)",
    )
    + f"SELECT trial, inliers, {rs('a b c d')} FROM sc ORDER BY inliers DESC, trial LIMIT 1"
)
COS5 = repr(math.cos(math.radians(5.0)))
SQL["candidate_filter"] = with_(PTS, FAC) + f"SELECT point_id FROM pts JOIN fac USING (facade_id) WHERE abs({DIST}) <= 0.004::DOUBLE AND abs(nx*a + ny*b + nz*c) >= {COS5}::DOUBLE"
XYZ = "xyz AS (SELECT facade_id, l_linenumber, point_id, x, y, z FROM pts)"
SQL["refit_filter"] = (
    with_(PTS, XYZ, FITTED, f"kept AS (SELECT facade_id, l_linenumber, x, y, z FROM xyz JOIN fitted USING (facade_id, l_linenumber) WHERE abs({DIST}) <= 1.8::DOUBLE * 0.002::DOUBLE)", fit("again", "kept", "facade_id, l_linenumber"))
    + f"SELECT CAST(facade_id AS BIGINT) AS facade_id, CAST(l_linenumber AS BIGINT) AS l_linenumber, n, {rs('cx cy cz a b c d', 8)} FROM again"
)
SQL["grid_components"] = (
    with_(
        PTS,
        FAC,
        "xyz AS (SELECT facade_id, x, y, z FROM pts)",
        f"uv AS (SELECT facade_id, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v FROM (SELECT facade_id, {UV} FROM xyz JOIN fac USING (facade_id)))",
        "st AS (SELECT * FROM uv)",
        "cel AS (SELECT DISTINCT facade_id, CAST(floor((u - u0) / 1.0::DOUBLE) AS BIGINT) AS i, CAST(floor((v - v0) / 1.0::DOUBLE) AS BIGINT) AS j FROM st JOIN (SELECT facade_id, min(u) AS u0, min(v) AS v0 FROM st GROUP BY facade_id) USING (facade_id))",
        "rec AS (SELECT facade_id, i, j, i * 1048576 + j AS lab FROM cel UNION SELECT c.facade_id, c.i, c.j, rec.lab FROM rec JOIN cel c ON c.facade_id = rec.facade_id AND abs(c.i - rec.i) + abs(c.j - rec.j) = 1)",
        "lab AS (SELECT facade_id, i, j, min(lab) AS component FROM rec GROUP BY facade_id, i, j)",
    )
    + "SELECT CAST(facade_id AS BIGINT) AS facade_id, component, count(*) AS cells, CAST(sum(i) AS BIGINT) AS sum_i, CAST(sum(j) AS BIGINT) AS sum_j FROM lab GROUP BY facade_id, component HAVING count(*) >= 3"
)
SQL["dbscan_core_points"] = with_(PTS, near("nb", "pts", "pts", 0.2, "facade_id")) + "SELECT left_id AS point_id, count(*) AS neighbours FROM nb WHERE left_id <> right_id GROUP BY left_id HAVING count(*) >= 3"
SQL["dbscan_clusters"] = (
    with_(
        PTS,
        near("nb", "pts", "pts", 0.3, "facade_id"),
        "core AS (SELECT left_id AS id FROM nb GROUP BY left_id HAVING count(*) >= 4)",
        "edge AS (SELECT left_id, right_id FROM nb WHERE left_id IN (SELECT id FROM core) AND right_id IN (SELECT id FROM core) AND left_id <> right_id)",
        "rec AS (SELECT id, id AS low FROM core UNION SELECT e.right_id, rec.low FROM rec JOIN edge e ON e.left_id = rec.id AND rec.low < e.right_id)",
        "named AS (SELECT id, min(low) AS cluster FROM rec GROUP BY id)",
        "best AS (SELECT left_id, cluster FROM nb JOIN named ON named.id = nb.right_id QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY dist, right_id) = 1)",
    )
    + "SELECT point_id, coalesce(cluster, -1) AS cluster FROM pts LEFT JOIN best ON left_id = point_id"
)
SQL["facade_ranking"] = (
    with_(PTS.replace("pts AS (", "pts0 AS (", 1), "pts AS (SELECT facade_id * 10 + l_linenumber AS facade, x, y, z FROM pts0)", fit("fx", "pts", "facade"), records("facade", "fx"))
    + "SELECT CAST(facade AS BIGINT) AS facade, row_number() OVER (ORDER BY CASE WHEN type = 'vertical_facade' THEN 0 ELSE 1 END, point_count DESC, facade) - 1 AS facade_id, type, point_count FROM recs"
)
SQL["facade_labels"] = with_(PTS, FAC, "xyz AS (SELECT facade_id, point_id, x, y, z FROM pts)") + f"SELECT point_id, CASE WHEN abs({DIST}) <= 0.003::DOUBLE THEN CAST(facade_id AS BIGINT) ELSE -1 END AS facade_id FROM xyz JOIN fac USING (facade_id)"


def quality(least: int = 30) -> tuple[str, ...]:
    n = lambda a: f"CASE WHEN {a}1 - {a}0 < 2 THEN 1 ELSE CAST(floor(({a}1 - {a}0 - 2) / 0.05::DOUBLE + 1e-9) AS BIGINT) + 1 END AS n{a}, CASE WHEN {a}1 - {a}0 < 2 THEN ({a}0 + {a}1 - 2) / 2 ELSE {a}0 END AS o{a}"
    return (
        PTS,
        "xyz AS (SELECT facade_id, point_id, x, y, z FROM pts WHERE facade_id < 2)",
        fit("walls", "xyz", "facade_id"),
        f"pl AS (SELECT facade_id, point_id, x, y, z, v AS vv FROM (SELECT *, {UV} FROM xyz JOIN walls USING (facade_id)))",
        f"sl AS (SELECT facade_id, point_id, x, y, z, least(CAST(floor((vv - w0) / 20) AS BIGINT), greatest(1, CAST(ceil((w1 - w0) / 20) AS BIGINT)) - 1) AS slot FROM pl JOIN (SELECT facade_id, min(vv) AS w0, max(vv) AS w1 FROM pl GROUP BY facade_id) USING (facade_id))",
        f"ids AS (SELECT facade_id, slot, row_number() OVER (PARTITION BY facade_id ORDER BY slot) - 1 AS interval_id FROM sl GROUP BY facade_id, slot HAVING count(*) >= {least})",
        "kept AS (SELECT facade_id, interval_id, point_id, x, y, z FROM sl JOIN ids USING (facade_id, slot))",
        fit("own", "kept", "facade_id, interval_id"),
        f"fl AS (SELECT facade_id, interval_id, point_id, {DIST} AS s, {UV} FROM kept JOIN own USING (facade_id, interval_id))",
        f"sp AS (SELECT *, {n('u')}, {n('v')}, 1 AS stride FROM (SELECT facade_id, interval_id, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM fl GROUP BY facade_id, interval_id))",
        "ku AS (SELECT facade_id, interval_id, ou, nv, ov, stride, unnest(range(0, nu, stride)) AS ku FROM sp)",
        "inu AS (SELECT fl.facade_id, fl.interval_id, point_id, s, v, ku, nv, ov, stride FROM fl JOIN ku ON fl.facade_id = ku.facade_id AND fl.interval_id = ku.interval_id AND u >= ou + ku * 0.05::DOUBLE AND u <= ou + ku * 0.05::DOUBLE + 2)",
        "kv AS (SELECT facade_id, interval_id, unnest(range(0, nv, stride)) AS kv FROM sp)",
        f"win AS (SELECT inu.facade_id, inu.interval_id, ku, kv, count(*) AS points, abs(avg(s)) AS gap FROM inu JOIN kv ON inu.facade_id = kv.facade_id AND inu.interval_id = kv.interval_id AND v >= ov + kv * 0.05::DOUBLE AND v <= ov + kv * 0.05::DOUBLE + 2 GROUP BY inu.facade_id, inu.interval_id, ku, kv HAVING count(*) >= {least})",
    )


def exact_quality(least: int = 30) -> tuple[str, ...]:
    """Windows by places in whole micrometres from the interval's least, planes about centres of whole nanometres: nothing hangs on the order in which
    doubles are summed. Both window bounds are closed."""
    exact = lambda *a: re.sub(r"avg\((.)\)", r"CAST(sum(CAST(floor(\1 * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS DOUBLE) / 1e9::DOUBLE / count(*)", fit(*a))
    whole = lambda e: f"CAST(floor(({e}) * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT)"
    n = lambda a: f"CASE WHEN max({a}) < 2000000 THEN 1 ELSE (max({a}) - 2000000) // 50000 + 1 END AS n{a}"
    # a window k has the places k * 50000 to k * 50000 + 2000000; places are not negative
    over = lambda a: f"CASE WHEN {a} <= 2000000 THEN 0 ELSE ({a} - 2000000 + 49999) // 50000 END AS a{a}, least(n{a} - 1, {a} // 50000) AS b{a}"
    return (
        PTS,
        "xyz AS (SELECT facade_id, point_id, x, y, z FROM pts WHERE facade_id < 2)",
        exact("walls", "xyz", "facade_id"),
        f"pl AS (SELECT facade_id, point_id, x, y, z, v AS vv FROM (SELECT *, {UV} FROM xyz JOIN walls USING (facade_id)))",
        f"sl AS (SELECT facade_id, point_id, x, y, z, least({whole('vv - w0')} // 20000000, greatest(1, CAST(ceil({whole('w1 - w0')} / 20000000) AS BIGINT)) - 1) AS slot FROM pl JOIN (SELECT facade_id, min(vv) AS w0, max(vv) AS w1 FROM pl GROUP BY facade_id) USING (facade_id))",
        f"ids AS (SELECT facade_id, slot, row_number() OVER (PARTITION BY facade_id ORDER BY slot) - 1 AS interval_id FROM sl GROUP BY facade_id, slot HAVING count(*) >= {least})",
        "kept AS (SELECT facade_id, interval_id, point_id, x, y, z FROM sl JOIN ids USING (facade_id, slot))",
        exact("own", "kept", "facade_id, interval_id"),
        f"fl AS (SELECT facade_id, interval_id, {DIST} AS s, {UV} FROM kept JOIN own USING (facade_id, interval_id))",
        f"mm AS (SELECT facade_id, interval_id, s, {whole('u - u0')} AS u, {whole('v - v0')} AS v FROM (SELECT facade_id, interval_id, s, u, v FROM fl) JOIN (SELECT facade_id, interval_id, min(u) AS u0, min(v) AS v0 FROM fl GROUP BY facade_id, interval_id) USING (facade_id, interval_id))",
        f"sp AS (SELECT facade_id, interval_id, {n('u')}, {n('v')} FROM mm GROUP BY facade_id, interval_id)",
        f"cov AS (SELECT facade_id, interval_id, s, {over('u')}, {over('v')} FROM mm JOIN sp USING (facade_id, interval_id))",
        "inu AS (SELECT facade_id, interval_id, unnest(range(au, bu + 1)) AS ku, av, bv, n, s FROM (SELECT facade_id, interval_id, au, bu, av, bv, count(*) AS n, sum(s) AS s FROM cov GROUP BY ALL))",
        "inv AS (SELECT facade_id, interval_id, ku, unnest(range(av, bv + 1)) AS kv, n, s FROM (SELECT facade_id, interval_id, ku, av, bv, CAST(sum(n) AS BIGINT) AS n, sum(s) AS s FROM inu GROUP BY ALL))",
        f"win AS (SELECT facade_id, interval_id, ku, kv, CAST(sum(n) AS BIGINT) AS points, abs(sum(s) / sum(n)) AS gap FROM inv GROUP BY facade_id, interval_id, ku, kv HAVING sum(n) >= {least})",
    )


IDS = "CAST(facade_id AS BIGINT) AS facade_id, CAST(interval_id AS BIGINT) AS interval_id"
RES = f"""res AS (SELECT own.facade_id, own.interval_id, n AS point_count, coalesce(windows, 0) AS windows, coalesce(wg, spread) AS gap, {VERT} AS verticality, {DEV} AS deviation, coalesce(wg, spread) <= 0.004 AS compliant
  FROM own JOIN (SELECT facade_id, interval_id, max(s) - min(s) AS spread FROM fl GROUP BY facade_id, interval_id) USING (facade_id, interval_id)
  LEFT JOIN (SELECT facade_id, interval_id, count(*) AS windows, max(gap) FILTER (gap > 0) AS wg FROM win GROUP BY facade_id, interval_id) USING (facade_id, interval_id))"""
LEV = "lev AS (SELECT *, CASE WHEN gap <= 0.001::DOUBLE THEN 0 WHEN gap <= 0.002::DOUBLE THEN 1 ELSE 2 END AS level FROM win)"
LRES = "lres AS (SELECT facade_id, interval_id, count(*) AS windows, count(*) FILTER (level = 0) AS passed, count(*) FILTER (level = 1) AS warned, count(*) FILTER (level = 2) AS failed, max(gap) AS gap, passed / windows AS compliance, compliance >= 0.95 AS compliant FROM lev GROUP BY facade_id, interval_id)"
SQL["quality_windows"] = with_(*exact_quality()) + f"SELECT {IDS}, ku, kv, points, {r('gap', 'gap')} FROM win"
SQL["quality_intervals"] = with_(*quality(), RES) + f"SELECT {IDS}, point_count, windows, {rs('gap verticality deviation')}, compliant FROM res"
SQL["quality_overall"] = with_(*quality(), RES) + f"SELECT CAST(facade_id AS BIGINT) AS facade_id, count(*) AS intervals, {r('max(gap)', 'gap')}, {r('max(verticality)', 'verticality')}, {r('max(deviation)', 'deviation')}, max(gap) <= 0.004 AS compliant, count(*) FILTER (compliant) AS compliant_intervals FROM res GROUP BY facade_id"
SQL["quality_levels"] = with_(*quality(), LEV, LRES) + f"SELECT {IDS}, windows, passed, warned, failed, {rs('gap compliance')}, compliant FROM lres"
SQL["quality_weighted"] = with_(*quality(), LEV, LRES) + f"SELECT CAST(facade_id AS BIGINT) AS facade_id, {r('sum(gap * n) / sum(n)', 'gap')}, {r('sum(compliance * n) / sum(n)', 'compliance')}, CAST(sum(n) AS BIGINT) AS points FROM lres JOIN own USING (facade_id, interval_id) GROUP BY facade_id"
SQL["point_levels"] = (
    with_(
        *quality(),
        LEV,
        # both window bounds are closed
        "hit AS (SELECT inu.facade_id, inu.interval_id, point_id, max(level) AS level FROM inu JOIN lev ON inu.facade_id = lev.facade_id AND inu.interval_id = lev.interval_id AND inu.ku = lev.ku AND v >= ov + kv * 0.05::DOUBLE AND v <= ov + kv * 0.05::DOUBLE + 2 GROUP BY ALL)",
        "pl2 AS (SELECT fl.facade_id, fl.interval_id, point_id, coalesce(level, -1) AS level FROM fl LEFT JOIN hit USING (facade_id, interval_id, point_id))",
    )
    + f"SELECT {IDS}, CAST(level AS BIGINT) AS level, count(*) AS points FROM pl2 GROUP BY facade_id, interval_id, level"
)
SQL["flatness_metrics"] = with_(PTS, XYZ, FITTED, f"sd AS (SELECT facade_id, l_linenumber, {DIST} AS s FROM xyz JOIN fitted USING (facade_id, l_linenumber))") + f"SELECT CAST(facade_id AS BIGINT) AS facade_id, CAST(l_linenumber AS BIGINT) AS l_linenumber, {r('max(s) - min(s)', 'gap')}, {r('stddev_pop(s)', 'std')}, {r('sqrt(avg(s*s))', 'rmse')} FROM sd GROUP BY facade_id, l_linenumber"
SQL["segment_dimensions"] = with_(PTS, FAC, "xyz AS (SELECT facade_id, x, y, z FROM pts)", f"fl AS (SELECT facade_id, {TYPE} AS ptype, z, {UV} FROM xyz JOIN fac USING (facade_id))") + f"SELECT CAST(facade_id AS BIGINT) AS facade_id, type, {rs('width height')}, {r('width * height', 'area')} FROM (SELECT facade_id, any_value(ptype) AS type, max(u) - min(u) AS width, CASE WHEN any_value(ptype) = 'vertical_facade' THEN max(z) - min(z) ELSE max(v) - min(v) END AS height FROM fl GROUP BY facade_id)"

#: Pixels of the demo camera.
CAM = "cam AS (SELECT *, x - 10 AS c1, 25 - z AS c2, y + 60 AS depth, c1 / depth AS xn, c2 / depth AS yn, xn*xn + yn*yn AS rr, 1 + rr * (-0.05::DOUBLE + rr * 0.01::DOUBLE) AS rad, 1000 * (xn*rad + 0.002::DOUBLE*xn*yn - 0.001::DOUBLE * (rr + 2*xn*xn)) + 960 AS px, 1000 * (yn*rad + 0.001::DOUBLE * (rr + 2*yn*yn) - 0.002::DOUBLE*xn*yn) + 540 AS py FROM pts)"


def quad(u: str, v: str, corners) -> str:
    terms = [f"CASE WHEN ({y0}::DOUBLE > {v}) <> ({y1}::DOUBLE > {v}) AND {u} < {x1 - x0}::DOUBLE * ({v} - {y0}::DOUBLE) / {y1 - y0}::DOUBLE + {x0}::DOUBLE THEN 1 ELSE 0 END" for (x0, y0), (x1, y1) in zip(corners, [*corners[1:], corners[0]], strict=True) if y0 != y1]
    return f"(({' + '.join(terms)}) % 2 = 1)"


INQ = quad("px", "py", scene.QUAD)
SQL["project_points"] = with_(PTS, CAM) + f"SELECT point_id, {r('px', 'px', 7)}, {r('py', 'py', 7)}, {r('depth', 'depth', 7)} FROM cam"
SQL["points_in_quad"] = with_(PTS, CAM) + f"SELECT point_id, CAST(facade_id AS BIGINT) AS facade_id FROM cam WHERE depth > 1e-9 AND {INQ}"
SQL["facade_in_photo"] = with_(PTS, CAM, f"ct AS (SELECT facade_id, count(*) FILTER (depth > 1e-9 AND {INQ}) AS inside, count(*) AS points FROM cam GROUP BY facade_id)") + f"SELECT CAST(facade_id AS BIGINT) AS facade_id, inside, points, {r('inside / points', 'coverage')} FROM ct WHERE inside >= 3 ORDER BY inside DESC, inside / points DESC, facade_id LIMIT 1"
SQL["largest_visible_facade"] = (
    with_(PTS, FAC, CAM, "nu AS (SELECT *, row_number() OVER (PARTITION BY facade_id ORDER BY point_id) - 1 AS i, count(*) OVER (PARTITION BY facade_id) AS everything FROM cam)", "ct AS (SELECT facade_id, count(*) FILTER (depth > 1e-9 AND px >= 0 AND px < 1920 AND py >= 0 AND py < 1080) AS visible, count(*) AS sampled FROM nu WHERE i % greatest(1, everything // 5000) = 0 GROUP BY facade_id)")
    + f"SELECT CAST(facade_id AS BIGINT) AS facade_id, visible, sampled, {r('area', 'area')}, {r('visible / sampled', 'share')}, {r('area * (visible / sampled)', 'score')} FROM ct JOIN fac USING (facade_id) WHERE visible >= 3 AND visible / sampled >= 0.02 ORDER BY area * (visible / sampled) DESC, facade_id LIMIT 1"
)
SQL["snap_to_plane"] = (
    with_(FAC, "o AS (SELECT o_orderkey AS query_id, o_totalprice / 20000 AS x, (o_custkey % 40)::DOUBLE AS y, (o_orderkey % 30)::DOUBLE AS z FROM orders)", f"al AS (SELECT *, {DIST} AS s, row_number() OVER (PARTITION BY query_id ORDER BY abs(s) > 4, abs(s), area DESC, facade_id) AS rn FROM o, fac)")
    + f"SELECT query_id, CAST(facade_id AS BIGINT) AS facade_id, {r('abs(s)', 'dist', 7)}, {r('x - s*a', 'snapped_x', 7)}, {r('y - s*b', 'snapped_y', 7)}, {r('z - s*c', 'snapped_z', 7)} FROM al WHERE rn = 1"
)
# the planted camera, and the pairs whose pixels were left as they are
SQL["camera_pose"] = with_(PTS) + f"""SELECT CAST(l_linenumber AS INTEGER) AS photo_id, count(*) AS pairs, count(*) FILTER (NOT (l_linenumber % 2 = 1 AND point_id % 1000 % 10 = 3)) AS inliers,
  {scene.POSE['camera_matrix'][0][0]}::DOUBLE AS focal, 0.0::DOUBLE AS rmse, {-scene.POSE['translation'][0]}::DOUBLE AS x, {-scene.POSE['translation'][2]}::DOUBLE AS y, {scene.POSE['translation'][1]}::DOUBLE AS z
FROM pts WHERE facade_id IN (0, 3) AND y + {scene.POSE['translation'][2]}::DOUBLE > 1 GROUP BY ALL HAVING count(*) >= 4"""
SQL["lod_sample"] = f"SELECT o_orderkey AS point_id, {r('o_totalprice', 'o_totalprice')} FROM orders WHERE o_orderkey % 7 = 0"
SQL["lod_stride"] = f"SELECT point_id, {r('o_totalprice', 'o_totalprice')} FROM (SELECT o_orderkey AS point_id, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 7 = 0"
SQL["row_numbers"] = "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS number FROM lineitem"
SQL["price_quantiles"] = f"SELECT l_returnflag, count(*) AS n, {r('quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5)', 'median')}, {r('quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.98)', 'high')} FROM lineitem GROUP BY l_returnflag"
SQL["rect_select_stride"] = with_(PTS, CAM) + "SELECT point_id FROM (SELECT *, row_number() OVER (ORDER BY point_id) - 1 AS i FROM cam) WHERE i % 3 = 0 AND depth > 1e-9 AND px BETWEEN 900 AND 1100 AND py BETWEEN 400 AND 600"
SQL["rect_select"] = with_(PTS, CAM) + "SELECT point_id FROM cam WHERE point_id % 3 = 0 AND depth > 1e-9 AND px BETWEEN 900 AND 1100 AND py BETWEEN 400 AND 600"
OFF = "sqrt((px - 1000) * (px - 1000) + (py - 500) * (py - 500))"
SQL["nearest_pick"] = with_(PTS, CAM) + f"SELECT point_id, CAST(facade_id AS BIGINT) AS facade_id, {r(OFF, 'off')}, {r('depth', 'depth')} FROM cam WHERE depth > 1e-9 ORDER BY {OFF} > 8, {OFF}, point_id LIMIT 1"


def _corner_sql() -> str:
    from plumbline.operators.photo import camera_centre, pixel_ray
    from plumbline.plans.queries import CORNERS

    centre, parts = camera_centre(scene.POSE), []
    for i, (pixel, corner) in enumerate(zip(scene.QUAD, CORNERS, strict=True)):
        ray = pixel_ray(pixel, scene.POSE)[1]
        d2 = " + ".join(f"({p} - {c}::DOUBLE) * ({p} - {c}::DOUBLE)" for p, c in zip("xyz", corner, strict=True))
        along = " + ".join(f"({p} - ({o!r})::DOUBLE) * ({k!r})::DOUBLE" for p, o, k in zip("xyz", centre, ray, strict=True))
        rel2 = " + ".join(f"({p} - ({o!r})::DOUBLE) * ({p} - ({o!r})::DOUBLE)" for p, o in zip("xyz", centre, strict=True))
        parts.append(f"(SELECT {i} AS corner, {corner[0]}::DOUBLE AS gx, {corner[1]}::DOUBLE AS gy, {corner[2]}::DOUBLE AS gz, point_id, x, y, z, sqrt((px - {pixel[0]}) * (px - {pixel[0]}) + (py - {pixel[1]}) * (py - {pixel[1]})) AS error FROM cam WHERE facade_id = 0 AND depth > 1e-9 AND ({d2} <= 9 OR {rel2} - ({along}) * ({along}) <= 2.25))")
    best = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY corner ORDER BY error, point_id) AS rn FROM (" + " UNION ALL ".join(parts) + ") WHERE error <= 120) WHERE rn = 1)"
    guess = "guess AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {c[0]}::DOUBLE, {c[1]}::DOUBLE, {c[2]}::DOUBLE)" for i, c in enumerate(CORNERS)) + ") AS t(corner, hx, hy, hz))"
    return with_(PTS, CAM, best, guess) + f"SELECT CAST(corner AS BIGINT) AS corner, point_id, {r('error', 'error')}, {', '.join(r(f'coalesce({p}, h{p})', p) for p in 'xyz')} FROM guess LEFT JOIN best USING (corner)"


SQL["refine_corners"] = _corner_sql()


def _quad3_sql() -> str:
    import numpy as np

    from plumbline.operators.photo import _axes

    at = np.array([(5.0, 5.0, 5.0), (15.0, 6.0, 6.0), (14.0, 15.0, 15.0), (6.0, 14.0, 14.0)])
    u, v = _axes(np.array(scene.FACADES[3][1:4]))
    flat = [(float(a), float(b)) for a, b in zip((at - at[0]) @ u, (at - at[0]) @ v, strict=True)]
    dot = lambda w: " + ".join(f"({p} - 5.0::DOUBLE) * ({float(k)!r})::DOUBLE" for p, k in zip("xyz", w, strict=True))
    return with_(PTS) + f"SELECT point_id FROM (SELECT point_id, {dot(u)} AS pu, {dot(v)} AS pv FROM pts) WHERE {quad('pu', 'pv', flat)}"


SQL["points_in_3d_quad"] = _quad3_sql()
C, N, H = ((0.03, 0.22, 1.0), (0.48, 0.48, 0.48), (1.0, 0.08, 0.02))
SQL["heatmap_cells"] = (
    with_(
        PTS,
        "fl AS (SELECT -x AS u, z AS v, y AS s FROM pts WHERE facade_id = 0)",
        "bd AS (SELECT min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1, greatest(2.0::DOUBLE, (max(u) - min(u)) / 200, (max(v) - min(v)) / 200) AS size, greatest(1, CAST(ceil((max(u) - min(u)) / greatest(2.0::DOUBLE, (max(u) - min(u)) / 200, (max(v) - min(v)) / 200) - 1e-12) AS BIGINT)) AS nu, greatest(1, CAST(ceil((max(v) - min(v)) / greatest(2.0::DOUBLE, (max(u) - min(u)) / 200, (max(v) - min(v)) / 200) - 1e-12) AS BIGINT)) AS nv FROM fl)",
        "ce AS (SELECT least(nu - 1, CAST(floor((u - u0) / size) AS BIGINT)) AS i, least(nv - 1, CAST(floor((v - v0) / size) AS BIGINT)) AS j, quantile_cont(s, 0.5) AS value, count(*) AS points FROM fl, bd GROUP BY ALL HAVING count(*) >= 3)",
        "ed AS (SELECT i, j, value, points, least(bd.u1, bd.u0 + i * size) AS a0, least(bd.u1, bd.u0 + (i + 1) * size) AS a1, least(bd.v1, bd.v0 + j * size) AS b0, least(bd.v1, bd.v0 + (j + 1) * size) AS b1 FROM ce, bd)",
        "li AS (SELECT greatest(0.004, quantile_cont(abs(value), 0.98)) AS lim FROM ed WHERE a1 > a0 AND b1 > b0)",
        "he AS (SELECT *, greatest(-1, least(1, value / lim)) AS t FROM ed, li WHERE a1 > a0 AND b1 > b0)",
    )
    + f"SELECT i, j, {r('value', 'value')}, points, {r('a0', 'u0')}, {r('a1', 'u1')}, {r('b0', 'v0')}, {r('b1', 'v1')}, {r('lim', '\"limit\"')}, "
    + ", ".join(r(f"CASE WHEN t < 0 THEN {n}::DOUBLE + (-t) * ({c}::DOUBLE - {n}::DOUBLE) ELSE {n}::DOUBLE + t * ({h}::DOUBLE - {n}::DOUBLE) END", k) for c, n, h, k in zip(C, N, H, "rgb", strict=True))
    + " FROM he"
)
TYPES = {"vertical_facade": (0.95, 0.68, 0.18), "horizontal": (0.25, 0.65, 0.95), "inclined": (0.55, 0.45, 0.9)}
DIM_TYPES = {"vertical_facade": (0.55, 0.38, 0.12), "horizontal": (0.12, 0.34, 0.5), "inclined": (0.28, 0.22, 0.45)}


def by_type(expr: str, i: int, table: dict, other: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {c[i]}::DOUBLE" for k, c in table.items()) + f" ELSE {other} END"


ON_TYPE = "FROM pts JOIN (SELECT facade_id, type FROM fac) USING (facade_id)"
SQL["highlight_colors"] = with_(PTS, FAC) + "SELECT point_id, " + ", ".join(r(f"CASE WHEN facade_id = 1 THEN {h}::DOUBLE ELSE {by_type('type', i, DIM_TYPES, f'0.22::DOUBLE * c{c}')} END", f"show_{c}") for i, (c, h) in enumerate(zip("rgb", (0.2, 0.8, 0.2), strict=True))) + f" {ON_TYPE}"
SQL["label_colors"] = with_(PTS, FAC) + "SELECT point_id, " + ", ".join(r(by_type("CASE WHEN l_linenumber <= 5 THEN type END", i, TYPES, f"0.35::DOUBLE * c{c}"), f"show_{c}") for i, c in enumerate("rgb")) + f" {ON_TYPE}"
SQL["uniform_colors"] = with_(PTS) + "SELECT CAST(facade_id AS BIGINT) AS facade_id, CAST(l_linenumber AS BIGINT) AS l_linenumber, greatest(max(cr) - min(cr), max(cg) - min(cg), max(cb) - min(cb)) <= 1e-4 AS uniform FROM pts GROUP BY facade_id, l_linenumber"


def _moved(prefix: str = "") -> list[str]:
    from plumbline.plans.queries import MOVE

    return [f"({m[0]!r})::DOUBLE * {prefix}x + ({m[1]!r})::DOUBLE * {prefix}y + ({m[2]!r})::DOUBLE * {prefix}z + ({m[3]!r})::DOUBLE" for m in MOVE]


def _rigid_rows() -> str:
    from plumbline.plans.queries import MOVE

    return "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {j}::BIGINT, round(({v!r})::DOUBLE, 6))" for i, row in enumerate([*MOVE, [0.0, 0.0, 0.0, 1.0]]) for j, v in enumerate(row)) + ") AS t(i, j, value)"


SQL["rigid_align"] = _rigid_rows()
SQL["apply_transform"] = with_(PTS) + "SELECT point_id, " + ", ".join(r(m, p, 7) for m, p in zip(_moved(), "xyz", strict=True)) + " FROM pts"
SQL["merge_clouds"] = (
    with_(PTS, "s AS (SELECT 'source' AS cloud, point_id, x, y, z, 1.0::DOUBLE AS cr, 0.4::DOUBLE AS cg, 0.4::DOUBLE AS cb FROM pts WHERE l_linenumber % 2 = 1)", "t0 AS (SELECT * FROM pts WHERE l_linenumber % 2 = 0)", "un AS (SELECT coalesce(greatest(max(cr) - min(cr), max(cg) - min(cg), max(cb) - min(cb)), 0) <= 1e-4 AS uni FROM t0)")
    + f"SELECT cloud, point_id, {', '.join(r(p, p, 7) for p in 'xyz')}, {r('cr', 'r', 7)}, {r('cg', 'g', 7)}, {r('cb', 'b', 7)} FROM (SELECT * FROM s UNION ALL SELECT 'target', point_id, x, y, z, CASE WHEN uni THEN 0.4::DOUBLE ELSE cr END, CASE WHEN uni THEN 0.4::DOUBLE ELSE cg END, CASE WHEN uni THEN 1.0::DOUBLE ELSE cb END FROM t0, un)"
)
FILES = "f AS (SELECT o_orderkey AS id, o_custkey % 20 AS project_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS scene_id, lower(o_orderstatus) AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'CACHE' WHEN 1 THEN 'PERSIST' ELSE 'TEMP' END AS policy, '/data/' || o_orderkey || '.ply' AS path, o_orderkey % 13 = 0 AS is_deleted FROM orders)"
SQL["catalog_gc"] = with_(FILES) + "SELECT f.id, CASE WHEN f.id % 7 = 0 THEN 'missing' WHEN policy = 'CACHE' AND scene_id IS NOT NULL AND NOT coalesce(c_acctbal > 0, false) THEN 'remove' ELSE 'keep' END AS action FROM f LEFT JOIN customer ON c_custkey = scene_id WHERE NOT is_deleted AND policy IN ('CACHE', 'PERSIST')"
SQL["catalog_missing"] = with_(FILES) + "SELECT id, path FROM f WHERE NOT is_deleted AND kind IN ('o', 'f') AND id % 5 = 0"
SQL["catalog_listing"] = "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey <> 3 ORDER BY (c_custkey * 37) % 1000 DESC, c_custkey DESC LIMIT 50"
SQL["catalog_upsert"] = "SELECT c_name AS project_uuid, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'old' END AS name, CASE WHEN c_custkey % 3 = 0 THEN '/new' ELSE '/old' END AS root_dir FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"
SQL["catalog_activate"] = "SELECT c_custkey AS id, 'X' AS status, CASE WHEN c_nationkey = 7 THEN c_custkey = 30 ELSE c_acctbal > 0 END AS is_active FROM customer"
SQL["catalog_soft_delete"] = with_(FILES) + "SELECT project_id, count(*) FILTER (is_deleted OR id % 10 = 0) AS deleted, count(*) AS files FROM f GROUP BY project_id"
STEM = lambda e: f"regexp_replace(regexp_replace({e}, '[^\\w.\\-]+', '_', 'g'), '(.)\\.[^.]*$', '\\1')"
TAG = "replace(format('{:.6g}', p_size / 100.0::DOUBLE), '.', 'p')"
NAME = "p_name || ' scan.v1.ply'"
SQL["result_ids"] = (
    f"SELECT p_partkey, {STEM(NAME)} || '__' || {STEM("p_brand || '.ply'")} || '_v' || {TAG} AS registration, "
    f"'facade_' || substr(regexp_replace({NAME}, '[^\\p{{L}}\\p{{N}}_\\-]', '_', 'g'), 1, 40) || '_' || substr(sha1({NAME} || '|' || p_partkey || '|' || format('{{:.4f}}', p_size / 100.0::DOUBLE) || '|' || format('{{:.2f}}', p_size::DOUBLE)), 1, 12) AS detection, "
    f"{STEM(NAME)} || '_s' || p_partkey || '_v' || {TAG} || '.ply' AS cache FROM part"
)
SQL["file_kinds"] = "SELECT p_partkey, ['point_cloud', 'point_cloud', 'image', 'pdf', 'other', 'point_cloud'][p_partkey % 6 + 1] AS kind, regexp_replace(p_name || '.' || ['ply', 'PCD', 'jpg', 'pdf', 'docx', 'xyz'][p_partkey % 6 + 1], '[^\\w.\\-]+', '_', 'g') AS name FROM part"
SQL["conversion_jobs"] = "SELECT path, stem || CASE WHEN n > 1 THEN '_' || n ELSE '' END || '.ply' AS output FROM (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY path) AS n FROM (SELECT '/scans/' || p_partkey || '/' || nm || '.fls' AS path, regexp_replace(nm, '[^\\w.\\-]+', '_', 'g') AS stem FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS nm FROM part)))"
SQL["project_index"] = "SELECT o_custkey % 50 AS project, count(*) AS scan_count, CAST(sum(o_orderkey) AS BIGINT) AS total_points FROM orders GROUP BY 1"
SQL["sidecar_parse"] = f"SELECT CAST(event_id AS VARCHAR) AS path, coalesce(event_type, '') AS scan_name, CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END AS num_rows, {r('coalesce(value, 0)', 'range_m')}, 1.0::DOUBLE AS factor, '' AS scanner FROM events"
SQL["ply_vertices"] = "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey END AS vertices FROM part"
SQL["pick_debounce"] = """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, event_type, event_id, n, ms AS last, true AS ok FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.n, CASE WHEN e.ms - w.last >= 1800000 THEN e.ms ELSE w.last END, e.ms - w.last >= 1800000
  FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.n = w.n + 1)
SELECT event_id FROM w WHERE ok"""
