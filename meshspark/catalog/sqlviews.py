"""SQL text of the fixture views and of shared expressions (DuckDB dialect)."""

from __future__ import annotations


def u(seed: str, *keys: str) -> str:
    parts = "||'|'||".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(('0x'||substr(md5({parts}),1,8))::UBIGINT/4294967296.0)"


def gauss(seed: str, *keys: str) -> str:
    return f"(sqrt(-2.0*ln(1.0-{u(seed + '/r', *keys)}))*cos(2.0*pi()*{u(seed + '/a', *keys)}))"


def r6(expr: str) -> str:
    return f"(round({expr},6)+0.0)"


def cols6(*names: str) -> str:
    return ", ".join(f"{r6(n)} AS {n}" for n in names)


GRID = """grid AS MATERIALIZED (SELECT p_partkey AS vid, p_partkey%50 AS i, p_partkey//50 AS j, CAST(p_partkey%50 AS DOUBLE) AS x,
  CAST(p_partkey//50 AS DOUBLE) AS y, p_size*CAST(0.05 AS DOUBLE) AS z FROM part)"""
FACES = GRID + """,
faces AS MATERIALIZED (SELECT g.j//10 AS arch_id, t.fid, t.v0, t.v1, t.v2, (g.i//3)%17 AS label FROM grid g
  JOIN grid o ON o.vid = g.vid+51,
  LATERAL (SELECT 2*g.vid AS fid, g.vid AS v0, g.vid+1 AS v1, g.vid+50 AS v2
           UNION ALL SELECT 2*g.vid+1, g.vid+1, g.vid+51, g.vid+50) t WHERE g.i < 49)"""
CORNERS = FACES + """,
corners AS (SELECT f.*, a.x AS px, a.y AS py, a.z AS pz, b.x AS qx, b.y AS qy, b.z AS qz, c.x AS rx, c.y AS ry, c.z AS rz
  FROM faces f JOIN grid a ON a.vid=f.v0 JOIN grid b ON b.vid=f.v1 JOIN grid c ON c.vid=f.v2)"""
GEOM = CORNERS + """,
crossed AS (SELECT *, (qy-py)*(rz-pz)-(qz-pz)*(ry-py) AS kx, (qz-pz)*(rx-px)-(qx-px)*(rz-pz) AS ky,
  (qx-px)*(ry-py)-(qy-py)*(rx-px) AS kz, (px+qx+rx)/3.0 AS mx, (py+qy+ry)/3.0 AS my, (pz+qz+rz)/3.0 AS mz FROM corners),
geom AS MATERIALIZED (SELECT *, kx/sqrt(kx*kx+ky*ky+kz*kz) AS nx, ky/sqrt(kx*kx+ky*ky+kz*kz) AS ny, kz/sqrt(kx*kx+ky*ky+kz*kz) AS nz,
  0.5*sqrt(kx*kx+ky*ky+kz*kz) AS area FROM crossed)"""
ADJ = """edges AS (SELECT arch_id, fid, least(p,q) AS e0, greatest(p,q) AS e1 FROM (
    SELECT arch_id, fid, v0 AS p, v1 AS q FROM faces UNION ALL SELECT arch_id, fid, v1, v2 FROM faces
    UNION ALL SELECT arch_id, fid, v2, v0 FROM faces)),
adj AS MATERIALIZED (SELECT DISTINCT arch_id, min(fid) AS a, max(fid) AS b FROM edges WHERE e0<>e1
  GROUP BY arch_id, e0, e1 HAVING count(*)=2 AND min(fid)<>max(fid))"""
FRAMES = """tooth AS (SELECT arch_id, label, avg(mx) AS ox, avg(my) AS oy, avg(mz) AS oz, avg(nx) AS sx, avg(ny) AS sy, avg(nz) AS sz
  FROM geom GROUP BY arch_id, label),
tf AS MATERIALIZED (SELECT arch_id, label, ox, oy, oz, sx/l AS nx, sy/l AS ny, sz/l AS nz FROM (
  SELECT *, sqrt(sx*sx+sy*sy+sz*sz) AS l FROM tooth))"""
TANGENTS = FRAMES + """,
nb AS (SELECT t.*, a.ox AS pox, a.oy AS poy, a.oz AS poz, b.ox AS qox, b.oy AS qoy, b.oz AS qoz FROM tf t
  LEFT JOIN tf a ON a.arch_id=t.arch_id AND a.label=t.label-1 AND a.label>=1
  LEFT JOIN tf b ON b.arch_id=t.arch_id AND b.label=t.label+1 AND b.label<=16 WHERE t.label BETWEEN 1 AND 16),
raw_dir AS (SELECT *,
  CASE WHEN pox IS NULL AND qox IS NULL THEN 1.0-nx*nx ELSE coalesce(qox,ox)-coalesce(pox,ox) END AS dx,
  CASE WHEN pox IS NULL AND qox IS NULL THEN 0.0-ny*nx ELSE coalesce(qoy,oy)-coalesce(poy,oy) END AS dy,
  CASE WHEN pox IS NULL AND qox IS NULL THEN 0.0-nz*nx ELSE coalesce(qoz,oz)-coalesce(poz,oz) END AS dz FROM nb),
in_plane AS (SELECT *, dx-nx*(dx*nx+dy*ny+dz*nz) AS ex, dy-ny*(dx*nx+dy*ny+dz*nz) AS ey, dz-nz*(dx*nx+dy*ny+dz*nz) AS ez FROM raw_dir),
tangent AS MATERIALIZED (SELECT arch_id, label, ox, oy, oz, nx, ny, nz, ex/l AS tx, ey/l AS ty, ez/l AS tz FROM (
  SELECT *, sqrt(ex*ex+ey*ey+ez*ez) AS l FROM in_plane))"""
FACIAL = TANGENTS + """,
center AS (SELECT arch_id, avg(mx) AS ax, avg(my) AS ay, avg(mz) AS az FROM geom WHERE label<>0 GROUP BY arch_id),
out0 AS (SELECT t.*, ox-c.ax AS fx0, oy-c.ay AS fy0, oz-c.az AS fz0 FROM tangent t JOIN center c USING (arch_id)),
out1 AS (SELECT *, fx0-nx*(fx0*nx+fy0*ny+fz0*nz) AS fx1, fy0-ny*(fx0*nx+fy0*ny+fz0*nz) AS fy1, fz0-nz*(fx0*nx+fy0*ny+fz0*nz) AS fz1 FROM out0),
out2 AS (SELECT *, fx1-tx*(fx1*tx+fy1*ty+fz1*tz) AS fx2, fy1-ty*(fx1*tx+fy1*ty+fz1*tz) AS fy2, fz1-tz*(fx1*tx+fy1*ty+fz1*tz) AS fz2 FROM out1),
facial AS MATERIALIZED (SELECT arch_id, label, ox, oy, oz, nx, ny, nz, tx, ty, tz, fx2/l AS fx, fy2/l AS fy, fz2/l AS fz FROM (
  SELECT *, sqrt(fx2*fx2+fy2*fy2+fz2*fz2) AS l FROM out2))"""
POINTS = """pts AS (SELECT CAST(label AS BIGINT) AS cloud, vec_id AS pid, CAST(embedding[1] AS DOUBLE)*20.0 AS x,
  CAST(embedding[2] AS DOUBLE)*20.0 AS y, CAST(embedding[3] AS DOUBLE)*20.0 AS z, embedding AS feat FROM embeddings)"""
V3 = """fr AS (SELECT event_id AS mesh_id, event_id AS seq, (user_id//16)%4 AS run_id, event_type AS frame_type, ts,
  user_id AS region, value, CAST(floor(value*10) AS BIGINT)+1 AS face_count, props AS header,
  CAST(floor(epoch(date_trunc('second', ts))-1704067200) AS BIGINT)//21600 AS cycle, 1+user_id%16 AS label,
  CAST(user_id%16 AS DOUBLE)*4.0+value*CAST(0.01 AS DOUBLE) AS cx, value*CAST(0.05 AS DOUBLE) AS cy,
  CAST(event_id%7 AS DOUBLE)*CAST(0.1 AS DOUBLE) AS cz FROM events)"""
COUNTS = V3 + """,
cc AS (SELECT run_id, cycle, label, count(*) AS n, avg(cx) AS cx, avg(cy) AS cy, avg(cz) AS cz FROM fr GROUP BY ALL)"""
OBS = """obs AS (SELECT l_orderkey AS chunk, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, l_suppkey AS supp,
  l_quantity AS cx, l_discount*100 AS cy, l_tax*100 AS cz,
  CAST(CASE WHEN l_returnflag='N' THEN 102 ELSE 120+l_partkey%130 END AS BIGINT) AS r,
  CAST(CASE WHEN l_returnflag='N' THEN 102 ELSE 100+l_suppkey%140 END AS BIGINT) AS g,
  CAST(CASE WHEN l_returnflag='N' THEN 102 ELSE 90+(l_orderkey*7)%150 END AS BIGINT) AS b,
  (l_linestatus='F') AS is_gum_pred, l_extendedprice AS price FROM lineitem)"""
RUNS = """ru AS (SELECT o_custkey%20 AS run_id, row_number() OVER (PARTITION BY o_custkey%20 ORDER BY o_orderdate, o_orderkey)-1 AS epoch,
  o_totalprice/1e6 AS metric FROM orders)"""
LOGITS = """lg AS (SELECT vec_id AS fid, CAST(label AS BIGINT) AS target, list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE)*8.0) AS logits FROM embeddings)"""
SCORED = LOGITS + """,
sc AS (SELECT fid//20 AS patch_id, fid, CAST((fid//20)*37%600 AS DOUBLE) AS area_mm2, target AS gt,
  CAST(list_position(logits, list_max(logits))-1 AS BIGINT) AS pred FROM lg)"""
