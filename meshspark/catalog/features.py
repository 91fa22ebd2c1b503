"""Normalisation, feature and augmentation queries on the lattice mesh."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshspark import fixtures
from meshspark.catalog.common import lattice_geometry, out
from meshspark.catalog.mesh import _W
from meshspark.catalog.registry import query
from meshspark.catalog.sqlviews import ADJ, FACES, GEOM, cols6, gauss, r6, u
from meshspark.functions.vectors import rounded
from meshspark.operators import augment, mesh, normalise as nz
from meshspark.session import cut_lineage


def _normals(spark, sf):
    g = cut_lineage(lattice_geometry(spark, sf))
    return g, mesh.vertex_normals(g)


CN = f"""{_W}, gn AS MATERIALIZED (SELECT g.*, a.nx AS pnx, a.ny AS pny, a.nz AS pnz, b.nx AS qnx, b.ny AS qny, b.nz AS qnz, c.nx AS rnx, c.ny AS rny, c.nz AS rnz
  FROM geom g JOIN vn a ON a.arch_id=g.arch_id AND a.vid=g.v0 JOIN vn b ON b.arch_id=g.arch_id AND b.vid=g.v1 JOIN vn c ON c.arch_id=g.arch_id AND c.vid=g.v2)"""
USED = """usedv AS (SELECT DISTINCT arch_id, vid FROM (SELECT arch_id, v0 AS vid FROM faces UNION ALL SELECT arch_id, v1 FROM faces UNION ALL SELECT arch_id, v2 FROM faces)),
verts AS MATERIALIZED (SELECT arch_id, vid, x, y, z FROM usedv JOIN grid USING (vid))"""

CENTRE = """ctr AS (SELECT arch_id, avg(c0x) AS ax, avg(c0y) AS ay, avg(c0z) AS az FROM (
  SELECT arch_id, px AS c0x, py AS c0y, pz AS c0z FROM geom UNION ALL SELECT arch_id, qx, qy, qz FROM geom UNION ALL SELECT arch_id, rx, ry, rz FROM geom) GROUP BY arch_id)"""


@query("patch_normalise", f"""WITH {GEOM}, {CENTRE} SELECT g.arch_id AS patch_id, fid, {r6('(px-ax)/15.0')} AS px, {r6('(qy-ay)/15.0')} AS qy, {r6('(mz-az)/15.0')} AS mz FROM geom g JOIN ctr USING (arch_id)""")
def patch_normalise(spark, sf):
    g = lattice_geometry(spark, sf).withColumnRenamed("arch_id", "patch_id")
    return out(nz.normalise_patch(g), ["patch_id", "fid"], ["px", "qy", "mz"])


@query("move_to_origin", f"""WITH {FACES}, {USED}, c AS (SELECT arch_id, avg(x) AS ax, avg(y) AS ay, avg(z) AS az FROM verts GROUP BY arch_id)
SELECT arch_id, vid, {r6('x-ax')} AS x, {r6('y-ay')} AS y, {r6('z-az')} AS z FROM verts JOIN c USING (arch_id)""")
def move_to_origin(spark, sf):
    return out(nz.move_to_origin(fixtures.lattice_vertices(spark, sf)), ["arch_id", "vid"], ["x", "y", "z"])


@query("mesh_normalise", f"""WITH {GEOM}, {CN}, {USED}, sv AS (SELECT arch_id, avg(x) AS mx0, stddev_samp(x) AS sx0, min(z) AS z0, max(z) AS z1 FROM verts GROUP BY arch_id),
sn AS (SELECT arch_id, avg(nx) AS mn, stddev_samp(nx) AS sn FROM vn GROUP BY arch_id), sf AS (SELECT arch_id, avg(nz) AS mf, stddev_samp(nz) AS sf FROM geom GROUP BY arch_id)
SELECT arch_id, fid, {r6('(px-mx0)/sx0')} AS px, {r6('(mz-z0)/(z1-z0)')} AS mz, {r6('(pnx-mn)/sn')} AS pnx, {r6('(nz-mf)/sf')} AS nz FROM gn JOIN sv USING (arch_id) JOIN sn USING (arch_id) JOIN sf USING (arch_id)""")
def mesh_normalise(spark, sf):
    g, vn = _normals(spark, sf)
    vn = cut_lineage(vn)
    stats = nz.mesh_stats(fixtures.lattice_vertices(spark, sf), vn, g)
    return out(nz.normalise_mesh(nz.with_corner_normals(g, vn), stats), ["arch_id", "fid"], ["px", "mz", "pnx", "nz"])


@query("feature_rows", f"""WITH {GEOM}, {CN}, {CENTRE} SELECT g.arch_id AS patch_id, fid, 24 AS dims, {r6('round(CAST((px-ax)/15.0 AS FLOAT),5)')} AS first, {r6('round(CAST(CAST((mx-ax)/15.0 AS FLOAT) AS DOUBLE),5)')} AS pos0, {r6('round(CAST(CAST(nz AS FLOAT) AS DOUBLE),5)')} AS last FROM gn g JOIN ctr USING (arch_id)"""
       .replace("24 AS dims", "CAST(24 AS BIGINT) AS dims").replace("round(CAST((px-ax)/15.0 AS FLOAT),5)", "round(CAST(CAST((px-ax)/15.0 AS FLOAT) AS DOUBLE),5)"))
def feature_rows(spark, sf):
    g, vn = _normals(spark, sf)
    d = nz.normalise_patch(nz.with_corner_normals(g, vn).withColumnRenamed("arch_id", "patch_id"))
    d = d.select("patch_id", "fid", nz.feature_row().alias("x"))
    r5 = lambda c: rounded(F.round(c.cast("double"), 5))
    return d.select("patch_id", "fid", F.size("x").cast("bigint").alias("dims"), r5(F.col("x")[0]).alias("first"),
                    r5(nz.position_of(F.col("x"))[0]).alias("pos0"), r5(F.col("x")[23]).alias("last"))


@query("pca_covariance", f"WITH {GEOM} SELECT arch_id, {', '.join(r6(f'covar_pop(m{a},m{b})') + f' AS cov_{a}{b}' for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM geom GROUP BY arch_id")
def pca_covariance(spark, sf):
    c = nz.covariance(lattice_geometry(spark, sf), ["arch_id"], "m")
    return out(c, ["arch_id"], [f"cov_{n}" for n in ("xx", "xy", "xz", "yy", "yz", "zz")])


@query("pca_axes")
def pca_axes(spark, sf):
    g = cut_lineage(lattice_geometry(spark, sf))
    axes = nz.principal_axes(nz.covariance(g, ["arch_id"], "m"), ["arch_id"])
    mean = g.groupBy("arch_id").agg(*[F.avg(f"n{a}").alias(f"g{a}") for a in "xyz"])
    return nz.view_axes(axes, mean, ["arch_id"])


@query("projected_corners")
def projected_corners(spark, sf):
    g = cut_lineage(lattice_geometry(spark, sf))
    axes = nz.principal_axes(nz.covariance(g, ["arch_id"], "m"), ["arch_id"])
    mean = g.groupBy("arch_id").agg(*[F.avg(f"n{a}").alias(f"g{a}") for a in "xyz"])
    d = nz.project_corners(g, nz.view_axes(axes, mean, ["arch_id"]), ["arch_id"])
    return out(d, ["arch_id", "fid"], ["u_p", "v_p", "u_q", "v_q", "u_r", "v_r", "depth"])


def _patch(spark, sf):
    f = cut_lineage(fixtures.lattice_faces(spark, sf))
    p = f.select(F.concat_ws("/", "arch_id", "label").alias("patch_id"), "arch_id", "fid", "label")
    return p, mesh.face_adjacency(f)


_PD = """pf AS MATERIALIZED (SELECT arch_id||'/'||label AS patch_id, arch_id, fid, label FROM faces),
pdeg AS MATERIALIZED (SELECT f.patch_id, f.arch_id, f.fid, count(n.fid) AS degree, count(*) OVER (PARTITION BY f.patch_id) AS nf FROM pf f LEFT JOIN (
  SELECT x.patch_id, a.a AS fid FROM adj a JOIN pf x ON x.fid=a.a JOIN pf y ON y.fid=a.b WHERE x.patch_id=y.patch_id
  UNION ALL SELECT x.patch_id, a.b FROM adj a JOIN pf x ON x.fid=a.a JOIN pf y ON y.fid=a.b WHERE x.patch_id=y.patch_id) n ON n.fid=f.fid GROUP BY f.patch_id, f.arch_id, f.fid)"""


@query("erode_boundary", f"""WITH {FACES}, {ADJ}, {_PD} SELECT patch_id, arch_id, fid FROM pdeg WHERE NOT (nf>=20 AND degree<3 AND {u('erode', 'patch_id', 'fid')}<0.3*{u('erode/rate', 'patch_id')})""")
def erode_boundary(spark, sf):
    p, adj = _patch(spark, sf)
    return augment.erode_boundary(p, adj).select("patch_id", "arch_id", "fid")


@query("punch_holes")
def punch_holes(spark, sf):
    p, adj = _patch(spark, sf)
    return augment.punch_holes(p.drop("label"), adj)


@query("drop_faces")
def drop_faces(spark, sf):
    p, adj = _patch(spark, sf)
    return augment.drop_faces(p.drop("label"), adj)


@query("jitter_positions", f"""WITH {FACES}, {USED} SELECT arch_id AS patch_id, vid, {', '.join(r6(f"{a}+0.15*{u('jit/sigma', 'arch_id')}*{gauss('jit/' + a, 'arch_id', 'vid')}") + f' AS {a}' for a in 'xyz')} FROM verts""")
def jitter_positions(spark, sf):
    v = fixtures.lattice_vertices(spark, sf).withColumnRenamed("arch_id", "patch_id")
    return out(augment.jitter_positions(v), ["patch_id", "vid"], ["x", "y", "z"])


_JN = ", ".join(f"n{a}+0.08*{u('jitn/sigma', 'arch_id')}*{gauss('jitn/' + a, 'arch_id', 'fid')} AS j{a}" for a in "xyz")


@query("jitter_normals", f"""WITH {GEOM}, j AS (SELECT arch_id, fid, {_JN} FROM geom) SELECT arch_id AS patch_id, fid, {', '.join(r6(f'j{a}/(sqrt(jx*jx+jy*jy+jz*jz)+CAST(1e-9 AS DOUBLE))') + f' AS n{a}' for a in 'xyz')} FROM j""")
def jitter_normals(spark, sf):
    g = lattice_geometry(spark, sf).withColumnRenamed("arch_id", "patch_id").select("patch_id", "fid", "nx", "ny", "nz")
    return out(augment.jitter_normals(g, "fid"), ["patch_id", "fid"], ["nx", "ny", "nz"])
