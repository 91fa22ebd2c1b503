"""Geometry and mesh set queries on the lattice mesh."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshspark import fixtures
from meshspark.catalog.common import lattice_geometry, longs, out
from meshspark.catalog.registry import query
from meshspark.catalog.sqlviews import ADJ, CORNERS, FACES, GEOM, cols6, r6
from meshspark.functions import labels as lab
from meshspark.operators import mesh


@query("face_geometry", f"""WITH {GEOM} SELECT arch_id, fid, label, {cols6('mx', 'my', 'mz', 'nx', 'ny', 'nz', 'area')} FROM geom""")
def face_geometry(spark, sf):
    return out(lattice_geometry(spark, sf), ["arch_id", "fid", "label"], ["mx", "my", "mz", "nx", "ny", "nz", "area"])


@query("face_labels", f"""WITH {FACES}, vl AS (SELECT DISTINCT f.arch_id, v.vid, (v.i//3)%17 AS label FROM grid v JOIN (
  SELECT arch_id, v0 AS vid FROM faces UNION SELECT arch_id, v1 FROM faces UNION SELECT arch_id, v2 FROM faces) f ON f.vid=v.vid)
SELECT f.arch_id, f.fid, vl.label FROM faces f JOIN vl ON vl.arch_id=f.arch_id AND vl.vid=f.v0""")
def face_labels(spark, sf):
    from meshspark.sources.mesh_text import face_labels_from_vertex_labels
    v = fixtures.lattice_vertices(spark, sf).select(
        "arch_id", "vid", F.expr("((vid % 50) div 3) % 17").alias("label"))
    faces = fixtures.lattice_faces(spark, sf).drop("label")
    return face_labels_from_vertex_labels(faces, v).select("arch_id", "fid", "label")


def corner_angle(o: str, u: str, v: str) -> str:
    dot = "+".join(f"({u}{a}-{o}{a})*({v}{a}-{o}{a})" for a in "xyz")
    uu = "+".join(f"({u}{a}-{o}{a})*({u}{a}-{o}{a})" for a in "xyz")
    vv = "+".join(f"({v}{a}-{o}{a})*({v}{a}-{o}{a})" for a in "xyz")
    return f"acos(least(1.0, greatest(-1.0, ({dot})/(sqrt({uu})*sqrt({vv})))))"


_W = f"""wt AS (SELECT arch_id, v0 AS vid, nx, ny, nz, {corner_angle('p','q','r')} AS w FROM geom
  UNION ALL SELECT arch_id, v1, nx, ny, nz, {corner_angle('q','p','r')} FROM geom
  UNION ALL SELECT arch_id, v2, nx, ny, nz, {corner_angle('r','p','q')} FROM geom),
sm AS (SELECT arch_id, vid, sum(nx*w) AS x, sum(ny*w) AS y, sum(nz*w) AS z FROM wt GROUP BY ALL),
vn AS (SELECT arch_id, vid, x/sqrt(x*x+y*y+z*z) AS nx, y/sqrt(x*x+y*y+z*z) AS ny, z/sqrt(x*x+y*y+z*z) AS nz FROM sm)"""


@query("vertex_normals", f"WITH {GEOM}, {_W} SELECT arch_id, vid, {cols6('nx', 'ny', 'nz')} FROM vn")
def vertex_normals(spark, sf):
    return out(mesh.vertex_normals(lattice_geometry(spark, sf)), ["arch_id", "vid"], ["nx", "ny", "nz"])


@query("face_adjacency", f"WITH {FACES}, {ADJ} SELECT arch_id, a, b FROM adj")
def face_adjacency(spark, sf):
    return mesh.face_adjacency(fixtures.lattice_faces(spark, sf))


_DEG = """deg AS (SELECT f.arch_id, f.label, f.fid, count(n.fid) AS degree FROM faces f LEFT JOIN (
  SELECT a.arch_id, a.a AS fid, y.label FROM adj a JOIN faces x ON x.fid=a.a JOIN faces y ON y.fid=a.b WHERE x.label=y.label
  UNION ALL SELECT a.arch_id, a.b, x.label FROM adj a JOIN faces x ON x.fid=a.a JOIN faces y ON y.fid=a.b WHERE x.label=y.label) n
  ON n.arch_id=f.arch_id AND n.fid=f.fid GROUP BY ALL)"""


@query("boundary_degree", f"WITH {FACES}, {ADJ}, {_DEG} SELECT arch_id, label, fid, degree, degree<3 AS boundary FROM deg")
def boundary_degree(spark, sf):
    f = fixtures.lattice_faces(spark, sf)
    d = mesh.inner_degree(f.select("arch_id", "label", "fid"), mesh.face_adjacency(f), ["arch_id", "label"])
    return d.select("arch_id", "label", "fid", "degree", (F.col("degree") < 3).alias("boundary"))


@query("mesh_area_density", f"""WITH {GEOM} SELECT arch_id, count(*) AS n_faces, {r6('sum(area)')} AS area_mm2, {r6('count(*)/sum(area)')} AS density,
  CAST(round_even(sum(area)*0.5,0) AS BIGINT) AS target, least(CAST(round_even(sum(area)*0.5,0) AS BIGINT),300) AS capped FROM geom GROUP BY arch_id""")
def mesh_area_density(spark, sf):
    a = mesh.mesh_area(lattice_geometry(spark, sf), "arch_id")
    d = a.withColumn("density", F.col("n_faces") / F.col("area_mm2")) \
        .withColumn("target", mesh.target_count(F.col("area_mm2"), 0.5)) \
        .withColumn("capped", mesh.target_count(F.col("area_mm2"), 0.5, cap=300))
    return longs(out(d, ["arch_id", "n_faces", "target", "capped"], ["area_mm2", "density"]), "capped")


@query("merge_weld", f"""WITH {FACES}, used AS (SELECT DISTINCT arch_id, vid FROM (SELECT arch_id, v0 AS vid FROM faces UNION ALL SELECT arch_id, v1 FROM faces UNION ALL SELECT arch_id, v2 FROM faces))
SELECT CAST(0 AS BIGINT) AS run_id, (SELECT count(*) FROM used) AS n_before, (SELECT count(DISTINCT vid) FROM used) AS n_after, (SELECT count(*) FROM faces) AS n_faces""")
def merge_weld(spark, sf):
    from meshspark.operators.merge import merge_meshes
    v = fixtures.lattice_vertices(spark, sf).select(F.lit(0).cast("bigint").alias("run_id"),
                                                    F.col("arch_id").alias("mesh_id"), "vid", "x", "y", "z")
    f = fixtures.lattice_faces(spark, sf).select(F.lit(0).cast("bigint").alias("run_id"),
                                                 F.col("arch_id").alias("mesh_id"), "fid", "v0", "v1", "v2")
    mv, mf = merge_meshes(v, f)
    before = v.groupBy("run_id").agg(F.count("*").alias("n_before"))
    return before.join(mv.groupBy("run_id").agg(F.count("*").alias("n_after")), "run_id") \
        .join(mf.groupBy("run_id").agg(F.count("*").alias("n_faces")), "run_id")


@query("pad_faces", f"""WITH {GEOM}, t AS (SELECT arch_id, count(*) AS n, max(fid) AS mx, CAST(round_even(sum(area)*1.6,0) AS BIGINT) AS target FROM geom GROUP BY arch_id)
SELECT arch_id, fid, v0, v1, v2 FROM faces UNION ALL
SELECT arch_id, mx+s, 0, 0, 0 FROM t, LATERAL (SELECT unnest(generate_series(1, target-n)) AS s) WHERE target>n""")
def pad_faces(spark, sf):
    g = lattice_geometry(spark, sf)
    t = g.groupBy("arch_id").agg(F.count("*").alias("n_faces"), F.max("fid").alias("max_fid"),
                                 F.sum("area").alias("area")) \
        .withColumn("target", mesh.target_count(F.col("area"), 1.6))
    return mesh.pad_faces(fixtures.lattice_faces(spark, sf), t)


_DOWN = f"""WITH {GEOM}, plan AS (SELECT arch_id, sum(area) AS area, count(*) AS n, greatest(CAST(round_even(sum(area)*0.4,0) AS BIGINT),4) AS target FROM geom GROUP BY arch_id),
cellof AS (SELECT arch_id, CASE WHEN target<n THEN sqrt(2.0*area/target) END AS h FROM plan),
used AS (SELECT DISTINCT arch_id, vid FROM (SELECT arch_id, v0 AS vid FROM faces UNION ALL SELECT arch_id, v1 FROM faces UNION ALL SELECT arch_id, v2 FROM faces)),
kv AS (SELECT u.arch_id, u.vid, g.x, g.y, g.z, floor(g.x/h) AS kx, floor(g.y/h) AS ky, floor(g.z/h) AS kz, CASE WHEN h IS NULL THEN u.vid END AS s
  FROM used u JOIN grid g USING (vid) JOIN cellof c ON c.arch_id=u.arch_id),
cells AS (SELECT arch_id, kx, ky, kz, s, min(vid) AS rep, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM kv GROUP BY ALL),
mp AS (SELECT k.arch_id, k.vid, c.rep, c.x, c.y, c.z FROM kv k JOIN cells c ON k.arch_id=c.arch_id AND k.kx IS NOT DISTINCT FROM c.kx
  AND k.ky IS NOT DISTINCT FROM c.ky AND k.kz IS NOT DISTINCT FROM c.kz AND k.s IS NOT DISTINCT FROM c.s),
nf AS (SELECT f.arch_id, f.fid, a.rep AS v0, b.rep AS v1, c.rep AS v2, list_sort([a.rep,b.rep,c.rep]) AS st FROM faces f
  JOIN mp a ON a.arch_id=f.arch_id AND a.vid=f.v0 JOIN mp b ON b.arch_id=f.arch_id AND b.vid=f.v1 JOIN mp c ON c.arch_id=f.arch_id AND c.vid=f.v2
  WHERE a.rep<>b.rep AND b.rep<>c.rep AND c.rep<>a.rep)
SELECT arch_id, fid, v0, v1, v2 FROM nf QUALIFY row_number() OVER (PARTITION BY arch_id, st ORDER BY fid)=1"""


@query("density_downsample", _DOWN)
def density_downsample(spark, sf):
    _, f = mesh.reduce_density(lattice_geometry(spark, sf), fixtures.lattice_vertices(spark, sf), 0.4)
    return f


@query("corner_gather", f"WITH {CORNERS} SELECT arch_id, fid, {cols6(*[p + a for p in 'pqr' for a in 'xyz'])} FROM corners")
def corner_gather(spark, sf):
    c = mesh.gather_corners(fixtures.lattice_faces(spark, sf), fixtures.lattice_vertices(spark, sf))
    return out(c, ["arch_id", "fid"], [p + a for p in "pqr" for a in "xyz"])


@query("shared_vertices", f"""WITH {FACES}, used AS (SELECT DISTINCT arch_id, vid FROM (SELECT arch_id, v0 AS vid FROM faces UNION ALL SELECT arch_id, v1 FROM faces UNION ALL SELECT arch_id, v2 FROM faces))
SELECT arch_id, vid, {cols6('x', 'y', 'z')} FROM used JOIN grid USING (vid)""")
def shared_vertices(spark, sf):
    c = mesh.gather_corners(fixtures.lattice_faces(spark, sf), fixtures.lattice_vertices(spark, sf))
    rows = c.select("arch_id", "fid", F.array("v0", "v1", "v2").alias("v"),
                    F.array(*[F.array(p + "x", p + "y", p + "z") for p in "pqr"]).alias("tri"))
    return out(mesh.shared_vertices(rows), ["arch_id", "vid"], ["x", "y", "z"])


_VALUES = ", ".join(f"('{a}',{i},{lab.fdi_of(i, a)},{lab.universal_of(i, a)},{lab.coarse_of(i)},{c[0]},{c[1]},{c[2]})"
                    for a in ("upper", "lower") for i, c in enumerate(lab.TOOTH_RGB))
DIM = f"dim(arch, label, fdi, universal, coarse, r, g, b) AS (VALUES {_VALUES})"


@query("tooth_codes", f"""WITH {FACES}, {DIM}, coded AS (SELECT f.arch_id, f.fid, f.label, CAST(d.fdi AS BIGINT) AS fdi FROM faces f JOIN dim d ON d.label=f.label AND d.arch=CASE WHEN f.arch_id%2=0 THEN 'upper' ELSE 'lower' END)
SELECT arch_id, fid, fdi, label FROM coded""")
def tooth_codes(spark, sf):
    f = fixtures.lattice_faces(spark, sf)
    jaw = F.when(F.col("arch_id") % 2 == 0, "upper").otherwise("lower").alias("arch")
    dim = lab.dim_tooth(spark).select("arch", "label", "fdi")
    coded = f.select("arch_id", "fid", "label", jaw).join(F.broadcast(dim), ["arch", "label"]).select("arch_id", "fid", "fdi")
    return lab.with_label_from_fdi(coded).select("arch_id", "fid", "fdi", "label")


@query("coarse_labels", f"""WITH {FACES}, {DIM} SELECT f.arch_id, CAST(d.coarse AS BIGINT) AS coarse, count(*) AS n FROM faces f JOIN dim d ON d.label=f.label AND d.arch='upper' GROUP BY ALL""")
def coarse_labels(spark, sf):
    f = fixtures.lattice_faces(spark, sf)
    return f.groupBy("arch_id", lab.label_to_coarse(F.col("label")).alias("coarse")).agg(F.count("*").alias("n"))


@query("universal_numbers", f"""WITH {FACES}, {DIM} SELECT f.arch_id, f.fid, CAST(u.universal AS BIGINT) AS upper_no, CAST(l.universal AS BIGINT) AS lower_no, '#'||CAST(u.universal AS VARCHAR) AS text
FROM faces f JOIN dim u ON u.label=f.label AND u.arch='upper' JOIN dim l ON l.label=f.label AND l.arch='lower'""")
def universal_numbers(spark, sf):
    f = fixtures.lattice_faces(spark, sf)
    return f.select("arch_id", "fid", lab.label_to_universal(F.col("label"), "upper").alias("upper_no"),
                    lab.label_to_universal(F.col("label"), "lower").alias("lower_no"),
                    lab.label_text(F.col("label"), "upper").alias("text"))


@query("palette_roundtrip", f"""WITH {FACES}, {DIM} SELECT f.arch_id, f.fid, CAST(d.r AS BIGINT) AS r, CAST(d.g AS BIGINT) AS g, CAST(d.b AS BIGINT) AS b, f.label FROM faces f JOIN dim d ON d.label=f.label AND d.arch='upper'""")
def palette_roundtrip(spark, sf):
    f = fixtures.lattice_faces(spark, sf).withColumn("c", lab.label_to_rgb(F.col("label")))
    painted = f.select("arch_id", "fid", "c.r", "c.g", "c.b")
    return lab.with_label_from_rgb(painted).select("arch_id", "fid", "r", "g", "b", "label")


@query("label_histogram", f"""WITH {FACES}, a AS (SELECT DISTINCT arch_id FROM faces), c AS (SELECT unnest(generate_series(0,16)) AS label)
SELECT a.arch_id, CAST(c.label AS BIGINT) AS label, count(f.fid) AS n FROM a CROSS JOIN c LEFT JOIN faces f ON f.arch_id=a.arch_id AND f.label=c.label GROUP BY ALL""")
def label_histogram(spark, sf):
    from meshspark.operators.metrics import class_counts
    return class_counts(fixtures.lattice_faces(spark, sf), ["arch_id"], "label", 17)


@query("histogram_text", f"""WITH {FACES}, c AS (SELECT arch_id, label, count(*) AS n FROM faces GROUP BY ALL)
SELECT arch_id, string_agg(label||':'||n, ', ' ORDER BY label) AS text FROM c GROUP BY arch_id""")
def histogram_text(spark, sf):
    c = fixtures.lattice_faces(spark, sf).groupBy("arch_id", "label").agg(F.count("*").alias("n"))
    return c.groupBy("arch_id").agg(lab.histogram_text("label", "n").alias("text"))
