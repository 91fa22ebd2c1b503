"""Tooth frame queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshspark.catalog.common import lattice_geometry, out
from meshspark.catalog.registry import query
from meshspark.catalog.sqlviews import FACIAL, FRAMES, GEOM, TANGENTS, cols6
from meshspark.operators import frames

XYZ = lambda *p: [f"{q}{a}" for q in p for a in "xyz"]


@query("tooth_frames", f"""WITH {GEOM}, {FRAMES} SELECT t.arch_id, t.label, {cols6(*XYZ('o', 'n'))}, round(s.area_mm2,6)+0.0 AS area_mm2, s.n_faces FROM tf t
JOIN (SELECT arch_id, label, sum(area) AS area_mm2, count(*) AS n_faces FROM geom GROUP BY ALL) s ON s.arch_id=t.arch_id AND s.label=t.label""")
def tooth_frames(spark, sf):
    from meshspark.operators.mesh import mesh_area
    g = lattice_geometry(spark, sf)
    d = frames.tooth_frames(g).join(mesh_area(g, "arch_id", "label"), ["arch_id", "label"])
    return out(d, ["arch_id", "label", "n_faces"], XYZ("o", "n") + ["area_mm2"])


@query("tangent_axes", f"WITH {GEOM}, {TANGENTS} SELECT arch_id, label, {cols6(*XYZ('t'))} FROM tangent")
def tangent_axes(spark, sf):
    return out(frames.tangent_axes(frames.tooth_frames(lattice_geometry(spark, sf))), ["arch_id", "label"], XYZ("t"))


@query("facial_dirs", f"WITH {GEOM}, {FACIAL} SELECT arch_id, label, {cols6(*XYZ('f'))} FROM facial")
def facial_dirs(spark, sf):
    g = lattice_geometry(spark, sf)
    t = frames.tangent_axes(frames.tooth_frames(g))
    return out(frames.facial_directions(t, frames.arch_centers(g)), ["arch_id", "label"], XYZ("f"))


MIDLINE = """mid0 AS (SELECT a.arch_id, (a.ox+b.ox)/2 AS ox, (a.oy+b.oy)/2 AS oy, (a.oz+b.oz)/2 AS oz, a.nx+b.nx AS sx, a.ny+b.ny AS sy, a.nz+b.nz AS sz,
  b.ox-a.ox AS dx, b.oy-a.oy AS dy, b.oz-a.oz AS dz FROM tf a JOIN tf b ON a.arch_id=b.arch_id AND a.label=8 AND b.label=9),
mid1 AS (SELECT *, sx/sqrt(sx*sx+sy*sy+sz*sz) AS nx, sy/sqrt(sx*sx+sy*sy+sz*sz) AS ny, sz/sqrt(sx*sx+sy*sy+sz*sz) AS nz FROM mid0),
mid2 AS (SELECT *, dx-nx*(dx*nx+dy*ny+dz*nz) AS ex, dy-ny*(dx*nx+dy*ny+dz*nz) AS ey, dz-nz*(dx*nx+dy*ny+dz*nz) AS ez FROM mid1),
midline AS MATERIALIZED (SELECT arch_id, ox, oy, oz, nx, ny, nz, ex/sqrt(ex*ex+ey*ey+ez*ez) AS tx, ey/sqrt(ex*ex+ey*ey+ez*ez) AS ty, ez/sqrt(ex*ex+ey*ey+ez*ez) AS tz FROM mid2)"""


@query("midline_frame", f"WITH {GEOM}, {FRAMES}, {MIDLINE} SELECT arch_id, {cols6(*XYZ('o', 'n', 't'))} FROM midline")
def midline_frame(spark, sf):
    return out(frames.midline_frames(frames.tooth_frames(lattice_geometry(spark, sf))), ["arch_id"], XYZ("o", "n", "t"))


@query("local_coordinates", f"""WITH {GEOM}, {FACIAL} SELECT g.arch_id, g.fid, t.label AS tooth,
  {cols6('u', 'w', 'occ').replace('round(u,6)', 'round((g.mx-t.ox)*t.tx+(g.my-t.oy)*t.ty+(g.mz-t.oz)*t.tz,6)').replace('round(w,6)', 'round((g.mx-t.ox)*t.nx+(g.my-t.oy)*t.ny+(g.mz-t.oz)*t.nz,6)').replace('round(occ,6)', 'round(g.nx*t.nx+g.ny*t.ny+g.nz*t.nz,6)')}
FROM geom g JOIN facial t ON t.arch_id=g.arch_id AND t.label=g.label""")
def local_coordinates(spark, sf):
    from meshspark.functions.vectors import Vec
    g = lattice_geometry(spark, sf)
    t = frames.tangent_axes(frames.tooth_frames(g)).withColumnsRenamed({f"n{a}": f"w{a}" for a in "xyz"})
    j = g.join(t, ["arch_id", "label"])
    u, v, w = frames.local_uvw(Vec.cols("m").minus(Vec.cols("o")), Vec.cols("t"), Vec.cols("t"), Vec.cols("w"))
    j = j.withColumns({"u": u, "w": w, "occ": frames.occlusality(Vec.cols("n"), Vec.cols("w"))}) \
        .withColumn("tooth", F.col("label"))
    return out(j, ["arch_id", "fid", "tooth"], ["u", "w", "occ"])
