"""Nothing is cut, dropped or capped behind the caller's back."""

import tempfile

import pytest
from pyspark.sql import functions as F

from meshspark import fixtures
from meshspark.operators import augment, graph, mesh, metrics
from meshspark.plans import jobs
from meshspark.session import cut_lineage
from meshspark.sources import mesh_text, results


def folder(name, text):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{path}/{name}", "w") as f:
        f.write(text)
    return path


def test_polygons_become_fans(spark):
    path = folder("m.obj", "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nv 2 2 2\nf 1 2 3\nf 1/1/1 2/2/2 3/3/3 4/4/4 5\n")
    _, f = mesh_text.read_meshes(spark, path)
    assert sorted((r.fid, r.v0, r.v1, r.v2) for r in f.collect()) == [(0, 0, 1, 2), (1, 0, 1, 2), (2, 0, 2, 3), (3, 0, 3, 4)]
    _, bad = mesh_text.read_meshes(spark, folder("n.obj", "v 0 0 0\nf -1 -1 -1\n"))
    with pytest.raises(Exception, match="not a positive vertex number"):
        bad.collect()


def test_face_without_label_is_an_error(spark):
    faces = spark.createDataFrame([("a", 0, 5)], "arch_id string, fid bigint, v0 bigint")
    codes = spark.createDataFrame([("a", 1, 11)], "arch_id string, vid bigint, fdi bigint")
    with pytest.raises(Exception, match="no label"):
        mesh_text.face_labels_from_vertex_labels(faces, codes).collect()


def test_blobs_reach_their_size_on_a_strip(spark):
    adj = spark.range(99).select(F.lit(0).alias("arch_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    members = spark.range(100).select(F.lit(0).alias("arch_id"), F.lit("p").alias("patch_id"), F.col("id").alias("fid"))
    seeds = spark.createDataFrame([(0, "p", 1, 0, 60)], "arch_id int, patch_id string, hole int, fid bigint, size bigint")
    assert graph.grow_blobs(seeds, adj, members).count() == 60


def test_a_hole_takes_what_the_budget_has_left(spark):
    f = fixtures.lattice_faces(spark, "/root/testdata/sf0.001")
    patch = f.select(F.col("arch_id").cast("string").alias("patch_id"), "arch_id", "fid")
    adj = cut_lineage(mesh.face_adjacency(f))
    n = {r.patch_id: r["count"] for r in patch.groupBy("patch_id").count().collect()}
    for seed in ("a", "b", "c"):
        left = {r.patch_id: r["count"] for r in augment.punch_holes(patch, adj, max_holes=2, size_range=(500, 500), seed=seed).groupBy("patch_id").count().collect()}
        from meshspark.functions.hashing import uniform_int
        holes = {r.patch_id: r.h for r in patch.select("patch_id", uniform_int(0, 2, f"{seed}/n", "patch_id").alias("h")).distinct().collect()}
        for p, h in holes.items():
            assert n[p] - left[p] == (max(1, int(n[p] * 0.15)) if h else 0)


def test_long_rows_of_results_are_kept(spark):
    path = folder("r.csv", "run,acc\na,0.5\nb,0.7,extra\nc\n")
    got = {r.run: (r.acc, r[results.CORRUPT]) for r in results.read_results(spark, path).collect()}
    assert got["a"] == ("0.5", None) and got["b"] == ("0.7", "b,0.7,extra") and got["c"][0] is None


def test_caps_are_the_callers(spark):
    counts = spark.createDataFrame([(0, 1000), (1, 1)], "label bigint, n bigint")
    with pytest.raises(ValueError):
        metrics.class_alpha(counts, "capped")
    a = {r.label: r.alpha for r in metrics.class_alpha(counts, "capped", cap=5.0).collect()}
    assert abs(a[1] / a[0] - 5.0) < 1e-9
    b = {r.label: r.alpha for r in metrics.class_alpha(counts, "sqrt").collect()}
    assert abs(b[1] / b[0] - 1000 ** 0.5) < 1e-9


def test_patch_modes_and_cap_report(spark, sf):
    from meshspark.catalog.common import lattice_geometry
    g = cut_lineage(lattice_geometry(spark, "/root/testdata/sf0.01"))
    adj = cut_lineage(mesh.face_adjacency(g))
    for kw, mode in ((dict(midline_prob=1.0, midline_size=(2.0, 8.0)), "midline"), (dict(whole_tooth_prob=1.0), "whole_tooth")):
        got = jobs.sample_patches(g, adj, "modes", width=6.0, height=6.0, **kw)
        assert {r.mode for r in got.select("mode").distinct().collect()} == {mode} and got.count() > 0
    patch = g.select(F.col("arch_id").cast("string").alias("patch_id"), "arch_id", "fid")
    x = jobs.patch_features(patch, g, cut_lineage(mesh.vertex_normals(g)), adj, 100, augmented=False)
    n = {r.patch_id: r["count"] for r in patch.groupBy("patch_id").count().collect()}
    for r in x.groupBy("patch_id").agg(F.count("*").alias("k"), F.max("n_capped").alias("c")).collect():
        assert r.k == min(100, n[r.patch_id]) and r.c == max(0, n[r.patch_id] - 100)
