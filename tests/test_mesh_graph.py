"""Geometry, adjacency, components, coverage, welding and density on small meshes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark import fixtures
from meshspark.operators import augment, graph, mesh, patches as pt
from meshspark.operators.merge import merge_meshes
from meshspark.session import cut_lineage

V = "arch_id bigint, vid bigint, x double, y double, z double"
T = "arch_id bigint, fid bigint, v0 bigint, v1 bigint, v2 bigint"


def test_zero_area_face_has_null_normal(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 0.0, 1.0, 0.0), (0, 3, 2.0, 0.0, 0.0)], V)
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 0, 1, 3)], T)
    r = {x.fid: x for x in mesh.face_geometry(f, v).collect()}
    assert r[0].nz == 1.0 and r[0].area == 0.5
    assert r[1].nx is None and r[1].area == 0.0


def test_empty_mesh(spark):
    g = mesh.face_geometry(spark.createDataFrame([], T), spark.createDataFrame([], V))
    assert g.count() == 0 and mesh.face_adjacency(g).count() == 0


def test_adjacency_needs_exactly_two_faces_and_an_edge(spark):
    # faces 0 and 1 share an edge, 2 touches at a vertex only; three faces on edge (10, 11) are not adjacent
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 1, 3, 2), (0, 2, 2, 8, 9), (0, 3, 10, 11, 12), (0, 4, 10, 11, 13),
                               (0, 5, 10, 11, 14)], T)
    assert [(r.a, r.b) for r in mesh.face_adjacency(f).collect()] == [(0, 1)]


@pytest.mark.parametrize("parts", [1, 7])
def test_components_on_paths_rings_and_isolated(spark, parts):
    rng = np.random.default_rng(3)
    edges = []
    perm = rng.permutation(200).tolist()
    edges += [("p", int(a), int(b)) for a, b in zip(perm, perm[1:])]
    edges += [("q", int(a), int((a + 1) % 50)) for a in range(50)] + [("q", 100, 101)]
    e = spark.createDataFrame(edges, "g string, a bigint, b bigint").repartition(parts)
    v = spark.createDataFrame([("p", i) for i in range(200)] + [("q", i) for i in [*range(50), 100, 101, 7000]], "g string, v bigint")
    got = {(r.g, r.v): r.comp for r in graph.components(e, v).collect()}
    assert {got["p", i] for i in range(200)} == {0}
    assert {got["q", i] for i in range(50)} == {0} and got["q", 101] == 100 and got["q", 7000] == 7000


def test_components_survive_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        e = spark.createDataFrame([("g", i, i + 1) for i in range(60)] + [("g", 0, i) for i in range(2, 60, 2)], "g string, a bigint, b bigint")
        v = spark.createDataFrame([("g", i) for i in range(61)], "g string, v bigint")
        assert {r.comp for r in graph.components(e, v).collect()} == {0}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_choose_component_falls_back_when_all_are_small(spark):
    s = "fp string, fid bigint, comp bigint, d2 double"
    rows = [("a", 0, 0, 0.1), ("a", 1, 1, 0.5), ("b", 5, 5, 0.01)] + [("b", 10 + i, 10, 1.0 + i) for i in range(5)]
    got = {(r.fp, r.fid) for r in graph.choose_component(spark.createDataFrame(rows, s), 5).collect()}
    assert got == {("a", 0)} | {("b", 10 + i) for i in range(5)}


@pytest.fixture(scope="module")
def lattice(spark, sf):
    g = cut_lineage(mesh.face_geometry(fixtures.lattice_faces(spark, sf), fixtures.lattice_vertices(spark, sf)))
    return g, cut_lineage(mesh.face_adjacency(g))


def test_coverage_is_monotone_in_the_threshold(lattice):
    g, adj = lattice
    sets = []
    for t in (0.9, 0.6, 0.2):
        ext = g.select("arch_id", "fid", "label", F.col("nz").alias("occ"), F.lit(t).alias("threshold"))
        sets.append({(r.arch_id, r.fid) for r in graph.grow_coverage(ext, adj).collect()})
    assert sets[0] <= sets[1] <= sets[2]
    none = g.select("arch_id", "fid", "label", F.col("nz").alias("occ"), F.lit(1.5).alias("threshold"))
    assert graph.grow_coverage(none, adj).count() == 0


def test_sweep_stages_are_nested_connected_and_disjoint(spark, lattice):
    g, adj = lattice
    present = pt.present_labels(g)
    p = pt.draw_patches(present, "t")
    visits = cut_lineage(pt.sweep_visits(p, present))
    s = cut_lineage(pt.sweep_stages(visits, g, adj, 6.0, 6.0))
    assert s.count() == s.select("patch_id", "fid").distinct().count() > 0
    growth = pt.stage_growth(s, g, visits)
    assert growth.count() == visits.count() > s.select("patch_id", "stage").distinct().count()
    drawn = pt.up_to_drawn(visits, "t")
    early = {(r.patch_id, r.fid) for r in pt.sweep_stages(cut_lineage(drawn), g, adj, 6.0, 6.0).collect()}
    assert early == {(r.patch_id, r.fid) for r in pt.sample_stage(s, visits, "t").collect()}
    assert pt.shrinking_stages(growth).count() == 0
    share = pt.phase_increments(s, g).groupBy("patch_id").agg(F.sum("share").alias("t")).collect()
    assert all(abs(r.t - 1.0) < 1e-9 for r in share)


def test_augmentation_only_removes_within_budget(spark, lattice):
    g, adj = lattice
    patch = g.select(F.col("arch_id").cast("string").alias("patch_id"), "arch_id", "fid")
    full = {(r.patch_id, r.fid) for r in patch.collect()}
    holes = {(r.patch_id, r.fid) for r in augment.punch_holes(patch, adj).collect()}
    assert holes <= full
    for pid in {p for p, _ in full}:
        n = sum(1 for p, _ in full if p == pid)
        assert n - sum(1 for p, _ in holes if p == pid) <= max(1, int(n * 0.15))
    eroded = {(r.patch_id, r.fid) for r in augment.erode_boundary(patch, adj, 1.0).collect()}
    deg = {(r.patch_id, r.fid): r.degree for r in mesh.inner_degree(patch, adj, ["patch_id"]).collect()}
    assert all(deg[k] < 3 for k in full - eroded)
    tiny = patch.filter("fid < 8")
    assert augment.drop_faces(tiny, adj).count() == tiny.count()


def test_weld_merges_equal_positions_and_drops_collapsed(spark):
    v = spark.createDataFrame([(0, 1, i, float(x), float(y), 0.0) for i, (x, y) in enumerate([(0, 0), (1, 0), (0, 1)])]
                              + [(0, 2, i, float(x), float(y), 0.0) for i, (x, y) in enumerate([(1, 0), (0, 1), (1, 1), (1, 1)])]
                              + [(0, 3, 0, 9.0, 9.0, 9.0)],
                              "run_id bigint, mesh_id bigint, vid bigint, x double, y double, z double")
    f = spark.createDataFrame([(0, 1, 0, 0, 1, 2), (0, 2, 0, 0, 2, 1), (0, 2, 1, 1, 2, 3)],
                              "run_id bigint, mesh_id bigint, fid bigint, v0 bigint, v1 bigint, v2 bigint")
    mv, mf = merge_meshes(v, f)
    assert mv.count() == 4 and mf.count() == 2


def test_density_reduction_stops_at_the_target(lattice, spark, sf):
    g, _ = lattice
    v = fixtures.lattice_vertices(spark, sf)
    _, same = mesh.reduce_density(g, v, 50.0)
    assert same.count() == g.count()
    _, less = mesh.reduce_density(g, v, 0.3)
    assert 0 < less.count() < g.count()


def test_jitter_is_shared_by_faces_and_reproducible(spark, sf):
    v = fixtures.lattice_vertices(spark, sf).withColumnRenamed("arch_id", "patch_id")
    a, b = (sorted(map(tuple, augment.jitter_positions(v.repartition(n)).collect())) for n in (1, 5))
    assert a == b
    n = augment.jitter_normals(spark.createDataFrame([(0, 1, 0.0, 0.0, 1.0)], "patch_id bigint, fid bigint, nx double, ny double, nz double"), "fid").first()
    assert abs(math.sqrt(n.nx ** 2 + n.ny ** 2 + n.nz ** 2) - 1) < 1e-6
