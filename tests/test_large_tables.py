"""What only shows on larger tables: broadcasts planned from file sizes, ids of more digits, near ties."""

import datetime as dt
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from meshspark import catalog, fixtures
from meshspark.catalog.common import lattice_geometry
from meshspark.operators import augment, graph, mesh, patches, spatial, transfer
from meshspark.operators.merge import merge_meshes
from meshspark.operators.spatial import nearest
from meshspark.plans import jobs
from meshspark.session import cut_lineage
from meshspark.streaming import live


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_transfer_broadcasts_no_mesh(spark, sf):
    assert "Broadcast" not in plan(fixtures.lattice_faces(spark, sf))
    assert "Broadcast" not in plan(fixtures.lattice_vertices(spark, sf))
    assert "Broadcast" not in plan(catalog.QUERIES["colour_transfer"](spark, sf))


def test_cycle_of_a_name_with_more_than_six_digits(spark, tmp_path):
    ids = [7, 999_999, 1_000_000, 12_345_678]
    spark.createDataFrame([(i, dt.datetime(2024, 1, 1), 3, "mesh", 1.0, "{}") for i in ids],
                          "event_id long, ts timestamp, user_id long, event_type string, value double, props string") \
        .write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["text_functions"](spark, str(tmp_path)).collect()
    assert sorted((r.seq, r.cycle) for r in got) == [(i, i) for i in ids]


def test_weld_broadcasts_no_mesh(spark, sf):
    key = F.lit(0).cast("bigint").alias("run_id"), F.col("arch_id").alias("mesh_id")
    f = fixtures.lattice_faces(spark, sf).select(*key, "fid", "v0", "v1", "v2")
    v = fixtures.lattice_vertices(spark, sf).select(*key, "vid", "x", "y", "z")
    for d in (*merge_meshes(v, f), mesh.face_geometry(fixtures.lattice_faces(spark, sf), fixtures.lattice_vertices(spark, sf))):
        assert "Broadcast" not in plan(d)


def test_components_at_one_distance_go_by_face_id(spark):
    # 0.3 and 0.1 + 0.2 are one distance, whatever way it was added up; the second component has the smaller id
    rows = [("a", 10 + i, 10, 0.3 + i) for i in range(5)] + [("a", 1 + i, 1, 0.1 + 0.2 + i) for i in range(5)]
    d = spark.createDataFrame(rows, "fp string, fid long, comp long, d2 double")
    assert {r.comp for r in graph.choose_component(d, digits=8).collect()} == {1}
    assert {r.comp for r in graph.choose_component(d).collect()} == {10}


def test_sweep_sql_breaks_near_ties_as_the_query_does():
    for name in ("sweep_stages", "phase_increments", "stage_growth", "stage_draw", "job_full_sequence"):
        assert "round(d2, 8), fid)" in catalog.ORACLES[name]


def test_previous_cycle_is_searched_by_position(spark, monkeypatch):
    searched = []

    def spy(queries, points, *rest, **kw):
        searched.append((queries.count(), points.count()))
        return nearest(queries, points, *rest, **kw)

    monkeypatch.setattr(transfer, "nearest", spy)
    now = spark.createDataFrame([(0, i, float(i % 2), 0.0, 0.0) for i in range(40)], "cloud int, qid int, x double, y double, z double")
    before = spark.createDataFrame([(0, i, 0.25 + 3.0 * (i % 2), 0.0, 0.0, i * 10) for i in range(5, 45)], "cloud int, pid int, x double, y double, z double, old int")
    got = {r.qid: (r.pid, r.old, r.dist) for r in transfer.match_previous(now, before, 0.5, 0.5, values=("old",)).collect()}
    assert searched == [(2, 2)]
    assert got == {i: (None, None, None) if i % 2 else (6, 60, 0.25) for i in range(40)}


def test_claims_hold_the_winners_and_one_chunk_only(monkeypatch):
    class Held:
        def exists(self):
            return False

        def update(self, value):
            pass

    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"run_id": 0, "vx": np.arange(2000) % 8, "chunk": rng.permutation(2000)})
    chunks = [rows[i:i + 100] for i in range(0, 2000, 100)]
    want = rows.sort_values("chunk").drop_duplicates("vx").set_index("vx")["chunk"].to_dict()
    sizes, concat = [], pd.concat
    monkeypatch.setattr(live.pd, "concat", lambda *a, **k: sizes.append(len(d := concat(*a, **k))) or d)
    block = live._ClaimBlock("run_id", ["vx"], ["chunk"], ["run_id", "vx", "chunk"])
    block.held = Held()
    state = next(block.handleInputRows((0,), iter(chunks), None))
    sent = list(live._first_rows(["run_id", "vx"], ["chunk"])(iter(chunks)))
    assert max(sizes) <= 108
    for got in (state, *sent):
        assert got.set_index("vx")["chunk"].to_dict() == want
    assert len(sent) == 1 and sum(map(len, live._first_rows(["run_id", "vx"], ["chunk"], 8)(iter(chunks)))) == 8 * 20


def test_shared_vertices_broadcasts_no_mesh(spark, sf):
    assert "Broadcast" not in plan(catalog.QUERIES["shared_vertices"](spark, sf))


def test_ranked_neighbours_are_dealt_by_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    at = rng.random((600, 3))
    p = spark.createDataFrame(pd.DataFrame({"cloud": 0, "pid": np.arange(600), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]}))
    monkeypatch.setattr(spatial, "TASK_PAIRS", 5_000)
    got = spatial.nearest(p.withColumnRenamed("pid", "qid"), p, 20, 0.5, exclude_self=True)
    tasks = [int(n) for n in re.findall(r"hashpartitioning\(_g[^)]*_cz[^)]*, (\d+)\), REPARTITION_BY_NUM", plan(got))]
    assert len(tasks) == 2 and min(tasks) > 8
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    want = np.argsort(d2, axis=1, kind="stable")[:, :20]
    rows = got.toPandas().sort_values(["qid", "rank"])
    assert (rows["pid"].to_numpy().reshape(600, 20) == want).all()


def test_noise_of_a_patch_is_drawn_once(spark, sf):
    g = cut_lineage(lattice_geometry(spark, sf))
    patch = g.select(F.concat_ws("/", "arch_id", "label").alias("patch_id"), "arch_id", "fid")
    x = jobs.patch_features(patch, g, cut_lineage(mesh.vertex_normals(g)), mesh.face_adjacency(g), 30)
    assert "md5" not in plan(x)
    assert x.groupBy("patch_id").count().agg(F.max("count")).first()[0] <= 30


def test_relaxing_coverage_reads_its_stages_once(spark, sf):
    g = cut_lineage(lattice_geometry(spark, sf))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    stages = g.select(F.col("arch_id").cast("string").alias("patch_id"), "arch_id", "fid", (F.col("fid") % 3).alias("stage"))
    n = stages.count()
    got = patches.relaxing_coverage(stages.mapInPandas(count, stages.schema), g, cut_lineage(mesh.face_adjacency(g)), (0.0, 0.0, 1.0), 3, 0.9, 0.3)
    assert got.count() > 0 and read.value == n


def test_holes_find_neighbours_once(spark, sf, monkeypatch):
    f = cut_lineage(fixtures.lattice_faces(spark, sf))
    patch = f.select(F.col("arch_id").cast("string").alias("patch_id"), "arch_id", "fid")
    found, restrict = [], mesh.restrict_adjacency
    monkeypatch.setattr(mesh, "restrict_adjacency", lambda *a: found.append(1) or restrict(*a))
    left = augment.punch_holes(patch, mesh.face_adjacency(f), max_holes=3)
    assert len(found) == 1
    assert "Broadcast" not in plan(left)
    assert left.count() < patch.count()


def test_drop_faces_broadcasts_no_mesh(spark, sf):
    f = cut_lineage(fixtures.lattice_faces(spark, sf))
    patch = f.select(F.col("arch_id").cast("string").alias("patch_id"), "arch_id", "fid")
    assert "Broadcast" not in plan(mesh.inner_degree(patch, mesh.face_adjacency(f), ["patch_id"]))
    assert "Broadcast" not in plan(catalog.QUERIES["drop_faces"](spark, sf))


def test_dilation_sends_members_to_the_cells_around_them(spark, sf):
    g = cut_lineage(lattice_geometry(spark, sf))
    got = patches.dilate_set(g.filter("label = 8"), g, 1.5)
    assert "Broadcast" not in plan(got)
    # cells are listed behind the distinct positions of the members, never behind the faces that are tested
    listed = [i for i, line in enumerate(plan(got).splitlines()) if "Generate explode(sequence" in line]
    above = plan(got).splitlines()[listed[-1] + 1:]
    assert len(listed) == 3 and any("HashAggregate" in line for line in above[:3])
    f = g.toPandas()
    a, m = f[["mx", "my", "mz"]].to_numpy(), (f["label"] == 8).to_numpy()
    near = {}
    for arch in f["arch_id"].unique():
        own = (f["arch_id"] == arch).to_numpy()
        d2 = ((a[own][:, None] - a[own & m][None]) ** 2).sum(2)
        near[arch] = set(f["fid"][own][(d2 <= 2.25).any(1)])
    assert {(r.arch_id, r.fid) for r in got.collect()} == {(k, x) for k, v in near.items() for x in v}


def test_footprints_take_the_smaller_face_id_at_one_distance(spark, tmp_path):
    # a steep ridge at row 5 of each mesh leaves two components, one the other turned by half a turn around the origin: always a tie
    meshes = 40
    rows = [(j * 50 + i, 50 if j % 10 == 5 else 1) for j in range(10 * meshes + 1) for i in range(3, 13)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.QUERIES["footprint_components"](spark, str(tmp_path)).collect()
    assert {r.fp for r in got} == {f"{m}/{label}" for m in range(meshes) for label in (1, 2, 3)}
    assert {r.fid // 2 // 50 % 10 for r in got} == {2, 3}
