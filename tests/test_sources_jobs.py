"""Files in and out, guards, colour transfer, whole jobs."""

import json

import pytest
from pyspark.sql import functions as F

from meshspark import catalog, fixtures
from meshspark.functions import labels as lab
from meshspark.operators import mesh, sampling, transfer
from meshspark.plans import jobs
from meshspark.session import scratch_path
from meshspark.sources import cache, frames as fr, mesh_text, results, snapshots


@pytest.fixture
def raw(tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    n = 12
    pts = [(i * 0.2, j * 0.2, 0.0) for j in range(n) for i in range(n)]
    lines = ["# grid"] + [f"v {x} {y} {z}" for x, y, z in pts]
    tris = []
    for j in range(n - 1):
        for i in range(n - 1):
            a = j * n + i + 1
            tris += [(a, a + 1, a + n), (a + 1, a + n + 1, a + n)]
    lines += [f"f {a}/{a} {b}/{b} {c}/{c}" for a, b, c in tris]
    (d / "case_lower.obj").write_text("\n".join(lines))
    (d / "case_lower.json").write_text(json.dumps({"labels": [31 if x < 1.0 else 41 for x, _, _ in pts]}))
    (d / "other_upper.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n")
    return str(d), len(tris)


def test_mesh_text_and_sidecars(spark, raw):
    folder, n = raw
    v, f, skipped = mesh_text.labelled_faces(spark, folder)
    assert v.count() == 144 and f.count() == n
    assert [r.arch_id for r in skipped.collect()] == ["other_upper"]
    assert {r.label for r in f.select("label").distinct().collect()} == {8, 9}


def test_build_cache_is_additive_and_guarded(spark, raw, tmp_path):
    folder, n = raw
    path = str(tmp_path / "cache")
    jobs.build_cache(spark, folder, path, 20.0, None)
    first = spark.read.parquet(path)
    k = first.count()
    assert {r.label for r in first.select("label").distinct().collect()} == {8, 9}
    assert k == round(first.agg(F.sum("area")).first()[0] * 20.0) or k == n or first.filter("area = 0").count() > 0
    jobs.build_cache(spark, folder, path, 20.0, None)
    assert spark.read.parquet(path).count() == k
    with pytest.raises(ValueError):
        jobs.build_cache(spark, folder, path, 4.0, None)


def test_unknown_tooth_code_is_an_error(spark):
    with pytest.raises(Exception, match="unknown tooth code"):
        lab.with_label_from_fdi(spark.createDataFrame([(99,)], "fdi bigint")).collect()


def test_known_numbering_points():
    assert lab.universal_of(8, "upper") == 8 and lab.fdi_of(8, "upper") == 11
    assert lab.universal_of(16, "lower") == 32 and lab.fdi_of(16, "lower") == 48
    assert lab.universal_of(8, "lower") == 24 and lab.fdi_of(1, "lower") == 38


def test_split_lists(spark, tmp_path):
    (tmp_path / "training_lower.txt").write_text("a\nb\n")
    (tmp_path / "training_upper.txt").write_text("c\n")
    done = spark.createDataFrame([("a",), ("c",)], "arch_id string")
    got = {(r.split_file, r.arch_id) for r in cache.read_split(spark, str(tmp_path), 1, True, done).collect()}
    assert got == {("training_lower.txt", "a"), ("training_upper.txt", "c")}
    with pytest.raises(ValueError):
        cache.read_split(spark, str(tmp_path), 3, True)


def test_frames_with_absent_sections_and_bad_length(spark):
    c = spark.createDataFrame([(1, [0.0] * 9, [0, 1, 2], [1, 2, 3] * 3), (2, [1.0] * 9, [0, 1, 2], None)],
                              "mesh_id bigint, vertices array<float>, triangles array<bigint>, colors array<smallint>")
    parsed = fr.length_ok(fr.parse_headers(fr.encode(c)))
    assert {(r.mesh_id, r.length_ok, r.has_colour) for r in parsed.collect()} == {(1, True, True), (2, True, False)}
    v = {(r.mesh_id, r.vid): (r.r, r.nx) for r in fr.vertex_rows(fr.decode(parsed)).collect()}
    assert v[1, 0] == (1, None) and v[2, 0] == (None, None)
    cut = parsed.drop("length_ok", "has_colour").withColumn("blob", F.expr("substring(blob, 1, 10)"))
    assert not fr.length_ok(cut).first().length_ok


def test_snapshots_fill_missing_guidance(spark, tmp_path):
    p = str(tmp_path / "snap")
    snapshots.write_snapshots(spark.range(10).select(F.lit(1).alias("run_id"), F.col("id").alias("cycle")), p, 3)
    assert [r.cycle for r in snapshots.in_cycle_order(snapshots.read_snapshots(spark, p)).collect()] == [0, 3, 6, 9]
    d = spark.createDataFrame([("x/cycle_0042.npz",)], "n string").select(snapshots.cycle_of(F.col("n")).alias("c"))
    assert d.first().c == 42


def test_ragged_results_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("run,metric,notes,\na,0.5,x,\nb,0.7,y,z,extra\nc,0.9\n")
    rows = results.read_results(spark, str(tmp_path / "r.csv"), "run string, metric double, notes string, tail string").collect()
    assert [(r.run, r.metric) for r in rows] == [("a", 0.5), ("b", 0.7), ("c", 0.9)]
    u = results.union_rows([spark.range(1).select(F.lit(1).alias("b")), spark.range(1).select(F.lit(2).alias("a"))])
    assert u.columns == ["a", "b"]


def test_colour_falls_back_without_any_colour(spark):
    d = spark.createDataFrame([(0, i, float(i), 0.0, 0.0, 102, 102, 102) for i in range(3)] + [(1, 7, 0.0, 0.0, 0.0, 200, 100, 100), (1, 8, 0.3, 0.0, 0.0, 102, 102, 102)],
                              "run_id bigint, fid bigint, x double, y double, z double, r bigint, g bigint, b bigint")
    got = {(r.run_id, r.fid): r.filled for r in transfer.fill_missing_colour(d, F.col("r") > 150, 0.5, False).collect()}
    assert got == {(0, 0): False, (0, 1): False, (0, 2): False, (1, 7): True, (1, 8): True}


def test_spatial_split_matches_even_runs(spark):
    d = spark.range(11).select(F.lit(0).alias("mesh_id"), F.col("id").alias("fid"), (F.col("id") * 1.7).alias("p"))
    sizes = [r["count"] for r in sampling.spatial_split(d, F.col("p"), 4).groupBy("piece").count().orderBy("piece").collect()]
    assert sizes == [3, 3, 3, 2]


def test_graph_job_ranks_skip_the_query_itself(spark, sf):
    p = fixtures.points(spark, sf).select("cloud", "pid", "x", "y", "z")
    local, wide = jobs.neighbour_graph(p, 4, (8,), 0.5, "cloud", "pid")
    assert local.filter("pid = qid").count() == 0
    per = local.groupBy("cloud", "qid").agg(F.array_sort(F.collect_list("rank")).alias("r")).select("r").distinct().collect()
    assert [r.r for r in per] == [[1, 2, 3, 4]]
    assert wide.groupBy("qid").count().filter("count <> 4").count() == 0


def test_entry_contract(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_all_sql_runs(sf):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, sql in catalog.ORACLES.items():
        con.execute(sql).fetchall()
