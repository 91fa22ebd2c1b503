"""Pieces that users call on their own and no registered query exercises."""

import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshspark.functions.hashing import uniform_between
from meshspark.operators import normalise, sampling
from meshspark.plans import jobs
from meshspark.sources import cache, mesh_text, results
from meshspark.streaming import live

import numpy as np


def fresh():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_batched_picks_equal_one_by_one():
    rng = np.random.default_rng(0)
    sizes = np.array([20, 3, 7, 4])
    pools = rng.standard_normal((4, 20, 3))
    got = sampling._fps_picks(pools, sizes, 4)
    for pool, m, row in zip(pools, sizes, got):
        if m <= 4:
            assert row.tolist() == [*range(m), *[-1] * (4 - m)]
            continue
        picked = [0]
        while len(picked) < 4:
            d = ((pool[:m, None] - pool[picked][None]) ** 2).sum(2).min(1)
            d[picked] = -1
            picked.append(int(d.argmax()))
        assert row.tolist() == picked


def test_stream_helpers(spark):
    base = fresh()
    spark.createDataFrame([(0, 1, "mesh"), (0, 1, "mesh"), (0, 2, "status")], "run_id bigint, mesh_id bigint, type string") \
        .withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.mode("overwrite").parquet(base)
    s = live.file_stream(spark, base, spark.read.parquet(base).schema)
    assert live.run_to_table(live.route(s)["mesh"], fresh()).count() == 2
    assert live.run_to_table(live.claim_any(s, ["mesh_id"]), fresh()).count() == 2
    assert live.run_to_table(live.first_delivery(s, "1 hour"), fresh()).count() == 2


def test_feature_row_and_back(spark):
    x = [float(i) for i in range(24)] + [1.0, -1.0, 0.0]
    d = spark.createDataFrame([(x,)], "x array<double>")
    r = d.select(*[c.alias(k) for k, c in normalise.unpack_feature("x").items()]).first()
    assert r.tri == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0], [6.0, 7.0, 8.0]] and r.rgb[:2] == [255, 0]


def test_local_ids_are_dense_per_piece(spark):
    f = spark.createDataFrame([(0, 5, 9, 70000), (0, 9, 5, 3), (1, 70000, 3, 9)], "piece bigint, v0 bigint, v1 bigint, v2 bigint")
    got = sorted(tuple(r) for r in sampling.local_vertex_ids(f, ["piece"]).collect())
    assert got == [(0, 3, 0), (0, 5, 1), (0, 9, 2), (0, 70000, 3), (1, 3, 0), (1, 9, 1), (1, 70000, 2)]


def test_labels_from_colour_and_processed_flag(spark):
    from meshspark.functions import labels as lab
    d = spark.range(17).select(F.col("id").alias("label"), lab.label_to_rgb(F.col("id")).alias("c")).select("label", "c.*")
    d = d.withColumnRenamed("label", "want")
    got = mesh_text.labels_from_face_colour(d).collect()
    assert all(r.label == r.want for r in got)
    a = spark.createDataFrame([("x",), ("y",)], "arch_id string")
    assert cache.is_processed(a, a) and not cache.is_processed(a.limit(1), a)


def test_result_tables_and_draws(spark):
    path = fresh()
    results.write_results(spark.createDataFrame([(2, "a")], "z int, b string"), path)
    assert results.read_results(spark, path).columns == ["b", "z", results.CORRUPT]
    log = fresh()
    for _ in range(2):  # a retried batch leaves one row
        results.write_cycle_stats(spark.createDataFrame([(0, 3)], "run_id bigint, cycle bigint"), log, 7)
    assert spark.read.parquet(log).count() == 1
    u = [r.u for r in spark.range(500).select(uniform_between(2.0, 5.0, "s", "id").alias("u")).collect()]
    assert min(u) >= 2.0 and max(u) < 5.0 and 3.2 < sum(u) / 500 < 3.8


def test_board_and_threshold(spark):
    runs = spark.createDataFrame([(r, e, 0.1 * e + r) for r in (0, 1) for e in range(10)], "run_id bigint, epoch bigint, metric double")
    assert jobs.experiment_board(runs, 0, 5).count() == 2
    rows = [(200, 60, 60)] * 40 + [(120, 118, 110)] * 60 + [(102, 102, 102)] * 5
    t = jobs.redness_threshold(spark.createDataFrame(rows, "r bigint, g bigint, b bigint")).toPandas()
    assert isinstance(t, pd.DataFrame) and len(t) == 1


def test_a_corner_without_a_vertex_is_an_error(spark):
    from meshspark.operators import mesh
    v = spark.createDataFrame([(0, i, float(i), 0.0, 1.0) for i in range(3)], "arch_id long, vid long, x double, y double, z double")
    good, bad = (spark.createDataFrame([(0, 0, 0, 1, k)], "arch_id long, fid long, v0 long, v1 long, v2 long") for k in (2, 9))
    assert mesh.gather_corners(good, v).count() == 1
    with pytest.raises(Exception, match="no vertex 9 in mesh 0"):
        mesh.gather_corners(bad, v).collect()
