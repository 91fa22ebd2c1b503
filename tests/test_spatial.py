"""Grid joins against brute force: ties, copies, outliers, k beyond the cloud, empty results."""

import numpy as np
import pytest

from meshspark.operators import pointset, sampling, spatial
from meshspark.operators.farthest import farthest_points


def cloud(seed, n, shape):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(n, 3)) * (1.0, 1.0, 0.1)
    if shape == "copies":
        p[: n // 3] = p[0]
    if shape == "outlier":
        p[0] = (500.0, -300.0, 40.0)
    if shape == "lattice":
        p = np.round(p * 2)
    if shape == "dense":
        p[: n // 2] *= 1e-4
        p[-1] = (4e5, -7e6, 1.0)
    return p


def frame(spark, arrays):
    rows = [(g, i, *map(float, p)) for g, a in enumerate(arrays) for i, p in enumerate(a)]
    return spark.createDataFrame(rows, "cloud bigint, pid bigint, x double, y double, z double")


def brute(a, k, exclude):
    out = {}
    for i in range(len(a)):
        d = ((a - a[i]) ** 2).sum(1)
        order = sorted((d[j], j) for j in range(len(a)) if not (exclude and j == i))
        out[i] = [j for _, j in order[:k]]
    return out


@pytest.mark.parametrize("shape", ["plain", "copies", "outlier", "lattice", "dense"])
@pytest.mark.parametrize("k,exclude", [(1, False), (5, True), (200, True)])
def test_nearest_equals_brute_force(spark, shape, k, exclude):
    arrays = [cloud(1, 60, shape), cloud(2, 25, shape), cloud(3, 2, "plain")]
    p = frame(spark, arrays)
    got = {}
    for r in spatial.nearest(p.withColumnRenamed("pid", "qid"), p, k, 0.2, exclude_self=exclude).orderBy("cloud", "qid", "rank").collect():
        got.setdefault((r.cloud, r.qid), []).append(r.pid)
    for g, a in enumerate(arrays):
        for q, want in brute(a, k, exclude).items():
            assert got.get((g, q), []) == want


def test_nearest_with_cap_drops_far_points(spark):
    p = frame(spark, [np.array([[0.0, 0, 0], [1.0, 0, 0], [5.0, 0, 0]])])
    q = spark.createDataFrame([(0, 9, 1.4, 0.0, 0.0), (0, 10, 9.0, 0.0, 0.0), (0, 11, 6.0, 0.0, 0.0)],
                              "cloud bigint, qid bigint, x double, y double, z double")
    got = {r.qid: r.pid for r in spatial.nearest(q, p, 1, 0.1, max_dist=1.0).collect()}
    assert got == {9: 1, 11: 2}


def test_ball_query_pads_with_first_hit_and_empty_is_zero(spark):
    p = frame(spark, [np.array([[0.0, 0, 0], [0.5, 0, 0], [0.9, 0, 0], [50.0, 0, 0]])])
    q = spark.createDataFrame([(0, 0, 0.2, 0.0, 0.0), (0, 1, -20.0, 0.0, 0.0)], "cloud bigint, qid bigint, x double, y double, z double")
    got = {}
    for r in pointset.ball_query(q, p, 0.5, 4).orderBy("qid", "slot").collect():
        got.setdefault(r.qid, []).append(r.pid)
    assert got == {0: [0, 1, 0, 0], 1: [0, 0, 0, 0]}


def test_ball_is_open_and_margin_is_closed(spark):
    p = frame(spark, [np.array([[0.0, 0, 0], [1.0, 0, 0]])])
    q = p.withColumnRenamed("pid", "qid")
    assert spatial.pairs_within(q, p, 1.0, inclusive=False).count() == 2
    assert spatial.pairs_within(q, p, 1.0).count() == 4


def test_farthest_points_small_cloud_gives_all(spark):
    a = cloud(4, 6, "plain")
    got = farthest_points(frame(spark, [a]), 10).orderBy("step").collect()
    assert sorted(r.pid for r in got) == list(range(6)) and got[0].pid == 0


def test_dilated_pool_keeps_self_and_size(spark):
    a = cloud(6, 40, "plain")
    p = frame(spark, [a])
    nn = spatial.nearest(p.withColumnRenamed("pid", "qid"), p, 20, 0.2)
    d = sampling.dilated_neighbours(nn, p, 4, [8, 20])
    rows = d.collect()
    assert len(rows) == 40 * 2 * 4
    first = {(r.level, r.qid): r.pid for r in rows if r.rank == 1}
    assert all(q == pid for (_, q), pid in first.items())
