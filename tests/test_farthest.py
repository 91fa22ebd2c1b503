"""Several picks a round give the order of one pick at a time."""

import numpy as np
import pytest

from meshspark.operators import farthest


def plain(ids, xyz, n, skip=False):
    order = np.argsort(ids)
    ids, xyz = ids[order], xyz[order]
    gap = np.full(len(ids), np.inf)
    if skip:
        gap[(xyz * xyz).sum(axis=1) <= 1e-3] = -1.0
    out = [0]
    while len(out) < min(n, len(ids)):
        d = xyz - xyz[out[-1]]
        gap = np.minimum(gap, d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
        gap[out[-1]] = -1.0
        if gap.max() < 0:
            break
        out.append(int(gap.argmax()))
    return ids[out].tolist()


def table(spark, clouds):
    import pandas as pd
    parts = [pd.DataFrame({"g": name, "pid": ids, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "gap": 0.0}) for name, (ids, xyz) in clouds.items()]
    return spark.createDataFrame(pd.concat(parts))


@pytest.mark.parametrize("skip", [False, True])
def test_order_of_large_and_small_clouds(spark, skip):
    rng = np.random.default_rng(7)
    sphere = rng.normal(size=(20000, 3))
    sphere = 10.0 * sphere / np.linalg.norm(sphere, axis=1)[:, None]
    dense = np.concatenate([0.01 * rng.normal(size=(6000, 3)), rng.uniform(-5, 5, size=(1500, 3)), np.zeros((3000, 3)), [[40.0, 0, 0]]])
    lattice = np.stack(np.meshgrid(*[np.arange(18.0)] * 3), axis=-1).reshape(-1, 3)  # many ties
    clouds = {"sphere": (rng.permutation(20000), sphere), "dense": (np.arange(len(dense))[::-1].copy(), dense),
              "lattice": (rng.permutation(len(lattice)) + 5, lattice), "few": (np.array([9, 4, 7]), rng.normal(size=(3, 3))),
              "same": (np.arange(40), np.ones((40, 3))), "one": (np.array([3]), np.zeros((1, 3)))}
    rounds = []
    got = {}
    for r in farthest.farthest_points(table(spark, clouds), 256, "g", skip_near_zero=skip, rounds=rounds).orderBy("g", "step").collect():
        got.setdefault(r.g, []).append(r.pid)
    for name, (ids, xyz) in clouds.items():
        assert got[name] == plain(ids, xyz, 256, skip), name
    assert len(rounds) < 40  # 256 picks


def test_empty(spark):
    d = table(spark, {"a": (np.array([1]), np.zeros((1, 3)))}).limit(0)
    assert farthest.farthest_points(d, 5, "g").count() == 0
