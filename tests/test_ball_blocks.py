"""Ball queries in blocks against brute force, with dense cells and early stops."""

import numpy as np
import pandas as pd
import pytest

from meshspark.operators import pointset


def plain(q, p, radius, n):
    out = {}
    for g, i, *c in q:
        ids = sorted(j for h, j, *d in p if h == g and sum((a - b) * (a - b) for a, b in zip(c, d)) < radius * radius)[:n]
        out[g, i] = ids + (ids[:1] or [0]) * (n - len(ids))
    return out


def frame(spark, rows, ident):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["cloud", ident, "x", "y", "z"])).selectExpr("cloud", ident, "x", "y", "z", "1 as i", "2 as _n")


@pytest.mark.parametrize("block", [4096, 16])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pointset, "POINTS", block)
    monkeypatch.setattr(pointset, "CENTRES", block)
    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.uniform(-3, 3, (300, 3)), 0.2 * rng.normal(size=(400, 3)), np.zeros((100, 3)), [[9.0, 9, 9]]])
    p = [(i % 2, int(j), *map(float, c)) for i, (j, c) in enumerate(zip(rng.permutation(200_000)[:len(xyz)], xyz))]
    q = [(g, 10_000_000 + i, *map(float, c)) for i, (g, _, *c) in enumerate(p[::5])] + [(0, 5, 50.0, 0.0, 0.0), (7, 6, 0.0, 0.0, 0.0)]
    got = {}
    for r in pointset.ball_query(frame(spark, q, "qid"), frame(spark, p, "pid"), 0.7, 9).orderBy("cloud", "qid", "slot").collect():
        got.setdefault((r.cloud, r.qid), []).append(r.pid)
    assert got == plain(q, p, 0.7, 9)


def test_empty(spark):
    a = frame(spark, [(0, 1, 0.0, 0.0, 0.0)], "qid")
    b = frame(spark, [(0, 1, 0.0, 0.0, 0.0)], "pid")
    assert [r.pid for r in pointset.ball_query(a, b.limit(0), 1.0, 2).collect()] == [0, 0]
    assert pointset.ball_query(a.limit(0), b, 1.0, 2).count() == 0
