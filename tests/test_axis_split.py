"""Pieces along the main axis against a plain sort."""

import numpy as np
import pandas as pd
import pytest

from meshspark.operators import axis_split


def plain(ids, pos, n):
    order = sorted(range(len(ids)), key=lambda i: (pos[i], ids[i]))
    q, r = divmod(len(ids), n)
    ends = np.cumsum([q + (k < r) for k in range(n)])
    return {ids[i]: int(np.searchsorted(ends, rank, side="right")) for rank, i in enumerate(order)}


@pytest.mark.parametrize("leaf,bins", [(4096, 1024), (20, 8)])
def test_exact_ranks_with_ties(spark, monkeypatch, leaf, bins):
    monkeypatch.setattr(axis_split, "LEAF", leaf)
    monkeypatch.setattr(axis_split, "BINS", bins)
    rng = np.random.default_rng(1)
    meshes = {"a": (rng.permutation(5000), np.round(rng.normal(size=5000), 2)), "b": (np.arange(3), np.zeros(3)),
              "c": (rng.permutation(900) * 7, np.repeat([1.0, 5.0, 5.0], 300)), "d": (np.arange(301), np.append(rng.normal(size=300), 1e12))}
    d = spark.createDataFrame(pd.concat([pd.DataFrame({"arch_id": k, "fid": i, "p": p}) for k, (i, p) in meshes.items()]))
    from pyspark.sql import functions as F
    for n in (1, 2, 5):
        got = {(r.arch_id, r.fid): r.piece for r in axis_split.split_along(d, F.col("p"), n).collect()}
        assert got == {(k, int(i)): v for k, (ids, p) in meshes.items() for i, v in plain(ids, p, n).items()}
    assert axis_split.split_along(d.limit(0), F.col("p"), 3).count() == 0


def test_main_axis_and_dense_numbers(spark):
    side = 12
    v = [("m", 100 + 2 * (i * 3 + j), float(i), 0.1 * j, 0.0, i * 20) for i in range(side) for j in range(3)]
    at = lambda i, j: 100 + 2 * (i * 3 + j)
    f = [("m", 2 * (i * 2 + j) + k, *c, 10 * i) for i in range(side - 1) for j in range(2)
         for k, c in enumerate(((at(i, j), at(i + 1, j), at(i, j + 1)), (at(i + 1, j), at(i + 1, j + 1), at(i, j + 1))))]
    vd = spark.createDataFrame(v, "arch_id string, vid long, x double, y double, z double, r int")
    fd = spark.createDataFrame(f, "arch_id string, fid long, v0 long, v1 long, v2 long, g int")
    from meshspark.operators.mesh import face_geometry
    pieces = axis_split.split_main_axis(face_geometry(fd, vd), 3).select(*fd.columns, "piece")
    rows = pieces.collect()
    sizes = pd.Series([r.piece for r in rows]).value_counts()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 3
    assert max(r.v0 for r in rows if r.piece == 0) <= min(r.v1 for r in rows if r.piece == 2)  # the long side is x
    pv, pf = axis_split.reindexed(pieces, vd)
    colour, place = {i: r for _, i, _, _, _, r in v}, {i: (x, y) for _, i, x, y, _, _ in v}
    new = {(r.piece, r.vid): r for r in pv.collect()}
    for p in range(3):
        assert sorted(i for q, i in new if q == p) == list(range(sum(q == p for q, _ in new)))
    old = {r.fid: r for r in rows}
    for r in pf.collect():
        for c in ("v0", "v1", "v2"):
            w = new[r.piece, r[c]]
            assert (w.x, w.y) == place[old[r.fid][c]] and w.r == colour[old[r.fid][c]]
        assert r.g == old[r.fid].g
    assert pf.count() == len(f)
