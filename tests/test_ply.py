"""Coloured meshes: what is written comes back, and files of other makers are read."""

import os
import tempfile

import numpy as np
import pytest

from meshspark import fixtures
from meshspark.sources import mesh_text, ply


def test_written_meshes_come_back(spark, sf):
    v, f = fixtures.lattice_vertices(spark, sf), fixtures.lattice_faces(spark, sf)
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "out")
    mesh_text.write_coloured_meshes(v, f, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8kb")  # many splits a file
    try:
        gv, gf = ply.read_labelled(spark, path, pattern="*")
        got_v, got_f = gv.orderBy("arch_id", "vid").collect(), gf.orderBy("arch_id", "fid").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    name = lambda r: f"pred_{r.arch_id}"
    want_v = sorted((name(r), r.vid, r.x, r.y, r.z) for r in v.collect())
    want_f = sorted((name(r), r.fid, r.v0, r.v1, r.v2, r.label) for r in f.collect())
    assert [(r.arch_id, r.x, r.y, r.z) for r in got_v] == [(m, *c) for m, _, *c in want_v]
    assert [(r.arch_id, r.v0, r.v1, r.v2, r.label) for r in got_f] == [(m, *c) for m, _, *c in want_f]


def binary(order, n=70_000):
    rng = np.random.default_rng(1)
    v = np.zeros(n, np.dtype([("x", order + "f4"), ("nx", order + "f8"), ("y", order + "f4"), ("z", order + "f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1"), ("alpha", "u1")]))
    for c in v.dtype.names:
        v[c] = rng.integers(0, 200, n)
    e = np.zeros(3, np.dtype([("q", order + "i2")]))
    f = np.zeros(n // 2, np.dtype([("n", "u1"), ("v", order + "i4", (3,)), ("red", "u1"), ("green", "u1"), ("blue", "u1"), ("alpha", "u1")]))
    f["n"], f["v"], f["red"], f["blue"] = 3, rng.integers(0, n, (n // 2, 3)), 230, 25
    props = "".join(f"property {'double' if c == 'nx' else 'float' if c in 'xyz' else 'uchar'} {c}\n" for c in v.dtype.names)
    head = (f"ply\nformat binary_{'little' if order == '<' else 'big'}_endian 1.0\ncomment made here\nelement vertex {n}\n{props}element other 3\nproperty short q\n"
            f"element face {n // 2}\nproperty list uchar int vertex_indices\n" + "".join(f"property uchar {c}\n" for c in f.dtype.names[2:]) + "end_header\n")
    return head.encode() + v.tobytes() + e.tobytes() + f.tobytes(), v, f


@pytest.mark.parametrize("order", ["<", ">"])
def test_binary_files(spark, order):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    raw, v, f = binary(order)
    for name, content in (("a.ply", raw), ("b.ply", raw), ("c.txt", b"other")):
        with open(f"{path}/{name}", "wb") as out:
            out.write(content)
    gv, gf = ply.read_binary(spark, path)
    gv, gf = gv.filter("arch_id = 'b'").orderBy("vid").toPandas(), gf.orderBy("arch_id", "fid").toPandas()
    assert (gv[["x", "y", "z"]].to_numpy() == np.stack([v[a] for a in "xyz"], axis=1)).all() and (gv["g"] == v["green"]).all()
    assert len(gf) == 2 * len(f) and (gf[["v0", "v1", "v2"]].to_numpy()[:len(f)] == f["v"]).all() and set(gf["r"]) == {230} and set(gf["b"]) == {25}


def test_odd_files(spark):
    def read(*texts, rows=True):
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        for i, t in enumerate(texts):
            with open(f"{path}/m{i}.ply", "w") as out:
                out.write(t)
        return [d.collect() for d in ply.read_text(spark, path)]

    plain = "ply\nformat ascii 1.0\nelement vertex 3\nproperty float z\nproperty float x\nproperty float y\nelement face 1\nproperty list uchar int vertex_index\nend_header\n3 1 2\n6 4 5\n 9   7 8\n3 0 1 2\n"
    v, f = read(plain, "ply\nformat ascii 1.0\nelement vertex 0\nproperty float x\nproperty float y\nproperty float z\nend_header\n")
    assert sorted((r.arch_id, r.vid, r.x, r.y, r.z, r.r) for r in v) == [("m0", i, 3.0 * i + 1, 3.0 * i + 2, 3.0 * i + 3, None) for i in range(3)]
    assert [(r.arch_id, r.fid, r.v0, r.v1, r.v2, r.g) for r in f] == [("m0", 0, 0, 1, 2, None)]
    with pytest.raises(Exception, match="not a triangle"):
        read(plain.replace("3 0 1 2", "4 0 1 2 0"))
    with pytest.raises(Exception, match="not text"):
        read(plain.replace("ascii", "binary_little_endian"))
    with pytest.raises(Exception, match="shorter"):
        read(plain.replace("face 1", "face 2"))
    with pytest.raises(Exception, match="not a PLY header"):
        read(plain.replace("end_header", "end"))
