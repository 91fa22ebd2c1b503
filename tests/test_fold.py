"""The fold as a chain of streams: once per chunk, sessions, restarts, cost per cycle, state that expires."""

import json
import os

import numpy as np

from meshspark.session import scratch_path
from meshspark.streaming import fold, live

T0 = 1_700_000_000


def frame(mesh_id, seq, at, n=2, colour=True, ts=T0, **head):
    """A strip of n triangles of legs 1 on the plane z = 0, from (at, 0)."""
    v = np.array([[at + i // 2, i % 2, 0] for i in range(n + 2)], dtype="<f4")
    t = np.array([[i, i + 1, i + 2] if i % 2 == 0 else [i + 1, i, i + 2] for i in range(n)], dtype="<u4")
    c = np.full((n + 2, 3), 10 * mesh_id, dtype="u1").tobytes() if colour else b""
    layout = {"vertices_bytes": v.nbytes, "normals_bytes": 0, "colors_bytes": len(c), "triangles_bytes": t.nbytes}
    h = {"type": "mesh", "mesh_id": mesh_id, "seq": seq, "vertex_count": n + 2, "face_count": n, "layout": layout, "ts": ts, **head}
    return (0, json.dumps(h), bytearray(v.tobytes() + c + t.tobytes()))


def reset(seq, ts=T0):
    return (0, json.dumps({"type": "scan_control", "action": "reset", "seq": seq, "ts": ts}), None)


class Capture:
    """A folder of frame files, one file a batch, in the order of delivery."""

    def __init__(self, spark):
        self.spark, self.path, self.n = spark, scratch_path(spark, "capture"), 0

    def deliver(self, *rows):
        self.spark.createDataFrame(list(rows), "run_id bigint, header string, blob binary").coalesce(1).write.mode("append").parquet(self.path)
        for base, _, names in os.walk(self.path.removeprefix("file:")):
            for f in names:
                p = os.path.join(base, f)
                if f.startswith("part") and os.path.getmtime(p) > 1e6:
                    self.n += 1
                    os.utime(p, (1000 + self.n, 1000 + self.n))
        return self

    def stream(self):
        return live.file_stream(self.spark, self.path, self.spark.read.parquet(self.path).schema, 1)


def kept(claims):
    return {(r.session, r.vx, r.mesh_id, r.seq, r.fid) for r in fold.accumulated(claims).collect()}


KW = dict(density=1000.0, voxel=0.5, files_per_batch=1)


def test_chunks_count_once_whatever_the_batches(spark):
    rows = [frame(1, 1, 0), frame(2, 2, 1), frame(1, 3, 0), frame(1, 4, 0, n=4), frame(3, 5, 0, colour=False)]
    one = Capture(spark).deliver(*rows)
    want = kept(fold.advance(one.stream(), scratch_path(spark, "fold"), **KW))
    # chunk 1 and 2 keep their faces; the grown chunk 1 and the uncoloured chunk 3 lie on claimed voxels
    assert want == {(0, 0, 1, 1, 0), (0, 1, 1, 1, 1), (0, 2, 2, 2, 0), (0, 3, 2, 2, 1)}
    many = Capture(spark)
    many.deliver(rows[1]).deliver(rows[0], rows[4]).deliver(rows[3], rows[2])
    assert kept(fold.advance(many.stream(), scratch_path(spark, "fold"), **KW)) == want


def test_a_restart_reads_what_is_new_and_a_reset_starts_without_claims(spark):
    path, cap = scratch_path(spark, "fold"), Capture(spark)
    first = fold.advance(cap.deliver(frame(1, 1, 0), frame(9, 2, 0, vertex_count=0)).stream(), path, **KW)
    before = kept(first)
    assert {(s, m) for s, _, m, _, _ in before} == {(0, 1)}
    assert spark.read.parquet(f"{path}/land/quarantine").count() == 1
    after = fold.advance(cap.deliver(frame(1, 5, 0), frame(2, 6, 0), reset(6), frame(1, 7, 3)).stream(), path, **KW)
    got = kept(after)
    assert before < got and {(s, m) for s, _, m, _, _ in got} == {(0, 1), (1, 2), (1, 1)}
    d = fold.accumulated(after)
    r = d.filter("session = 1 and mesh_id = 2").first()
    assert (r.r, r.g, r.b) == (20, 20, 20) and abs(r.area - 0.5) < 1e-9 and (r.pnz, r.qnz, r.rnz) in ((1.0, 1.0, 1.0), (-1.0, -1.0, -1.0))
    faces = [len(live_rows(spark, f"{path}/faces/data/{b}")) for b in sorted(os.listdir(f"{path.removeprefix('file:')}/faces/data")) if b.startswith("batch")]
    assert sum(faces) == 6  # two a chunk; the repeated chunk of session 0 came through no second time


def live_rows(spark, path):
    return spark.read.parquet(path).collect()


def test_idle_state_goes_and_is_counted(spark):
    path, cap, lost = scratch_path(spark, "fold"), Capture(spark), []
    cap.deliver(frame(1, 1, 0, ts=T0)).deliver(frame(2, 2, 40, ts=T0 + 1)).deliver(frame(3, 3, 80, ts=T0 + 500))
    t = fold.advance(cap.stream(), path, idle_ms=60_000, losses=lost.append, **KW)
    assert {(r.session, r.evicted) for r in fold.evictions(t).collect()} == {(0, 4)} and sum(lost) == 0
    assert {m for _, _, m, _, _ in kept(t)} == {1, 2, 3}  # what was kept stays
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{path}/claims/checkpoint").count()
    assert held == 1
    last = spark.read.format("statestore").option("stateVarName", "last").load(f"{path}/faces/checkpoint").count()
    assert last == 1
