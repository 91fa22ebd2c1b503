"""Streaming and file round-trip queries: streams over the given tables, files derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshspark import fixtures
from meshspark.catalog.registry import ORACLES, query
from meshspark.catalog.mesh import _W as VERTEX_NORMALS
from meshspark.catalog.sqlviews import COUNTS, FACES, GEOM, OBS, V3, cols6, r6, u
from meshspark.catalog.temporal import CYC, MIN, STREAK
from meshspark.functions.vectors import rounded
from meshspark.session import cut_lineage, scratch_path
from meshspark.sources import cache, frames as fr, mesh_text, ply, snapshots
from meshspark.operators import normalise as nz
from meshspark.plans import jobs
from meshspark.streaming import fold, live


@query("stream_claim", ORACLES["claim_voxels"])
def stream_claim(spark, sf):
    li = live.file_stream(spark, f"{sf}/lineitem.parquet", fixtures.table(spark, sf, "lineitem").schema)
    s = li.select(F.lit(0).cast("bigint").alias("run_id"), F.floor("l_quantity").alias("vx"),
                  F.floor(F.col("l_discount") * 100 + 0.5).alias("vy"), F.floor(F.col("l_tax") * 100 + 0.5).alias("vz"),
                  F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").cast("bigint").alias("line"),
                  F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"))
    won = live.claim_voxels(s, ["vx", "vy", "vz"], ["chunk", "line", "part", "supp", "price"])
    table = live.run_to_table(won, scratch_path(spark, "claim"), "update")
    return live.newest_update(table, ["run_id", "vx", "vy", "vz"]).select("vx", "vy", "vz", "chunk", "line", "part")


def _cycle_stream(spark, sf, columns):
    """Stored cycles as a stream and as a table; rows of a cycle may fall into several files and batches."""
    path = scratch_path(spark, "cycles")
    f = fixtures.frames(spark, sf)
    here = f.groupBy("run_id", "cycle").agg(*[F.avg(f"c{a}").alias(f"h{a}") for a in "xyz"])
    d = fixtures.cycle_counts(spark, sf).join(here, ["run_id", "cycle"]).select(*columns)
    d.write.parquet(path)
    return live.file_stream(spark, path, spark.read.parquet(path).schema), spark.read.parquet(path)


@query("stream_confirm", f"WITH {COUNTS}, {STREAK} SELECT run_id, label, confirmed_cycle FROM fc")
def stream_confirm(spark, sf):
    s, _ = _cycle_stream(spark, sf, ["run_id", "cycle", "label", "n"])
    return live.confirmed(live.run_to_table(live.confirm_labels(s, MIN, CYC), scratch_path(spark, "confirm"), "update"))


CYCLE_COLS = ["run_id", "cycle", "label", "n", "cx", "cy", "cz", "hx", "hy", "hz"]
KW = dict(min_faces=MIN, cycles=CYC, near_mm=12.0, min_move_mm=0.5, return_mm=6.0, arch="upper")


@query("stream_waypoints")
def stream_waypoints(spark, sf):
    s, _ = _cycle_stream(spark, sf, CYCLE_COLS)
    return live.guided(live.run_to_table(live.guide(s, **KW), scratch_path(spark, "guide"), "update"))


@query("guidance_replay")
def guidance_replay(spark, sf):
    _, d = _cycle_stream(spark, sf, CYCLE_COLS)
    return live.guide_batch(d, **KW)


@query("stream_throughput", ORACLES["frame_throughput"])
def stream_throughput(spark, sf):
    ev = live.file_stream(spark, f"{sf}/events.parquet", fixtures.table(spark, sf, "events").schema)
    s = ev.select(F.expr("(user_id div 16) % 4").alias("run_id"), F.col("event_type").alias("frame_type"),
                  F.col("ts").cast("timestamp").alias("ts"), ((F.floor(F.col("value") * 10) + 1) * 12).alias("bytes"))
    t = live.run_to_table(live.throughput(s, "1 day"), scratch_path(spark, "rate"), "update")
    return live.newest_update(t, ["run_id", "frame_type", "w"]) \
        .select("run_id", "frame_type", F.unix_seconds("w.start").alias("period"), "n_frames", "bytes")


def _row_chunks(spark, sf):
    """Lattice rows as mesh chunks with local vertex numbers (two vertex rows per chunk)."""
    f = fixtures.lattice_faces(spark, sf)
    g = fixtures.lattice_grid(spark, sf)
    cell = F.expr("fid div 2 div 50")
    local = lambda v: (F.col(v) - F.col("mesh_id") * 50)
    tri = f.withColumn("mesh_id", cell).groupBy("mesh_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(
        F.struct("fid", local("v0").alias("a"), local("v1").alias("b"), local("v2").alias("c")))),
        lambda t: F.array(t["a"], t["b"], t["c"]))).alias("triangles"))
    rows = g.withColumn("mesh_id", F.explode(F.array(F.col("j"), F.col("j") - 1))).groupBy("mesh_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vid", "x", "y", "z"))),
                              lambda p: F.array(p["x"], p["y"], p["z"]))).cast("array<float>").alias("vertices"))
    return tri.join(rows, "mesh_id")


@query("frames_roundtrip", f"""WITH {FACES}, r AS (SELECT fid//2//50 AS mesh_id, * FROM faces) SELECT r.mesh_id, count(*) AS n_faces, (SELECT count(*) FROM grid g WHERE g.j IN (r.mesh_id, r.mesh_id+1)) AS n_vertices,
round(sum(CAST(CAST(a.z AS FLOAT) AS DOUBLE)),4)+0.0 AS z_sum, true AS length_ok FROM r JOIN grid a ON a.vid=r.v0 GROUP BY r.mesh_id""")
def frames_roundtrip(spark, sf):
    frames = cut_lineage(fr.encode(_row_chunks(spark, sf)))
    parsed = fr.length_ok(fr.of_type(fr.parse_headers(frames), "mesh"))
    dec = cut_lineage(fr.decode(parsed))
    v, f = fr.vertex_rows(dec), fr.face_rows(dec)
    z = f.join(v.select("mesh_id", F.col("vid").alias("v0"), F.col("z").cast("double").alias("z")), ["mesh_id", "v0"]) \
        .groupBy("mesh_id").agg(F.count("*").alias("n_faces"), (F.round(F.sum("z"), 4) + 0.0).alias("z_sum"))
    n = v.groupBy("mesh_id").agg(F.count("*").alias("n_vertices"))
    return z.join(n, "mesh_id").join(parsed.select("mesh_id", "length_ok"), "mesh_id")


@query("snapshot_roundtrip", f"WITH {COUNTS} SELECT run_id, cycle, count(*) AS n_labels, CAST(sum(n) AS BIGINT) AS n, 'none' AS guidance_state FROM cc WHERE cycle%2=0 GROUP BY ALL")
def snapshot_roundtrip(spark, sf):
    path = scratch_path(spark, "snapshots")
    c = fixtures.cycle_counts(spark, sf).groupBy("run_id", "cycle").agg(F.count("*").alias("n_labels"), F.sum("n").alias("n"))
    snapshots.write_snapshots(c, path, every=2)
    return snapshots.read_snapshots(spark, path).select(F.col("run_id").cast("bigint").alias("run_id"), "cycle", "n_labels", "n", "guidance_state")


@query("cache_append", f"WITH {FACES} SELECT arch_id, count(*) AS n_faces FROM faces GROUP BY arch_id")
def cache_append(spark, sf):
    path = scratch_path(spark, "cache")
    f = fixtures.lattice_faces(spark, sf)
    cache.guard_config(spark, path, 5.0, 16000)
    cache.append_new(f, path)
    cache.append_new(f, path)  # nothing new: the stored meshes stay as they are
    return spark.read.parquet(path).groupBy("arch_id").agg(F.count("*").alias("n_faces"))


@query("mesh_text_roundtrip", f"""WITH {FACES}, o AS (SELECT *, row_number() OVER (PARTITION BY arch_id ORDER BY fid)-1 AS line FROM faces)
SELECT arch_id, line AS fid, v0, v1, v2, label FROM o""")
def mesh_text_roundtrip(spark, sf):
    """Coloured text meshes out and in again: corners, and labels recovered from the colours."""
    path = scratch_path(spark, "ply")
    mesh_text.write_coloured_meshes(fixtures.lattice_vertices(spark, sf), fixtures.lattice_faces(spark, sf), path)
    _, f = ply.read_labelled(spark, path, pattern="*")
    return f.select(F.regexp_extract("arch_id", r"(\d+)$", 1).cast("bigint").alias("arch_id"), "fid", "v0", "v1", "v2", "label")


@query("stream_fold_once")
def stream_fold_once(spark, sf):
    """Lattice chunks streamed twice through the fold: the second delivery adds nothing."""
    path, out = scratch_path(spark, "capture"), scratch_path(spark, "fold")
    frames = fr.encode(_row_chunks(spark, sf)).withColumn("run_id", F.lit(0).cast("bigint"))
    frames.write.parquet(path)
    once = live.FoldOnce(out, density=0.6, voxel=0.4)
    s = live.file_stream(spark, path, spark.read.parquet(path).schema)
    q = s.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(once).start()
    q.awaitTermination()
    once(spark.read.parquet(path), 1_000_000)
    return once.accumulated(spark).groupBy("run_id", "batch_id").agg(F.count("*").alias("n_kept"), rounded(F.sum("area")).alias("area_mm2"))


_FOLD_RESET, _FOLD_VOXEL, _FOLD_CAP = 2, 1.7, 60
# Rows of the lattice as chunks: the row is the mesh, heights travel as 32-bit floats.
_CHUNK_GEOM = GEOM.replace("p_size*CAST(0.05 AS DOUBLE) AS z", "CAST(CAST(p_size*CAST(0.05 AS DOUBLE) AS FLOAT) AS DOUBLE) AS z").replace("g.j//10 AS arch_id", "g.j AS arch_id")
_FOLD = f"""{_CHUNK_GEOM}, {VERTEX_NORMALS}, lf AS (SELECT geom.*, row_number() OVER (PARTITION BY arch_id ORDER BY fid)-1 AS k,
  CASE WHEN arch_id>={_FOLD_RESET} THEN 1 ELSE 0 END AS session, {', '.join(f"CAST(floor(m{a}/CAST({_FOLD_VOXEL} AS DOUBLE)) AS BIGINT) AS v{a}" for a in 'xyz')},
  {', '.join(f'(v0*{s}%200+v1*{s}%200+v2*{s}%200)//3 AS {c}' for c, s in zip(('red', 'green', 'blue'), (1, 7, 3)))} FROM geom),
acc AS (SELECT lf.*, {', '.join(f'n{i}.n{a} AS {p}n{a}' for i, p in enumerate('pqr') for a in 'xyz')} FROM lf
  {' '.join(f'JOIN vn n{i} ON n{i}.arch_id=lf.arch_id AND n{i}.vid=lf.v{i}' for i in range(3))}
  QUALIFY row_number() OVER (PARTITION BY session, vx, vy, vz ORDER BY lf.arch_id, k)=1)"""


def _coloured_capture(spark, sf):
    """Lattice rows as coloured chunks of run 0, delivered twice, with a reset of the run before chunk 2."""
    path = scratch_path(spark, "capture")
    rows = _row_chunks(spark, sf)
    k = F.sequence(F.lit(0), (F.size("vertices") / 3).cast("int") - 1)
    vid = lambda i: (F.col("vertices")[i * 3 + 1] * 50 + F.col("vertices")[i * 3]).cast("int")
    colours = F.flatten(F.transform(k, lambda i: F.array(*[(vid(i) * s % 200).cast("smallint") for s in (1, 7, 3)])))
    sent = fr.encode(rows.withColumn("colors", colours)).select(F.lit(0).cast("bigint").alias("run_id"), "header", "blob")
    reset = spark.range(1).select(F.lit(0).cast("bigint").alias("run_id"),
                                  F.lit(f'{{"type": "scan_control", "action": "reset", "seq": {_FOLD_RESET}}}').alias("header"), F.lit(None).cast("binary").alias("blob"))
    sent.unionByName(reset).unionByName(sent).write.parquet(path)
    return live.file_stream(spark, path, spark.read.parquet(path).schema)


def _live_fold(spark, sf):
    return fold.accumulated(fold.advance(_coloured_capture(spark, sf), scratch_path(spark, "fold"), density=1000.0, voxel=_FOLD_VOXEL))


@query("live_fold", f"""WITH {_FOLD} SELECT session, vx, vy, vz, arch_id AS mesh_id, k AS fid, red AS r, green AS g, blue AS b,
  {cols6('area', 'mx', 'pnx', 'qny', 'rnz')} FROM acc""")
def live_fold(spark, sf):
    d = _live_fold(spark, sf)
    return d.select("session", "vx", "vy", "vz", "mesh_id", "fid", "r", "g", "b", *[rounded(F.col(c)).alias(c) for c in ("area", "mx", "pnx", "qny", "rnz")])


_X = {"px": "(px-ox)", "mz": "(mz-oz)"}


@query("live_features", f"""WITH {_FOLD}, named AS (SELECT *, session AS patch_id, arch_id*1000+k AS id FROM acc),
cut AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY {u('cap', 'patch_id', 'id')}, id)<={_FOLD_CAP}),
o AS (SELECT patch_id, sum(area) AS area_mm2, {', '.join(f'(sum(p{a})+sum(q{a})+sum(r{a}))/(count(*)*3) AS o{a}' for a in 'xyz')} FROM cut GROUP BY 1)
SELECT patch_id, id AS fid, {cols6('area_mm2')}, 27 AS width, {', '.join(f"(round({e}/CAST({nz.SCALE_MM} AS DOUBLE),5)+0.0) AS {c}" for c, e in _X.items())},
  (round(pny,5)+0.0) AS pny, (round(blue/CAST(127.5 AS DOUBLE)-1,5)+0.0) AS blue FROM cut JOIN o USING (patch_id)""")
def live_features(spark, sf):
    """Network input of a live run: accumulated faces, cut to a ceiling, with colours and corner normals."""
    acc = _live_fold(spark, sf).withColumn("patch_id", F.col("session")).withColumn("fid", F.col("mesh_id") * 1000 + F.col("fid"))
    d = jobs.live_inputs(acc, _FOLD_CAP)
    at = lambda c, i: (F.round(F.col("x")[i].cast("double"), 5) + 0.0).alias(c)
    return d.select("patch_id", "fid", rounded(F.col("area_mm2")).alias("area_mm2"), F.size("x").alias("width"),
                    at("px", 0), at("mz", 11), at("pny", 13), at("blue", 26))
