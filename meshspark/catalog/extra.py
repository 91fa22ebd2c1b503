"""Remaining operators: sessions, signatures, offsets, text functions, SQL functions, further jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshspark import fixtures
from meshspark.catalog.common import lattice_geometry, longs, out
from meshspark.catalog.patches import ADJ, DRAWS, FACIAL, GEOM, SIZE, SWEEP, _mesh
from meshspark.catalog.registry import query
from meshspark.catalog.evaluation import class_sql
from meshspark.catalog.sqlviews import COUNTS, FACES, OBS, SCORED, V3, cols6, r6
from meshspark.catalog.temporal import CYC, MIN, NEW, OLD, STREAK, _SEQ
from meshspark.functions import sqlfunctions
from meshspark.functions.hashing import content_seed
from meshspark.functions.vectors import rounded
from meshspark.operators import frames as fr, mesh, temporal as tp
from meshspark.operators.merge import chunk_offsets
from meshspark.operators.transfer import transfer_vertex_colours
from meshspark.plans import jobs
from meshspark.session import cut_lineage
from meshspark.sources import frames as wire, results, snapshots
from meshspark.streaming import live


@query("session_reset", f"WITH {V3} SELECT run_id, seq, CAST(sum(CASE WHEN frame_type='error' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq) AS BIGINT) AS session FROM fr")
def session_reset(spark, sf):
    f = fixtures.frames(spark, sf).select("run_id", "seq", "frame_type")
    return tp.sessions(f, F.col("frame_type") == "error", 500).select("run_id", "seq", "session")


@query("skip_unchanged", f"WITH {V3} SELECT run_id, mesh_id, seq FROM (SELECT run_id, region AS mesh_id, seq, cycle, face_count FROM fr) n WHERE cycle>=60 AND NOT EXISTS (SELECT 1 FROM fr o WHERE o.cycle<60 AND o.run_id=n.run_id AND o.region=n.mesh_id AND o.face_count=n.face_count)")
def skip_unchanged(spark, sf):
    f = fixtures.frames(spark, sf).select("run_id", F.col("region").alias("mesh_id"), "seq", "cycle", "face_count",
                                          F.col("face_count").alias("vertex_count"))
    folded = f.filter("cycle < 60").select("run_id", "mesh_id", "vertex_count", "face_count")
    return tp.skip_unchanged(f.filter("cycle >= 60"), folded).select("run_id", "mesh_id", "seq")


@query("chunk_offsets", f"WITH {OBS}, n AS (SELECT chunk AS mesh_id, count(*) AS n FROM obs GROUP BY chunk) SELECT mesh_id, n, CAST(coalesce(sum(n) OVER (ORDER BY mesh_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS \"offset\" FROM n")
def chunk_offsets_query(spark, sf):
    v = fixtures.observations(spark, sf).select(F.lit(0).alias("run_id"), F.col("chunk").alias("mesh_id"))
    return chunk_offsets(v, 1000).select("mesh_id", "n", "offset")


@query("text_functions", f"""WITH {V3} SELECT seq, strftime(ts, '%Y%m%d_%H%M%S') AS run_text, seq AS cycle, 'type'||frame_type||'_run'||run_id AS run_label FROM fr""")
def text_functions(spark, sf):
    f = fixtures.frames(spark, sf).withColumn("name", F.format_string("runs/cycle_%06d.npz", "seq")) \
        .withColumn("run_text0", F.col("run_id").cast("string"))
    return f.select("seq", results.run_id_of(F.col("ts")).alias("run_text"), snapshots.cycle_of(F.col("name")).alias("cycle"),
                    results.run_label({"frame_type": "type", "run_text0": "run"}).alias("run_label"))


@query("frame_times", f"WITH {V3} SELECT seq, epoch_us(ts)//1000 AS from_millis, epoch_us(ts)//1000000 AS from_seconds FROM fr")
def frame_times(spark, sf):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("double")
    f = fixtures.frames(spark, sf).select("seq", ms.alias("ms"))
    return f.select("seq", F.unix_millis(wire.frame_time(F.col("ms"))).alias("from_millis"),
                    F.unix_seconds(wire.frame_time(F.floor(F.col("ms") / 1000).cast("double"))).alias("from_seconds"))


@query("content_seeds", f"WITH {COUNTS}, l AS (SELECT run_id, cycle, string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) AS t FROM cc GROUP BY ALL) SELECT run_id, cycle, CAST(('0x'||substr(sha256(t),57,8))::UBIGINT AS BIGINT) AS seed, CAST(('0x'||substr(sha256(t||'color_dropout'),57,8))::UBIGINT AS BIGINT) AS salted FROM l")
def content_seeds(spark, sf):
    c = fixtures.cycle_counts(spark, sf).groupBy("run_id", "cycle").agg(F.array_sort(F.collect_set("label")).alias("l"))
    return c.select("run_id", "cycle", content_seed(F.col("l")).alias("seed"), content_seed(F.col("l"), "color_dropout").alias("salted"))


@query("sql_functions", f"""WITH {OBS}, {V3} SELECT 'redness' AS f, {r6("avg(r-(g+b)/2.0)")} AS v FROM obs UNION ALL SELECT 'coarse', {r6("avg(CASE WHEN label BETWEEN 7 AND 10 THEN 1 WHEN label IN (6,11) THEN 2 WHEN label IN (4,5,12,13) THEN 3 ELSE 4 END)")} FROM fr
UNION ALL SELECT 'universal', {r6("avg(CASE WHEN label<=8 THEN 16+label ELSE 16+label END)")} FROM fr""".replace("CASE WHEN label<=8 THEN 16+label ELSE 16+label END", "CASE WHEN label<=8 THEN 25-(9-label) ELSE 24+(label-8) END"))
def sql_functions(spark, sf):
    sqlfunctions.register(spark)
    o, f = fixtures.observations(spark, sf), fixtures.frames(spark, sf)
    one = lambda d, name, e: d.select(F.expr(e).cast("double").alias("x")).agg(F.avg("x").alias("v")).select(F.lit(name).alias("f"), rounded(F.col("v")).alias("v"))
    return one(o, "redness", "redness(r, g, b)").unionByName(one(f, "coarse", "coarse_label(cast(label AS INT))")) \
        .unionByName(one(f, "universal", "universal_number(cast(label AS INT), 'lower')"))


@query("lingual_view_axis", f"WITH {GEOM}, {FACIAL} SELECT arch_id, CASE WHEN avg(fy)<0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sy FROM facial GROUP BY arch_id")
def lingual_view_axis(spark, sf):
    g = cut_lineage(lattice_geometry(spark, sf))
    f = cut_lineage(fr.facial_directions(fr.tangent_axes(fr.tooth_frames(g)), fr.arch_centers(g)))
    axis = f.select("arch_id").distinct().select("arch_id", *[F.lit(v).alias(n) for v, n in ((0.0, "sx"), (1.0, "sy"), (0.0, "sz"))])
    return out(fr.lingual_view_axis(f, axis), ["arch_id"], ["sy"])


@query("colour_transfer", f"""WITH {FACES}, uv AS (SELECT DISTINCT arch_id, vid FROM (SELECT arch_id, v0 AS vid FROM faces UNION ALL SELECT arch_id, v1 FROM faces UNION ALL SELECT arch_id, v2 FROM faces)),
o AS MATERIALIZED (SELECT arch_id, vid, x, y, z, vid*7%256 AS r, vid*11%256 AS g, vid*13%256 AS b FROM uv JOIN grid USING (vid))
SELECT t.arch_id, t.vid, s.r, s.g, s.b FROM o t JOIN o s ON s.arch_id=t.arch_id QUALIFY row_number() OVER (PARTITION BY t.arch_id, t.vid ORDER BY (t.x+0.3-s.x)*(t.x+0.3-s.x)+(t.y+0.4-s.y)*(t.y+0.4-s.y)+(t.z-s.z)*(t.z-s.z), s.vid)=1""")
def colour_transfer(spark, sf):
    v = fixtures.lattice_vertices(spark, sf).select("arch_id", "vid", "x", "y", "z", *[(F.col("vid") * m % 256).alias(c) for c, m in zip("rgb", (7, 11, 13))])
    v = cut_lineage(v)
    moved = v.select("arch_id", "vid", (F.col("x") + 0.3).alias("x"), (F.col("y") + 0.4).alias("y"), "z")
    return transfer_vertex_colours(moved, v, 0.5).select("arch_id", "vid", "r", "g", "b")


_SEEN = ", ".join(f"{m}({m}(c{a})) OVER w AS {m}_{a}" for a in "xyz" for m in ("min", "max"))
_FIT = ", ".join(f"(s.min_{a}+s.max_{a})/2.0{sign}greatest((s.max_{a}-s.min_{a})/2.0,CAST(0.001 AS DOUBLE))*CAST(1.7 AS DOUBLE) AS {n}_{a}"
                 for a in "xyz" for n, sign in (("lo", "-"), ("hi", "+")))
_IN = " AND ".join(f"s.min_{a}>=f.lo_{a} AND s.max_{a}<=f.hi_{a}" for a in "xyz")
_BOX = [f"{n}_{a}" for a in "xyz" for n in ("lo", "hi")]


@query("view_fit", f"""WITH RECURSIVE {V3}, s AS MATERIALIZED (SELECT run_id, cycle, row_number() OVER (PARTITION BY run_id ORDER BY cycle) AS k, {_SEEN} FROM fr GROUP BY run_id, cycle
  WINDOW w AS (PARTITION BY run_id ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT run_id, cycle, k, true AS refit, {_FIT} FROM s WHERE k=1
  UNION ALL SELECT s.run_id, s.cycle, s.k, NOT ({_IN}), {", ".join(f"CASE WHEN {_IN} THEN f.{c} ELSE n.{c} END" for c in _BOX)}
  FROM f JOIN s ON s.run_id=f.run_id AND s.k=f.k+1 JOIN (SELECT run_id, k, {_FIT} FROM s) n ON n.run_id=s.run_id AND n.k=s.k)
SELECT f.run_id, f.cycle, f.refit, {", ".join(f"{r6('f.' + c)} AS {c}" for c in _BOX)}, {", ".join(f"{r6('s.' + c)} AS {c}" for a in "xyz" for c in (f"min_{a}", f"max_{a}"))}
FROM f JOIN s USING (run_id, cycle)""")
def view_fit(spark, sf):
    d = tp.grow_only_fit(tp.bounds(fixtures.frames(spark, sf), ["run_id", "cycle"]))
    return out(d, ["run_id", "cycle", "refit"], [c for c in d.columns if c[:3] in ("lo_", "hi_", "min", "max")])


@query("gum_smoothing_step")
def gum_smoothing_step(spark, sf):
    """Two cycles of the same scan: the second blends with the first by nearest face."""
    o = fixtures.observations(spark, sf).select(
        F.lit(0).alias("run_id"), F.struct("chunk", "line", "part", "supp", "price").alias("fid"),
        F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), "r", "g", "b")
    first = cut_lineage(live.smooth_gum(o, None))
    second = live.smooth_gum(o.withColumn("x", F.col("x") + 0.25), first)
    return second.groupBy("is_gum").agg(F.count("*").alias("n"), rounded(F.avg("score")).alias("score"))


@query("job_guidance_changes", f"""WITH {COUNTS}, {STREAK}, {_SEQ}, {OLD}, {NEW}, l AS (SELECT 'single' AS rule, run_id, stage||target AS s, lag(stage||target) OVER (PARTITION BY run_id ORDER BY cycle) AS p FROM old
UNION ALL SELECT 'sustained', run_id, stage||target, lag(stage||target) OVER (PARTITION BY run_id ORDER BY cycle) FROM new)
SELECT rule, run_id, count(*) AS changes FROM l WHERE p IS NOT NULL AND p<>s GROUP BY ALL""")
def job_guidance_changes(spark, sf):
    c = jobs.guidance_report(fixtures.cycle_counts(spark, sf), MIN, CYC)["changes"]
    return c.filter("changes > 0").select("rule", "run_id", "changes")


@query("job_full_sequence", f"WITH RECURSIVE {GEOM}, {ADJ}, {FACIAL}, {DRAWS.split('CAST(0.2 AS DOUBLE)')[0] + '0.6::DOUBLE AS min_align FROM teeth' + DRAWS.split('AS min_align FROM teeth')[1]}, {SWEEP} SELECT v.patch_id, v.arch_id, coalesce(s.fid, -1) AS fid, v.stage, v.phase FROM visits v LEFT JOIN stages s ON s.patch_id=v.patch_id AND s.stage=v.stage")
def job_full_sequence(spark, sf):
    g, adj = _mesh(spark, sf)
    d = jobs.full_sequence(g, adj, "s", width=SIZE, height=SIZE)
    return d.select("patch_id", "arch_id", F.coalesce("fid", F.lit(-1).cast("bigint")).alias("fid"), "stage", "phase")


@query("job_snapshot_evolution")
def job_snapshot_evolution(spark, sf):
    f = fixtures.frames(spark, sf).select("run_id", "cycle", F.col("mesh_id").alias("vid"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    s = f.groupBy("run_id", "cycle").agg(F.count("*").cast("double").alias("area_mm2")).select(
        "*", F.array(F.col("area_mm2") >= 40, F.col("area_mm2") >= 180).alias("gates"), F.lit(None).cast("bigint").alias("raw_faces"),
        F.lit("none").alias("guidance_state"), F.lit(None).cast("double").alias("guidance_distance_mm"))
    _, projected = jobs.snapshot_evolution(s, f)
    return out(projected, ["run_id", "cycle", "vid"], ["u", "v"])


@query("job_colour_report", f"""WITH {OBS} SELECT chunk%7 AS run_id, count(*) AS n, count(*) FILTER (r=102 AND g=102 AND b=102) AS n_missing FROM obs GROUP BY 1""")
def job_colour_report(spark, sf):
    o = fixtures.observations(spark, sf).select((F.col("chunk") % 7).alias("run_id"), F.when(F.col("is_gum_pred"), 0).otherwise(1).alias("label"), "r", "g", "b")
    return jobs.colour_report(o)[2].select("run_id", "n", "n_missing")


@query("job_prediction_report", f"WITH {SCORED}, c AS ({class_sql('sc', 'patch_id')}), a AS (SELECT patch_id, sum(area_mm2) AS area_mm2 FROM sc GROUP BY patch_id) SELECT patch_id, {r6('avg(tp/(tp+fp+fn))')} AS macro_iou, {r6('sum(tp)/sum(tp+fn)')} AS acc, CAST(sum(tp+fn) AS BIGINT) AS n_faces, {r6('any_value(area_mm2)')} AS area_mm2 FROM c JOIN a USING (patch_id) GROUP BY patch_id")
def job_prediction_report(spark, sf):
    s = fixtures.scored(spark, sf).withColumn("area", F.col("area_mm2"))
    return out(jobs.prediction_report(s), ["patch_id", "n_faces"], ["macro_iou", "acc", "area_mm2"])
