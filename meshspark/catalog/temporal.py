"""Live-run queries on frames and cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshspark import fixtures
from meshspark.catalog.common import longs, out
from meshspark.catalog.registry import query
from meshspark.catalog.sqlviews import COUNTS, OBS, V3, cols6, r6
from meshspark.functions import labels as lab
from meshspark.functions.vectors import Vec, angle_deg, compass, rounded
from meshspark.operators import temporal as tp
from meshspark.session import cut_lineage

MIN, CYC = 2, 3
STREAK = f"""ci AS (SELECT run_id, cycle, row_number() OVER (PARTITION BY run_id ORDER BY cycle) AS ci FROM (SELECT DISTINCT run_id, cycle FROM cc)),
ok AS (SELECT c.run_id, c.label, c.cycle, ci FROM cc c JOIN ci USING (run_id, cycle) WHERE n>={MIN} AND label BETWEEN 1 AND 16),
isl AS (SELECT *, ci-row_number() OVER (PARTITION BY run_id, label ORDER BY ci) AS isl FROM ok),
st AS (SELECT run_id, label, cycle, row_number() OVER (PARTITION BY run_id, label, isl ORDER BY ci) AS streak FROM isl),
fc AS MATERIALIZED (SELECT run_id, label, min(cycle) AS confirmed_cycle FROM st WHERE streak>={CYC} GROUP BY ALL)"""


@query("confirm_streaks", f"WITH {COUNTS}, {STREAK} SELECT run_id, label, cycle, streak FROM st")
def confirm_streaks(spark, sf):
    return tp.streaks(fixtures.cycle_counts(spark, sf), MIN)


@query("first_seen", f"""WITH {COUNTS}, {STREAK}, fs AS (SELECT run_id, label, min(cycle) AS seen_cycle FROM cc WHERE n>={MIN} GROUP BY ALL)
SELECT run_id, label, coalesce(seen_cycle,-1) AS seen_cycle, coalesce(confirmed_cycle,-1) AS confirmed_cycle, coalesce(confirmed_cycle>seen_cycle,false) AS delayed FROM fs FULL JOIN fc USING (run_id, label)""")
def first_seen(spark, sf):
    d = tp.compare_rules(cut_lineage(fixtures.cycle_counts(spark, sf)), MIN, CYC)
    return d.fillna(-1, ["seen_cycle", "confirmed_cycle"])


_SEQ = "sq(stage, pos, label) AS (VALUES " + ", ".join(
    f"('{s}',{i},{l})" for s, seq, o in (("LEFT", lab.LEFT_SWEEP, 0), ("RIGHT", lab.RIGHT_SWEEP, 8)) for i, l in enumerate(seq, o)) + ")"


def regimen_sql(confirmed: str, name: str) -> str:
    return f"""{name} AS (SELECT c.run_id, c.cycle, coalesce(arg_min(q.stage, q.pos),'DONE') AS stage, coalesce(arg_min(q.label, q.pos),0) AS target FROM (SELECT DISTINCT run_id, cycle FROM cc) c
  LEFT JOIN sq q ON NOT EXISTS ({confirmed}) GROUP BY ALL)"""


OLD = regimen_sql(f"SELECT 1 FROM cc d WHERE d.run_id=c.run_id AND d.cycle=c.cycle AND d.label=q.label AND d.n>={MIN}", "old")
NEW = regimen_sql("SELECT 1 FROM fc d WHERE d.run_id=c.run_id AND d.label=q.label AND d.confirmed_cycle<=c.cycle", "new")


@query("regimen_replay", f"WITH {COUNTS}, {STREAK}, {_SEQ}, {OLD}, {NEW} SELECT o.run_id, o.cycle, o.stage AS old_stage, CAST(o.target AS BIGINT) AS old_target, n.stage AS new_stage, CAST(n.target AS BIGINT) AS new_target FROM old o JOIN new n USING (run_id, cycle)")
def regimen_replay(spark, sf):
    c = cut_lineage(fixtures.cycle_counts(spark, sf))
    o = tp.regimen(c, "single", MIN, CYC).withColumnsRenamed({"stage": "old_stage", "target": "old_target"})
    n = tp.regimen(c, "sustained", MIN, CYC).withColumnsRenamed({"stage": "new_stage", "target": "new_target"})
    return longs(o.join(n, ["run_id", "cycle"]), "old_target", "new_target")


@query("transitions", f"""WITH {COUNTS}, {STREAK}, {_SEQ}, {OLD}, {NEW}, l AS (SELECT 'old' AS rule, run_id, cycle, stage, target, lag(stage||target) OVER (PARTITION BY run_id ORDER BY cycle) AS p FROM old
UNION ALL SELECT 'new', run_id, cycle, stage, target, lag(stage||target) OVER (PARTITION BY run_id ORDER BY cycle) FROM new)
SELECT rule, run_id, cycle, stage, CAST(target AS BIGINT) AS target FROM l WHERE p IS NULL OR p<>stage||target""")
def transitions(spark, sf):
    c = cut_lineage(fixtures.cycle_counts(spark, sf))
    parts = [tp.transitions(tp.regimen(c, r, MIN, CYC), ["stage", "target"]).withColumn("rule", F.lit(n))
             for r, n in (("single", "old"), ("sustained", "new"))]
    return longs(parts[0].unionByName(parts[1]).select("rule", "run_id", "cycle", "stage", "target"), "target")


@query("gaps", f"""WITH {V3}, g AS (SELECT run_id, seq, epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY run_id ORDER BY ts, seq)) AS g FROM fr) SELECT run_id, seq, {r6('g/1e6')} AS gap_s FROM g WHERE g/1e6>1200.0""")
def gaps(spark, sf):
    return out(tp.frame_gaps(fixtures.frames(spark, sf), 1200.0), ["run_id", "seq"], ["gap_s"])


@query("recent_position", f"WITH {V3} SELECT run_id, mesh_id, {', '.join(r6(f'avg(c{a}) OVER w') + f' AS p{a}' for a in 'xyz')} FROM fr WINDOW w AS (PARTITION BY run_id ORDER BY mesh_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def recent_position(spark, sf):
    return out(tp.recent_position(fixtures.frames(spark, sf), bucket_size=500), ["run_id", "mesh_id"], ["px", "py", "pz"])


@query("raw_face_delta", f"WITH {V3} SELECT run_id, region, seq, face_count, face_count-coalesce(lag(face_count) OVER (PARTITION BY run_id, region ORDER BY seq),0) AS delta FROM fr")
def raw_face_delta(spark, sf):
    return tp.raw_face_delta(fixtures.frames(spark, sf), bucket_size=500)


@query("latest_frame", f"WITH {V3} SELECT run_id, region, seq, face_count FROM fr QUALIFY row_number() OVER (PARTITION BY run_id, region ORDER BY seq DESC)=1")
def latest_frame(spark, sf):
    return tp.latest_frame(fixtures.frames(spark, sf).select("run_id", "region", "seq", "face_count"), ["run_id", "region"])


@query("frame_throughput", f"WITH {V3} SELECT run_id, frame_type, CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS period, count(*) AS n_frames, CAST(sum(face_count*12) AS BIGINT) AS bytes FROM fr GROUP BY ALL")
def frame_throughput(spark, sf):
    f = fixtures.frames(spark, sf).withColumn("bytes", F.col("face_count") * 12)
    return tp.throughput(f, "1 day").select("run_id", "frame_type", F.unix_seconds("w.start").alias("period"), "n_frames", "bytes")


@query("oscillation", f"""WITH {COUNTS}, l AS (SELECT run_id, cycle, label AS leader FROM cc WHERE label IN (8,9) QUALIFY row_number() OVER (PARTITION BY run_id, cycle ORDER BY n DESC, label)=1),
s AS (SELECT *, CASE WHEN leader<>lag(leader) OVER (PARTITION BY run_id ORDER BY cycle) THEN 1 ELSE 0 END AS swap FROM l)
SELECT run_id, cycle, leader, CAST(swap AS BIGINT) AS swap, CAST(sum(swap) OVER (PARTITION BY run_id ORDER BY cycle) AS BIGINT) AS swaps FROM s""")
def oscillation(spark, sf):
    return tp.oscillation(fixtures.cycle_counts(spark, sf), 8, 9)


_EX = f"""{COUNTS}, {STREAK}, {_SEQ}, {NEW}, tgt AS (SELECT n.run_id, n.cycle, n.target, q.stage, q.pos FROM new n JOIN sq q ON q.label=n.target WHERE n.target<>0),
known AS (SELECT * FROM cc WHERE n>={MIN}),
anc AS (SELECT t.run_id, t.cycle, t.target, k.cx, k.cy, k.cz, row_number() OVER (PARTITION BY t.run_id, t.cycle ORDER BY q.pos DESC) AS rn FROM tgt t JOIN sq q ON q.stage=t.stage AND q.pos<t.pos
  JOIN known k ON k.run_id=t.run_id AND k.cycle=t.cycle AND k.label=q.label),
brg AS (SELECT t.run_id, t.cycle, t.target, k.cx, k.cy, k.cz, row_number() OVER (PARTITION BY t.run_id, t.cycle ORDER BY k.label DESC) AS rn FROM tgt t JOIN known k ON k.run_id=t.run_id AND k.cycle=t.cycle AND k.label IN (7,8)
  WHERE t.stage='RIGHT' AND NOT EXISTS (SELECT 1 FROM anc a WHERE a.run_id=t.run_id AND a.cycle=t.cycle)),
al AS (SELECT * FROM anc UNION ALL SELECT * FROM brg),
ext AS (SELECT a.run_id, a.cycle, a.target, coalesce(a.cx+(a.cx-b.cx),a.cx) AS x, coalesce(a.cy+(a.cy-b.cy),a.cy) AS y, coalesce(a.cz+(a.cz-b.cz),a.cz) AS z FROM al a
  LEFT JOIN al b ON b.run_id=a.run_id AND b.cycle=a.cycle AND b.rn=2 WHERE a.rn=1)"""


def _extrapolated(spark, sf):
    c = cut_lineage(fixtures.cycle_counts(spark, sf))
    t = tp.regimen(c, "sustained", MIN, CYC).filter("target <> 0")
    pos = c.filter(F.col("n") >= MIN).groupBy("run_id", "cycle").agg(F.map_from_entries(F.collect_list(F.struct(
        "label", F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))))).alias("pos"))
    d = t.join(pos, ["run_id", "cycle"]).withColumn("p", tp.extrapolate(F.col("pos"), F.col("target").cast("bigint")))
    return longs(d.filter("p is not null").select("run_id", "cycle", "target", "p.x", "p.y", "p.z"), "target")


@query("extrapolate", f"WITH {_EX} SELECT run_id, cycle, CAST(target AS BIGINT) AS target, {cols6('x', 'y', 'z')} FROM ext")
def extrapolate(spark, sf):
    return out(_extrapolated(spark, sf), ["run_id", "cycle", "target"], ["x", "y", "z"])


@query("guidance_compass", f"""WITH {_EX}, cen AS (SELECT run_id, cycle, avg(cx) AS hx, avg(cy) AS hy, avg(cz) AS hz FROM fr GROUP BY ALL),
v AS (SELECT e.run_id, e.cycle, target, sqrt((x-hx)*(x-hx)+(y-hy)*(y-hy)+(z-hz)*(z-hz)) AS distance_mm, degrees(atan2(y-hy, x-hx)) AS angle FROM ext e JOIN cen USING (run_id, cycle))
SELECT run_id, cycle, {cols6('distance_mm', 'angle')}, (['E','NE','N','NW','W','SW','S','SE'])[CAST(floor(((angle+22.5+360)%360)/45.0) AS INT)+1] AS compass FROM v""")
def guidance_compass(spark, sf):
    here = fixtures.frames(spark, sf).groupBy("run_id", "cycle").agg(*[F.avg(f"c{a}").alias(f"h{a}") for a in "xyz"])
    d = _extrapolated(spark, sf).join(here, ["run_id", "cycle"])
    v = Vec.cols("").minus(Vec.cols("h"))
    d = d.withColumn("distance_mm", v.norm()).withColumn("angle", angle_deg(v.y, v.x)).withColumn("compass", compass(F.col("angle")))
    return out(d, ["run_id", "cycle", "compass"], ["distance_mm", "angle"])


@query("scan_counters", f"""WITH {V3}, l AS (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY run_id, region ORDER BY seq DESC)=1), a AS (SELECT run_id, count(*) AS n_frames FROM fr GROUP BY 1)
SELECT l.run_id, a.n_frames, count(*) AS n_meshes, CAST(sum(face_count) AS BIGINT) AS raw_faces FROM l JOIN a USING (run_id) GROUP BY ALL""")
def scan_counters(spark, sf):
    f = fixtures.frames(spark, sf)
    last = tp.latest_frame(f.select("run_id", "region", "seq", "face_count"), ["run_id", "region"])
    t = last.groupBy("run_id").agg(F.count("*").alias("n_meshes"), F.sum("face_count").alias("raw_faces"))
    return f.groupBy("run_id").agg(F.count("*").alias("n_frames")).join(t, "run_id")


@query("bounds", f"WITH {V3}, b AS (SELECT run_id, min(cx) AS a, max(cx) AS b, min(cy) AS c, max(cy) AS d FROM fr GROUP BY run_id) SELECT run_id, {r6('(a+b)/2-greatest((b-a)/2,CAST(0.001 AS DOUBLE))*CAST(1.7 AS DOUBLE)')} AS lo_x, {r6('(c+d)/2+greatest((d-c)/2,CAST(0.001 AS DOUBLE))*CAST(1.7 AS DOUBLE)')} AS hi_y FROM b")
def bounds(spark, sf):
    return out(tp.margin_box(tp.bounds(fixtures.frames(spark, sf), ["run_id"])), ["run_id"], ["lo_x", "hi_y"])


@query("label_positions", f"WITH {COUNTS} SELECT run_id, cycle, label, {cols6('cx', 'cy', 'cz')}, '#'||CASE WHEN label<=8 THEN 16+label ELSE 16+label END AS text FROM cc WHERE label<>0"
       .replace("CASE WHEN label<=8 THEN 16+label ELSE 16+label END", "CAST(CASE WHEN label<=8 THEN 25-(9-label) ELSE 24+(label-8) END AS VARCHAR)"))
def label_positions(spark, sf):
    return out(tp.label_positions(fixtures.cycle_counts(spark, sf), "lower"), ["run_id", "cycle", "label", "text"], ["cx", "cy", "cz"])


@query("header_fields", f"WITH {V3} SELECT frame_type, CAST(json_extract_string(header, '$.k') AS BIGINT) AS k, count(*) AS n FROM fr GROUP BY ALL")
def header_fields(spark, sf):
    f = fixtures.frames(spark, sf).withColumn("h", F.from_json("header", "k bigint"))
    return f.groupBy("frame_type", F.col("h.k").alias("k")).agg(F.count("*").alias("n"))


@query("claim_voxels", f"""WITH {OBS} SELECT CAST(floor(cx) AS BIGINT) AS vx, CAST(floor(cy+0.5) AS BIGINT) AS vy, CAST(floor(cz+0.5) AS BIGINT) AS vz, chunk, line, part FROM obs
QUALIFY row_number() OVER (PARTITION BY floor(cx), floor(cy+0.5), floor(cz+0.5) ORDER BY chunk, line, part, supp, price)=1""")
def claim_voxels(spark, sf):
    o = fixtures.observations(spark, sf).select(
        F.floor("cx").alias("vx"), F.floor(F.col("cy") + 0.5).alias("vy"), F.floor(F.col("cz") + 0.5).alias("vz"),
        "chunk", "line", "part", "supp", "price")
    return tp.claim_voxels(o, ["vx", "vy", "vz"], ["chunk", "line", "part", "supp", "price"]).drop("supp", "price")


@query("voxel_density", f"""WITH {OBS}, v AS (SELECT floor(cx) AS a, floor(cy+0.5) AS b, floor(cz+0.5) AS c, count(*) AS n FROM obs GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n_seen, count(*) AS n_kept, CAST(max(n) AS BIGINT) AS busiest FROM v""")
def voxel_density(spark, sf):
    o = fixtures.observations(spark, sf)
    v = o.groupBy(F.floor("cx").alias("a"), F.floor(F.col("cy") + 0.5).alias("b"), F.floor(F.col("cz") + 0.5).alias("c")).agg(F.count("*").alias("n"))
    return v.agg(F.sum("n").alias("n_seen"), F.count("*").alias("n_kept"), F.max("n").alias("busiest"))
