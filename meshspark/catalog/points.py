"""Neighbour and point-set queries on the embedding-derived clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshspark import fixtures
from meshspark.catalog.common import lattice_geometry, out
from meshspark.catalog.registry import query
from meshspark.catalog.sqlviews import GEOM, OBS, POINTS, cols6, r6, u
from meshspark.functions.vectors import rounded
from meshspark.operators import axis_split, pointset as ps, sampling, spatial
from meshspark.operators.farthest import farthest_points
from meshspark.operators.metric_index import nearest_features
from meshspark.session import cut_lineage

CELL = 0.5
D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
KNN = f"""knn AS MATERIALIZED (SELECT a.cloud, a.pid AS qid, b.pid, sqrt({D2}) AS dist, row_number() OVER (PARTITION BY a.cloud, a.pid ORDER BY {D2}, b.pid) AS rank
  FROM pts a JOIN pts b ON b.cloud=a.cloud AND b.pid<>a.pid)"""
CAND = f"""cand AS MATERIALIZED (SELECT a.cloud, a.pid AS qid, b.pid, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.cloud, a.pid ORDER BY {D2}, b.pid) AS rank FROM pts a JOIN pts b ON b.cloud=a.cloud)"""


def _pts(spark, sf, feat: bool = False):
    p = fixtures.points(spark, sf).select("cloud", "pid", "x", "y", "z", *["feat"] * feat)
    p = cut_lineage(p)
    return p, p.withColumnRenamed("pid", "qid")


@query("knn", f"WITH {POINTS}, {KNN} SELECT cloud, qid, rank, pid, {cols6('dist')} FROM knn WHERE rank<=8")
def knn(spark, sf):
    p, q = _pts(spark, sf)
    return out(spatial.nearest(q, p, 8, CELL, exclude_self=True), ["cloud", "qid", "rank", "pid"], ["dist"])


@query("knn_all_neighbours", f"WITH {POINTS}, {KNN} SELECT cloud, qid, count(*) AS n, max(rank) AS last_rank FROM knn WHERE rank<=100 GROUP BY ALL")
def knn_all_neighbours(spark, sf):
    p, q = _pts(spark, sf)
    nn = spatial.nearest(q, p, 100, CELL, exclude_self=True)
    return nn.groupBy("cloud", "qid").agg(F.count("*").alias("n"), F.max("rank").alias("last_rank"))


@query("dilated_prefix", f"WITH {POINTS}, {CAND}, lv AS (SELECT * FROM (VALUES (0,5),(1,10),(2,20)) t(level, dk)) SELECT cloud, CAST(level AS BIGINT) AS level, qid, rank, pid FROM cand JOIN lv ON rank<=dk")
def dilated_prefix(spark, sf):
    p, q = _pts(spark, sf)
    nn = spatial.nearest(q, p, 20, CELL)
    levels = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("level"), F.lit(d).alias("dk"))
                                 for i, d in enumerate((5, 10, 20))])).alias("l")
    return nn.select("cloud", "qid", "rank", "pid", levels).filter("rank <= l.dk").select("cloud", "l.level", "qid", "rank", "pid")


_FPS2 = """p1 AS MATERIALIZED (SELECT cloud, level, qid, pid, x, y, z, rank FROM cand JOIN (VALUES (0,6),(1,12),(2,18)) t(level, dk) ON rank<=dk)"""


def _fps_rounds(src: str, keys: str, order: str, start: str, k: int) -> str:
    """Unrolled rounds of farthest-point sampling over groups ``keys`` of ``src``."""
    join = " AND ".join(f"c.{x}=s.{x}" for x in keys.split(", "))
    ctes = [f"r1 AS MATERIALIZED (SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {start})=1)",
            "s1 AS MATERIALIZED (SELECT *, 1 AS step FROM r1)"]
    for i in range(2, k + 1):
        gap = "min((c.x-s.x)*(c.x-s.x)+(c.y-s.y)*(c.y-s.y)+(c.z-s.z)*(c.z-s.z))"
        grp = ", ".join(f"c.{x}" for x in keys.split(", "))
        ctes.append(f"""g{i} AS MATERIALIZED (SELECT {grp}, c.pid, c.x, c.y, c.z{', c.rank' if 'rank' in order else ''}, {gap} AS gap FROM {src} c JOIN s{i - 1} s ON {join}
  WHERE NOT EXISTS (SELECT 1 FROM s{i - 1} t WHERE {join.replace('s.', 't.')} AND t.pid=c.pid) GROUP BY ALL)""")
        ctes.append(f"s{i} AS MATERIALIZED (SELECT {keys}, pid, x, y, z, step FROM s{i - 1} UNION ALL SELECT {keys}, pid, x, y, z, {i} FROM g{i} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY gap DESC, {order})=1)")
    ctes[1] = f"s1 AS MATERIALIZED (SELECT {keys}, pid, x, y, z, 1 AS step FROM r1)"
    return ", ".join(ctes)


@query("fps", f"WITH {POINTS}, {_fps_rounds('pts', 'cloud', 'pid', 'pid', 8)} SELECT cloud, CAST(step-1 AS BIGINT) AS step, pid FROM s8")
def fps(spark, sf):
    p, _ = _pts(spark, sf)
    return farthest_points(p, 8)


@query("token_sample", f"WITH {POINTS}, {_fps_rounds('pts', 'cloud', 'pid', 'pid', 24)} SELECT cloud, CAST(step-1 AS BIGINT) AS step, pid FROM s24")
def token_sample(spark, sf):
    p, _ = _pts(spark, sf)
    return farthest_points(p, 24)


@query("dilated_fps", f"""WITH {POINTS}, {CAND}, {_FPS2}, {_fps_rounds('p1', 'cloud, level, qid', 'rank', 'rank', 4)}
SELECT cloud, CAST(level AS BIGINT) AS level, qid, CAST(step AS BIGINT) AS rank, pid FROM s4""")
def dilated_fps(spark, sf):
    p, q = _pts(spark, sf)
    nn = spatial.nearest(q, p, 18, CELL)
    return sampling.dilated_neighbours(nn, p, 4, [6, 12, 18]).select("cloud", "level", "qid", "rank", "pid")


@query("three_nn_interp", f"""WITH {POINTS}, {_fps_rounds('pts', 'cloud', 'pid', 'pid', 8)}, kn AS (SELECT p.* FROM pts p JOIN s8 USING (cloud, pid)), nn AS (SELECT a.cloud, a.pid AS qid, b.pid, b.feat, sqrt({D2}) AS dist,
  row_number() OVER (PARTITION BY a.cloud, a.pid ORDER BY {D2}, b.pid) AS rank FROM pts a JOIN kn b ON b.cloud=a.cloud),
w AS (SELECT *, 1.0/(dist+CAST(1e-8 AS DOUBLE)) AS w FROM nn WHERE rank<=3)
SELECT cloud, qid, {r6('sum(w*CAST(feat[1] AS DOUBLE))/sum(w)')} AS f0, {r6('sum(w*CAST(feat[2] AS DOUBLE))/sum(w)')} AS f1 FROM w GROUP BY ALL""")
def three_nn_interp(spark, sf):
    p, q = _pts(spark, sf, feat=True)
    known = cut_lineage(p.join(farthest_points(p, 8).select("cloud", "pid"), ["cloud", "pid"]))
    f = ps.three_interpolate(q, known, 2, CELL)
    return f.select("cloud", "qid", rounded(F.col("feat")[0]).alias("f0"), rounded(F.col("feat")[1]).alias("f1"))


BALL = f"""hits AS (SELECT a.cloud, a.pid AS qid, b.pid, row_number() OVER (PARTITION BY a.cloud, a.pid ORDER BY b.pid) AS rn FROM pts a JOIN pts b ON b.cloud=a.cloud WHERE {D2}<CAST(2.25 AS DOUBLE)),
ball AS (SELECT p.cloud, p.pid AS qid, CAST(s.slot AS BIGINT) AS slot, coalesce(h.pid, f.pid, 0) AS pid FROM pts p CROSS JOIN (SELECT unnest(generate_series(0,5)) AS slot) s
  LEFT JOIN hits h ON h.qid=p.pid AND h.cloud=p.cloud AND h.rn=s.slot+1 LEFT JOIN hits f ON f.qid=p.pid AND f.cloud=p.cloud AND f.rn=1)"""


@query("ball_query", f"WITH {POINTS}, {BALL} SELECT cloud, qid, slot, pid FROM ball")
def ball_query(spark, sf):
    p, q = _pts(spark, sf)
    return ps.ball_query(q, p, 1.5, 6)


@query("edge_pool", f"""WITH {POINTS}, {KNN} SELECT k.cloud, k.qid, {r6('max(b.x)')} AS m0, {r6('max(b.y)')} AS m1, {r6('max(b.z-a.z)')} AS l2
FROM knn k JOIN pts b ON b.pid=k.pid JOIN pts a ON a.pid=k.qid WHERE rank<=6 GROUP BY ALL""")
def edge_pool(spark, sf):
    p, q = _pts(spark, sf)
    p = p.select("cloud", "pid", "x", "y", "z", F.array("x", "y", "z").alias("feat"))
    e = cut_lineage(spatial.nearest(q, p, 6, CELL, exclude_self=True))
    g = ps.edge_pool(e, p, 3, "global")
    l = ps.edge_pool(e, p, 3, "local").withColumnRenamed("pooled", "lp")
    return g.join(l, ["cloud", "qid"]).select("cloud", "qid", rounded(F.col("pooled")[0]).alias("m0"),
                                              rounded(F.col("pooled")[1]).alias("m1"), rounded(F.col("lp")[2]).alias("l2"))


@query("set_abstraction", f"""WITH {POINTS}, {_fps_rounds('pts', 'cloud', 'pid', 'pid', 5)}, hits AS (SELECT a.cloud, a.pid AS qid, b.pid, b.x-a.x AS dx, CAST(b.feat[1] AS DOUBLE) AS f0,
  row_number() OVER (PARTITION BY a.cloud, a.pid ORDER BY b.pid) AS rn FROM s5 a JOIN pts b ON b.cloud=a.cloud WHERE {D2}<CAST(9.0 AS DOUBLE))
SELECT cloud, qid, {r6('max(dx) FILTER (rn<=8)')} AS a0, {r6('max(f0) FILTER (rn<=8)')} AS a3, {r6('max(dx) FILTER (rn<=16)')} AS b0 FROM hits GROUP BY ALL""")
def set_abstraction(spark, sf):
    p, _ = _pts(spark, sf, feat=True)
    c = farthest_points(p, 5).join(p.select("cloud", "pid", "x", "y", "z"), ["cloud", "pid"]) \
        .select("cloud", F.col("pid").alias("qid"), "x", "y", "z")
    v = ps.set_abstraction(cut_lineage(c), p, [(3.0, 8), (3.0, 16)], 2)
    return v.select("cloud", "qid", rounded(F.col("pooled")[0]).alias("a0"), rounded(F.col("pooled")[3]).alias("a3"),
                    rounded(F.col("pooled")[5]).alias("b0"))


@query("group_all", f"WITH {POINTS} SELECT cloud, {r6('max(x)')} AS m0, {r6('max(CAST(feat[2] AS DOUBLE))')} AS m4 FROM pts GROUP BY cloud")
def group_all(spark, sf):
    v = ps.group_all(fixtures.points(spark, sf), 2)
    return v.select("cloud", rounded(F.col("pooled")[0]).alias("m0"), rounded(F.col("pooled")[4]).alias("m4"))


_SMALL = f"""tg AS (SELECT arch_id, fid, mx+0.2 AS x, my+0.1 AS y, mz AS z FROM geom)"""


@query("nearest_label_transfer", f"""WITH {GEOM}, {_SMALL} SELECT t.arch_id, t.fid, arg_min(s.label, struct_pack(d:=(t.x-s.mx)*(t.x-s.mx)+(t.y-s.my)*(t.y-s.my)+(t.z-s.mz)*(t.z-s.mz), f:=s.fid)) AS label
FROM tg t JOIN geom s ON s.arch_id=t.arch_id GROUP BY ALL""")
def nearest_label_transfer(spark, sf):
    from meshspark.operators.transfer import transfer_nearest
    g = cut_lineage(lattice_geometry(spark, sf).select("arch_id", "fid", "label", "mx", "my", "mz"))
    target = g.select("arch_id", "fid", (F.col("mx") + 0.2).alias("x"), (F.col("my") + 0.1).alias("y"), F.col("mz").alias("z"))
    source = g.select("arch_id", F.col("fid").alias("sid"), "label", F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"))
    return transfer_nearest(target, source, ["label"], 0.5, "arch_id", "fid", "sid").select("arch_id", "fid", "label")


@query("nearest_with_cap", f"""WITH {POINTS}, pr AS (SELECT (cloud+1)%10 AS cloud, pid, x, y, z FROM pts), m AS (SELECT a.cloud, a.pid AS qid, b.pid, sqrt({D2}) AS dist, row_number() OVER (PARTITION BY a.cloud, a.pid ORDER BY {D2}, b.pid) AS rank
  FROM pts a JOIN pr b ON b.cloud=a.cloud WHERE sqrt({D2})<=1.0)
SELECT a.cloud, a.pid AS qid, coalesce(m.pid, -1) AS match, {r6('m.dist')} AS dist FROM pts a LEFT JOIN m ON m.qid=a.pid AND m.rank=1""")
def nearest_with_cap(spark, sf):
    from meshspark.operators.transfer import match_previous
    p, now = _pts(spark, sf)
    previous = p.withColumn("cloud", (F.col("cloud") + 1) % 10)
    m = match_previous(now, previous, 1.0, CELL)
    return m.select("cloud", "qid", F.coalesce("pid", F.lit(-1)).alias("match"), rounded(F.col("dist")).alias("dist"))


_FEAT = ",".join(r6(c) for c in ("mx/15.0", "my/15.0", "mz/15.0", "px/15.0", "py/15.0", "pz/15.0", "qx/15.0", "qy/15.0", "qz/15.0", "nx", "ny", "nz"))


def _d2(dim: int) -> str:
    return "+".join(f"(CAST(a.feat[{i}] AS DOUBLE)-CAST(b.feat[{i}] AS DOUBLE))*(CAST(a.feat[{i}] AS DOUBLE)-CAST(b.feat[{i}] AS DOUBLE))" for i in range(1, dim + 1))


@query("feature_knn", f"""WITH {GEOM}, ft AS MATERIALIZED (SELECT arch_id, fid, [{_FEAT}] AS feat FROM geom), nn AS (SELECT a.arch_id, a.fid AS qid, b.fid AS pid, {_d2(12)} AS d2
  FROM ft a JOIN ft b ON b.arch_id=a.arch_id AND b.fid<>a.fid)
SELECT arch_id, qid, rank, pid, {r6('sqrt(d2)')} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY arch_id, qid ORDER BY d2, pid) AS rank FROM nn) WHERE rank<=4""")
def feature_knn(spark, sf):
    g = lattice_geometry(spark, sf)
    scaled = [F.col(c) / F.lit(15.0) for c in ("mx", "my", "mz", "px", "py", "pz", "qx", "qy", "qz")]
    feat = F.array(*[rounded(c) for c in scaled], *[rounded(F.col(c)) for c in ("nx", "ny", "nz")])
    p = cut_lineage(g.select("arch_id", F.col("fid").alias("pid"), feat.alias("feat")))
    nn = nearest_features(p.withColumnRenamed("pid", "qid"), p, 4, 12, group="arch_id")
    return nn.select("arch_id", "qid", "rank", "pid", rounded(F.col("dist")).alias("dist"))


@query("embedding_knn", f"""WITH {POINTS}, nn AS (SELECT a.cloud, a.pid AS qid, b.pid, {_d2(64)} AS d2 FROM pts a JOIN pts b ON b.cloud=a.cloud AND b.pid<>a.pid)
SELECT cloud, qid, rank, pid, {r6('sqrt(d2)')} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY cloud, qid ORDER BY d2, pid) AS rank FROM nn) WHERE rank<=8""")
def embedding_knn(spark, sf):
    p = fixtures.points(spark, sf)
    nn = nearest_features(p.withColumnRenamed("pid", "qid"), p, 8, 64)
    return nn.select("cloud", "qid", "rank", "pid", rounded(F.col("dist")).alias("dist"))


@query("cap_faces", f"""WITH {GEOM} SELECT arch_id AS patch_id, fid FROM faces QUALIFY row_number() OVER (PARTITION BY arch_id ORDER BY {u('cap', 'arch_id', 'fid')}, fid)<=200""")
def cap_faces(spark, sf):
    f = fixtures.lattice_faces(spark, sf).select(F.col("arch_id").alias("patch_id"), "fid")
    return sampling.cap_faces(f, 200)


@query("thin_faces", f"""WITH {GEOM}, n AS (SELECT arch_id, count(*) AS n, 0.7+CAST(0.30000000000000004 AS DOUBLE)*{u('thin/rate', 'arch_id')} AS rate FROM faces GROUP BY arch_id)
SELECT f.arch_id AS patch_id, f.fid FROM faces f JOIN n USING (arch_id) WHERE n.n<20 OR rate>=0.999 OR {u('thin', 'f.arch_id', 'f.fid')}<rate""")
def thin_faces(spark, sf):
    f = fixtures.lattice_faces(spark, sf).select(F.col("arch_id").alias("patch_id"), "fid")
    return sampling.thin_faces(f)


@query("trim_overshoot", f"""WITH {GEOM}, t AS (SELECT arch_id, CAST(count(*)*0.5 AS BIGINT) AS target FROM faces GROUP BY arch_id)
SELECT f.arch_id, f.fid FROM faces f JOIN t USING (arch_id) QUALIFY row_number() OVER (PARTITION BY f.arch_id ORDER BY {u('trim', 'f.arch_id', 'f.fid')}, f.fid)<=target""")
def trim_overshoot(spark, sf):
    f = fixtures.lattice_faces(spark, sf).select("arch_id", "fid")
    t = f.groupBy("arch_id").agg(F.round(F.count("*") * 0.5).cast("bigint").alias("target"))
    return sampling.trim_to_target(f.join(t, "arch_id")).select("arch_id", "fid")


@query("spatial_split", f"WITH {OBS} SELECT chunk, line, part, ntile(4) OVER (ORDER BY cx, part, supp, chunk, line, price)-1 AS piece FROM obs")
def spatial_split(spark, sf):
    o = fixtures.observations(spark, sf).withColumn("one", F.lit(0))
    o = o.withColumn("k", F.struct("part", "supp", "chunk", "line", "price"))
    return sampling.spatial_split(o, F.col("cx"), 4, "one", "k", tie_bucket=F.expr("part div 16")).select("chunk", "line", "part", "piece")


_PIECES = f"""cv AS MATERIALIZED (SELECT arch_id, {", ".join(f"covar_pop(m{a}, m{b}) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM geom GROUP BY arch_id),
it AS (SELECT arch_id, 0 AS i, CAST(1.0 AS DOUBLE) AS x, CAST(0.7 AS DOUBLE) AS y, CAST(0.3 AS DOUBLE) AS z FROM cv UNION ALL
  SELECT arch_id, i+1, px/s, py/s, pz/s FROM (SELECT *, sqrt(px*px+py*py+pz*pz) AS s FROM (SELECT arch_id, i, xx*x+xy*y+xz*z AS px, xy*x+yy*y+yz*z AS py, xz*x+yz*y+zz*z AS pz
  FROM it JOIN cv USING (arch_id) WHERE i<400))),
ax AS (SELECT arch_id, x*g AS x, y*g AS y, z*g AS z FROM (SELECT *, sign(CASE WHEN abs(x)>=abs(y) AND abs(x)>=abs(z) THEN x WHEN abs(y)>=abs(z) THEN y ELSE z END) AS g FROM it WHERE i=400)),
al AS (SELECT arch_id, fid, {r6('mx*x+my*y+mz*z')} AS pos FROM geom JOIN ax USING (arch_id))"""


@query("main_axis_split", f"""WITH RECURSIVE {GEOM}, {_PIECES}
SELECT arch_id, fid, ntile(5) OVER (PARTITION BY arch_id ORDER BY pos, fid)-1 AS piece FROM al""")
def main_axis_split(spark, sf):
    """Five pieces of each mesh along its main axis; positions are rounded, so that both engines see the same ties."""
    g = cut_lineage(lattice_geometry(spark, sf).select("arch_id", "fid", "mx", "my", "mz"))
    return axis_split.split_main_axis(g, 5, digits=6).select("arch_id", "fid", "piece")


@query("even_sample", f"""WITH e AS (SELECT DISTINCT o_custkey%20 AS run_id FROM orders), s AS (SELECT run_id, i FROM e, (SELECT unnest(generate_series(0,10)) AS i))
SELECT DISTINCT run_id, CAST(round_even(i*((c.n-1)/10.0),0) AS BIGINT) AS epoch FROM s JOIN (SELECT o_custkey%20 AS run_id, count(*) AS n FROM orders GROUP BY 1) c USING (run_id)""")
def even_sample(spark, sf):
    r = fixtures.runs(spark, sf)
    n = r.groupBy("run_id").agg(F.count("*").alias("n"))
    return sampling.even_sample(r.join(n, "run_id"), "run_id", "epoch", "n", 11).select("run_id", "epoch")
