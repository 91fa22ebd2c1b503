"""Whole jobs on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshspark import fixtures
from meshspark.catalog.common import lattice_geometry, out
from meshspark.catalog.registry import query
from meshspark.catalog.sqlviews import SCORED, FACES, cols6, r6
from meshspark.catalog.evaluation import BUCKET, class_sql
from meshspark.functions.vectors import rounded
from meshspark.operators import mesh
from meshspark.plans import jobs
from meshspark.session import cut_lineage


def _mesh(spark, sf):
    g = cut_lineage(lattice_geometry(spark, sf))
    return g, mesh.face_adjacency(g)


@query("job_sample_patches")
def job_sample_patches(spark, sf):
    g, adj = _mesh(spark, sf)
    return jobs.sample_patches(g, adj, "job", midline_prob=0.3, width=6.0, height=6.0, midline_size=(2.0, 8.0))


@query("job_patch_features")
def job_patch_features(spark, sf):
    g, adj = _mesh(spark, sf)
    patch = g.select(F.concat_ws("/", "arch_id", "label").alias("patch_id"), "arch_id", "fid")
    x = jobs.patch_features(patch, g, cut_lineage(mesh.vertex_normals(g)), adj, 20_000)
    return x.groupBy("patch_id").agg(F.count("*").alias("n"), F.max("n_capped").alias("n_capped"), F.max(F.size("x")).cast("bigint").alias("dims"),
                                     rounded(F.max("area_mm2")).alias("area_mm2"))


@query("job_neighbour_graph")
def job_neighbour_graph(spark, sf):
    p = cut_lineage(fixtures.points(spark, sf).select("cloud", "pid", "x", "y", "z"))
    local, wide = jobs.neighbour_graph(p, 6, (12, 24), 0.5, "cloud", "pid")
    return local.withColumn("level", F.lit(-1).cast("bigint")).select("cloud", "level", "qid", "rank", "pid") \
        .unionByName(wide.select("cloud", "level", "qid", "rank", "pid"))


@query("job_threshold_sweep", f"""WITH {SCORED}, cf AS (SELECT 'arg_max' AS config, area_mm2, gt, pred FROM sc UNION ALL SELECT 'truth', area_mm2, gt, gt FROM sc), sb AS (SELECT *, {BUCKET} AS bucket FROM cf),
al AS (SELECT config, 'all' AS bucket, gt, pred FROM sb UNION ALL SELECT config, bucket, gt, pred FROM sb), c AS ({class_sql('al', 'config, bucket')})
SELECT config, bucket, {r6('avg(tp/(tp+fp+fn))')} AS macro_iou, {r6('sum(tp)/sum(tp+fn)')} AS acc, CAST(sum(tp+fn) AS BIGINT) AS n_faces FROM c GROUP BY config, bucket""")
def job_threshold_sweep(spark, sf):
    s = fixtures.scored(spark, sf).withColumn("both", F.explode(F.array(
        F.struct(F.lit("arg_max").alias("config"), "pred"), F.struct(F.lit("truth").alias("config"), F.col("gt").alias("pred")))))
    d = jobs.threshold_sweep(s.select("both.config", "area_mm2", "gt", "both.pred"))
    return out(d, ["config", "bucket", "n_faces"], ["macro_iou", "acc"])


@query("scatter_prediction", f"""WITH {FACES}, p AS (SELECT arch_id, fid, CASE WHEN label=3 THEN 3 ELSE label+1 END AS pred FROM faces WHERE label<8)
SELECT f.arch_id, f.fid, coalesce(p.pred, f.label) AS shown, coalesce(p.pred=f.label, false) AS correct FROM faces f LEFT JOIN p ON p.arch_id=f.arch_id AND p.fid=f.fid""")
def scatter_prediction(spark, sf):
    f = fixtures.lattice_faces(spark, sf)
    p = f.filter("label < 8").withColumn("pred", F.when(F.col("label") == 3, 3).otherwise(F.col("label") + 1))
    return jobs.scatter_prediction(f, p).select("arch_id", "fid", "shown", F.coalesce("correct", F.lit(False)).alias("correct"))
