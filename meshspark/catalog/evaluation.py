"""Evaluation, leaderboard and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshspark import fixtures
from meshspark.catalog.common import lattice_geometry, out
from meshspark.catalog.registry import query
from meshspark.catalog.sqlviews import FACES, GEOM, LOGITS, RUNS, SCORED, cols6, r6
from meshspark.functions.vectors import rounded
from meshspark.operators import metrics as mt

BUCKET = "CASE WHEN area_mm2>=0 AND area_mm2<100 THEN '0-100' WHEN area_mm2>=100 AND area_mm2<400 THEN '100-400' WHEN area_mm2>=400 THEN '400+' ELSE 'unknown' END"


def class_sql(src: str, keys: str) -> str:
    k = keys + ", " if keys else ""
    return f"""SELECT {k}cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (
  SELECT {k}gt AS cls, CASE WHEN gt=pred THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN gt<>pred THEN 1 ELSE 0 END AS fn FROM {src}
  UNION ALL SELECT {k}pred, 0, CASE WHEN gt<>pred THEN 1 ELSE 0 END, 0 FROM {src}) GROUP BY ALL"""


@query("argmax", f"WITH {SCORED} SELECT fid, pred FROM sc")
def argmax(spark, sf):
    return fixtures.logits(spark, sf).select("fid", mt.argmax_label(F.col("logits")).alias("pred"))


@query("confusion", f"WITH {SCORED} SELECT gt, pred, count(*) AS n FROM sc GROUP BY ALL")
def confusion(spark, sf):
    return mt.confusion(fixtures.scored(spark, sf), [])


@query("class_iou", f"WITH {SCORED}, c AS ({class_sql('sc', '')}) SELECT cls, tp, fp, fn, {r6('tp/(tp+fp+fn)')} AS iou, {r6('2*tp/(2*tp+fp+fn)')} AS dice, coalesce({r6('tp/nullif(tp+fp,0)')},-1.0) AS prec, coalesce({r6('tp/nullif(tp+fn,0)')},-1.0) AS recall FROM c")
def class_iou(spark, sf):
    c = mt.per_class(mt.confusion(fixtures.scored(spark, sf), []), [])
    return c.select("cls", "tp", "fp", "fn", rounded(F.col("iou")).alias("iou"), rounded(F.col("dice")).alias("dice"),
                    F.coalesce(rounded(F.col("precision")), F.lit(-1.0)).alias("prec"), F.coalesce(rounded(F.col("recall")), F.lit(-1.0)).alias("recall"))


@query("macro_iou", f"WITH {SCORED}, c AS ({class_sql('sc', '')}) SELECT {r6('avg(tp/(tp+fp+fn))')} AS macro_iou, {r6('sum(tp)/sum(tp+fn)')} AS acc, CAST(sum(tp+fn) AS BIGINT) AS n_faces FROM c")
def macro_iou(spark, sf):
    s = mt.scores(mt.confusion(fixtures.scored(spark, sf), []), [])
    return out(s, ["n_faces"], ["macro_iou", "acc"])


@query("patch_scores", f"WITH {SCORED}, c AS ({class_sql('sc', 'patch_id')}) SELECT patch_id, {r6('avg(tp/(tp+fp+fn))')} AS macro_iou, {r6('sum(tp)/sum(tp+fn)')} AS acc, CAST(sum(tp+fn) AS BIGINT) AS n_faces FROM c GROUP BY patch_id")
def patch_scores(spark, sf):
    return out(mt.scores(mt.confusion(fixtures.scored(spark, sf), ["patch_id"]), ["patch_id"]), ["patch_id", "n_faces"], ["macro_iou", "acc"])


@query("iou_by_bucket", f"""WITH {SCORED}, sb AS (SELECT *, {BUCKET} AS bucket FROM sc), al AS (SELECT 'all' AS bucket, gt, pred FROM sb UNION ALL SELECT bucket, gt, pred FROM sb),
c AS ({class_sql('al', 'bucket')}) SELECT bucket, {r6('avg(tp/(tp+fp+fn))')} AS macro_iou, {r6('sum(tp)/sum(tp+fn)')} AS acc, CAST(sum(tp+fn) AS BIGINT) AS n_faces FROM c GROUP BY bucket""")
def iou_by_bucket(spark, sf):
    s = fixtures.scored(spark, sf).withColumn("bucket", mt.area_bucket(F.col("area_mm2")))
    c = mt.confusion_sets(s, [[], ["bucket"]], ["bucket"]).withColumn("bucket", F.coalesce("bucket", F.lit("all")))
    return out(mt.scores(c, ["bucket"]), ["bucket", "n_faces"], ["macro_iou", "acc"])


@query("area_gates", f"WITH {SCORED} SELECT DISTINCT patch_id, area_mm2>=40 AS g1, area_mm2>=180 AS g2, area_mm2>=360 AS g3, {BUCKET} AS bucket FROM sc")
def area_gates(spark, sf):
    g = mt.area_gates(F.col("area_mm2"), [40, 180, 360])
    return fixtures.scored(spark, sf).select("patch_id", "area_mm2").distinct().select(
        "patch_id", g[0].alias("g1"), g[1].alias("g2"), g[2].alias("g3"), mt.area_bucket(F.col("area_mm2")).alias("bucket"))


@query("class_alpha", f"""WITH {FACES}, c AS (SELECT l.label, count(f.fid) AS n FROM (SELECT unnest(generate_series(0,16)) AS label) l LEFT JOIN faces f ON f.label=l.label GROUP BY ALL),
a AS (SELECT label, n, 1.0::DOUBLE/greatest(n,1) AS a FROM c) SELECT CAST(label AS BIGINT) AS label, n, {r6('a*(count(*) OVER ())/(sum(a) OVER ())')} AS alpha FROM a""")
def class_alpha(spark, sf):
    c = mt.class_counts(fixtures.lattice_faces(spark, sf), ["arch_id"], "label", 17).groupBy("label").agg(F.sum("n").alias("n"))
    return out(mt.class_alpha(c), ["label", "n"], ["alpha"])


LSM = f"""{LOGITS}, ex AS (SELECT fid, target, list_max(logits) AS m, logits FROM lg),
ls AS (SELECT fid, target, logits[target+1]-m-ln(list_sum(list_transform(logits, lambda v: exp(v-m)))) AS lp FROM ex)"""


@query("log_softmax", f"WITH {LSM} SELECT fid, {r6('lp')} AS log_pt, {r6('exp(lp)')} AS pt FROM ls")
def log_softmax(spark, sf):
    return out(mt.focal_rows(fixtures.logits(spark, sf)), ["fid"], ["log_pt", "pt"])


@query("focal_loss", f"WITH {LSM} SELECT 'focal' AS kind, {r6('avg(-pow(1.0-exp(lp),2.0)*lp)')} AS loss, count(*) AS n FROM ls UNION ALL SELECT 'cross_entropy', {r6('avg(-lp)')}, count(*) FROM ls UNION ALL SELECT 'ignore_0_sum', {r6('sum(-pow(1.0-exp(lp),2.0)*lp)')}, count(*) FROM ls WHERE target<>0")
def focal_loss(spark, sf):
    l = fixtures.logits(spark, sf)
    parts = [("focal", mt.focal_loss(l)), ("cross_entropy", mt.focal_loss(l, gamma=0.0)),
             ("ignore_0_sum", mt.focal_loss(l, "sum", ignore_index=0))]
    rows = [d.select(F.lit(k).alias("kind"), rounded(F.col("loss")).alias("loss"), "n") for k, d in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("class_presence", f"""WITH {SCORED}, p AS (SELECT patch_id, gt, pred, area_mm2 AS area FROM sc) SELECT patch_id, count(DISTINCT gt) AS n_true, count(DISTINCT pred) AS n_pred, {r6('sum(CASE WHEN gt=pred THEN area ELSE 0.0 END)')} AS true_area,
{r6('sum(CASE WHEN NOT EXISTS (SELECT 1 FROM p q WHERE q.patch_id=p.patch_id AND q.gt=p.pred) THEN area ELSE 0.0 END)')} AS false_area FROM p GROUP BY patch_id""")
def class_presence(spark, sf):
    d = mt.class_presence(fixtures.scored(spark, sf).withColumn("area", F.col("area_mm2")), ["patch_id"])
    return out(d, ["patch_id", "n_true", "n_pred"], ["true_area", "false_area"])


@query("leaderboard", f"""WITH {RUNS}, e AS (SELECT run_id, max(epoch) AS le FROM ru GROUP BY run_id),
b AS (SELECT run_id, count(*) AS epochs, max(metric) AS best, arg_max(metric, epoch) AS final, max(metric) FILTER (epoch<=100) AS budget_best FROM ru GROUP BY run_id),
be AS (SELECT ru.run_id, min(epoch) AS best_epoch FROM ru JOIN b ON b.run_id=ru.run_id AND b.best=ru.metric GROUP BY ru.run_id),
t AS (SELECT ru.run_id, avg(metric) AS tail_mean FROM ru JOIN e ON e.run_id=ru.run_id WHERE epoch>le-20 GROUP BY ru.run_id)
SELECT b.run_id, epochs, CAST(best_epoch AS BIGINT) AS best_epoch, {cols6('best', 'final', 'tail_mean', 'budget_best')}, {r6('best-(SELECT best FROM b WHERE run_id=0)')} AS delta FROM b JOIN be USING (run_id) JOIN t USING (run_id)""")
def leaderboard(spark, sf):
    d = mt.leaderboard(fixtures.runs(spark, sf), 0, 100)
    return out(d, ["run_id", "epochs", "best_epoch"], ["best", "final", "tail_mean", "budget_best", "delta"])


@query("fold_cube", f"""WITH {RUNS}, f AS (SELECT run_id%4 AS type, epoch%5 AS fold, metric FROM ru) SELECT coalesce(CAST(type AS VARCHAR),'all') AS type, coalesce(CAST(fold AS VARCHAR),'all') AS fold, {r6('avg(metric)')} AS mean, {r6('stddev_samp(metric)')} AS std, count(*) AS n FROM f GROUP BY CUBE(type, fold)""")
def fold_cube(spark, sf):
    f = fixtures.runs(spark, sf).select((F.col("run_id") % 4).alias("type"), (F.col("epoch") % 5).alias("fold"), "metric")
    c = mt.fold_summary(f, ["type", "fold"], "metric")
    name = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("all")).alias(k)
    return c.select(name("type"), name("fold"), rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"), "n")


@query("timing_summary", f"WITH {RUNS} SELECT run_id, {r6('avg(metric)')} AS mean, {r6('median(metric)')} AS median, {r6('max(metric)')} AS max, count(*) AS n FROM ru GROUP BY run_id")
def timing_summary(spark, sf):
    return out(mt.timing_summary(fixtures.runs(spark, sf), ["run_id"], "metric"), ["run_id", "n"], ["mean", "median", "max"])


@query("split_audit", """WITH c AS (SELECT DISTINCT o_custkey AS c, o_orderstatus AS s FROM orders) SELECT a.s AS split_a, b.s AS split_b, count(*) AS n_cases FROM c a JOIN c b ON a.c=b.c AND a.s<b.s GROUP BY ALL""")
def split_audit(spark, sf):
    o = fixtures.table(spark, sf, "orders")
    return mt.split_audit(o.select(F.col("o_custkey").alias("case"), F.col("o_orderstatus").alias("split")))
