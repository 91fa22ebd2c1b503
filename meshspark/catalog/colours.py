"""Colour queries on observed and painted faces."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshspark import fixtures
from meshspark.catalog.common import longs, out
from meshspark.catalog.registry import query
from meshspark.catalog.sqlviews import FACES, OBS, cols6, gauss, r6, u
from meshspark.functions import colour as col
from meshspark.functions.vectors import rounded
from meshspark.operators import augment, colour_reports as cr, temporal as tp, transfer

REAL = "NOT (r=102 AND g=102 AND b=102)"
RED = "(r-(g+b)/2.0)"


@query("colour_stats", f"""WITH {OBS} SELECT is_gum_pred AS is_gum, count(*) AS n, {', '.join(f"{r6(f'avg({c})')} AS mean_{c}, {r6(f'stddev_pop({c})')} AS std_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}" for c in 'rgb')},
{r6("avg(CASE WHEN CASE WHEN is_gum_pred THEN r BETWEEN 190 AND 225 AND g BETWEEN 100 AND 150 AND b BETWEEN 115 AND 155 ELSE r BETWEEN 210 AND 245 AND g BETWEEN 200 AND 235 AND b BETWEEN 175 AND 215 END THEN 1 ELSE 0 END)")} AS in_range FROM obs WHERE {REAL} GROUP BY ALL""")
def colour_stats(spark, sf):
    s = cr.colour_stats(fixtures.observations(spark, sf).withColumnRenamed("is_gum_pred", "is_gum"), [])
    return out(s, ["is_gum", "n"] + [f"{m}_{c}" for c in "rgb" for m in ("min", "max")],
               [f"{m}_{c}" for c in "rgb" for m in ("mean", "std")] + ["in_range"])


@query("sentinel_share", f"WITH {OBS} SELECT is_gum_pred, count(*) AS n, count(*) FILTER (NOT {REAL}) AS n_missing, {r6(f'avg(CASE WHEN {REAL} THEN 0 ELSE 1 END)')} AS share FROM obs GROUP BY ALL")
def sentinel_share(spark, sf):
    return out(cr.sentinel_share(fixtures.observations(spark, sf), ["is_gum_pred"]), ["is_gum_pred", "n", "n_missing"], ["share"])


@query("redness_classes", f"WITH {OBS} SELECT is_gum_pred, {RED}>20 AS is_gum, count(*) AS n, {r6(f'avg(least(1.0,greatest(0.0,0.5+({RED}-20.0)/40.0)))')} AS score FROM obs WHERE {REAL} GROUP BY ALL")
def redness_classes(spark, sf):
    o = fixtures.observations(spark, sf).filter(~col.is_sentinel(F.col("r"), F.col("g"), F.col("b")))
    red = col.redness(F.col("r"), F.col("g"), F.col("b"))
    d = o.groupBy("is_gum_pred", (red > 20).alias("is_gum")).agg(F.count("*").alias("n"), F.avg(col.gum_score(red)).alias("score"))
    return out(d, ["is_gum_pred", "is_gum", "n"], ["score"])


@query("otsu", f"""WITH {OBS}, h AS (SELECT CAST(floor({RED}) AS BIGINT) AS bin, count(*) AS n FROM obs WHERE {REAL} GROUP BY ALL), m AS (SELECT bin, n, (bin+0.5::DOUBLE)*n AS m FROM h),
c AS (SELECT bin, CAST(sum(n) OVER (ORDER BY bin) AS DOUBLE) AS w0, sum(m) OVER (ORDER BY bin) AS s0, CAST(sum(n) OVER () AS DOUBLE) AS wt, sum(m) OVER () AS st FROM m)
SELECT 'all' AS pool, CAST(arg_max(bin, w0*(wt-w0)*pow(s0/w0-(st-s0)/(wt-w0),2))+1 AS DOUBLE) AS threshold FROM c WHERE w0<wt""")
def otsu(spark, sf):
    o = fixtures.observations(spark, sf).filter(~col.is_sentinel(F.col("r"), F.col("g"), F.col("b"))).withColumn("pool", F.lit("all"))
    return cr.otsu_threshold(o, ["pool"], col.redness(F.col("r"), F.col("g"), F.col("b")))


@query("flatten_colours", f"""WITH {OBS}, kn AS (SELECT cx, cy, cz, arg_min({RED}>20, row(chunk,line,part,supp,price)) AS gum, min(row(chunk,line,part,supp,price)) AS id FROM obs WHERE {REAL} GROUP BY ALL),
sp AS (SELECT DISTINCT cx, cy, cz FROM obs WHERE NOT {REAL}),
d AS (SELECT sp.cx, sp.cy, sp.cz, kn.gum, kn.id, (sp.cx-kn.cx)*(sp.cx-kn.cx)+(sp.cy-kn.cy)*(sp.cy-kn.cy)+(sp.cz-kn.cz)*(sp.cz-kn.cz) AS d2 FROM sp, kn),
md AS (SELECT cx, cy, cz, min(d2) AS m FROM d GROUP BY ALL),
nn AS (SELECT d.cx, d.cy, d.cz, arg_min(d.gum, d.id) AS gum FROM d JOIN md USING (cx, cy, cz) WHERE d.d2=md.m GROUP BY ALL),
al AS (SELECT chunk, line, part, {RED}>20 AS is_gum FROM obs WHERE {REAL} UNION ALL SELECT chunk, line, part, nn.gum FROM obs JOIN nn USING (cx, cy, cz) WHERE NOT {REAL})
SELECT chunk, line, part, is_gum, CAST(CASE WHEN is_gum THEN 205 ELSE 230 END AS BIGINT) AS r, CAST(CASE WHEN is_gum THEN 125 ELSE 220 END AS BIGINT) AS g, CAST(CASE WHEN is_gum THEN 135 ELSE 200 END AS BIGINT) AS b FROM al""")
def flatten_colours(spark, sf):
    o = fixtures.observations(spark, sf).select(
        F.lit(0).alias("run_id"), F.struct("chunk", "line", "part", "supp", "price").alias("fid"),
        F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), "r", "g", "b")
    d = augment.flatten_colours(o, (230, 220, 200), (205, 125, 135), 1.0)
    return d.select("fid.chunk", "fid.line", "fid.part", "is_gum", "r", "g", "b")


@query("temporal_gum_ema", f"""WITH RECURSIVE {OBS}, s AS MATERIALIZED (SELECT CAST(floor(cx) AS BIGINT) AS vx, CAST(floor(cy+0.5) AS BIGINT) AS vy, line AS cycle, avg(least(1.0,greatest(0.0,0.5+({RED}-20.0)/40.0))) AS raw FROM obs WHERE {REAL} GROUP BY ALL),
e AS (SELECT vx, vy, cycle, CAST(raw AS DOUBLE) AS blended FROM s WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.vx=s.vx AND p.vy=s.vy AND p.cycle=s.cycle-1)
  UNION ALL SELECT s.vx, s.vy, s.cycle, CAST(0.3 AS DOUBLE)*s.raw+CAST(0.7 AS DOUBLE)*e.blended FROM e JOIN s ON s.vx=e.vx AND s.vy=e.vy AND s.cycle=e.cycle+1)
SELECT vx, vy, cycle, {r6('blended+CAST(1e-9 AS DOUBLE)')} AS blended, round(blended+CAST(1e-9 AS DOUBLE),6)>0.5 AS is_gum FROM e""")
def temporal_gum_ema(spark, sf):
    o = fixtures.observations(spark, sf).filter(~col.is_sentinel(F.col("r"), F.col("g"), F.col("b")))
    s = o.groupBy(F.floor("cx").alias("vx"), F.floor(F.col("cy") + 0.5).alias("vy"), F.col("line").alias("cycle")) \
        .agg(F.avg(col.gum_score(col.redness(F.col("r"), F.col("g"), F.col("b")))).alias("raw"))
    # the tiny offset keeps exact ties of the rounding out of the comparison
    d = tp.ema_by_key(s, ["vx", "vy"], "cycle", "raw", 0.3).withColumn("blended", F.col("blended") + 1e-9)
    d = out(d, ["vx", "vy", "cycle"], ["blended"])
    return d.withColumn("is_gum", F.col("blended") > 0.5)


def _faces(spark, sf):
    return fixtures.lattice_faces(spark, sf).select(F.col("arch_id").alias("patch_id"), "fid", "label")


def _flat(ch, i):
    t, g = col.TOOTH_RGB_RANGE, col.GUM_RGB_RANGE
    cls = "CASE WHEN label=0 THEN 'gum' ELSE 'tooth' END"
    draw = u("paint", "arch_id", cls, f"'{ch}'")
    return (f"CAST(floor(CASE WHEN label=0 THEN {g[0][i]}.0 ELSE {t[0][i]}.0 END+(CASE WHEN label=0 THEN {g[1][i]}.0 ELSE {t[1][i]}.0 END"
            f"-CASE WHEN label=0 THEN {g[0][i]}.0 ELSE {t[0][i]}.0 END)*{draw}) AS BIGINT) AS {ch}")


@query("paint_flat", f"WITH {FACES} SELECT arch_id AS patch_id, fid, {', '.join(_flat(c, i) for i, c in enumerate('rgb'))} FROM faces")
def paint_flat(spark, sf):
    return augment.paint(_faces(spark, sf), "flat").select("patch_id", "fid", "r", "g", "b")


def _mosaic(ch, i):
    t, g = col.TOOTH_RGB_MEAN_STD, col.GUM_RGB_MEAN_STD
    pick = lambda p: f"CAST(CASE WHEN label=0 THEN {g[p][i]} ELSE {t[p][i]} END AS DOUBLE)"
    return f"CAST(floor(least(255.0,greatest(0.0,{pick(0)}+{pick(1)}*{gauss('paint/' + ch, 'arch_id', 'fid')}))) AS BIGINT) AS {ch}"


@query("paint_mosaic", f"WITH {FACES} SELECT arch_id AS patch_id, fid, {', '.join(_mosaic(c, i) for i, c in enumerate('rgb'))} FROM faces")
def paint_mosaic(spark, sf):
    return augment.paint(_faces(spark, sf), "mosaic").select("patch_id", "fid", "r", "g", "b")


def _hsv(ch, i):
    pick = lambda p: f"CAST(CASE WHEN label=0 THEN {col.GUM_HSV[i][p]} ELSE {col.TOOTH_HSV[i][p]} END AS DOUBLE)"
    return f"least(greatest({pick(0)}+{pick(1)}*{gauss('paint/' + ch, 'arch_id', 'fid')},{pick(2)}),{pick(3)}) AS {ch}"


def _rgb(n, ch):
    k = f"(({n}.0+hue/60.0)-6.0*floor(({n}.0+hue/60.0)/6.0))"
    return f"CAST(floor(least(255.0,greatest(0.0,(v-v*s*greatest(least({k},4.0-{k},1.0),0.0))*255.0))) AS BIGINT) AS {ch}"


@query("paint_hsv", f"""WITH {FACES}, d AS (SELECT arch_id, fid, {', '.join(_hsv(c, i) for i, c in enumerate('hsv'))} FROM faces), w AS (SELECT *, h-360.0*floor(h/360.0) AS hue FROM d)
SELECT arch_id AS patch_id, fid, {_rgb(5, 'r')}, {_rgb(3, 'g')}, {_rgb(1, 'b')} FROM w""")
def paint_hsv(spark, sf):
    return augment.paint(_faces(spark, sf), "hsv").select("patch_id", "fid", "r", "g", "b")


@query("colour_dropout", f"""WITH {FACES}, p AS (SELECT arch_id, fid, {', '.join(_flat(c, i) for i, c in enumerate('rgb'))} FROM faces), h AS (SELECT *, {u('colour_dropout', 'arch_id', 'fid')}<0.6 AS hit FROM p)
SELECT arch_id AS patch_id, fid, CASE WHEN hit THEN 102 ELSE r END AS r, CASE WHEN hit THEN 102 ELSE g END AS g, CASE WHEN hit THEN 102 ELSE b END AS b, round(CASE WHEN hit THEN 102 ELSE r END/127.5-1.0,6)+0.0 AS unit_r FROM h""")
def colour_dropout(spark, sf):
    d = augment.drop_colour(augment.paint(_faces(spark, sf), "flat"))
    return d.select("patch_id", "fid", "r", "g", "b", rounded(col.to_unit(F.col("r"))).alias("unit_r"))


@query("face_colour", f"""WITH {FACES}, vc AS (SELECT vid, vid*7%256 AS r, vid*11%256 AS g, vid*13%256 AS b FROM grid)
SELECT f.arch_id, f.fid, (a.r+b.r+c.r)//3 AS r, (a.g+b.g+c.g)//3 AS g, (a.b+b.b+c.b)//3 AS b FROM faces f JOIN vc a ON a.vid=f.v0 JOIN vc b ON b.vid=f.v1 JOIN vc c ON c.vid=f.v2""")
def face_colour(spark, sf):
    from meshspark.operators.mesh import face_colours
    v = fixtures.lattice_vertices(spark, sf).select("arch_id", "vid", (F.col("vid") * 7 % 256).alias("r"), (F.col("vid") * 11 % 256).alias("g"), (F.col("vid") * 13 % 256).alias("b"))
    return face_colours(fixtures.lattice_faces(spark, sf), v).select("arch_id", "fid", "r", "g", "b")
