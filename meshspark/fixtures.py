"""Views that derive meshes, points, frames, colours and runs from the given tables.

Each view exists twice: as a DataFrame here and as SQL text in ``catalog/sqlviews.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from meshspark.functions.hashing import uniform
from meshspark.operators.ordinals import row_ordinal


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lattice_grid(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("vid"), (k % 50).alias("i"), F.expr("p_partkey div 50").alias("j"),
        (k % 50).cast("double").alias("x"), F.expr("p_partkey div 50").cast("double").alias("y"),
        (F.col("p_size") * F.lit(0.05)).alias("z"))


def lattice_faces(spark: SparkSession, sf: str) -> DataFrame:
    """faces(arch_id, fid, v0, v1, v2, label): two triangles per cell of a 50-wide lattice."""
    g = lattice_grid(spark, sf).select("vid", "i", "j")
    opposite = g.select((F.col("vid") - 51).alias("vid"))
    cells = g.filter("i < 49").join(opposite.hint("merge"), "vid", "left_semi")
    v = F.col("vid")
    tri = F.array(
        F.struct((v * 2).alias("fid"), v.alias("v0"), (v + 1).alias("v1"), (v + 50).alias("v2")),
        F.struct((v * 2 + 1).alias("fid"), (v + 1).alias("v0"), (v + 51).alias("v1"), (v + 50).alias("v2")))
    return cells.select(F.expr("j div 10").alias("arch_id"),
                        F.expr("(i div 3) % 17").alias("label"), F.explode(tri).alias("t")) \
        .select("arch_id", "t.*", "label")


def lattice_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """vertices(arch_id, vid, x, y, z): a lattice row on a border belongs to both arches."""
    g = lattice_grid(spark, sf)
    arches = F.when((F.col("j") % 10 == 0) & (F.col("j") > 0),
                    F.array(F.expr("j div 10"), F.expr("j div 10 - 1"))).otherwise(F.array(F.expr("j div 10")))
    spread = g.select(F.explode(arches).alias("arch_id"), "vid", "x", "y", "z")
    used = lattice_faces(spark, sf).select("arch_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    return spread.join(used.hint("merge"), ["arch_id", "vid"], "left_semi")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """points(cloud, pid, x, y, z, feat)."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("cloud"), F.col("vec_id").alias("pid"),
        *[(e[d].cast("double") * 20.0).alias(a) for d, a in enumerate("xyz")],
        e.alias("feat"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """One row per captured frame of a live run, with a chunk centroid."""
    u, v, e = F.col("user_id"), F.col("value"), F.col("event_id")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(1704067200)
    return table(spark, sf, "events").select(
        e.alias("mesh_id"), e.alias("seq"), F.expr("(user_id div 16) % 4").alias("run_id"),
        F.col("event_type").alias("frame_type"), "ts", u.alias("region"), v.alias("value"),
        (F.floor(v * 10) + 1).alias("face_count"), F.col("props").alias("header"),
        F.floor(seconds / 21600).alias("cycle"), (1 + u % 16).alias("label"),
        ((u % 16).cast("double") * 4.0 + v * 0.01).alias("cx"), (v * 0.05).alias("cy"),
        ((e % 7).cast("double") * 0.1).alias("cz"))


def cycle_counts(spark: SparkSession, sf: str) -> DataFrame:
    """(run_id, cycle, label) -> predicted faces and centroid; every label of every cycle present in the run."""
    return frames(spark, sf).groupBy("run_id", "cycle", "label").agg(
        F.count("*").alias("n"), F.avg("cx").alias("cx"), F.avg("cy").alias("cy"), F.avg("cz").alias("cz"))


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Re-observed face centroids with colours: (run_id, chunk, line, cx, cy, cz, r, g, b, is_gum_pred, ord...)."""
    li = table(spark, sf, "lineitem")
    missing = F.col("l_returnflag") == "N"
    ch = {
        "r": 120 + F.col("l_partkey") % 130,
        "g": 100 + F.col("l_suppkey") % 140,
        "b": 90 + (F.col("l_orderkey") * 7) % 150,
    }
    return li.select(
        F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").cast("bigint").alias("line"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").alias("cx"), (F.col("l_discount") * 100).alias("cy"), (F.col("l_tax") * 100).alias("cz"),
        *[F.when(missing, F.lit(102)).otherwise(c).cast("bigint").alias(k) for k, c in ch.items()],
        (F.col("l_linestatus") == "F").alias("is_gum_pred"), F.col("l_extendedprice").alias("price"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Experiment histories (run_id, epoch, metric)."""
    o = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 20).alias("run_id"), "o_orderkey", "o_orderdate",
        (F.col("o_totalprice") / F.lit(1e6)).alias("metric"))
    bucket = F.to_date("o_orderdate")
    ranked = row_ordinal(o, ["run_id"], bucket, ["o_orderdate", "o_orderkey"], "epoch")
    return ranked.select("run_id", (F.col("epoch") - 1).alias("epoch"), "metric")


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """Scored faces (fid, target, logits)."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("fid"), F.col("label").cast("bigint").alias("target"),
        F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double") * 8.0).alias("logits"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scored faces of patches (patch_id, area, gt, pred): the arg-max class against the target."""
    return logits(spark, sf).select(
        F.expr("fid div 20").alias("patch_id"), "fid",
        (F.expr("fid div 20") * 37 % 600).cast("double").alias("area_mm2"),
        F.col("target").alias("gt"),
        (F.array_position("logits", F.array_max("logits")) - 1).cast("bigint").alias("pred"))
