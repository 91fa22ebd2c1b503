"""Meshes cut into near-equal pieces along their main axis, by exact ranks from a histogram tree.

All n - 1 cuts of all meshes are found together. A round counts the faces of every open interval in bins and goes on with the bin
that holds the wanted rank, until few faces are left, which are sorted. Where many faces share one position, the tree
goes on over their ids. No window and no sort ever holds a mesh.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshspark.functions.vectors import Vec, rounded
from meshspark.operators.mesh import remap_corners
from meshspark.operators.normalise import covariance, principal_axes
from meshspark.operators.ordinals import attach
from meshspark.operators.sampling import local_vertex_ids
from meshspark.session import cut_lineage

BINS, LEAF = 1024, 4096


def cut_points(values: DataFrame, n: int, key: str) -> DataFrame:
    """(key, cuts array<struct<k, pos, id>>): the first face of each piece but the first one, by (pos, id).

    values: (key, pos double, id bigint below 2**53, distinct in a key). The first pieces take the remainder.
    """
    whole = values.groupBy(key).agg(F.count("*").alias("_n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    start = F.col("k") * F.floor(F.col("_n") / n) + F.least(F.col("k"), F.col("_n") % n)
    nodes = cut_lineage(whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n - 1))))
                        .select(key, "k", start.alias("want"), "lo", "hi", F.lit(None).cast("double").alias("tie"), F.col("_n").alias("held"))
                        .filter(F.col("want") < F.col("held")))
    done = []
    while True:
        v = F.when(F.col("tie").isNull(), F.col("pos")).otherwise(F.col("id").cast("double"))
        inside = (F.col("tie").isNull() | (F.col("pos") == F.col("tie"))) & (v >= F.col("lo")) & (v <= F.col("hi"))
        small = nodes.filter(F.col("held") <= LEAF)
        rank = F.row_number().over(Window.partitionBy(key, "k").orderBy("pos", "id")) - 1
        done.append(attach(values, small, [key], ["id"]).filter(inside).withColumn("_r", rank)
                    .filter(F.col("_r") == F.col("want")).select(key, "k", "pos", "id"))
        nodes = nodes.filter(F.col("held") > LEAF)
        if nodes.isEmpty():
            break
        wide = F.col("hi") - F.col("lo")
        bin_ = F.least(F.floor((v - F.col("lo")) / wide * BINS), F.lit(BINS - 1))
        counts = attach(values, nodes, [key], ["id"]).filter(inside) \
            .groupBy(key, "k", "want", "tie", bin_.alias("bin")).agg(F.count("*").alias("held"), F.min(v).alias("lo"), F.max(v).alias("hi"),
                                                                     F.min("id").alias("_first"), F.max("id").alias("_last"))
        before = F.coalesce(F.sum("held").over(Window.partitionBy(key, "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("_before", before).filter((F.col("_before") <= F.col("want")) & (F.col("want") < F.col("_before") + F.col("held")))
        tied = F.col("tie").isNull() & (F.col("lo") == F.col("hi"))
        nodes = cut_lineage(found.select(
            key, "k", (F.col("want") - F.col("_before")).alias("want"), F.when(tied, F.col("_first").cast("double")).otherwise(F.col("lo")).alias("lo"),
            F.when(tied, F.col("_last").cast("double")).otherwise(F.col("hi")).alias("hi"),
            F.when(tied, F.col("lo")).otherwise(F.col("tie")).alias("tie"), "held"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "pos", "id"))).alias("cuts"))


def split_along(faces: DataFrame, position: Column, n: int, key: str = "arch_id", ident: str = "fid") -> DataFrame:
    """Adds ``piece`` 0..n-1 along ``position``, ties by ``ident``: sizes differ by one at most. Meshes with fewer than n faces leave
    the last pieces empty; an empty table gives an empty one."""
    d = faces.withColumn("_pos", position.cast("double"))
    values = cut_lineage(d.select(key, F.col("_pos").alias("pos"), F.col(ident).cast("bigint").alias("id")))
    if n < 2:
        return faces.withColumn("piece", F.lit(0).cast("bigint"))
    cuts = cut_lineage(values.select(key).distinct().join(cut_points(values, n, key), key, "left"))
    behind = F.filter("cuts", lambda c: (c["pos"] < F.col("_pos")) | ((c["pos"] == F.col("_pos")) & (c["id"] <= F.col(ident))))
    return attach(d, cuts, [key], [ident]).withColumn("piece", F.coalesce(F.size(behind), F.lit(0)).cast("bigint")).select(*faces.columns, "piece")


def split_main_axis(geom: DataFrame, n: int, key: str = "arch_id", ident: str = "fid", digits: int | None = None) -> DataFrame:
    """geom (key, ident, mx, my, mz, ...) with ``piece`` along the axis of largest variance of the centroids; ``digits`` rounds the
    positions along it first."""
    axes = principal_axes(covariance(geom, [key], "m"), [key]).select(key, *[F.col(f"e1{a}").alias(f"_a{a}") for a in "xyz"])
    d = attach(geom, axes, [key], [ident]).withColumn("_along", Vec.cols("m").dot(Vec.cols("_a")))
    along = F.col("_along") if digits is None else rounded(F.col("_along"), digits)
    return split_along(d, along, n, key, ident).select(*geom.columns, "piece")


def reindexed(piece_faces: DataFrame, vertices: DataFrame, key: str = "arch_id") -> tuple[DataFrame, DataFrame]:
    """Each piece as a mesh of its own: (vertices(key, piece, vid, ...), faces(key, piece, fid, v0, v1, v2, ...)) with dense vertex
    numbers in the old order; all other columns, colours among them, stay."""
    local = cut_lineage(local_vertex_ids(piece_faces, [key, "piece"]))
    rest = [c for c in vertices.columns if c not in (key, "vid")]
    v = local.join(vertices, [key, "vid"]).select(key, "piece", F.col("local").alias("vid"), *rest)
    f = remap_corners(piece_faces, local.withColumnRenamed("local", "_to"), [key, "piece"])
    return v, f.select(*piece_faces.columns)
