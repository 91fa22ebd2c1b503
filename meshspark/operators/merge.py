"""Merging chunk meshes into one: vertex offsets, colour sentinel, welding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from meshspark.functions.colour import NO_COLOUR
from meshspark.operators.mesh import remap_corners, weld
from meshspark.session import cut_lineage


def chunk_offsets(vertices: DataFrame, bucket_size: int = 100_000) -> DataFrame:
    """Running vertex count before each chunk in mesh_id order: (run_id, mesh_id, n, offset).

    Two-level prefix sum over mesh_id ranges, so a run with very many chunks is not sorted in one task.
    """
    n = vertices.groupBy("run_id", "mesh_id").agg(F.count("*").alias("n")) \
        .withColumn("_bk", F.floor(F.col("mesh_id") / bucket_size))
    upto = Window.unboundedPreceding, -1
    tot = n.groupBy("run_id", "_bk").agg(F.sum("n").alias("_t"))
    base = tot.select("run_id", "_bk", F.coalesce(
        F.sum("_t").over(Window.partitionBy("run_id").orderBy("_bk").rowsBetween(*upto)), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum("n").over(
        Window.partitionBy("run_id", "_bk").orderBy("mesh_id").rowsBetween(*upto)), F.lit(0))
    return n.withColumn("_in", inner).join(base, ["run_id", "_bk"]) \
        .select("run_id", "mesh_id", "n", (F.col("_base") + F.col("_in")).alias("offset"))


def merge_meshes(vertices: DataFrame, faces: DataFrame, digits: int = 8) -> tuple[DataFrame, DataFrame]:
    """One mesh per run: chunk vertices re-numbered, equal positions welded, collapsed faces dropped.

    vertices: (run_id, mesh_id, vid, x, y, z, [r, g, b]) with local ids of any numbering; faces: (run_id, mesh_id,
    fid, v0, v1, v2). Chunks without vertices or faces vanish; missing colour becomes the sentinel.
    """
    alive = faces.select("run_id", "mesh_id").distinct()
    v = vertices.join(alive.hint("merge"), ["run_id", "mesh_id"], "left_semi")
    off = chunk_offsets(v).select("run_id", "mesh_id", "offset")
    rank = F.row_number().over(Window.partitionBy("run_id", "mesh_id").orderBy("vid")) - 1
    v = v.withColumn("_local", rank).join(off.hint("merge"), ["run_id", "mesh_id"]) \
        .withColumn("gid", F.col("offset") + F.col("_local"))
    if "r" in vertices.columns:
        v = v.withColumns({c: F.coalesce(F.col(c), F.lit(s)) for c, s in zip("rgb", NO_COLOUR)})
    v = cut_lineage(v)
    ids = v.select("run_id", "mesh_id", "vid", F.col("gid").alias("_to"))
    f = remap_corners(faces, ids, ["run_id", "mesh_id"])
    colours = [c for c in ("r", "g", "b") if c in vertices.columns]
    return weld(v.select("run_id", "gid", "x", "y", "z", *colours),
                f.select("run_id", "mesh_id", "fid", "v0", "v1", "v2"), digits, "run_id", "gid")


def newest_per_region(frames: DataFrame, region: list[str], order: str = "seq") -> DataFrame:
    """Newest frame per region (model set, catalogue entry, ...); a keyed aggregate."""
    rest = [c for c in frames.columns if c not in region]
    return frames.groupBy(*region).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_m")).select(*region, "_m.*")
