"""Connected components and region growing on face graphs, all groups in one job."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from meshspark.operators.ordinals import attach
from meshspark.session import cut_lineage

CHUNK_EDGES = 2_000_000


def _contract(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index per vertex: hooking plus pointer jumping on whole arrays."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        nxt = root.copy()
        np.minimum.at(nxt, root[a], low)
        np.minimum.at(nxt, root[b], low)
        while True:
            jumped = nxt[nxt]
            if np.array_equal(jumped, nxt):
                break
            nxt = jumped
        if np.array_equal(nxt, root):
            return root
        root = nxt


def _stars(frames: list[pd.DataFrame]) -> pd.DataFrame:
    edges = pd.concat(frames, ignore_index=True)
    ends = pd.concat([edges[["g", "a"]].set_axis(["g", "v"], axis=1), edges[["g", "b"]].set_axis(["g", "v"], axis=1)],
                     ignore_index=True)
    verts = ends.drop_duplicates().sort_values(["g", "v"], ignore_index=True)
    code = pd.MultiIndex.from_frame(verts).get_indexer(pd.MultiIndex.from_frame(ends))
    m = len(edges)
    root = _contract(code[:m], code[m:], len(verts))
    return pd.DataFrame({"g": verts["g"], "v": verts["v"], "r": verts["v"].to_numpy()[root]})


def _local_union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contract the edges of a partition, chunk by chunk, to one star per local component."""
    held, size = [], 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size >= CHUNK_EDGES:
            yield _stars(held)
            held, size = [], 0
    if size:
        yield _stars(held)


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Component label = smallest vertex id reachable inside a group: (g, v, comp).

    edges: (g, a, b); vertices: (g, v), isolated ones included. Each round contracts every partition's own
    edges (a map-side union), keeps for each vertex its smallest local root and goes on with the much smaller graph
    of roots that share a vertex. Partition counts follow the shrinking size; the maps are applied backwards.
    """
    maps = []
    current = edges.filter("a <> b")
    while True:
        ranged = current.repartitionByRange("g", "a", "b")
        stars = cut_lineage(ranged.mapInPandas(_local_union, f"g {_type(current, 'g')}, v bigint, r bigint"))
        low = stars.groupBy("g", "v").agg(F.min("r").alias("m"), F.max("r").alias("hi"))
        maps.append(low.select("g", "v", "m"))
        between = stars.join(low.filter("m <> hi").select("g", "v", "m").hint("merge"), ["g", "v"]).filter("r <> m") \
            .select("g", F.col("m").alias("a"), F.col("r").alias("b")).distinct()
        between = cut_lineage(between)
        if between.isEmpty():
            break
        current = between
    label = maps[-1].withColumnRenamed("m", "comp")
    for step in reversed(maps[:-1]):
        up = label.select("g", F.col("v").alias("m"), "comp")
        label = step.join(up.hint("merge"), ["g", "m"], "left").select("g", "v", F.coalesce("comp", "m").alias("comp"))
    return vertices.select("g", "v").join(label.hint("merge"), ["g", "v"], "left") \
        .select("g", "v", F.coalesce("comp", "v").alias("comp"))


def _type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def set_components(members: DataFrame, adjacency: DataFrame, group: str = "arch_id") -> DataFrame:
    """Components of adjacency restricted to member sets: members + ``comp``. members: (arch_id, [group], fid)."""
    from meshspark.operators.mesh import restrict_adjacency
    keys = list(dict.fromkeys(["arch_id", group]))
    inside = restrict_adjacency(adjacency, members, [group])
    comp = components(inside.select(F.col(group).alias("g"), "a", "b"),
                      members.select(F.col(group).alias("g"), F.col("fid").alias("v")))
    return members.join(comp.select(F.col("g").alias(group), F.col("v").alias("fid"), "comp").hint("merge"), [group, "fid"]) \
        .select(*members.columns, "comp")


def choose_component(eligible: DataFrame, min_faces: int = 5, group: str = "fp", digits: int | None = None) -> DataFrame:
    """The component holding the face nearest to the origin, small components ignored unless all are small.

    eligible: (group, fid, comp, d2). Only aggregates per component leave the big table. With ``digits`` distances are compared rounded, so
    that faces at one distance are a tie (smaller id first) in whatever order the origin was added up.
    """
    near = F.col("d2") if digits is None else F.round("d2", digits)
    comps = eligible.groupBy(group, "comp").agg(F.count("*").alias("size"), F.min(F.struct(near.alias("d2"), "fid")).alias("near"))
    big = F.col("size") >= min_faces
    pick = comps.groupBy(group).agg(
        F.min(F.when(big, F.struct("near", "comp"))).alias("a"), F.min(F.struct("near", "comp")).alias("b")) \
        .select(group, F.coalesce(F.col("a.comp"), F.col("b.comp")).alias("comp"))
    return attach(eligible, pick, [group, "comp"], ["fid"])


def grow_coverage(extent: DataFrame, adjacency: DataFrame, group: str = "arch_id") -> DataFrame:
    """Faces a best-first fill reaches from the best tooth face while occlusality stays >= threshold.

    extent: (arch_id, [group], fid, label, occ, threshold). The fill equals the component of the seed among faces at
    or above the threshold; a group whose seed is below it is empty.
    """
    rank = F.struct("occ", (-F.col("fid")).alias("neg"))
    seeds = extent.groupBy(group).agg(
        F.max(F.when(F.col("label") != 0, rank)).alias("tooth"), F.max(rank).alias("any"),
        F.max("threshold").alias("t")) \
        .withColumn("best", F.coalesce("tooth", "any")) \
        .filter(F.col("best.occ") >= F.col("t")).select(group, (-F.col("best.neg")).alias("fid"))
    open_faces = attach(extent.filter(F.col("occ") >= F.col("threshold")), seeds.select(group), [group], ["fid"])
    comp = set_components(open_faces, adjacency, group)
    comp = cut_lineage(comp)
    chosen = comp.join(seeds, [group, "fid"], "left_semi").select(group, "comp")
    return attach(comp, chosen, [group, "comp"], ["fid"])


def face_neighbours(adjacency: DataFrame, members: DataFrame, group: str = "patch_id") -> DataFrame:
    """(arch_id, group, fid, nbs array): the neighbours of each member inside its set, at most one per edge of the face."""
    from meshspark.operators.mesh import restrict_adjacency
    keys = list(dict.fromkeys(["arch_id", group]))
    ends = F.explode(F.array(F.struct(F.col("a").alias("fid"), F.col("b").alias("nb")), F.struct(F.col("b").alias("fid"), F.col("a").alias("nb"))))
    return restrict_adjacency(adjacency, members, [group]).select(*keys, ends.alias("e")) \
        .groupBy(*keys, F.col("e.fid").alias("fid")).agg(F.collect_list("e.nb").alias("nbs"))


def grow_blobs(seeds: DataFrame, adjacency: DataFrame, members: DataFrame, group: str = "patch_id",
               neighbours: DataFrame | None = None) -> DataFrame:
    """Connected blobs grown from seed faces, breadth first in hash order, until ``size`` faces are collected or none is left.

    seeds: (arch_id, group, hole, fid, size); members: (arch_id, group, fid). A blob never exceeds its size, so the
    frontier stays tiny next to the mesh. ``neighbours``, as written by a caller who grows several times, saves finding them again.
    Returns (arch_id, group, hole, fid).
    """
    from meshspark.functions.hashing import uniform
    keys = list(dict.fromkeys(["arch_id", group]))
    if neighbours is None:
        neighbours = cut_lineage(face_neighbours(adjacency, members, group))
    blob = cut_lineage(seeds.filter("size >= 1").select(*keys, "hole", "fid", "size"))
    ring = blob
    while True:
        have = blob.groupBy(*keys, "hole").agg(F.count("*").alias("have"))
        nxt = ring.join(neighbours.hint("merge"), [*keys, "fid"]).select(*keys, "hole", F.explode("nbs").alias("fid"), "size").distinct() \
            .join(blob.select(*keys, "hole", "fid"), [*keys, "hole", "fid"], "left_anti") \
            .join(have, [*keys, "hole"]).filter("have < size")
        w = Window.partitionBy(*keys, "hole").orderBy(uniform("blob", group, "hole", "fid"), "fid")
        ring = nxt.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= F.col("size") - F.col("have")) \
            .select(*keys, "hole", "fid", "size")
        ring = cut_lineage(ring)
        if ring.isEmpty():
            break
        blob = cut_lineage(blob.unionByName(ring))
    return blob.select(*keys, "hole", "fid")
