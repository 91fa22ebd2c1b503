"""Dilated neighbourhoods, exact caps, thinning and spatial splits."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from meshspark.functions.hashing import uniform
from meshspark.operators.ordinals import attach, row_ordinal, take_smallest


def cap_faces(faces: DataFrame, max_faces: int, key: str = "patch_id", seed: str = "cap") -> DataFrame:
    """Exactly ``max_faces`` faces of a larger patch, uniform without replacement; smaller patches unchanged."""
    return take_smallest(faces, [key], uniform(seed, key, "fid"), ["fid"], max_faces)


def trim_to_target(faces: DataFrame, target: str = "target", key: str = "arch_id", seed: str = "trim") -> DataFrame:
    """Random exact subset down to a per-mesh target column."""
    return take_smallest(faces, [key], uniform(seed, key, "fid"), ["fid"], F.col(target))


def thin_faces(faces: DataFrame, low: float = 0.7, high: float = 1.0, min_faces: int = 20, key: str = "patch_id",
               seed: str = "thin") -> DataFrame:
    """Bernoulli thinning with one rate per patch; small patches and rates >= 0.999 stay whole."""
    n = faces.groupBy(key).agg(F.count("*").alias("_n"))
    rate = F.lit(low) + F.lit(high - low) * uniform(f"{seed}/rate", key)
    keep = (F.col("_n") < min_faces) | (rate >= 0.999) | (uniform(seed, key, "fid") < rate)
    return attach(faces, n, [key], ["fid"]).filter(keep).select(*faces.columns)


def spatial_split(faces: DataFrame, position: Column, n_splits: int, key: str = "mesh_id", ident: str = "fid",
                  bucket_width: float = 1.0, tie_bucket: Column | None = None) -> DataFrame:
    """Adds ``piece`` 0..n-1: near-equal runs along ``position`` (the first runs take the remainder).

    Ranks come from per-bucket counts, so a huge chunk is never sorted as one group. Where many faces share a position,
    ``tie_bucket`` (monotone in ``ident``) splits them further.
    """
    d = faces.withColumn("_pos", position)
    run = F.col("_pos") if tie_bucket is not None else F.floor(F.col("_pos") / F.lit(float(bucket_width)))
    bucket = F.struct(run.alias("p"), tie_bucket.alias("t")) if tie_bucket is not None else run
    ranked = row_ordinal(d, [key], bucket, ["_pos", ident], "_rk")
    sized = attach(ranked, d.groupBy(key).agg(F.count("*").alias("_n")), [key], ["_rk"])
    q, r, i = F.floor(F.col("_n") / n_splits), F.col("_n") % n_splits, F.col("_rk") - 1
    long_part = r * (q + 1)
    piece = F.when(i < long_part, F.floor(i / (q + 1))).otherwise(r + F.floor((i - long_part) / F.greatest(q, F.lit(1))))
    return sized.withColumn("piece", piece.cast("bigint")).select(*faces.columns, "piece")


def local_vertex_ids(piece_faces: DataFrame, keys: list[str]) -> DataFrame:
    """Dense vertex numbers inside each piece: (keys..., vid, local)."""
    used = piece_faces.select(*keys, F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return row_ordinal(used, keys, F.floor(F.col("vid") / 65536), ["vid"], "local") \
        .withColumn("local", F.col("local") - 1)


def even_sample(df: DataFrame, key: str, index: str, n: str, k: int) -> DataFrame:
    """Rows whose index is among k evenly spaced ones of 0..n-1, both ends included."""
    if k < 2:
        raise ValueError("k must be at least 2")
    step = (F.col(n) - 1) / F.lit(float(k - 1))
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * step).cast("bigint"))
    return df.filter((F.col(n) <= k) | F.array_contains(picks, F.col(index)))


POOLS_AT_ONCE = 256  # only sets how much one numpy step holds


def _fps_picks(pools: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Farthest-point picks (B, k) of B candidate pools (B, M, 3) at once, each from its first row; a pool of at most k
    rows gives them in order, then -1."""
    n, m, _ = pools.shape
    own, place = np.arange(n), np.arange(m)
    gap = np.where(place[None, :] < sizes[:, None], np.inf, -1.0)
    picked = np.zeros((n, k), np.int64)
    for s in range(1, k):
        diff = pools - pools[own, picked[:, s - 1]][:, None, :]
        np.minimum(gap, (diff * diff).sum(axis=2), out=gap)
        gap[own, picked[:, s - 1]] = -1.0
        picked[:, s] = gap.argmax(axis=1)
    small = sizes <= k
    picked[small] = np.where(np.arange(k)[None, :] < sizes[small][:, None], np.arange(k)[None, :], -1)
    return picked


def dilated_neighbours(ranked: DataFrame, points: DataFrame, k: int, dilations: list[int], group: str = "cloud",
                       qid: str = "qid", pid: str = "pid") -> DataFrame:
    """k farthest-point representatives of the nearest ``d`` candidates of each query, per dilation level.

    ranked: one shared ranking (group, qid, rank, pid) that includes the query itself, up to max(dilations); every
    smaller level is a prefix of it. A pool never exceeds max(dilations) points. Returns (group, level, qid, rank,
    pid).
    """
    widest = max(dilations)
    pos = points.select(group, pid, *[F.col(a).cast("double").alias(a) for a in "xyz"])
    pools = ranked.filter(F.col("rank") <= widest).join(pos, [group, pid]).groupBy(group, qid) \
        .agg(F.array_sort(F.collect_list(F.struct("rank", pid, "x", "y", "z"))).alias("pool"))
    pools = pools.select(group, qid, F.col(f"pool.{pid}").alias("ids"), *[F.col(f"pool.{a}").alias(a) for a in "xyz"])
    kinds = {c: points.schema[c].dataType.simpleString() for c in (group, pid)}
    qkind = ranked.schema[qid].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), POOLS_AT_ONCE):
                b = whole.iloc[at:at + POOLS_AT_ONCE]
                sizes = b["ids"].map(len).to_numpy()
                inside = np.arange(sizes.max())[None, :] < sizes[:, None]
                xyz, ids = np.zeros((*inside.shape, 3)), np.zeros(inside.shape, b["ids"].iloc[0].dtype)
                for i, a in enumerate("xyz"):
                    xyz[..., i][inside] = np.concatenate(b[a].to_list())
                ids[inside] = np.concatenate(b["ids"].to_list())
                for level, d in enumerate(dilations):
                    picked = _fps_picks(xyz[:, :d], np.minimum(sizes, d), k)
                    row, rank = np.nonzero(picked >= 0)
                    yield pd.DataFrame({group: b[group].to_numpy()[row], "level": level, qid: b[qid].to_numpy()[row],
                                        "rank": rank + 1, pid: ids[row, picked[row, rank]]})

    return pools.mapInPandas(run, f"{group} {kinds[group]}, level bigint, {qid} {qkind}, rank bigint, {pid} {kinds[pid]}")
