"""Point-set operators: ball query, gather, edge pooling, set abstraction, interpolation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meshspark.operators.ordinals import blocks, row_ordinal
from meshspark.operators.spatial import nearest
from meshspark.session import cut_lineage


CENTRES, POINTS = 512, 4096  # rows of a block
_AT = ["_g", "_cx", "_cy", "_cz"]


def _first_hits(radius: float, n: int, g_type, q_type, p_type):
    """Of each centre of a block the ``n`` smallest ids among the points of the other block that are closer than the radius."""
    def numbers(rows, names):
        return [rows.field(c).to_numpy(zero_copy_only=False) for c in names]

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                centres, points = b.column("centres").slice(at, 1).flatten(), b.column("points").slice(at, 1).flatten()
                order = pa.compute.sort_indices(points.field("i"))
                ids = points.field("i").take(order)
                q, p = numbers(centres, "xyz"), [c[order.to_numpy()] for c in numbers(points, "xyz")]
                d2 = 0.0
                for c, d in zip(q, p):
                    gap = c[:, None] - d[None, :]
                    d2 = d2 + gap * gap
                hit = d2 < radius * radius
                row, col = np.nonzero(hit)
                start = np.searchsorted(row, np.arange(len(hit) + 1))
                early = np.arange(len(row)) - start[row] < n
                found = np.flatnonzero(np.diff(start))
                ends = np.concatenate([[0], np.cumsum(np.minimum(np.diff(start), n)[found])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("_g")[at].as_py()] * len(found), g_type), centres.field("i").take(pa.array(found)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(col[early])))], names=["_g", "_q", "ids"])
    return run


def ball_query(centers: DataFrame, points: DataFrame, radius: float, n_sample: int, group: str = "cloud",
               qid: str = "qid", pid: str = "pid") -> DataFrame:
    """First ``n_sample`` points (by id) closer than ``radius``; short lists repeat the first hit.

    Returns (group, qid, slot, pid) with slots 0..n_sample-1; a centre without any hit gives id 0. Ids are integers, (group, qid) tells
    centres apart. Blocks of centres meet blocks of points of the 27 cells around them, and of each meeting a centre keeps at most ``n_sample``
    ids: no list of all points in a ball is made. A cell with many points is cut by id, and its later blocks are only
    searched for centres that have not yet found enough smaller ids.
    """
    g, q, p = points.schema[group].dataType, centers.schema[qid].dataType, points.schema[pid].dataType
    cell = [F.floor(F.col(a) / F.lit(float(radius))).alias(f"_c{a}") for a in "xyz"]
    at = lambda d, ident: d.select(F.col(group).alias("_g"), F.col(ident).alias("i"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
    c, d = at(centers, qid).select("*", *cell), at(points, pid).select("*", *cell)
    d = row_ordinal(d, _AT, F.floor(F.col("i") / 65536), ["i"], "_n").withColumn("_part", F.floor((F.col("_n") - 1) / POINTS))
    held = cut_lineage(d.groupBy(*_AT, "_part").agg(F.collect_list(F.struct("i", "x", "y", "z")).alias("points"), F.min("i").alias("_least")))

    def search(wanted: DataFrame, blocks_: DataFrame) -> DataFrame:
        """wanted: centres with their cells and ``_most``, the id below which further hits matter."""
        b = blocks(wanted, _AT, "i", CENTRES, ["i", "x", "y", "z", "_most"], "centres").withColumn("_most", F.array_max("centres._most"))
        for a in "xyz":
            b = b.withColumn(f"_c{a}", F.explode(F.sequence(F.col(f"_c{a}") - 1, F.col(f"_c{a}") + 1)))
        met = b.join(blocks_, _AT).filter(F.col("_least") < F.col("_most"))
        return met.select("_g", "centres", "points").mapInArrow(
            _first_hits(float(radius), n_sample, to_arrow_type(g), to_arrow_type(q), to_arrow_type(p)),
            f"_g {g.simpleString()}, _q {q.simpleString()}, ids array<{p.simpleString()}>")

    def merged(found: DataFrame) -> DataFrame:
        ids = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, n_sample)
        return found.groupBy("_g", "_q").agg(ids.alias("ids"))

    last = (1 << 63) - 1
    lists = merged(search(c.withColumn("_most", F.lit(last)), held.filter("_part = 0")))
    later = held.filter("_part > 0")
    if not later.isEmpty():
        lists = cut_lineage(lists)
        enough = lists.filter(F.size("ids") == n_sample).select("_g", F.col("_q").alias("i"), F.element_at("ids", -1).cast("bigint").alias("_most"))
        rest = c.join(enough, ["_g", "i"], "left").withColumn("_most", F.coalesce("_most", F.lit(last)))
        lists = merged(lists.unionByName(search(rest, later)))
    full = centers.select(F.col(group), F.col(qid)).join(lists.select(F.col("_g").alias(group), F.col("_q").alias(qid), "ids"), [group, qid], "left")
    slots = F.transform(F.sequence(F.lit(0), F.lit(n_sample - 1)), lambda i: F.when(
        F.col("ids").isNull(), F.lit(0).cast("bigint")).otherwise(
        F.coalesce(F.get("ids", i), F.get("ids", F.lit(0)))))
    return full.select(group, qid, F.posexplode(slots).alias("slot", pid)) \
        .withColumn("slot", F.col("slot").cast("bigint"))


def gather(edges: DataFrame, points: DataFrame, value: str, group: str = "cloud", pid: str = "pid",
           out: str | None = None) -> DataFrame:
    """Attach a point attribute to index rows."""
    return edges.join(points.select(group, pid, F.col(value).alias(out or value)), [group, pid])


def _max_dims(column: Column, dim: int) -> list[Column]:
    return [F.max(column[d]).alias(f"_m{d}") for d in range(dim)]


def _packed(dim: int, name: str) -> Column:
    return F.array(*[F.col(f"_m{d}") for d in range(dim)]).alias(name)


def edge_features(edges: DataFrame, points: DataFrame, mode: str = "global", feature: str = "feat",
                  group: str = "cloud", qid: str = "qid", pid: str = "pid") -> DataFrame:
    """Per edge: the neighbour's feature (global), neighbour minus own (local), or both concatenated."""
    if mode not in ("global", "local", "local_global"):
        raise ValueError(f"unknown edge feature {mode!r}")
    e = gather(edges, points, feature, group, pid, "_n")
    if mode == "global":
        return e.withColumnRenamed("_n", "edge")
    own = points.select(group, F.col(pid).alias(qid), F.col(feature).alias("_o"))
    diff = F.zip_with("_n", "_o", lambda a, b: a - b)
    return e.join(own, [group, qid]).withColumn("edge", diff if mode == "local" else F.concat(diff, F.col("_o"))) \
        .drop("_n", "_o")


def edge_pool(edges: DataFrame, points: DataFrame, dim: int, mode: str = "global", feature: str = "feat",
              group: str = "cloud", qid: str = "qid", pid: str = "pid") -> DataFrame:
    """Maximum over the neighbours per dimension: (group, qid, pooled). Partial maxima before the shuffle."""
    width = 2 * dim if mode == "local_global" else dim
    e = edge_features(edges, points, mode, feature, group, qid, pid)
    return e.groupBy(group, qid).agg(*_max_dims(F.col("edge"), width)).select(group, qid, _packed(width, "pooled"))


def set_abstraction(centers: DataFrame, points: DataFrame, scales: list[tuple[float, int]], dim: int,
                    feature: str = "feat", group: str = "cloud", qid: str = "qid", pid: str = "pid") -> DataFrame:
    """Group around centres at several radii, take positions relative to the centre, pool the maximum, concatenate.

    Pooled vector per scale: 3 relative coordinates then the ``dim`` features.
    """
    out = centers.select(group, qid)
    at = points.select(group, pid, *[F.col(a).alias("p" + a) for a in "xyz"], F.col(feature).alias("_f"))
    for s, (radius, n_sample) in enumerate(scales):
        # padding repeats a hit and cannot change a maximum
        idx = ball_query(centers, points, radius, n_sample, group, qid, pid).select(group, qid, pid).distinct()
        rel = idx.join(at, [group, pid]).join(centers.select(group, qid, "x", "y", "z"), [group, qid])
        vec = F.concat(F.array(*[F.col("p" + a) - F.col(a) for a in "xyz"]), F.transform("_f", lambda v: v.cast("double")))
        pooled = rel.withColumn("_v", vec).groupBy(group, qid).agg(*_max_dims(F.col("_v"), dim + 3)) \
            .select(group, qid, _packed(dim + 3, f"_s{s}"))
        out = out.join(pooled, [group, qid])
    return out.select(group, qid, F.concat(*[F.col(f"_s{s}") for s in range(len(scales))]).alias("pooled"))


def group_all(points: DataFrame, dim: int, feature: str = "feat", group: str = "cloud") -> DataFrame:
    """One group per cloud: positions as they are, then features, pooled by maximum."""
    vec = F.concat(F.array("x", "y", "z"), F.transform(feature, lambda v: v.cast("double")))
    return points.withColumn("_v", vec).groupBy(group).agg(*_max_dims(F.col("_v"), dim + 3)) \
        .select(group, _packed(dim + 3, "pooled"))


def three_interpolate(unknown: DataFrame, known: DataFrame, dim: int, cell: float, feature: str = "feat",
                      group: str = "cloud", qid: str = "qid", pid: str = "pid") -> DataFrame:
    """Inverse-distance mean of the three nearest known features: (group, qid, feat)."""
    nn = nearest(unknown, known, 3, cell, group, qid, pid)
    w = nn.withColumn("_w", F.lit(1.0) / (F.col("dist") + 1e-8))
    e = gather(w, known, feature, group, pid, "_f")
    total = F.sum("_w")
    sums = [(F.sum(F.col("_w") * F.col("_f")[d].cast("double")) / total).alias(f"_m{d}") for d in range(dim)]
    return e.groupBy(group, qid).agg(*sums).select(group, qid, _packed(dim, "feat"))
