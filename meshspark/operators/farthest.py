"""Farthest-point samples of clouds of any size, several picks a round, in the exact order of one pick at a time.

A cloud is cut into cells, and every block of a cell keeps the gap of its points, the squared distance to the nearest pick. Once a
round a block folds the new picks into its gaps and reports its best candidates, its box and the largest gap it does not
report. Picks then go on among the candidates alone: no other point of a block can have a gap above what the block kept
back, nor above the distance from a new pick to the farthest corner of the box. The round ends where the best candidate no
longer beats all of these bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meshspark.operators.ordinals import attach, blocks
from meshspark.session import cut_lineage

WHOLE = 4096  # clouds up to this size report all their points: one round
DIVISIONS = 16  # cells along each axis of a larger cloud
REPORTED = 16
_POINT = "struct<i:bigint,x:double,y:double,z:double>"
_PICK = pa.list_(pa.struct([("i", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())]))


def _xyz(rows: pa.StructArray) -> np.ndarray:
    return np.stack([rows.field(a).to_numpy(zero_copy_only=False) for a in "xyz"], axis=1).reshape(-1, 3)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]


def _structs(ids: np.ndarray, xyz: np.ndarray, extra: dict | None = None) -> pa.StructArray:
    columns = {"i": pa.array(ids, pa.int64()), **{a: pa.array(xyz[:, j], pa.float64()) for j, a in enumerate("xyz")}, **(extra or {})}
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def _one(array: pa.Array) -> pa.Array:
    """A list column with the array as its only row."""
    return pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)


def _folded(skip_near_zero: bool, g_type):
    """Gaps of each block with the new picks, and what it reports."""
    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                row = {c: b.column(c).slice(at, 1) for c in b.schema.names}
                points, fresh = row["points"].flatten(), row["fresh"].flatten()
                ids, xyz = points.field("i").to_numpy(), _xyz(points)
                gap = row["gap"].flatten().to_numpy()
                if len(gap) == 0:
                    gap = np.full(len(ids), np.inf)
                    if skip_near_zero:
                        gap[_squared(xyz, np.zeros(3)) <= 1e-3] = -1.0
                else:
                    gap = gap.copy()
                low, high = xyz.min(axis=0), xyz.max(axis=0)
                for i, p in zip(fresh.field("i").to_numpy(), _xyz(fresh)):
                    near = np.maximum(np.maximum(low - p, p - high), 0.0)
                    if (near * near).sum() <= gap.max() * (1.0 + 1e-12):  # beyond that no gap of the block can shrink
                        np.minimum(gap, _squared(xyz, p), out=gap)
                    gap[ids == i] = -1.0
                order = np.lexsort((ids, -gap))
                n = row["report"][0].as_py()
                top = order[:n]
                rest = gap[order[n]] if len(order) > n else -1.0
                report = _structs(ids[top], xyz[top], {"gap": pa.array(gap[top])})
                box = pa.StructArray.from_arrays([pa.array([rest]), _one(report), _one(pa.array(low)), _one(pa.array(high))], names=["rest", "top", "low", "high"])
                yield pa.RecordBatch.from_arrays([row["_g"], row["_cell"], row["_b"], row["report"], row["points"], _one(pa.array(gap)), box],
                                                 names=["_g", "_cell", "_b", "report", "points", "gap", "seen"])
    return run


def _picked(n: int, g_type):
    """Picks of one round of each cloud from the reports of its blocks."""
    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                have = b.column("have")[at].as_py()
                seen = b.column("seen").slice(at, 1).flatten()
                tops = seen.field("top")
                size = np.diff(np.asarray(tops.offsets))
                top = tops.flatten()
                ids, xyz, gap = top.field("i").to_numpy(), _xyz(top), top.field("gap").to_numpy().copy()
                rest = seen.field("rest").to_numpy().copy()
                low, high = (seen.field(c).flatten().to_numpy().reshape(len(size), 3) for c in ("low", "high"))
                out = []
                while have + len(out) < n and len(gap):
                    best = gap.max()
                    if best < 0 or out and best <= rest.max():
                        break
                    tied = np.flatnonzero(gap == best)
                    i = tied[np.argmin(ids[tied])]
                    out.append(i)
                    np.minimum(gap, _squared(xyz, xyz[i]), out=gap)
                    gap[i] = -1.0
                    corner = np.maximum(np.abs(xyz[i] - low), np.abs(xyz[i] - high))
                    rest = np.minimum(rest, (corner * corner).sum(axis=1) * (1.0 + 1e-12))
                yield pa.RecordBatch.from_arrays([b.column("_g").slice(at, 1), _one(_structs(ids[out], xyz[out]))], names=["_g", "fresh"])
    return run


def farthest_points(points: DataFrame, n: int, group: str = "cloud", pid: str = "pid", skip_near_zero: bool = False,
                    rounds: list | None = None) -> DataFrame:
    """Farthest-point sample of each cloud: (group, step, pid). Start is the smallest id; ties keep the smaller id.

    points: (group, pid, x, y, z); ids are distinct integers inside a group, coordinates finite. Clouds with at most n points give
    all of them, in sampling order; an empty table gives an empty one. ``skip_near_zero`` leaves points at the origin out of the
    later picks (|p|^2 <= 1e-3). ``rounds`` receives the number of clouds that were still open in each round.

    A cloud has at most 16^3 cells plus 2048 further blocks where cells are dense, so the picking step of a cloud sees a bounded
    number of candidates; blocks hold the larger of ``WHOLE`` points and 1/2048 of the cloud. A round writes the gaps once.
    """
    g_name = points.schema[group].dataType.simpleString()
    g_type = to_arrow_type(points.schema[group].dataType)
    p = cut_lineage(points.select(F.col(group).alias("_g"), F.col(pid).cast("bigint").alias("i"), *[F.col(a).cast("double").alias(a) for a in "xyz"]))
    whole = p.groupBy("_g").agg(F.count("*").alias("_all"), F.min(F.struct("i", "x", "y", "z")).alias("start"),
                                *[f(a).alias(f"_{w}{a}") for a in "xyz" for w, f in (("l", F.min), ("h", F.max))])
    whole = cut_lineage(whole)
    large = F.col("_all") > WHOLE

    def slot(a):
        wide = F.col(f"_h{a}") - F.col(f"_l{a}")
        return F.when(large & (wide > 0), F.least(F.floor((F.col(a) - F.col(f"_l{a}")) / wide * DIVISIONS), F.lit(DIVISIONS - 1))).otherwise(F.lit(0)).cast("int")

    placed = attach(p, whole.drop("start"), ["_g"], ["i"]).select(
        "_g", "i", *"xyz", ((slot("x") * DIVISIONS + slot("y")) * DIVISIONS + slot("z")).alias("_cell"),
        F.when(large, F.lit(REPORTED)).otherwise(F.lit(WHOLE)).alias("report"),
        F.greatest(F.lit(WHOLE), F.ceil(F.col("_all") / 2048)).alias("size"))
    state = blocks(placed, ["_g", "_cell", "report", "size"], "i", F.col("size"), ["i", "x", "y", "z"], "points").drop("size") \
        .withColumn("gap", F.array().cast("array<double>"))
    chosen = whole.select("_g", F.array("start").cast(f"array<{_POINT}>").alias("picks"), F.array("start").cast(f"array<{_POINT}>").alias("fresh"))
    chosen = cut_lineage(chosen)
    done = []
    while True:
        open_ = chosen.filter((F.size("picks") < n) & (F.size("fresh") > 0))
        left = open_.count()
        done.append(chosen.filter(~((F.size("picks") < n) & (F.size("fresh") > 0))).select("_g", "picks"))
        if rounds is not None:
            rounds.append(left)
        if left == 0:
            break
        kinds = f"_g {g_name}, _cell int, _b bigint, report int, points array<{_POINT}>, gap array<double>"
        state = cut_lineage(attach(state, open_.select("_g", "fresh"), ["_g"], ["_cell", "_b"])
                            .select("_g", "_cell", "_b", "report", "points", "gap", "fresh").mapInArrow(
            _folded(skip_near_zero, g_type),
            kinds + f", seen struct<rest:double,top:array<struct<i:bigint,x:double,y:double,z:double,gap:double>>,low:array<double>,high:array<double>>"))
        seen = state.groupBy("_g").agg(F.collect_list("seen").alias("seen"))
        fresh = seen.join(open_.select("_g", F.size("picks").alias("have")), "_g").mapInArrow(_picked(n, g_type), f"_g {g_name}, fresh array<{_POINT}>")
        chosen = cut_lineage(open_.drop("fresh").join(fresh, "_g").withColumn("picks", F.concat("picks", "fresh")))
        state = state.drop("seen")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("_g").alias(group), F.posexplode("picks").alias("step", "s")) \
        .select(group, F.col("step").cast("bigint").alias("step"), F.col("s.i").alias(pid))
