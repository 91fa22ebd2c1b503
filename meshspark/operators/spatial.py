"""Exact spatial joins on grid cells: radius, nearest, k-nearest, nearest-with-cap, box.

Every join is an equi-join on (group, cell) followed by a distance test, so a huge cloud spreads over
its cells. ``nearest`` picks the cell size per region from cell counts alone: the finest level whose 3x3x3
block holds enough points gives an upper bound for the k-th distance, and one ball search within that bound is
exact. Points at one identical position are reduced to the few with the smallest ids before any pairing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshspark.functions.vectors import Vec
from meshspark.session import cut_lineage

AXES = "xyz"
TASK_PAIRS = 4_000_000  # pairs one task of a ranked join meets, as far as whole cells allow


def _cells(prefix: str, size: float) -> list[Column]:
    return [F.floor(F.col(a) / F.lit(float(size))).alias(prefix + a) for a in AXES]


def _shift(levels: Column, c: str) -> Column:
    # arithmetic shift keeps floor semantics for negative cells
    return F.expr(f"shiftright({c}, _lv)").alias(c)


def _spread(lo: str, hi: str, out: str) -> Column:
    return F.explode(F.sequence(F.col(lo), F.col(hi))).alias(out)


def _q(df: DataFrame, group: str, ident: str, name: str) -> DataFrame:
    return df.select(F.col(group).alias("_g"), F.col(ident).alias(name), *[F.col(a).cast("double").alias(a) for a in AXES])


def pairs_within(queries: DataFrame, points: DataFrame, radius: float, group: str = "cloud",
                 qid: str = "qid", pid: str = "pid", inclusive: bool = True) -> DataFrame:
    """All (group, qid, pid, d2) with distance <= radius (or < radius)."""
    q = _q(queries, group, qid, "_qid").select("*", *_cells("_c", radius))
    p = _q(points, group, pid, "_pid").select("_g", "_pid", *[F.col(a).alias("p" + a) for a in AXES],
                                              *[F.floor(F.col(a) / F.lit(float(radius))).alias("_c" + a) for a in AXES])
    for a in AXES:
        q = q.withColumn(f"_c{a}", F.explode(F.sequence(F.col(f"_c{a}") - 1, F.col(f"_c{a}") + 1)))
    d2 = Vec.cols("").minus(Vec.cols("p")).sq()
    r2 = F.lit(float(radius) * float(radius))
    j = q.join(p.hint("merge"), ["_g", *[f"_c{a}" for a in AXES]]).withColumn("d2", d2)
    return j.filter(F.col("d2") <= r2 if inclusive else F.col("d2") < r2) \
        .select(F.col("_g").alias(group), F.col("_qid").alias(qid), F.col("_pid").alias(pid), "d2")


def any_within(queries: DataFrame, points: DataFrame, radius: float, group: str = "cloud",
               qid: str = "qid") -> DataFrame:
    """Distinct (group, qid) that have a point within ``radius``; a semi-join, so no pairs leave the join."""
    q = _q(queries, group, qid, "_qid").select("*", *_cells("_c", radius)).alias("q")
    p = points.select(F.col(group).alias("_g"), *[F.col(a).cast("double").alias("p" + a) for a in AXES],
                      *_cells("_c", radius)).distinct()
    for a in AXES:  # the points go to the cells around them: the queries, mostly far more, are shuffled once
        p = p.withColumn(f"_c{a}", F.explode(F.sequence(F.col(f"_c{a}") - 1, F.col(f"_c{a}") + 1)))
    p = p.hint("merge").alias("p")
    near = Vec(*[F.col(f"q.{a}") for a in AXES]).minus(Vec(*[F.col(f"p.p{a}") for a in AXES])).sq() \
        <= F.lit(float(radius) * float(radius))
    same = [F.col(f"q.{c}") == F.col(f"p.{c}") for c in ("_g", "_cx", "_cy", "_cz")]
    cond = same[0] & same[1] & same[2] & same[3] & near
    return q.join(p, cond, "left_semi").select(F.col("_g").alias(group), F.col("_qid").alias(qid)).distinct()


def distinct_positions(points: DataFrame, keep: int) -> DataFrame:
    """At most ``keep`` ids per identical position: no other copy can enter a result ranked by (distance, id)."""
    w = Window.partitionBy("_g", *AXES).orderBy("_pid")
    return points.withColumn("_dup", F.row_number().over(w)).filter(F.col("_dup") <= keep).drop("_dup")


def _block_bounds(points: DataFrame, need: int, cell: float, levels: int) -> DataFrame:
    """(_g, _lv, cell, bound): target cells whose 27-block holds >= need points, with the distance bound in cells.

    The bound adds up the counts of the block's four shells (own cell, face, edge and corner neighbours).
    """
    base = points.groupBy("_g", *_cells("_c", cell)).agg(F.count("*").alias("_n"))
    lv = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_lv")
    rolled = base.select("_g", "_cx", "_cy", "_cz", "_n", lv) \
        .select("_g", "_lv", *[F.expr(f"shiftright(_c{a}, _lv)").alias(f"_c{a}") for a in AXES], "_n") \
        .groupBy("_g", "_lv", "_cx", "_cy", "_cz").agg(F.sum("_n").alias("_n"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"),
                               F.lit(abs(i) + abs(j) + abs(k)).alias("s"))
                      for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    around = rolled.select("_g", "_lv", "_cx", "_cy", "_cz", "_n", F.explode(steps).alias("_d")) \
        .select("_g", "_lv", (F.col("_cx") + F.col("_d.i")).alias("_cx"), (F.col("_cy") + F.col("_d.j")).alias("_cy"),
                (F.col("_cz") + F.col("_d.k")).alias("_cz"), "_n", F.col("_d.s").alias("_s"))
    upto = [F.sum(F.when(F.col("_s") <= s, F.col("_n"))).alias(f"_n{s}") for s in range(4)]
    reach = F.when(F.col("_n0") >= need, 3.0).when(F.col("_n1") >= need, 6.0) \
        .when(F.col("_n2") >= need, 9.0).otherwise(12.0)
    return around.groupBy("_g", "_lv", "_cx", "_cy", "_cz").agg(*upto).filter(F.col("_n3") >= need) \
        .select("_g", "_lv", "_cx", "_cy", "_cz", F.sqrt(reach).alias("_reach"))


def _grid(queries: DataFrame, points: DataFrame, need: int, cell: float) -> tuple[float, int]:
    """(cell edge, levels) from two single-row aggregates: the fullest cell and the extent of all positions."""
    full = points.select("_g", *AXES).distinct().groupBy("_g", *_cells("_c", cell)).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    finer = min(20, max(0, math.ceil(math.log2(full / (4.0 * need)) / 2))) if full else 0
    span = queries.select(*AXES).unionByName(points.select(*AXES)).agg(*[(F.max(_finite(a)) - F.min(_finite(a))).alias(a) for a in AXES]).first()
    cell = cell / 2 ** finer
    extent = max([span[a] or 0.0 for a in AXES])
    return cell, min(60, max(1, math.ceil(math.log2(max(extent / cell, 1.0)))) + 2)


def _finite(axis: str) -> Column:
    return F.when(F.abs(axis) < 1e300, F.col(axis))


def _join_tasks(left: DataFrame, right: DataFrame, keys: list[str]) -> int:
    """Tasks for a join on ``keys`` whose pairs are sorted: counted from rows per key, one single-row aggregate."""
    a, b = left.groupBy(*keys).agg(F.count("*").alias("_a")), right.groupBy(*keys).agg(F.count("*").alias("_b"))
    pairs = a.join(b.hint("merge"), keys).agg(F.sum(F.col("_a") * F.col("_b")).alias("n")).first().n or 0
    return max(left.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / TASK_PAIRS))


def nearest(queries: DataFrame, points: DataFrame, k: int, cell: float, group: str = "cloud", qid: str = "qid",
            pid: str = "pid", exclude_self: bool = False, max_dist: float | None = None) -> DataFrame:
    """The k nearest points of each query, ranked by (distance, id): (group, qid, rank, pid, dist).

    ``cell`` is a first guess of the cell edge (about the point spacing); the grid is refined where cells hold many points, and
    its levels double the edge until one block of cells spans everything, so that a far outlier still searches blocks.
    Only groups with fewer points than asked for are one key. They give all they have. ``max_dist`` drops farther points (inclusive).
    """
    need = k + (1 if exclude_self else 0)
    q, p = _q(queries, group, qid, "_qid"), _q(points, group, pid, "_pid")
    cell, levels = _grid(q, p, need, cell)
    p = distinct_positions(p, need)
    q = q.select("*", *_cells("_h", cell))

    homes = q.select("_g", "_hx", "_hy", "_hz").distinct()
    lv = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_lv")
    chain = homes.select("*", lv).select(
        "*", *[F.expr(f"shiftright(_h{a}, _lv)").alias(f"_c{a}") for a in AXES])
    bounds = _block_bounds(p, need, cell, levels)
    found = chain.join(bounds.hint("merge"), ["_g", "_lv", "_cx", "_cy", "_cz"]) \
        .groupBy("_g", "_hx", "_hy", "_hz").agg(F.min(F.struct("_lv", "_reach")).alias("_b")) \
        .select("_g", "_hx", "_hy", "_hz", F.col("_b._lv").alias("_l"), F.col("_b._reach").alias("_reach"))
    top = levels  # one cell per group: used where no block holds enough points
    located = q.join(found.hint("merge"), ["_g", "_hx", "_hy", "_hz"], "left")
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_l"))
    bound = F.col("_reach") * size * F.lit(1.0 + 1e-9)
    if max_dist is not None:
        bound = F.least(bound, F.lit(float(max_dist)))
    located = located.withColumn("_r", bound)
    if max_dist is not None:
        # no bound from counts: the cap itself is the radius, at the level whose cells match it
        cap_level = 0
        while cap_level < levels - 1 and cell * 2 ** cap_level < max_dist:
            cap_level += 1
        located = located.withColumn("_r", F.coalesce("_r", F.lit(float(max_dist))))
        search = F.when(F.col("_l").isNull(), F.lit(cap_level)).otherwise(
            F.least(F.col("_l") + 1, F.lit(cap_level)))
    else:
        search = F.when(F.col("_l").isNull(), F.lit(top)).otherwise(F.least(F.col("_l") + 1, F.lit(levels - 1)))
    # written once: which levels occur (a handful of integers) decides how often a point has to be offered
    located = cut_lineage(located.withColumn("_lv", search.cast("int")).drop("_hx", "_hy", "_hz", "_l", "_reach"))
    in_use = sorted(r[0] for r in located.select("_lv").distinct().collect())
    edge = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_lv"))
    keyed = located
    for a in AXES:
        lo = F.when(F.col("_lv") == top, F.lit(0)).otherwise(F.floor((F.col(a) - F.col("_r")) / edge))
        hi = F.when(F.col("_lv") == top, F.lit(0)).otherwise(F.floor((F.col(a) + F.col("_r")) / edge))
        keyed = keyed.withColumn(f"_c{a}", F.explode(F.sequence(lo, hi)))
    # skip cells of the bounding cube that the ball does not touch
    gap = None
    for a in AXES:
        low, high = F.col(f"_c{a}") * edge, (F.col(f"_c{a}") + 1) * edge
        g = F.greatest(low - F.col(a), F.col(a) - high, F.lit(0.0))
        gap = g * g if gap is None else gap + g * g
    touches = F.col("_r").isNull() | (gap <= F.col("_r") * F.col("_r") * (1.0 + 1e-9))
    keyed = keyed.filter((F.col("_lv") == top) | touches) \
        .select("_g", "_qid", *AXES, "_r", "_lv", "_cx", "_cy", "_cz")

    plv = F.explode(F.array(*[F.lit(i) for i in in_use or [top]])).alias("_lv")
    spread = p.select("_g", "_pid", *[F.col(a).alias("p" + a) for a in AXES], *_cells("_b", cell), plv) \
        .select("_g", "_pid", "px", "py", "pz", "_lv",
                *[F.when(F.col("_lv") == top, F.lit(0).cast("bigint"))
                  .otherwise(F.expr(f"shiftright(_b{a}, _lv)")).alias(f"_c{a}") for a in AXES])
    d2 = Vec.cols("").minus(Vec.cols("p")).sq()
    at = ["_g", "_lv", "_cx", "_cy", "_cz"]
    if k > 1:
        # ranking sorts the pairs, whose number the sizes of the two sides do not tell: as many tasks as pairs ask for
        tasks = _join_tasks(keyed, spread, at)
        keyed, spread = keyed.repartition(tasks, *at), spread.repartition(tasks, *at)
    pairs = keyed.join(spread.hint("merge"), at).withColumn("d2", d2) \
        .filter(F.col("_r").isNull() | (F.col("d2") <= F.col("_r") * F.col("_r") * F.lit(1.0 + 1e-9)))
    if max_dist is not None:
        pairs = pairs.filter(F.sqrt("d2") <= F.lit(float(max_dist)))
    if exclude_self:
        pairs = pairs.filter(F.col("_pid") != F.col("_qid"))
    if k == 1:
        best = pairs.groupBy("_g", "_qid").agg(F.min(F.struct("d2", "_pid")).alias("m"))
        ranked = best.select("_g", "_qid", F.lit(1).alias("rank"), F.col("m._pid").alias("_pid"),
                             F.col("m.d2").alias("d2"))
    else:
        w = Window.partitionBy("_g", "_qid").orderBy("d2", "_pid")
        ranked = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(F.col("_g").alias(group), F.col("_qid").alias(qid), F.col("rank").cast("bigint").alias("rank"),
                         F.col("_pid").alias(pid), F.sqrt("d2").alias("dist"))


def in_boxes(faces: DataFrame, frames: DataFrame, group: str = "arch_id") -> DataFrame:
    """Faces inside oriented boxes.

    faces: (group, fid, mx, my, mz, nx, ny, nz); frames: (group, fp, ox.., tx.., bx.., wx.., half_u, half_v, half_w,
    min_align) with t, b, w the orthonormal tangent, binormal and viewing axes. A box is looked up by the grid
    cells its bounding ball touches, so the faces of one large mesh spread over cells.
    """
    size = 8.0
    o = Vec.cols("o")
    reach = F.sqrt(F.col("half_u") ** 2 + F.col("half_v") ** 2 + F.col("half_w") ** 2)
    f = frames.withColumn("_reach", reach)
    for a, c in zip(AXES, o):
        f = f.withColumn(f"_c{a}", F.explode(F.sequence(F.floor((c - F.col("_reach")) / size),
                                                        F.floor((c + F.col("_reach")) / size))))
    s = faces.select("*", *[F.floor(F.col("m" + a) / size).alias(f"_c{a}") for a in AXES])
    rel = Vec.cols("m").minus(o)
    j = s.join(f.hint("merge"), [group, "_cx", "_cy", "_cz"])
    inside = (F.abs(rel.dot(Vec.cols("t"))) <= F.col("half_u")) & (F.abs(rel.dot(Vec.cols("b"))) <= F.col("half_v")) \
        & (F.abs(rel.dot(Vec.cols("w"))) <= F.col("half_w")) \
        & (Vec.cols("n").dot(Vec.cols("w")) >= F.col("min_align"))
    return j.filter(inside).withColumn("d2", rel.sq()).drop("_cx", "_cy", "_cz", "_reach")


def pairs_cells(geom: DataFrame, margin: float) -> DataFrame:
    """(arch_id, tooth, fid) of faces within ``margin`` of some face of a tooth, by centroid.

    Tooth faces offer themselves to the 27 cells around them as distinct (tooth, cell) keys first, so a face meets
    only the teeth nearby; the semi-join then stops at the first face that is close enough.
    """
    pos = geom.select("arch_id", "fid", "label", *[F.col("m" + a).alias(a) for a in AXES])
    tooth = pos.filter(F.col("label").between(1, 16)).select(
        F.col("arch_id").alias("_g"), F.col("label").alias("tooth"), *[F.col(a).alias("p" + a) for a in AXES],
        *_cells("_c", margin))
    homes = tooth.select("_g", "tooth", "_cx", "_cy", "_cz").distinct()
    for a in AXES:
        homes = homes.withColumn(f"_h{a}", F.explode(F.sequence(F.col(f"_c{a}") - 1, F.col(f"_c{a}") + 1)))
    q = pos.select(F.col("arch_id").alias("_g"), "fid", *AXES, *_cells("_h", margin))
    tried = q.join(homes.hint("merge"), ["_g", "_hx", "_hy", "_hz"]).alias("q")
    t = tooth.hint("merge").alias("t")
    same = [F.col(f"q.{c}") == F.col(f"t.{c}") for c in ("_g", "tooth", "_cx", "_cy", "_cz")]
    near = Vec(*[F.col(f"q.{a}") for a in AXES]).minus(Vec(*[F.col(f"t.p{a}") for a in AXES])).sq() \
        <= F.lit(float(margin) * float(margin))
    cond = near
    for s in same:
        cond = cond & s
    return tried.join(t, cond, "left_semi").select(F.col("_g").alias("arch_id"), "tooth", "fid").distinct()
