"""Attribute transfer by nearest neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshspark.functions.colour import is_sentinel
from meshspark.operators.spatial import nearest
from meshspark.session import cut_lineage


def transfer_nearest(target: DataFrame, source: DataFrame, values: list[str], cell: float, group: str = "arch_id",
                     tid: str = "fid", sid: str = "sid") -> DataFrame:
    """Each target row takes the values of the nearest source row of its group (ties: the smaller id)."""
    nn = nearest(target.select(group, tid, "x", "y", "z"), source.select(group, sid, "x", "y", "z"), 1, cell, group, tid, sid)
    got = nn.select(group, tid, sid).join(source.select(group, sid, *values).hint("merge"), [group, sid]).drop(sid)
    return target.join(got.hint("merge"), [group, tid])


def match_previous(now: DataFrame, previous: DataFrame, max_dist: float, cell: float, group: str = "cloud",
                   qid: str = "qid", pid: str = "pid", values: tuple[str, ...] = ()) -> DataFrame:
    """Nearest row of the previous cycle within ``max_dist``, else nulls: now + (pid, values of that row, dist).

    Rows at one position have one answer, and of previous ones only the smallest id can be it: positions are searched, not rows.
    """
    # written once: the search goes over positions several times
    spots = cut_lineage(now.select(group, "x", "y", "z").distinct().withColumn("_q", F.struct("x", "y", "z")))
    known = cut_lineage(previous.groupBy(group, "x", "y", "z").agg(F.min(F.struct(pid, *values)).alias("_s")))
    nn = nearest(spots, known.select(group, "x", "y", "z", F.col(f"_s.{pid}").alias(pid)), 1, cell, group, "_q", pid, max_dist=max_dist) \
        .join(known.select(group, F.col(f"_s.{pid}").alias(pid), *[f"_s.{v}" for v in values]), [group, pid])
    at = cut_lineage(nn.select(group, *[F.col(f"_q.{a}").alias(a) for a in "xyz"], pid, *values, "dist"))
    return now.join(at, [group, "x", "y", "z"], "left").select(*now.columns, pid, *values, "dist")


def fill_missing_colour(faces: DataFrame, value: Column, cell: float, default, group: str = "run_id", fid: str = "fid") -> DataFrame:
    """``value`` of coloured faces; colourless faces take that of the nearest coloured one, or ``default`` if none.

    faces: (group, fid, x, y, z, r, g, b). Adds ``filled``.
    """
    d = faces.withColumn("_missing", is_sentinel(F.col("r"), F.col("g"), F.col("b"))) \
        .withColumn("_own", F.when(~F.col("_missing"), value))
    # one source row per position is enough: copies at one spot share the smallest id
    known = d.filter("not _missing").groupBy(group, "x", "y", "z") \
        .agg(F.min(F.struct(fid, "_own")).alias("s")).select(group, "x", "y", "z", F.col(f"s.{fid}").alias("_sid"),
                                                             F.col("s._own").alias("_near"))
    spots = d.filter("_missing").select(group, "x", "y", "z").distinct() \
        .withColumn("_q", F.struct("x", "y", "z"))
    known, spots = cut_lineage(known), cut_lineage(spots)
    nn = nearest(spots, known, 1, cell, group, "_q", "_sid").select(group, "_q", "_sid") \
        .join(known.select(group, "_sid", "_near").hint("merge"), [group, "_sid"]) \
        .join(spots.hint("merge"), [group, "_q"]).select(group, "x", "y", "z", "_near")
    nn = cut_lineage(nn)
    own = d.filter("not _missing").withColumn("_near", F.col("_own"))
    lent = d.filter("_missing").join(nn, [group, "x", "y", "z"], "left").select(*own.columns)
    return own.unionByName(lent).select(*faces.columns, F.coalesce("_near", F.lit(default)).alias("filled"))


def transfer_vertex_colours(reduced: DataFrame, original: DataFrame, cell: float, group: str = "arch_id") -> DataFrame:
    """Colours of reduced vertices from the nearest original vertex. Both: (group, vid, x, y, z, ...)."""
    return transfer_nearest(reduced, original.withColumnRenamed("vid", "sid"), ["r", "g", "b"], cell, group, "vid", "sid")
