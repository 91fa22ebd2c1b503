"""Local frames per tooth: origin, normal, tangent, facial direction; midline frame of two teeth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshspark.functions.vectors import Vec, add_reject, add_unit, add_vec


def tooth_frames(geom: DataFrame) -> DataFrame:
    """(arch_id, label, o*, n*): mean centroid and unit mean normal. One partial aggregate, no window."""
    s = geom.groupBy("arch_id", "label").agg(
        *[F.avg(f"m{a}").alias(f"o{a}") for a in "xyz"], *[F.avg(f"n{a}").alias(f"s{a}") for a in "xyz"])
    return add_unit(s, "n", Vec.cols("s")).drop("sx", "sy", "sz")


def _add_in_plane(df: DataFrame, out: str, direction: Vec, normal: Vec) -> DataFrame:
    """Add the unit projection into the tangent plane; where it vanishes, that of an axis not parallel to the normal."""
    steep = F.abs(normal.x) < 0.9
    axis = Vec(F.when(steep, 1.0).otherwise(0.0), F.when(steep, 0.0).otherwise(1.0), F.lit(0.0))
    d = add_reject(add_reject(df, "_e", direction, normal), "_f", axis, normal)
    d = d.withColumn("_flat", Vec.cols("_e").norm() < 1e-9)
    q = Vec(*[F.when(F.col("_flat"), s).otherwise(p) for s, p in zip(Vec.cols("_f"), Vec.cols("_e"))])
    return add_unit(d, out, q).drop("_ex", "_ey", "_ez", "_fx", "_fy", "_fz", "_flat")


def tangent_axes(frames: DataFrame) -> DataFrame:
    """Frames of teeth 1..16 plus t*: direction along the arch from the label neighbours that exist.

    At most 16 rows per arch enter the window.
    """
    teeth = frames.filter(F.col("label").between(1, 16))
    w = Window.partitionBy("arch_id").orderBy("label")
    near = {f"_{side}{c}": fn(c).over(w) for side, fn in (("p", F.lag), ("q", F.lead))
            for c in ("label", "ox", "oy", "oz")}
    d = teeth.withColumns(near)
    has_p = F.coalesce(F.col("_plabel") == F.col("label") - 1, F.lit(False))
    has_q = F.coalesce(F.col("_qlabel") == F.col("label") + 1, F.lit(False))
    here, n = Vec.cols("o"), Vec.cols("n")
    before = Vec(*[F.when(has_p, F.col(f"_po{a}")).otherwise(h) for a, h in zip("xyz", here)])
    after = Vec(*[F.when(has_q, F.col(f"_qo{a}")).otherwise(h) for a, h in zip("xyz", here)])
    lone = Vec.of(1.0, 0.0, 0.0).reject(n)
    raw = Vec(*[F.when(has_p | has_q, q - p).otherwise(s) for p, q, s in zip(before, after, lone)])
    return _add_in_plane(d, "t", raw, n).drop(*near)


def arch_centers(geom: DataFrame) -> DataFrame:
    return geom.filter("label <> 0").groupBy("arch_id").agg(*[F.avg(f"m{a}").alias(f"a{a}") for a in "xyz"])


def facial_directions(tangents: DataFrame, centers: DataFrame) -> DataFrame:
    """Adds f*: outward direction in the plane perpendicular to normal and tangent; lingual is its negation."""
    d = tangents.join(centers, "arch_id")
    d = add_reject(d, "_o", Vec.cols("o").minus(Vec.cols("a")), Vec.cols("n"))
    d = add_reject(d, "_p", Vec.cols("_o"), Vec.cols("t"))
    return add_unit(d, "f", Vec.cols("_p")).drop(*[f"{p}{a}" for p in ("a", "_o", "_p") for a in "xyz"])


def midline_frames(frames: DataFrame, tooth_a: int = 8, tooth_b: int = 9) -> DataFrame:
    """(arch_id, o*, n*, t*) between two teeth; arches missing either one give no row."""
    pick = lambda t, c: F.max(F.when(F.col("label") == t, F.col(c))).alias(f"{c}_{'a' if t == tooth_a else 'b'}")
    cols = [f"{p}{a}" for p in "on" for a in "xyz"]
    w = frames.filter(F.col("label").isin(tooth_a, tooth_b)).groupBy("arch_id") \
        .agg(*[pick(t, c) for t in (tooth_a, tooth_b) for c in cols], F.count("*").alias("_k")).filter("_k = 2")
    oa, ob = Vec.cols("o", "_a"), Vec.cols("o", "_b")
    d = add_unit(add_vec(w, "o", oa.plus(ob).times(0.5)), "n", Vec.cols("n", "_a").plus(Vec.cols("n", "_b")))
    d = add_unit(add_reject(d, "_t", ob.minus(oa), Vec.cols("n")), "t", Vec.cols("_t"))
    return d.select("arch_id", *[f"{p}{a}" for p in "ont" for a in "xyz"])


def local_uvw(rel: Vec, t: Vec, b: Vec, n: Vec) -> tuple[Column, Column, Column]:
    return rel.dot(t), rel.dot(b), rel.dot(n)


def view_boxes(frames: DataFrame, axis: str, width, height, slab, min_align) -> DataFrame:
    """Frames as oriented boxes for ``spatial.in_boxes``; ``axis`` is the column prefix of the viewing direction.

    The tangent is re-orthogonalised against the viewing axis.
    """
    w, t = Vec.cols(axis), Vec.cols("t")
    d = add_unit(frames, "_b", w.cross(t))
    d = add_vec(d, "_t", Vec.cols("_b").cross(w))
    d = add_vec(d, "_w", w)
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    keep = [c for c in frames.columns if c != "min_align" and (c[:-1] not in ("n", "t", "f", "w", "b") or c[-1] not in "xyz")]
    return d.select(*keep, *[F.col(f"_{p}{a}").alias(f"{p}{a}") for p in "tbw" for a in "xyz"],
                    (lit(width) / 2.0).alias("half_u"), (lit(height) / 2.0).alias("half_v"),
                    (lit(slab) / 2.0).alias("half_w"), lit(min_align).alias("min_align"))


def occlusality(normal: Vec, axis: Vec) -> Column:
    return normal.dot(axis)


def lingual_view_axis(facial: DataFrame, secondary: DataFrame) -> DataFrame:
    """Sign a per-arch axis (sx, sy, sz) so that it points against the mean facial direction."""
    mean = facial.groupBy("arch_id").agg(*[F.avg(f"f{a}").alias(f"g{a}") for a in "xyz"])
    d = secondary.join(mean, "arch_id")
    s = Vec.cols("s")
    flip = F.when(s.dot(Vec.cols("g")) < 0, 1.0).otherwise(-1.0)
    return d.select("arch_id", *s.times(flip).named("s"))
