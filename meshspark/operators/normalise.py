"""Centring, scaling, whole-mesh statistics, principal axes, feature rows."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from meshspark.functions.colour import to_unit
from meshspark.functions.vectors import Vec, add_vec
from meshspark.operators.ordinals import attach

SCALE_MM = 15.0  # fixed value: patch scale
CORNER_COLS = [f"{p}{a}" for p in "pqr" for a in "xyz"]
CENTRE_COLS = ["mx", "my", "mz"]
CORNER_NORMALS = [f"{p}n{a}" for p in "pqr" for a in "xyz"]
FACE_NORMAL = ["nx", "ny", "nz"]
FEATURE_COLS = CORNER_COLS + CENTRE_COLS + CORNER_NORMALS + FACE_NORMAL  # 24 columns


def with_corner_normals(geom: DataFrame, normals: DataFrame, key: str = "arch_id") -> DataFrame:
    """Attach vertex normals to the three corners as pnx.., qnx.., rnx.."""
    out = geom
    for i, p in enumerate("pqr"):
        n = normals.select(key, F.col("vid").alias(f"v{i}"), *[F.col(f"n{a}").alias(f"{p}n{a}") for a in "xyz"])
        out = out.join(n, [key, f"v{i}"])
    return out


def move_to_origin(vertices: DataFrame, key: str = "arch_id") -> DataFrame:
    """Subtract the mean vertex of each mesh."""
    c = vertices.groupBy(key).agg(*[F.avg(a).alias(f"_c{a}") for a in "xyz"])
    d = attach(vertices, c, [key], ["vid"])
    return d.withColumns({a: F.col(a) - F.col(f"_c{a}") for a in "xyz"}).drop("_cx", "_cy", "_cz")


def mesh_stats(vertices: DataFrame, normals: DataFrame, geom: DataFrame, key: str = "arch_id") -> DataFrame:
    """Per mesh: mean, sample std, min, max of vertices; mean and sample std of vertex and face normals."""
    v = vertices.groupBy(key).agg(*[e for a in "xyz" for e in (
        F.avg(a).alias(f"v_mean_{a}"), F.stddev_samp(a).alias(f"v_std_{a}"),
        F.min(a).alias(f"v_min_{a}"), F.max(a).alias(f"v_max_{a}"))])
    n = normals.groupBy(key).agg(*[e for a in "xyz" for e in (
        F.avg(f"n{a}").alias(f"vn_mean_{a}"), F.stddev_samp(f"n{a}").alias(f"vn_std_{a}"))])
    f = geom.groupBy(key).agg(*[e for a in "xyz" for e in (
        F.avg(f"n{a}").alias(f"fn_mean_{a}"), F.stddev_samp(f"n{a}").alias(f"fn_std_{a}"))])
    return v.join(n, key).join(f, key)


def normalise_mesh(geom_normals: DataFrame, stats: DataFrame, key: str = "arch_id") -> DataFrame:
    """z-scored corners and normals, min-max scaled centres, by whole-mesh statistics."""
    d = attach(geom_normals, stats, [key], ["fid"])
    z = lambda c, kind, a: (F.col(c) - F.col(f"{kind}_mean_{a}")) / F.col(f"{kind}_std_{a}")
    new = {}
    for a in "xyz":
        for p in "pqr":
            new[f"{p}{a}"] = z(f"{p}{a}", "v", a)
            new[f"{p}n{a}"] = z(f"{p}n{a}", "vn", a)
        new[f"m{a}"] = (F.col(f"m{a}") - F.col(f"v_min_{a}")) / (F.col(f"v_max_{a}") - F.col(f"v_min_{a}"))
        new[f"n{a}"] = z(f"n{a}", "fn", a)
    return d.withColumns(new).select(*geom_normals.columns)


def normalise_patch(patch: DataFrame, key: str = "patch_id", scale: float = SCALE_MM) -> DataFrame:
    """Centre on the mean face corner and divide by a fixed scale; normals stay raw."""
    mean = [((F.sum(f"p{a}") + F.sum(f"q{a}") + F.sum(f"r{a}")) / (F.count("*") * 3)).alias(f"_c{a}") for a in "xyz"]
    d = attach(patch, patch.groupBy(key).agg(*mean), [key], ["fid"])
    s = F.lit(float(scale))
    new = {f"{p}{a}": (F.col(f"{p}{a}") - F.col(f"_c{a}")) / s for p in "pqrm" for a in "xyz"}
    return d.withColumns(new).select(*patch.columns)


def feature_row(colour: tuple[str, str, str] | None = None) -> Column:
    """24 dimensions (corners, centre, corner normals, face normal), 27 with unit-scaled colour."""
    base = [F.col(c).cast("float") for c in FEATURE_COLS]
    extra = [to_unit(F.col(c)).cast("float") for c in colour] if colour else []
    return F.array(*base, *extra)


def position_of(x: Column) -> Column:
    """The centre part of a feature row."""
    return F.slice(x, 10, 3)


def unpack_feature(x: str = "x") -> dict[str, Column]:
    """Corners (3 x 3), centre and, for 27 dimensions, 8-bit colour back from a feature row."""
    from meshspark.functions.colour import from_unit
    col = F.col(x)
    return {
        "tri": F.array(*[F.slice(col, 1 + 3 * i, 3) for i in range(3)]),
        "pos": position_of(col),
        "rgb": F.when(F.size(col) == 27, F.transform(F.slice(col, 25, 3), lambda v: F.round(from_unit(v)).cast("int"))),
    }


def covariance(points: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """Means and the six population covariances per group: one partial aggregate."""
    x, y, z = (F.col(prefix + a) for a in "xyz")
    pair = {"xx": (x, x), "xy": (x, y), "xz": (x, z), "yy": (y, y), "yz": (y, z), "zz": (z, z)}
    return points.groupBy(*keys).agg(*[F.avg(prefix + a).alias(f"mean_{a}") for a in "xyz"],
                                     *[F.covar_pop(p, q).alias(f"cov_{n}") for n, (p, q) in pair.items()])


def principal_axes(cov: DataFrame, keys: list[str]) -> DataFrame:
    """Unit eigenvectors of the 3x3 covariance, largest variance first: e1*, e2*, e3* and variances var1..3.

    One small row per group enters Python. The sign makes the largest component positive.
    """
    names = ["xx", "xy", "xz", "yy", "yz", "zz"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            xx, xy, xz, yy, yz, zz = (b[f"cov_{n}"].to_numpy() for n in names)
            m = np.stack([np.stack([xx, xy, xz], 1), np.stack([xy, yy, yz], 1), np.stack([xz, yz, zz], 1)], 1)
            val, vec = np.linalg.eigh(m)
            out = b[keys].copy()
            for rank, i in enumerate((2, 1, 0), start=1):
                v = vec[:, :, i]
                big = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1)
                v = v * np.where(big < 0, -1.0, 1.0)
                out[f"var{rank}"] = val[:, i]
                for j, a in enumerate("xyz"):
                    out[f"e{rank}{a}"] = v[:, j]
            yield out

    kinds = ", ".join(f"{k} {cov.schema[k].dataType.simpleString()}" for k in keys)
    cols = ", ".join(f"var{r} double, e{r}x double, e{r}y double, e{r}z double" for r in (1, 2, 3))
    return cov.select(*keys, *[f"cov_{n}" for n in names]).mapInPandas(solve, f"{kinds}, {cols}")


def view_axes(axes: DataFrame, mean_normals: DataFrame, keys: list[str]) -> DataFrame:
    """tangent = e1, secondary = e2, normal = e3 signed along the mean face normal (gx, gy, gz)."""
    d = axes.join(mean_normals, keys)
    flip = F.when(Vec.cols("e3").dot(Vec.cols("g")) < 0, -1.0).otherwise(1.0)
    return d.select(*keys, *Vec.cols("e1").named("t"), *Vec.cols("e2").named("s"),
                    *Vec.cols("e3").times(flip).named("w"))


def project_corners(geom: DataFrame, axes: DataFrame, keys: list[str]) -> DataFrame:
    """u, v of every corner on two axes (t, s) and centroid depth on the third (w)."""
    d = attach(geom, axes, keys, ["fid"])
    new = {}
    for p in "pqr":
        new[f"u_{p}"] = Vec.cols(p).dot(Vec.cols("t"))
        new[f"v_{p}"] = Vec.cols(p).dot(Vec.cols("s"))
    new["depth"] = Vec.cols("m").dot(Vec.cols("w"))
    return d.withColumns(new)
