"""Sim-to-real augmentation: holes, eroded boundaries, thinning, shared-vertex noise, painted colour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshspark.functions import colour as col
from meshspark.functions.hashing import gaussian, uniform, uniform_int
from meshspark.functions.vectors import Vec, add_vec
from meshspark.operators.graph import face_neighbours, grow_blobs
from meshspark.operators.mesh import inner_degree
from meshspark.operators.ordinals import attach
from meshspark.operators.sampling import thin_faces
from meshspark.session import cut_lineage

MIN_FACES = 20  # fixed value: smaller patches lose no faces


def punch_holes(patch: DataFrame, adjacency: DataFrame, max_holes: int = 2, size_range: tuple[int, int] = (3, 40),
                max_fraction: float = 0.15, seed: str = "hole") -> DataFrame:
    """Remove up to ``max_holes`` connected blobs, at most ``max_fraction`` of the patch. patch: (patch_id, arch_id, fid).

    Holes come one after the other: each may take what the earlier ones have left of the budget, and may overlap them.
    """
    n = patch.groupBy("patch_id", "arch_id").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_FACES)
    # one random seed face per hole: the smallest of independent draws, a keyed aggregate
    u = [uniform(f"{seed}/seed", "patch_id", F.lit(h), "fid") for h in range(1, max_holes + 1)]
    first = patch.groupBy("patch_id", "arch_id").agg(*[F.min_by("fid", F.struct(u[h], "fid")).alias(f"_s{h + 1}")
                                                       for h in range(max_holes)])
    plan = cut_lineage(n.join(first.hint("merge"), ["patch_id", "arch_id"]).withColumn("n_holes", uniform_int(0, max_holes, f"{seed}/n", "patch_id"))
                       .withColumn("budget", F.greatest(F.lit(1), F.floor(F.col("n") * max_fraction))))
    gone = None
    members = patch.select("arch_id", "patch_id", "fid")
    neighbours = cut_lineage(face_neighbours(adjacency, members)) if max_holes > 0 else None
    for h in range(1, max_holes + 1):
        left = plan.filter(F.col("n_holes") >= h)
        if gone is None:
            left = left.withColumn("left", F.col("budget"))
        else:
            used = gone.groupBy("patch_id").agg(F.count("*").alias("used"))
            left = left.join(used, "patch_id", "left").withColumn("left", F.col("budget") - F.coalesce("used", F.lit(0)))
        size = F.least(uniform_int(size_range[0], size_range[1], f"{seed}/size", "patch_id", F.lit(h)), F.col("left"))
        seeds = left.filter("left > 0").select("arch_id", "patch_id", F.lit(h).alias("hole"), F.col(f"_s{h}").alias("fid"), size.alias("size"))
        blob = grow_blobs(seeds, adjacency, members, neighbours=neighbours).select("patch_id", "fid")
        gone = cut_lineage(blob if gone is None else gone.unionByName(blob).distinct())
    if gone is None:
        return patch
    return patch.join(gone.hint("merge"), ["patch_id", "fid"], "left_anti").select(*patch.columns)


def erode_boundary(patch: DataFrame, adjacency: DataFrame, max_prob: float = 0.3, seed: str = "erode") -> DataFrame:
    """Drop boundary faces (fewer than 3 neighbours in the patch) with one random rate per patch."""
    deg = inner_degree(patch, adjacency, ["patch_id"])
    n = patch.groupBy("patch_id").agg(F.count("*").alias("_n"))
    rate = F.lit(max_prob) * uniform(f"{seed}/rate", "patch_id")
    drop = (F.col("_n") >= MIN_FACES) & (F.col("degree") < 3) & (uniform(seed, "patch_id", "fid") < rate)
    return attach(deg, n.hint("merge"), ["patch_id"], ["fid"]).filter(~drop).select(*patch.columns)


def jitter_positions(vertices: DataFrame, max_sigma: float = 0.15, seed: str = "jit", key: str = "patch_id") -> DataFrame:
    """Gaussian noise per (patch, vertex): faces that share a vertex move together."""
    sigma = F.lit(max_sigma) * uniform(f"{seed}/sigma", key)
    return vertices.withColumns({a: F.col(a) + sigma * gaussian(f"{seed}/{a}", key, "vid") for a in "xyz"})


def jitter_normals(rows: DataFrame, ident: str, max_sigma: float = 0.08, seed: str = "jitn",
                   key: str = "patch_id") -> DataFrame:
    """Noise on unit normals (nx, ny, nz) per row, renormalised. Use with vertices and with faces alike."""
    sigma = F.lit(max_sigma) * uniform(f"{seed}/sigma", key)
    d = add_vec(rows, "_j", Vec(*[F.col(f"n{a}") + sigma * gaussian(f"{seed}/{a}", key, ident) for a in "xyz"]))
    d = d.withColumn("_len", Vec.cols("_j").norm() + 1e-9)
    return d.withColumns({f"n{a}": F.col(f"_j{a}") / F.col("_len") for a in "xyz"}).drop("_jx", "_jy", "_jz", "_len")


def drop_faces(patch: DataFrame, adjacency: DataFrame, seed: str = "aug") -> DataFrame:
    """Holes, then erosion, then thinning: faces only ever disappear."""
    p = punch_holes(patch, adjacency, seed=f"{seed}/hole")
    p = erode_boundary(p, adjacency, seed=f"{seed}/erode")
    return thin_faces(p, seed=f"{seed}/thin")


PAINTS = {"flat": col.paint_flat, "mosaic": col.paint_mosaic, "hsv": col.paint_hsv}


def paint(faces: DataFrame, style: str, seed: str = "paint", key: str = "patch_id") -> DataFrame:
    """Synthetic r, g, b from the label (0 is gum): one flat draw per class, per-face Gaussian or per-face HSV."""
    if style not in PAINTS:
        raise ValueError(f"unknown paint style {style!r}")
    keys = (key,) if style == "flat" else (key, "fid")
    rgb = PAINTS[style](F.col("label") == 0, seed, *keys)
    return faces.withColumns({n: c for n, c in zip("rgb", rgb)})


def drop_colour(faces: DataFrame, prob: float = 0.6, seed: str = "colour_dropout", key: str = "patch_id") -> DataFrame:
    """Replace the colour of a share of faces by the no-colour sentinel."""
    hit = uniform(seed, key, "fid") < prob
    return faces.withColumns({n: F.when(hit, F.lit(s).cast("bigint")).otherwise(F.col(n))
                              for n, s in zip("rgb", col.NO_COLOUR)})


def flatten_colours(faces: DataFrame, tooth: tuple[int, int, int], gum: tuple[int, int, int], cell: float,
                    threshold: float = col.REDNESS_THRESHOLD, group: str = "run_id", fid: str = "fid") -> DataFrame:
    """Classify by redness, lend colourless faces the class of the nearest coloured one, paint two flat colours."""
    from meshspark.operators.transfer import fill_missing_colour
    red = col.redness(F.col("r"), F.col("g"), F.col("b"))
    d = fill_missing_colour(faces, red > threshold, cell, False, group, fid).withColumnRenamed("filled", "is_gum")
    return d.withColumns({n: F.when(F.col("is_gum"), g).otherwise(t).cast("bigint") for n, t, g in zip("rgb", tooth, gum)})
