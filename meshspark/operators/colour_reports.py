"""Captured-colour statistics and threshold search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from meshspark.functions import colour as col


def colour_stats(faces: DataFrame, keys: list[str], gum: str = "is_gum") -> DataFrame:
    """Count, mean, population std, min, max per channel for tooth and gum faces, sentinel faces left out."""
    real = faces.filter(~col.is_sentinel(F.col("r"), F.col("g"), F.col("b")))
    per = [e for c in "rgb" for e in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"),
                                      F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]
    inside = F.lit(True)
    low_in = None
    for i, c in enumerate("rgb"):
        lo = F.when(F.col(gum), col.GUM_RGB_RANGE[0][i]).otherwise(col.TOOTH_RGB_RANGE[0][i])
        hi = F.when(F.col(gum), col.GUM_RGB_RANGE[1][i]).otherwise(col.TOOTH_RGB_RANGE[1][i])
        inside = inside & F.col(c).between(lo, hi)
    return real.groupBy(*keys, gum).agg(F.count("*").alias("n"), *per, F.avg(inside.cast("int")).alias("in_range"))


def sentinel_share(faces: DataFrame, keys: list[str]) -> DataFrame:
    hit = col.is_sentinel(F.col("r"), F.col("g"), F.col("b")).cast("int")
    return faces.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(hit).alias("n_missing"), F.avg(hit).alias("share"))


def otsu_threshold(faces: DataFrame, keys: list[str], value, width: float = 1.0) -> DataFrame:
    """Threshold with the largest between-class variance per group, from a histogram (at most a few hundred bins)."""
    hist = faces.groupBy(*keys, F.floor(value / width).alias("bin")).agg(F.count("*").alias("n"))
    h = hist.withColumn("m", (F.col("bin") + 0.5) * width * F.col("n"))
    run = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    h = h.withColumns({"w0": F.sum("n").over(run), "s0": F.sum("m").over(run),
                       "wt": F.sum("n").over(all_), "st": F.sum("m").over(all_)}).filter("w0 < wt")
    gap = F.col("s0") / F.col("w0") - (F.col("st") - F.col("s0")) / (F.col("wt") - F.col("w0"))
    h = h.withColumn("v", F.col("w0").cast("double") * (F.col("wt") - F.col("w0")) * gap * gap)
    best = h.groupBy(*keys).agg(F.max_by("bin", F.struct("v", -F.col("bin"))).alias("bin"))
    return best.select(*keys, ((F.col("bin") + 1) * width).alias("threshold"))
