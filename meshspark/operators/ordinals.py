"""Ordinals, running sums and look-backs over groups of any size.

A plain window puts a whole group in one task. Here a group is first cut into ordered buckets; a small
bucket table carries the offsets, so that the heavy sort only ever sees (group, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def row_ordinal(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """1-based row number inside ``keys`` ordered by ``order``; ``bucket`` must be monotone in ``order``."""
    d = df.withColumn("_bk", bucket)
    sizes = d.groupBy(*keys, "_bk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "_bk", F.coalesce(before, F.lit(0)).alias("_off"))
    rn = F.row_number().over(Window.partitionBy(*keys, "_bk").orderBy(*order))
    local = d.withColumn("_rn", rn)
    return local.join(offsets, [*keys, "_bk"]) \
        .select(*df.columns, (F.col("_rn") + F.col("_off")).alias(name))


def attach(df: DataFrame, per_group: DataFrame, keys: list[str], spread: list[str], salts: int = 16) -> DataFrame:
    """Join one-row-per-group values back to the rows of the group.

    The rows of a group are spread over ``salts`` join keys by a hash of ``spread`` (row id columns) and the small side
    is repeated as often, so a group with a third of all rows does not end in one task.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).alias("_salt")
    small = per_group.select("*", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(salts)])).alias("_salt"))
    return df.select("*", salt).join(small, [*keys, "_salt"]).drop("_salt")


def exact_median(df: DataFrame, keys: list[str], value: str, buckets: int = 1024) -> DataFrame:
    """(keys..., median): only the value buckets that hold the middle ranks are sorted."""
    st = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    d = attach(df.filter(F.col(value).isNotNull()), st, keys, [value]) \
        .withColumn("_bk", F.floor((F.col(value) - F.col("_lo")) / span * buckets))
    size = d.groupBy(*keys, "_bk").agg(F.count("*").alias("_m"), F.max("_n").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    size = size.withColumn("_off", F.coalesce(F.sum("_m").over(w), F.lit(0)))
    low, high = F.floor((F.col("_n") + 1) / 2), F.ceil((F.col("_n") + 1) / 2)
    mid = size.filter((F.col("_off") < high) & (F.col("_off") + F.col("_m") >= low)).select(*keys, "_bk", "_off")
    rn = F.row_number().over(Window.partitionBy(*keys, "_bk").orderBy(value))
    r = d.join(mid, [*keys, "_bk"]).withColumn("_r", rn + F.col("_off"))
    return r.filter(F.col("_r").between(low, high)).groupBy(*keys).agg(F.avg(value).alias("median"))


def with_lookback(df: DataFrame, keys: list[str], bucket: Column, order: list, lookback: int) -> DataFrame:
    """Rows plus, per (group, bucket), copies of the last ``lookback`` rows before the bucket.

    Adds ``_bk`` and ``_halo``. A window over (keys, _bk) then sees exactly the rows a window over the
    whole group would see up to ``lookback`` rows back; drop ``_halo`` rows afterwards.
    """
    d = df.withColumn("_bk", bucket)
    per_group = Window.partitionBy(*keys).orderBy("_bk")
    later = [F.lead("_bk", s).over(per_group) for s in range(1, lookback + 1)]
    order_of = d.select(*keys, "_bk").distinct().select(*keys, "_bk", F.array(*later).alias("_later"))
    newest = Window.partitionBy(*keys, "_bk").orderBy(*[o.desc() if isinstance(o, Column) else F.col(o).desc()
                                                        for o in order])
    tails = d.withColumn("_tail", F.row_number().over(newest)).filter(F.col("_tail") <= lookback).drop("_tail")
    halo = tails.join(order_of, [*keys, "_bk"]) \
        .withColumn("_next", F.explode(F.filter("_later", lambda b: b.isNotNull()))) \
        .select(*df.columns, F.col("_next").alias("_bk"), F.lit(True).alias("_halo"))
    return d.withColumn("_halo", F.lit(False)).unionByName(halo)


def take_smallest(df: DataFrame, keys: list[str], draw: Column, tie: list[str], limit, buckets: int = 4096) -> DataFrame:
    """Exactly ``limit`` rows per group with the smallest ``draw`` in [0, 1).

    A histogram of the draw finds the one bucket in which the limit falls; only that bucket is sorted.
    ``limit`` is an integer or a column that is constant inside a group.
    """
    lim = F.lit(limit) if isinstance(limit, int) else limit
    d = df.withColumn("_u", draw).withColumn("_lim", lim).withColumn("_bk", F.floor(F.col("_u") * buckets))
    hist = d.groupBy(*keys, "_bk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1))
    hist = hist.select(*keys, "_bk", "_n", F.coalesce(before, F.lit(0)).alias("_off"))
    j = d.join(hist, [*keys, "_bk"])
    whole = j.filter(F.col("_off") + F.col("_n") <= F.col("_lim"))
    rn = F.row_number().over(Window.partitionBy(*keys, "_bk").orderBy("_u", *tie))
    edge = j.filter((F.col("_off") < F.col("_lim")) & (F.col("_off") + F.col("_n") > F.col("_lim"))) \
        .withColumn("_rn", rn).filter(F.col("_rn") + F.col("_off") <= F.col("_lim")).drop("_rn")
    return whole.unionByName(edge).select(*df.columns)


def blocks(df: DataFrame, keys: list[str], ident: str, size, columns: list[str], name: str) -> DataFrame:
    """(keys..., _b, name array<struct<columns>>): rows of each key in blocks of about ``size`` rows (a number or a column that
    is constant for a key), dealt by a hash of ``ident``."""
    per = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    limit = F.lit(size) if isinstance(size, int) else size
    d = attach(df, per, keys, [ident]).withColumn("_b", F.pmod(F.xxhash64(ident), F.ceil(F.col("_n") / limit)))
    return d.groupBy(*keys, "_b").agg(F.collect_list(F.struct(*columns)).alias(name))
