"""Mixing sources to target weights along a training curriculum, with DataFrame functions only.

A source has a piecewise linear weight over training time t in [0, 1]. The integral of the weight is its share; the
running integral, scaled to the source's target, is its cumulative word demand. A document that occupies words [c, c + size)
of its source stands where the demand reaches c: the inverse of that integral. Documents are then sorted by position in ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from meshspark.llm.shared import keep, query, read, unused

ROWS_PER_BUCKET = 1 << 17


def text_size(text: str = "text"):
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def integrate(schedules: DataFrame) -> DataFrame:
    """(source, weight, segments) from (source, knots array<struct<t, w>>): each segment with its start, slope and area before."""
    w = Window.partitionBy("source").orderBy("t", "pos")
    legs = schedules.select("source", F.posexplode("knots").alias("pos", "k")) \
        .select("source", "pos", F.col("k.t").alias("t"), F.col("k.w").alias("w")) \
        .withColumn("t1", F.lead("t").over(w)).withColumn("w1", F.lead("w").over(w)).filter("t1 > t") \
        .withColumn("area", (F.col("t1") - F.col("t")) * (F.col("w") + F.col("w1")) / 2)
    before = F.sum("area").over(w.rowsBetween(Window.unboundedPreceding, -1))
    seg = F.struct("t", "w", ((F.col("w1") - F.col("w")) / (F.col("t1") - F.col("t"))).alias("slope"),
                   F.coalesce(before, F.lit(0.0)).alias("before"))
    return legs.withColumn("seg", seg).groupBy("source") \
        .agg(F.sum("area").alias("weight"), F.array_sort(F.collect_list("seg")).alias("segments"))


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): share of all sizes by weight, at most cap times a source's size.

    What a full source cannot take goes to the others by weight. With sources sorted by size per weight this has a closed
    form: the first ones are full, and all later ones get one common level times their weight. One row per source enters.
    """
    r = F.when(F.col("weight") > 0, cap * F.col("source_size") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.orderBy("_r", F.col("source").asc_nulls_last())
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    d = sources.withColumn("_r", r) \
        .withColumn("_level", (share * F.sum("source_size").over(whole)
                               - cap * F.coalesce(F.sum("source_size").over(prior), F.lit(0))) / F.sum("weight").over(rest)) \
        .withColumn("_rank", F.row_number().over(order))
    fits = F.when(F.col("_level") <= F.col("_r"), F.struct("_rank", "_level"))
    d = d.withColumn("_cut", F.min(fits).over(whole))
    return d.withColumn("target", F.when(F.col("_rank") >= F.col("_cut._rank"), F.col("weight") * F.col("_cut._level"))
                        .otherwise(cap * F.col("source_size")).cast("double")).drop("_r", "_level", "_rank", "_cut")


def _position(words_before):
    """Inverse of the running integral: t where the source's demand reaches ``words_before``."""
    need = F.least(words_before / F.col("_target"), F.lit(1.0)) * F.col("_weight")
    seg = F.element_at(F.filter("_segments", lambda s: s.before <= need), -1)
    over = need - seg.before
    root = (F.sqrt(seg.w * seg.w + 2 * seg.slope * over) - seg.w) / seg.slope
    flat = F.abs(seg.slope) < 1e-12
    return seg.t + F.coalesce(F.when(flat, over / seg.w).otherwise(root), F.lit(0.0))


def mix(docs: DataFrame, schedules: DataFrame | None = None, share: float = 1.5, cap: float = 2.0, size=None) -> DataFrame:
    """Every document with what the mix takes of it.

    docs: any table with ``doc_id``, ``source`` and ``text``. schedules: (source, knots array<struct<t, w>>), null sources
    included; default ``cyclic_schedules``. Adds size, source_size, target, taken (words, repeats counted), position (of the
    first pass, null if nothing is taken) and passes array<struct<pass, position, words>>.

    Order inside a source is the hash of doc_id, so reruns agree; the last pass is cut at the word where the demand ends, so
    each source meets its rounded target. Null texts have size 0 and are not taken; equal rows are separate documents;
    sources of size 0 get target 0; an empty table gives an empty one. Input columns named as the added ones are replaced, others kept.

    A source is cut into hash buckets whose number follows the row count, and offsets per bucket come from sums: no task
    holds a whole source, however large.
    """
    new = ["size", "source_size", "target", "taken", "position", "passes"]
    d = docs.drop(*new)
    columns = d.columns
    own = ["_h", "_size", "_tie", "_bucket", "_s", "_before", "_offset", "_start", "_source_size", "_target", "_weight", "_segments"]
    aside = {c: unused([*columns, *own], f"_{c}") for c in columns if c.lower() in own}
    d = d.withColumnsRenamed(aside)
    bits = max(7, math.ceil(math.log2(max(1, docs.count()) / ROWS_PER_BUCKET)))
    d = d.withColumn("_h", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))) \
        .withColumn("_size", text_size() if size is None else size).withColumn("_tie", F.xxhash64("text")) \
        .withColumn("_bucket", F.shiftright(F.coalesce(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long"), F.lit(0)), 32 - bits)) \
        .withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    parts = d.groupBy("_s", "_bucket").agg(F.first("source").alias("source"), F.sum("_size").alias("_words"))
    parts = keep(parts, "mixing-sizes")
    per_source = parts.groupBy("_s").agg(F.first("source").alias("source"), F.sum("_words").alias("source_size"))
    plan = integrate(cyclic_schedules(per_source) if schedules is None else schedules) \
        .withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    goal = targets(per_source.join(plan.drop("source"), "_s", "left").fillna({"weight": 0.0}), share, cap) \
        .select("_s", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
                F.col("weight").alias("_weight"), F.col("segments").alias("_segments"))
    prior = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_s", "_bucket", F.coalesce(F.sum("_words").over(prior), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_s", "_bucket").orderBy("_h", "doc_id", "_size", "_tie") \
        .rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0))) \
        .join(offsets, ["_s", "_bucket"]).join(goal, "_s") \
        .withColumn("_start", F.col("_before") + F.col("_offset"))
    demand = F.round("_target").cast("long")

    def one(p):
        start = F.col("_start") + p * F.col("_source_size")
        words = F.greatest(F.lit(0), F.least(F.col("_size"), demand - start)).cast("long")
        return F.struct(p.alias("pass"), _position(start).alias("position"), words.alias("words"))

    n = math.ceil(cap)
    passes = F.filter(F.array(*[one(F.lit(i)) for i in range(n)]), lambda x: x.words > 0)
    return d.withColumn("passes", passes).select(
        *[F.col(aside.get(c, c)).alias(c) for c in columns], F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.coalesce(F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x.words), F.lit(0)).alias("taken"),
        F.try_element_at("passes", F.lit(1)).getField("position").alias("position"), "passes")


def cyclic_schedules(sources: DataFrame, cycle: tuple = ((6.0, 4.0), (2.0, 2.0), (0.5, 1.5))) -> DataFrame:
    """Weights by the rank of the source (code point order, null last), repeating: (at t = 0, at t = 1).

    The default integrates to 5, 2, 1: the first kind fades, the last one grows.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    knots = [F.array(F.struct(F.lit(0.0).alias("t"), F.lit(float(a)).alias("w")), F.struct(F.lit(1.0).alias("t"), F.lit(float(b)).alias("w")))
             for a, b in cycle]
    return sources.select("source").distinct().withColumn("_k", F.pmod(rank, F.lit(len(cycle)))) \
        .select("source", F.element_at(F.array(*knots), (F.col("_k") + 1).cast("int")).alias("knots"))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sort by position: partition i holds earlier positions than partition i + 1; what is not taken comes last.

    Ties go by the hash of doc_id. Every row and column is kept, texts are not looked at; an empty table gives an empty one.
    """
    return mixed.withColumn("_p", F.coalesce("position", F.lit(2.0))).repartitionByRange(F.col("_p"), F.xxhash64("doc_id")) \
        .sortWithinPartitions("_p", F.xxhash64("doc_id")).drop("_p")


def training_rows(mixed: DataFrame) -> DataFrame:
    """One row per document and pass, sorted into training order by ranges of position.

    ``taken``, ``position`` and ``pass`` (from 0) are those of the pass, so a document taken twice stands at two places and its rows add up
    to what the mix takes of it. A document that is not taken has one row with taken 0 and no position, at the end.
    """
    p = F.col("_p")
    own = [c for c in mixed.columns if c not in ("passes", "taken", "position", "pass")]
    rows = mixed.select(*own, F.explode_outer("passes").alias("_p")).select(
        *own, F.coalesce(p["words"], F.lit(0)).cast("long").alias("taken"), p["pass"].alias("pass"), p["position"].alias("position"))
    return in_training_order(rows)


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
s AS (SELECT source, source_size, [5.0, 2.0, 1.0][k % 3 + 1]::DOUBLE AS weight FROM s0),
r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS r FROM s),
l AS (SELECT *, row_number() OVER w AS rank,
  (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r WINDOW w AS (ORDER BY r, source NULLS LAST)),
c AS (SELECT min(rank) AS cut, arg_min(level, rank) AS level FROM l WHERE level <= r),
t AS (SELECT source, source_size, CASE WHEN rank >= c.cut THEN weight * c.level ELSE 2.0::DOUBLE * source_size END AS target
  FROM l LEFT JOIN c ON true),
p AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (greatest(0, least(size, round(target)::BIGINT - start)) + greatest(0, least(size, round(target)::BIGINT - start - source_size)))::BIGINT AS taken
FROM p
"""


@query("op3_mixing", SQL)
def op3_mixing(spark, sf_dir):
    mixed = mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return in_training_order(mixed.select("doc_id", "size", "source_size", "target", "taken", "position")).drop("position")
