"""Cycle logic of live runs: confirmation, regimen targets, transitions, positions, gaps, smoothing.

Frame-level steps use bucketed look-backs; everything per cycle works on aggregates of (run, cycle, label).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshspark.functions.labels import LEFT_SWEEP, RIGHT_SWEEP
from meshspark.operators.ordinals import attach, with_lookback
from meshspark.session import cut_lineage

MIN_FACES, CONFIRM_CYCLES = 30, 8  # fixed values


def claim_voxels(observed: DataFrame, voxel: list[str], order: list[str]) -> DataFrame:
    """The first observation of each voxel wins for good. A keyed minimum: a hot voxel combines before the shuffle."""
    rest = [c for c in observed.columns if c not in voxel and c not in order]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_w")
    return observed.groupBy(*voxel).agg(first).select(*voxel, "_w.*").select(*observed.columns)


def cycle_index(counts: DataFrame) -> DataFrame:
    """(run_id, cycle, ci): consecutive number of the cycles that a run processed."""
    w = Window.partitionBy("run_id").orderBy("cycle")
    return counts.select("run_id", "cycle").distinct().withColumn("ci", F.row_number().over(w))


def streaks(counts: DataFrame, min_faces: int = MIN_FACES) -> DataFrame:
    """(run_id, label, cycle, streak): consecutive cycles with at least ``min_faces`` faces (gaps and islands)."""
    ok = counts.filter((F.col("n") >= min_faces) & F.col("label").between(1, 16)) \
        .join(cycle_index(counts), ["run_id", "cycle"])
    w = Window.partitionBy("run_id", "label").orderBy("ci")
    isl = ok.withColumn("_isl", F.col("ci") - F.row_number().over(w))
    inner = Window.partitionBy("run_id", "label", "_isl").orderBy("ci")
    return isl.select("run_id", "label", "cycle", F.row_number().over(inner).cast("bigint").alias("streak"))


def first_confirmed(counts: DataFrame, min_faces: int = MIN_FACES, cycles: int = CONFIRM_CYCLES) -> DataFrame:
    """First cycle at which a label has kept its streak long enough; confirmed for good from then on."""
    return streaks(counts, min_faces).filter(F.col("streak") >= cycles).groupBy("run_id", "label") \
        .agg(F.min("cycle").alias("confirmed_cycle"))


def first_seen(counts: DataFrame, min_faces: int = MIN_FACES) -> DataFrame:
    return counts.filter((F.col("n") >= min_faces) & F.col("label").between(1, 16)).groupBy("run_id", "label") \
        .agg(F.min("cycle").alias("seen_cycle"))


def compare_rules(counts: DataFrame, min_faces: int = MIN_FACES, cycles: int = CONFIRM_CYCLES) -> DataFrame:
    """Single-cycle rule against sustained rule per label."""
    d = first_seen(counts, min_faces).join(first_confirmed(counts, min_faces, cycles), ["run_id", "label"], "full")
    return d.withColumn("delayed", F.coalesce(F.col("confirmed_cycle") > F.col("seen_cycle"), F.lit(False)))


def regimen_target(confirmed: Column) -> Column:
    """Struct (stage, target) for an array of confirmed labels: first missing of the left sweep, then of the right."""
    def missing(seq):
        return F.array_except(F.array(*[F.lit(v).cast("bigint") for v in seq]), confirmed)
    left, right = missing(LEFT_SWEEP), missing(RIGHT_SWEEP)
    stage = F.when(F.size(left) > 0, "LEFT").when(F.size(right) > 0, "RIGHT").otherwise("DONE")
    return F.struct(stage.alias("stage"), F.coalesce(F.get(left, F.lit(0)), F.get(right, F.lit(0)), F.lit(0)).alias("target"))


def regimen(counts: DataFrame, rule: str, min_faces: int = MIN_FACES, cycles: int = CONFIRM_CYCLES) -> DataFrame:
    """(run_id, cycle, stage, target) under the single-cycle or the sustained rule; target 0 when done."""
    if rule == "single":
        sets = counts.groupBy("run_id", "cycle").agg(F.collect_set(
            F.when((F.col("n") >= min_faces) & F.col("label").between(1, 16), F.col("label"))).alias("c"))
    elif rule == "sustained":
        done = first_confirmed(counts, min_faces, cycles).groupBy("run_id") \
            .agg(F.collect_list(F.struct("label", "confirmed_cycle")).alias("d"))
        empty = F.expr("cast(array() as array<struct<label:bigint,confirmed_cycle:bigint>>)")
        sets = counts.select("run_id", "cycle").distinct().join(done, "run_id", "left") \
            .withColumn("d", F.coalesce("d", empty)) \
            .withColumn("c", F.transform(F.filter("d", lambda e: e["confirmed_cycle"] <= F.col("cycle")), lambda e: e["label"]))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return sets.withColumn("_t", regimen_target(F.col("c"))).select("run_id", "cycle", "_t.stage", "_t.target")


def transitions(states: DataFrame, value: list[str], key: str = "run_id", order: str = "cycle") -> DataFrame:
    """Rows at which the value differs from the previous cycle (the first one included)."""
    w = Window.partitionBy(key).orderBy(order)
    cur = F.struct(*value)
    return states.withColumn("_p", F.lag(cur).over(w)).filter(F.col("_p").isNull() | (F.col("_p") != cur)).drop("_p")


def frame_gaps(frames: DataFrame, min_gap_s: float = 0.2) -> DataFrame:
    """Frames that follow their predecessor in the run by more than ``min_gap_s`` seconds."""
    d = with_lookback(frames.select("run_id", "seq", "ts"), ["run_id"], F.to_date("ts"), ["ts", "seq"], 1)
    w = Window.partitionBy("run_id", "_bk").orderBy("ts", "seq")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    d = d.withColumn("gap_s", (us(F.col("ts")) - us(F.lag("ts").over(w))) / 1e6)
    return d.filter(~F.col("_halo") & (F.col("gap_s") > min_gap_s)).select("run_id", "seq", "gap_s")


def recent_position(frames: DataFrame, last: int = 5, bucket_size: int = 4096) -> DataFrame:
    """Mean centroid of the newest ``last`` chunks per run, in mesh_id order."""
    d = with_lookback(frames.select("run_id", "mesh_id", "cx", "cy", "cz"), ["run_id"],
                      F.floor(F.col("mesh_id") / bucket_size), ["mesh_id"], last - 1)
    w = Window.partitionBy("run_id", "_bk").orderBy("mesh_id").rowsBetween(-(last - 1), 0)
    return d.select("run_id", "mesh_id", "_halo", *[F.avg(f"c{a}").over(w).alias(f"p{a}") for a in "xyz"]) \
        .filter(~F.col("_halo")).drop("_halo")


def raw_face_delta(frames: DataFrame, mesh: str = "region", bucket_size: int = 4096) -> DataFrame:
    """Change of the face count each time a mesh is sent again."""
    d = with_lookback(frames.select("run_id", mesh, "seq", "face_count"), ["run_id", mesh],
                      F.floor(F.col("seq") / bucket_size), ["seq"], 1)
    w = Window.partitionBy("run_id", mesh, "_bk").orderBy("seq")
    d = d.withColumn("delta", F.col("face_count") - F.coalesce(F.lag("face_count").over(w), F.lit(0)))
    return d.filter(~F.col("_halo")).select("run_id", mesh, "seq", "face_count", "delta")


def latest_frame(frames: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    from meshspark.operators.merge import newest_per_region
    return newest_per_region(frames, keys, order)


def skip_unchanged(frames: DataFrame, folded: DataFrame) -> DataFrame:
    """Frames whose (mesh, vertex count, face count) signature was not folded before."""
    return frames.join(folded, ["run_id", "mesh_id", "vertex_count", "face_count"], "left_anti")


def throughput(frames: DataFrame, period: str = "1 hour") -> DataFrame:
    """Frames, bytes and distinct meshes per run, type and tumbling period."""
    return frames.groupBy("run_id", "frame_type", F.window(F.col("ts").cast("timestamp"), period).alias("w")).agg(
        F.count("*").alias("n_frames"), F.sum("bytes").alias("bytes"), F.approx_count_distinct("mesh_id").alias("meshes"))


def extrapolate(positions: Column, target: Column) -> Column:
    """Position of an unseen target from map<label, struct<x,y,z>>: one more step along its sweep.

    Two anchors continue their spacing, one anchor is taken itself; the right sweep borrows teeth 7 and 8 when it has
    no anchor of its own; no anchor gives null.
    """
    def before(seq):
        arr = F.array(*[F.lit(v).cast("bigint") for v in seq])
        at = F.array_position(arr, target)
        return F.filter(F.slice(arr, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")),
                        lambda l: F.element_at(positions, l).isNotNull())
    right = before(RIGHT_SWEEP)
    bridge = F.filter(F.array(F.lit(7).cast("bigint"), F.lit(8).cast("bigint")),
                      lambda l: F.element_at(positions, l).isNotNull())
    is_left = target.isin(LEFT_SWEEP)
    anchors = F.when(is_left, before(LEFT_SWEEP)).when(F.size(right) > 0, right).otherwise(bridge)
    n = F.size(anchors)
    last = F.element_at(positions, F.get(anchors, n - 1))
    prev = F.element_at(positions, F.get(anchors, n - 2))
    step = {a: F.when(n >= 2, last[a] + (last[a] - prev[a])).when(n == 1, last[a]) for a in "xyz"}
    return F.when(n > 0, F.struct(*[c.alias(a) for a, c in step.items()]))


def oscillation(counts: DataFrame, a: int, b: int) -> DataFrame:
    """Leader of two labels per cycle, whether it changed, and the number of changes so far."""
    lead = counts.filter(F.col("label").isin(a, b)).groupBy("run_id", "cycle") \
        .agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("leader"))
    w = Window.partitionBy("run_id").orderBy("cycle")
    d = lead.withColumn("swap", (F.col("leader") != F.lag("leader").over(w)).cast("bigint"))
    return d.withColumn("swap", F.coalesce("swap", F.lit(0))).withColumn("swaps", F.sum("swap").over(w))


def ema_by_key(scores: DataFrame, keys: list[str], order: str, value: str, alpha: float) -> DataFrame:
    """Blend with the previous cycle of the same key: alpha * raw + (1 - alpha) * previous; a missing cycle restarts.

    scores: one row per key and cycle (an integer), keys not null. A step is the affine map of the previous value, so a history is a scan of composed
    maps: prefix sums inside buckets of cycles, and between buckets the value that the bucket before hands on. A bucket that is run
    through passes on less than 1e-12 of what came in, so what two buckets hand on is all that a double can hold. No
    task holds a key: windows see one bucket, and buckets meet by number.
    """
    d = 1.0 - alpha
    if not 1e-6 <= alpha <= 1.0:
        raise ValueError("alpha must lie between 1e-6 and 1")
    length = 1 if d <= 1e-12 else max(1, math.ceil(-12.0 / math.log10(d)))
    rows = scores.select(*keys, F.col(order).alias("_o"), F.col(value).cast("double").alias("_x"), F.floor(F.col(order) / length).alias("_bk"))
    bucket = Window.partitionBy(*keys, "_bk").orderBy("_o")
    rows = rows.withColumn("_new", (F.coalesce(F.lag("_o").over(bucket) != F.col("_o") - 1, F.lit(True))).cast("int")) \
        .withColumn("_seg", F.sum("_new").over(bucket))
    seg = Window.partitionBy(*keys, "_bk", "_seg").orderBy("_o")
    j = F.row_number().over(seg) - 1
    rows = rows.withColumn("_j", j).withColumn("_x0", F.first("_x").over(seg))
    # weights grow by at most 1e12 inside a bucket
    up = F.pow(F.lit(d), -F.col("_j")) if d > 1e-12 else F.when(F.col("_j") == 0, 1.0).otherwise(0.0)
    total = F.sum(F.when(F.col("_j") > 0, up * F.col("_x")).otherwise(0.0)).over(seg.rowsBetween(Window.unboundedPreceding, 0))
    own = F.pow(F.lit(d), "_j") * (F.col("_x0") + F.lit(alpha) * F.col("_t")) if d > 1e-12 else F.col("_x")
    rows = rows.withColumn("_t", total).withColumn("_u", own)
    # what a bucket hands on: u + d^n (c - x0) if one unbroken segment of n rows leads through it, else u
    last = F.max_by(F.struct("_o", "_u", "_seg", "_j", "_x0"), "_o").alias("_l")
    handed = rows.groupBy(*keys, "_bk").agg(F.min("_o").alias("_first"), last) \
        .select(*keys, "_bk", "_first", F.col("_l._o").alias("_last"), F.col("_l._u").alias("_u"),
                F.when(F.col("_l._seg") == 1, F.pow(F.lit(d), F.col("_l._j") + 1)).otherwise(F.lit(0.0)).alias("_w"), F.col("_l._x0").alias("_x0"))
    handed = cut_lineage(handed)

    def before(table: DataFrame, carry: DataFrame) -> DataFrame:
        """The value handed on by the bucket before, where its last cycle is the one before this bucket's first."""
        c = carry.select(*keys, (F.col("_bk") + 1).alias("_bk"), (F.col("_last") + 1).alias("_first"), F.col("_c"))
        return table.join(c, [*keys, "_bk", "_first"], "left")

    once = before(handed, handed.withColumn("_c", F.col("_u")))
    once = once.withColumn("_c", F.col("_u") + F.when(F.col("_c").isNotNull(), F.col("_w") * (F.col("_c") - F.col("_x0"))).otherwise(F.lit(0.0)))
    carried = before(handed.select(*keys, "_bk", "_first"), once).filter("_c is not null").drop("_first")
    out = rows.join(carried, [*keys, "_bk"], "left")
    fix = F.when((F.col("_seg") == 1) & F.col("_c").isNotNull(), F.pow(F.lit(d), F.col("_j") + 1) * (F.col("_c") - F.col("_x0"))).otherwise(F.lit(0.0))
    return out.select(*keys, F.col("_o").alias(order), (F.col("_u") + fix).alias("blended"))


def bounds(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.groupBy(*keys).agg(*[e for a in "xyz" for e in (F.min(f"c{a}").alias(f"min_{a}"), F.max(f"c{a}").alias(f"max_{a}"))])


def margin_box(b: DataFrame, margin: float = 1.7) -> DataFrame:
    """Box grown around its centre by ``margin``; a flat side keeps a small extent."""
    new = {}
    for a in "xyz":
        mid, half = (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2.0, F.greatest((F.col(f"max_{a}") - F.col(f"min_{a}")) / 2.0, F.lit(1e-3))
        new[f"lo_{a}"], new[f"hi_{a}"] = mid - half * margin, mid + half * margin
    return b.withColumns(new)


def label_positions(counts: DataFrame, arch: str | None) -> DataFrame:
    """Centroid and text of every predicted label other than gum; no rows when the jaw is unknown."""
    from meshspark.functions.labels import label_text
    if arch is None:
        return counts.filter(F.lit(False)).select("run_id", "cycle", "label", "cx", "cy", "cz", F.lit("").alias("text"))
    return counts.filter("label <> 0").select("run_id", "cycle", "label", "cx", "cy", "cz",
                                              label_text(F.col("label"), arch).alias("text"))


def sessions(frames: DataFrame, is_reset: Column, bucket_size: int = 4096) -> DataFrame:
    """Adds ``session``: the number of coordinate-frame resets of the run up to and including the frame.

    (run_id, session) is the state key of everything that a reset clears. Running sums per bucket of ``seq``.
    """
    d = frames.withColumn("_r", is_reset.cast("bigint")).withColumn("_bk", F.floor(F.col("seq") / bucket_size))
    tot = d.groupBy("run_id", "_bk").agg(F.sum("_r").alias("_t"))
    w = Window.partitionBy("run_id").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select("run_id", "_bk", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("run_id", "_bk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("_in", F.sum("_r").over(inner)).join(tot, ["run_id", "_bk"]) \
        .select(*frames.columns, (F.col("_base") + F.col("_in")).alias("session"))


def running_bounds(per_cycle: DataFrame, bucket_size: int = 1024) -> DataFrame:
    """Bounds of all cycles of the run up to each one: bounds per bucket of cycles first, then inside the bucket."""
    sides = [(f"{m}_{a}", F.min if m == "min" else F.max, F.least if m == "min" else F.greatest) for a in "xyz" for m in ("min", "max")]
    d = per_cycle.withColumn("_bk", F.floor(F.col("cycle") / bucket_size))
    whole = d.groupBy("run_id", "_bk").agg(*[f(c).alias(c) for c, f, _ in sides])
    earlier = Window.partitionBy("run_id").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("run_id", "_bk", *[f(c).over(earlier).alias("_" + c) for c, f, _ in sides])
    inside = Window.partitionBy("run_id", "_bk").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("run_id", "_bk", "cycle", *[f(c).over(inside).alias(c) for c, f, _ in sides])
    return d.join(whole, ["run_id", "_bk"]).select("run_id", "cycle", *[join(c, "_" + c).alias(c) for c, _, join in sides])


def grow_only_fit(per_cycle: DataFrame, margin: float = 1.7) -> DataFrame:
    """View box per run and cycle: kept while everything seen so far fits, else refitted with a margin.

    per_cycle: one row of bounds per (run_id, cycle). Running bounds only grow, so the next refit of a run is the first cycle whose
    running bounds leave the current box: a keyed minimum. Each refit widens an axis by a share of the margin, so rounds are
    few (the logarithm of how far the bounds grow), and no history is gathered.
    """
    axes = "xyz"
    seen = cut_lineage(running_bounds(per_cycle))
    lo = [F.col(f"min_{a}") for a in axes]
    hi = [F.col(f"max_{a}") for a in axes]
    box = []
    for a, low, high in zip(axes, lo, hi):
        mid, half = (low + high) / 2.0, F.greatest((high - low) / 2.0, F.lit(1e-3)) * margin
        box += [(mid - half).alias(f"lo_{a}"), (mid + half).alias(f"hi_{a}")]
    bounds_at = F.struct("cycle", *lo, *hi)

    def fitted(first: DataFrame) -> DataFrame:
        return cut_lineage(first.select("run_id", "_m.*").select("run_id", F.col("cycle").alias("since"), *box))

    now = fitted(seen.groupBy("run_id").agg(F.min_by(bounds_at, "cycle").alias("_m")))
    fits = now
    while True:
        leaves = F.lit(False)
        for a in axes:
            leaves = leaves | (F.col(f"min_{a}") < F.col(f"lo_{a}")) | (F.col(f"max_{a}") > F.col(f"hi_{a}"))
        later = attach(seen, now, ["run_id"], ["cycle"]).filter((F.col("cycle") > F.col("since")) & leaves)
        now = fitted(later.groupBy("run_id").agg(F.min_by(bounds_at, "cycle").alias("_m")))
        if now.isEmpty():
            break
        fits = fits.unionByName(now)
    spans = cut_lineage(fits.withColumn("_until", F.lead("since").over(Window.partitionBy("run_id").orderBy("since"))))
    met = attach(seen, spans, ["run_id"], ["cycle"]) \
        .filter((F.col("cycle") >= F.col("since")) & (F.col("_until").isNull() | (F.col("cycle") < F.col("_until"))))
    return met.select("run_id", "cycle", (F.col("cycle") == F.col("since")).alias("refit"),
                      *[f"{n}_{a}" for a in axes for n in ("lo", "hi", "min", "max")])
