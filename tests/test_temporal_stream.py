"""Cycle logic, ordinals over hot groups, stream = batch, guidance state machine."""

import pytest
from pyspark.sql import functions as F, Window

from meshspark import catalog, fixtures
from meshspark.operators import metrics, ordinals, temporal as tp
from meshspark.streaming import guidance as gd, live


def test_streak_resets_and_confirmation_is_sticky(spark):
    n = {1: 5, 2: 5, 3: 0, 4: 5, 5: 5, 6: 5, 7: 1}
    rows = [(0, c, 3, k) for c, k in n.items() if k] + [(0, c, 9, 1) for c in n]
    counts = spark.createDataFrame(rows, "run_id bigint, cycle bigint, label bigint, n bigint")
    got = {r.label: r.confirmed_cycle for r in tp.first_confirmed(counts, 2, 3).collect()}
    assert got == {3: 6}
    run = gd.new_run()
    fresh = [gd.confirm(run, {3: k}, 2, 3) for k in n.values()]
    assert fresh == [[], [], [], [], [], [3], []]


def test_row_ordinal_equals_window_on_a_hot_group(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 5).alias("g"), (F.col("id") * 7919 % 3001).alias("o"), "id")
    a = ordinals.row_ordinal(d, ["g"], F.floor(F.col("o") / 100), ["o", "id"], "rn")
    b = d.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")))
    assert a.exceptAll(b.withColumn("rn", F.col("rn").cast("bigint"))).count() == 0


@pytest.mark.parametrize("limit", [1, 100, 999, 5000])
def test_take_smallest_is_exact(spark, limit):
    from meshspark.functions.hashing import uniform
    d = spark.range(2000).select((F.col("id") % 2).alias("g"), "id")
    got = ordinals.take_smallest(d, ["g"], uniform("t", "g", "id"), ["id"], limit, 16)
    w = Window.partitionBy("g").orderBy(uniform("t", "g", "id"), "id")
    want = d.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit).drop("r")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_lookback_reaches_over_sparse_buckets(spark):
    d = spark.createDataFrame([(0, o) for o in (1, 2, 50, 51, 200, 900)], "g bigint, o bigint")
    w = Window.partitionBy("g", "_bk").orderBy("o").rowsBetween(-3, 0)
    got = ordinals.with_lookback(d, ["g"], F.floor(F.col("o") / 10), ["o"], 3).withColumn("s", F.sum("o").over(w)).filter(~F.col("_halo"))
    assert {r.o: r.s for r in got.collect()} == {1: 1, 2: 3, 50: 53, 51: 104, 200: 303, 900: 1201}


def test_exact_median(spark):
    d = spark.createDataFrame([("a", float(v)) for v in (5, 1, 3)] + [("b", float(v)) for v in (4, 1, 2, 9)] + [("c", 7.0)], "k string, v double")
    assert {r.k: r.median for r in ordinals.exact_median(d, ["k"], "v", 8).collect()} == {"a": 3.0, "b": 3.0, "c": 7.0}


def test_sweep_needs_confirmation_arrival_and_movement():
    centres = {8: (0.0, 0.0, 0.0), 7: (10.0, 0.0, 0.0), 6: (20.0, 0.0, 0.0)}
    seq, s = (8, 7, 6), gd.new_sweep()
    assert gd.advance(seq, s, {7, 6}, centres, (0.5, 0, 0), 2.0, 4.0) == 8     # not confirmed
    assert gd.advance(seq, s, {8, 7, 6}, centres, (0.5, 0, 0), 2.0, 4.0) == 7
    assert gd.advance(seq, s, {8, 7, 6}, centres, (0.6, 0, 0), 2.0, 4.0) == 7  # seen is not reached
    assert gd.advance(seq, s, {8, 7, 6}, centres, (25.0, 0, 0), 3.0, 4.0) == 6  # one waypoint per cycle, passed
    assert gd.advance(seq, s, {8, 7, 6}, centres, (25.5, 0, 0), 3.0, 4.0) == 6  # no movement
    assert gd.advance(seq, s, {8, 7, 6}, centres, (float("nan"), 0, 0), 3.0, 4.0) == 6
    assert gd.advance(seq, s, {8, 7, 6}, centres, (31.0, 0, 0), 3.0, 4.0) is None


def test_stream_results_equal_batch(spark, sf):
    q = catalog.QUERIES
    a, b = q["stream_claim"](spark, sf), q["claim_voxels"](spark, sf)
    assert a.select(*b.columns).exceptAll(b).count() == 0 and a.count() == b.count()
    s, g = q["stream_waypoints"](spark, sf), q["guidance_replay"](spark, sf)
    assert s.select(*g.columns).exceptAll(g).count() == 0 and s.count() == g.count()


def test_second_delivery_adds_nothing(spark, sf):
    rows = catalog.QUERIES["stream_fold_once"](spark, sf).collect()
    assert len(rows) == 1 and rows[0].n_kept > 0


def test_gamma_zero_is_cross_entropy_and_ignored_rows_leave(spark):
    d = spark.createDataFrame([(0, [2.0, 0.0]), (1, [2.0, 0.0]), (-100, [0.0, 9.0])], "target bigint, logits array<double>")
    import math
    ce = (math.log(1 + math.exp(-2)) + math.log(1 + math.exp(2))) / 2
    r = metrics.focal_loss(d, gamma=0.0).first()
    assert r.n == 2 and abs(r.loss - ce) < 1e-9
    w = metrics.focal_loss(d, gamma=0.0, alpha=[5.0, 5.0]).first()
    assert abs(w.loss - 5 * ce) < 1e-9


def test_macro_iou_counts_predicted_only_classes_as_zero(spark):
    d = spark.createDataFrame([(0, 0), (0, 0), (0, 2)], "gt bigint, pred bigint")
    r = metrics.scores(metrics.confusion(d, []), []).first()
    assert abs(r.macro_iou - (2 / 3 + 0) / 2) < 1e-9


def test_gum_smoothing_blends_near_faces_only(spark):
    s = "run_id bigint, fid bigint, x double, y double, z double, r bigint, g bigint, b bigint"
    one = live.smooth_gum(spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 200, 100, 100), (0, 2, 9.0, 0.0, 0.0, 100, 100, 100)], s), None)
    assert {r.fid: r.score for r in one.collect()} == {1: 1.0, 2: 0.0}
    two = live.smooth_gum(spark.createDataFrame([(0, 5, 0.4, 0.0, 0.0, 100, 100, 100), (0, 6, 30.0, 0.0, 0.0, 200, 100, 100)], s), one)
    got = {r.fid: (round(r.score, 9), r.is_gum) for r in two.collect()}
    assert got == {5: (0.7, True), 6: (1.0, True)}
