"""Evaluation: confusion, IoU, class weights, focal loss, leaderboards, coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshspark.operators.ordinals import attach, exact_median


def class_counts(df: DataFrame, keys: list[str], label: str, n_classes: int) -> DataFrame:
    """Counts with every class 0..n-1 present. Pivoted conditional sums: one partial aggregate, no join."""
    sums = [F.count(F.when(F.col(label) == c, 1)).alias(f"_c{c}") for c in range(n_classes)]
    wide = df.groupBy(*keys).agg(*sums)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).cast("bigint").alias(label), F.col(f"_c{c}").alias("n"))
                                for c in range(n_classes)])).alias("e")
    return wide.select(*keys, pairs).select(*keys, "e.*")


def coverage_share(extent: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Share of faces and area of an extent (keys, fid, area) that a subset (keys, fid) covers."""
    d = extent.join(covered.select(*keys, "fid", F.lit(True).alias("_in")), [*keys, "fid"], "left")
    hit = F.col("_in").isNotNull()
    return d.groupBy(*keys).agg(
        F.count(F.when(hit, 1)).alias("n_faces"), (F.count(F.when(hit, 1)) / F.count("*")).alias("face_share"),
        (F.coalesce(F.sum(F.when(hit, F.col("area"))), F.lit(0.0)) / F.sum("area")).alias("area_share"))


def area_bucket(area: Column) -> Column:
    return F.when((area >= 0) & (area < 100), "0-100").when((area >= 100) & (area < 400), "100-400") \
        .when(area >= 400, "400+").otherwise("unknown")


def area_gates(area: Column, thresholds: list[float], gating: bool = True) -> Column:
    """One boolean per threshold; all open without gating or without an area."""
    return F.array(*[(F.coalesce(area >= F.lit(float(t)), F.lit(True)) if gating else F.lit(True)) for t in thresholds])


def argmax_label(logits: Column) -> Column:
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("bigint")


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return F.transform(logits, lambda v: v - top - F.log(total))


def confusion(df: DataFrame, keys: list[str], gt: str = "gt", pred: str = "pred") -> DataFrame:
    return df.groupBy(*keys, F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_sets(df: DataFrame, sets: list[list[str]], dims: list[str]) -> DataFrame:
    """Confusions of several groupings in one pass (grouping sets over ``dims`` plus gt, pred)."""
    full = [[F.col(c) for c in (*s, "gt", "pred")] for s in sets]
    return df.groupingSets(full, *[F.col(c) for c in (*dims, "gt", "pred")]) \
        .agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


def per_class(conf: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, IoU, Dice, precision, recall per class that occurs in truth or prediction."""
    sides = F.explode(F.array(
        F.struct(F.col("gt").alias("cls"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"), F.when(F.col("gt") != F.col("pred"), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(F.col("gt") != F.col("pred"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("bigint").alias("fn"))))
    c = conf.select(*keys, sides.alias("s")).groupBy(*keys, F.col("s.cls").alias("cls")) \
        .agg(*[F.sum(f"s.{k}").alias(k) for k in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns({"iou": F.try_divide(tp, tp + fp + fn), "dice": F.try_divide(2 * tp, 2 * tp + fp + fn),
                          "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn)})


def scores(conf: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy and macro IoU per group; classes without any union stay out, classes only predicted count as 0."""
    k = keys or [F.lit(1).alias("_all")]
    c = per_class(conf, keys)
    iou = c.groupBy(*keys).agg(F.avg(F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, F.col("iou"))).alias("macro_iou"),
                               (F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("acc"),
                               F.sum(F.col("tp") + F.col("fn")).alias("n_faces"))
    return iou


def class_alpha(counts: DataFrame, mode: str = "inverse", cap: float | None = None, label: str = "label",
                n: str = "n") -> DataFrame:
    """Class weights with mean 1: inverse (or square-root inverse, or capped) frequency, counts floored at 1.

    counts: one row per class, so the closing aggregate is tiny.
    """
    if mode == "capped" and cap is None:
        raise ValueError("capped weights need a cap")
    floor = F.greatest(F.col(n).cast("double"), F.lit(1.0))
    raw = {"inverse": 1.0 / floor, "sqrt": 1.0 / F.sqrt(floor), "capped": 1.0 / floor}[mode]
    d = counts.groupBy(label).agg(F.sum(n).alias(n)).withColumn("_a", raw)
    if mode == "capped":
        low = d.agg(F.min("_a").alias("_lo"))
        d = d.join(F.broadcast(low)).withColumn("_a", F.least("_a", F.col("_lo") * F.lit(float(cap)))).drop("_lo")
    total = d.agg(F.sum("_a").alias("_s"), F.count("*").alias("_k"))
    return d.join(F.broadcast(total)).select(label, F.col(n), (F.col("_a") * F.col("_k") / F.col("_s")).alias("alpha"))


def focal_rows(df: DataFrame, gamma: float = 2.0, alpha: list[float] | None = None, ignore_index: int = -100) -> DataFrame:
    """Per-row focal loss of (logits, target); rows with the ignored target are left out. gamma 0 is cross-entropy."""
    d = df.filter(F.col("target") != ignore_index).withColumn("_lp", log_softmax(F.col("logits")))
    d = d.withColumn("log_pt", F.element_at("_lp", F.col("target").cast("int") + 1)).withColumn("pt", F.exp("log_pt"))
    loss = -F.pow(F.greatest(1.0 - F.col("pt"), F.lit(0.0)), F.lit(float(gamma))) * F.col("log_pt")
    if alpha is not None:
        loss = loss * F.element_at(F.array(*[F.lit(float(a)) for a in alpha]), F.col("target").cast("int") + 1)
    return d.withColumn("loss", loss).drop("_lp")


def focal_loss(df: DataFrame, reduction: str = "mean", **kw) -> DataFrame:
    if reduction not in ("mean", "sum", "none"):
        raise ValueError(f"unknown reduction {reduction!r}")
    rows = focal_rows(df, **kw)
    if reduction == "none":
        return rows
    return rows.agg((F.avg if reduction == "mean" else F.sum)("loss").alias("loss"), F.count("*").alias("n"))


def class_presence(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: classes in truth and prediction, area right, area of classes absent from the truth."""
    conf = df.groupBy(*keys, "gt", "pred").agg(F.sum("area").alias("a"))
    seen = conf.groupBy(*keys).agg(F.collect_set("gt").alias("_gt"), F.collect_set("pred").alias("_pred"),
                                   F.sum(F.when(F.col("gt") == F.col("pred"), F.col("a")).otherwise(0.0)).alias("true_area"))
    absent = conf.join(seen.select(*keys, "_gt"), keys).groupBy(*keys).agg(
        F.sum(F.when(~F.array_contains("_gt", F.col("pred")), F.col("a")).otherwise(0.0)).alias("false_area"))
    return seen.join(absent, keys).select(*keys, F.size("_gt").cast("bigint").alias("n_true"),
                                          F.size("_pred").cast("bigint").alias("n_pred"), "true_area", "false_area")


def leaderboard(runs: DataFrame, anchor: int, budget: int, last: int = 20) -> DataFrame:
    """Per run: best metric and its epoch, final, mean of the last epochs, best within a budget, delta to the anchor.

    All of it comes from keyed aggregates; only run-level rows meet the anchor.
    """
    ends = runs.groupBy("run_id").agg(F.max("epoch").alias("last_epoch"))
    top = F.struct("metric", (-F.col("epoch")).alias("e"))
    a = runs.groupBy("run_id").agg(
        F.max(top).alias("_b"), F.max_by("metric", "epoch").alias("final"), F.count("*").alias("epochs"),
        F.max(F.when(F.col("epoch") <= budget, F.col("metric"))).alias("budget_best"))
    tail = attach(runs, ends, ["run_id"], ["epoch"]).filter(F.col("epoch") > F.col("last_epoch") - last).groupBy("run_id") \
        .agg(F.avg("metric").alias("tail_mean"))
    d = a.join(tail, "run_id").select("run_id", "epochs", F.col("_b.metric").alias("best"), (-F.col("_b.e")).alias("best_epoch"),
                                      "final", "tail_mean", "budget_best")
    base = d.filter(F.col("run_id") == anchor).select(F.col("best").alias("_base"))
    return d.join(F.broadcast(base), how="left").withColumn("delta", F.col("best") - F.col("_base")).drop("_base")


def fold_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and spread over every combination of keys (cube)."""
    return df.cube(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))


def timing_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    d = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.count("*").alias("n"))
    return d.join(exact_median(df, keys, value), keys)


def split_audit(cases: DataFrame) -> DataFrame:
    """cases: (case, split). Per pair of splits: how many cases occur in both."""
    per = cases.distinct().groupBy("case").agg(F.array_sort(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return per.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("split_a"), F.col("p.b").alias("split_b")) \
        .agg(F.count("*").alias("n_cases"))
