"""User-level jobs composed of the operators: cache building, patch sampling, graphs, reports, the live cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshspark.functions.vectors import Vec
from meshspark.operators import augment, colour_reports, mesh, metrics, normalise as nz, patches as pt, sampling, spatial, temporal
from meshspark.operators.transfer import transfer_nearest
from meshspark.session import cut_lineage
from meshspark.sources import cache, mesh_text


def build_cache(spark: SparkSession, raw: str, path: str, target_density: float = 5.0, max_target_count: int | None = 16000) -> DataFrame:
    """Raw meshes and sidecars to density-normalised labelled faces, appended to the table; returns the skipped ids.

    Meshes already stored are left out before any geometry is computed.
    """
    cache.guard_config(spark, path, target_density, max_target_count)
    v, f, skipped = mesh_text.labelled_faces(spark, raw)
    if cache.table_exists(spark, path):
        have = spark.read.parquet(path).select("arch_id").distinct()
        v, f = v.join(have, "arch_id", "left_anti"), f.join(have, "arch_id", "left_anti")
    v, f = cut_lineage(v), cut_lineage(f)
    g = mesh.face_geometry(f, v)
    rv, rf = mesh.reduce_density(g, v, target_density, max_target_count, floor=1)
    plan = g.groupBy("arch_id").agg(F.sum("area").alias("_area")) \
        .withColumn("target", mesh.target_count(F.col("_area"), target_density, max_target_count))
    rf = sampling.trim_to_target(rf.join(plan.select("arch_id", "target"), "arch_id")).drop("target")
    # a mesh below its target is filled up with faces without area at its first vertex
    short = rf.groupBy("arch_id").agg(F.count("*").alias("n_faces"), F.max("fid").alias("max_fid")) \
        .join(plan.select("arch_id", F.col("target").cast("bigint").alias("target")), "arch_id")
    at_first = rv.groupBy("arch_id").agg(F.min("vid").alias("_v")).join(short.select("arch_id", "max_fid"), "arch_id")
    rf = cut_lineage(mesh.pad_faces(rf, cut_lineage(short)).join(at_first, "arch_id").select("arch_id", "fid", *[
        F.when(F.col("fid") > F.col("max_fid"), F.col("_v")).otherwise(F.col(f"v{i}")).alias(f"v{i}") for i in range(3)]))
    rg = cut_lineage(mesh.face_geometry(rf, rv))
    at = [F.col("m" + a).alias(a) for a in "xyz"]
    cell = 1.0 / target_density ** 0.5
    lab = transfer_nearest(rg.select("arch_id", "fid", *at), g.select("arch_id", F.col("fid").alias("sid"), "label", *at),
                           ["label"], cell).select("arch_id", "fid", "label")
    moved = nz.move_to_origin(rv)
    geom = mesh.face_geometry(rf.join(lab, ["arch_id", "fid"]), moved)
    out = nz.with_corner_normals(geom, mesh.vertex_normals(geom))
    cache.append_new(out, path)
    return skipped


def sample_patches(geom: DataFrame, adjacency: DataFrame, seed: str, epochs: int = 1, midline_prob: float = 0.0,
                   whole_tooth_prob: float = 0.0, is_train: bool = True, width: float = 14.0, height: float = 14.0,
                   slab: float = 16.0, midline_size: tuple[float, float] = (8.0, 22.0)) -> DataFrame:
    """One sampled patch per mesh and epoch: (patch_id, arch_id, fid, stage, mode)."""
    present = pt.present_labels(geom)
    drawn = pt.draw_patches(present, seed, epochs)
    p = cut_lineage(pt.choose_mode(drawn, present, seed, whole_tooth_prob, midline_prob, is_train))
    # the stage is drawn from the visits, and geometry is computed for visits up to it only
    of = lambda mode: p.filter(F.col("mode") == mode)
    sweep = cut_lineage(pt.up_to_drawn(pt.sweep_visits(of("sweep"), present), seed))
    stages = pt.sweep_stages(sweep, geom, adjacency, width, height, slab).select("patch_id", "arch_id", "fid", "stage")
    if whole_tooth_prob > 0:
        whole = cut_lineage(pt.up_to_drawn(pt.whole_tooth_visits(of("whole_tooth"), present), seed))
        stages = stages.unionByName(pt.whole_tooth_stages(p, geom, visits=whole))
    if midline_prob > 0:
        mid = cut_lineage(pt.up_to_drawn(pt.midline_visits(of("midline")), seed))
        stages = stages.unionByName(pt.midline_stages(pt.fr.tooth_frames(geom), geom, adjacency, *midline_size, slab=slab, visits=mid))
    return stages.join(p.select("patch_id", "mode"), "patch_id") \
        .select("patch_id", "arch_id", "fid", "stage", "mode")


def patch_features(patch: DataFrame, geom: DataFrame, normals: DataFrame, adjacency: DataFrame, max_faces: int | None,
                   colour: str | None = None, augmented: bool = True, dropout: float = 0.0,
                   num_classes: int = 17, seed: str = "aug") -> DataFrame:
    """Samples ready for a network: (patch_id, fid, label, x, area_mm2, n_capped).

    ``max_faces`` is the caller's (None: no cap); n_capped says how many faces it cut from the patch.

    Dropout of faces, then the patch area, then the cap, shared-vertex noise, features, colour: in that order, so
    the area ignores noise and cap.
    """
    from meshspark.functions.labels import label_to_coarse
    if num_classes not in (5, 17):
        raise ValueError(f"num_classes must be 5 or 17, not {num_classes}")
    if dropout > 0 and colour is None:
        raise ValueError("colour dropout needs a colour style")
    p = patch.select("patch_id", "arch_id", "fid")
    if augmented:
        p = augment.drop_faces(p, adjacency, seed)
    full = cut_lineage(nz.with_corner_normals(geom, normals).join(p, ["arch_id", "fid"]))
    cut = F.greatest(F.count("*") - F.lit(max_faces), F.lit(0)) if max_faces is not None else F.lit(0)
    area = full.groupBy("patch_id").agg(F.sum("area").alias("area_mm2"), cut.cast("bigint").alias("n_capped"))
    # the cap draws from ids alone, so it comes before the noise: draws are made once, for the faces that stay
    d = full if max_faces is None else sampling.cap_faces(full, max_faces)
    if augmented:
        noise = {}
        for i, c in enumerate("pqr"):
            for a in "xyz":
                s = F.lit(0.15) * augment.uniform(f"{seed}/pos/sigma", "patch_id")
                noise[f"{c}{a}"] = F.col(f"{c}{a}") + s * augment.gaussian(f"{seed}/pos/{a}", "patch_id", f"v{i}")
        d = d.withColumns(noise).withColumns({f"m{a}": (F.col("p" + a) + F.col("q" + a) + F.col("r" + a)) / 3.0 for a in "xyz"})
        d = augment.jitter_normals(d, "fid", seed=f"{seed}/fn")
        for i, c in enumerate("pqr"):
            d = d.withColumnsRenamed({f"n{a}": f"_k{a}" for a in "xyz"}).withColumnsRenamed({f"{c}n{a}": f"n{a}" for a in "xyz"})
            d = augment.jitter_normals(d, f"v{i}", seed=f"{seed}/vn")
            d = d.withColumnsRenamed({f"n{a}": f"{c}n{a}" for a in "xyz"}).withColumnsRenamed({f"_k{a}": f"n{a}" for a in "xyz"})
        d = cut_lineage(d)
    d = nz.normalise_patch(d)
    if colour:
        d = augment.paint(d, colour)
        if dropout > 0:
            d = augment.drop_colour(d, dropout)
    label = F.col("label") if num_classes == 17 else label_to_coarse(F.col("label"))
    x = nz.feature_row(("r", "g", "b") if colour else None)
    return d.select("patch_id", "fid", label.alias("label"), x.alias("x")).join(area, "patch_id")


def neighbour_graph(points: DataFrame, k: int = 32, dilations: tuple[int, ...] = (200, 900, 1800), cell: float = 0.03,
                    group: str = "patch_id", pid: str = "fid") -> tuple[DataFrame, DataFrame]:
    """(local edges, dilated edges) of every patch from one shared ranking. points: (group, pid, x, y, z)."""
    q = points.withColumnRenamed(pid, "qid")
    ranked = cut_lineage(spatial.nearest(q, points, max(k + 1, *dilations), cell, group, "qid", pid))
    local = ranked.filter(F.col(pid) != F.col("qid"))
    shift = F.when(F.col("rank") > F.coalesce(F.col("_self"), F.lit(1 << 40)), F.col("rank") - 1).otherwise(F.col("rank"))
    own = ranked.filter(F.col(pid) == F.col("qid")).select(group, "qid", F.col("rank").alias("_self"))
    local = local.join(own, [group, "qid"], "left").withColumn("rank", shift).filter(F.col("rank") <= k).drop("_self")
    return local, sampling.dilated_neighbours(ranked, points, k, list(dilations), group, "qid", pid)


def full_sequence(geom: DataFrame, adjacency: DataFrame, seed: str, **size) -> DataFrame:
    """All stages of every mesh at the fixed alignment 0.6, nothing augmented: each face at its first stage.

    A stage that adds no face has one row without a face, so the sequence is complete.
    """
    present = pt.present_labels(geom)
    p = pt.draw_patches(present, seed, occlusality=None, fixed_occlusality=0.6)
    visits = cut_lineage(pt.sweep_visits(p, present))
    faces = pt.sweep_stages(visits, geom, adjacency, **size).drop("arch_id")
    return visits.select("patch_id", "arch_id", "stage", "phase", "tooth") \
        .join(faces, ["patch_id", "stage", "phase", "tooth"], "left").select("patch_id", "arch_id", "fid", "stage", "phase", "tooth")


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """Accuracy and macro IoU per threshold configuration, overall and per area bucket. scored: (config, area_mm2, gt, pred)."""
    s = scored.withColumn("bucket", metrics.area_bucket(F.col("area_mm2")))
    c = metrics.confusion_sets(s, [["config"], ["config", "bucket"]], ["config", "bucket"]) \
        .withColumn("bucket", F.coalesce("bucket", F.lit("all")))
    return metrics.scores(c, ["config", "bucket"])


def prediction_report(scored: DataFrame) -> DataFrame:
    """Per patch: accuracy, macro IoU, faces, area. scored: (patch_id, gt, pred, area)."""
    s = metrics.scores(metrics.confusion(scored, ["patch_id"]), ["patch_id"])
    return s.join(scored.groupBy("patch_id").agg(F.sum("area").alias("area_mm2")), "patch_id")


def scatter_prediction(faces: DataFrame, predicted: DataFrame) -> DataFrame:
    """Whole-mesh labels with the patch prediction written over them, plus a ``correct`` flag on predicted faces."""
    d = faces.join(predicted.select("arch_id", "fid", "pred"), ["arch_id", "fid"], "left")
    return d.withColumn("shown", F.coalesce("pred", "label")).withColumn("correct", F.col("pred") == F.col("label"))


def snapshot_evolution(snapshots: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per-cycle table, vertices projected on the two main axes fitted to each run's largest snapshot)."""
    table = snapshots.select("run_id", "cycle", "area_mm2", "gates", "raw_faces", "guidance_state", "guidance_distance_mm")
    size = vertices.groupBy("run_id", "cycle").agg(F.count("*").alias("n"))
    largest = size.groupBy("run_id").agg(F.max_by("cycle", F.struct("n", "cycle")).alias("cycle"))
    axes = nz.principal_axes(nz.covariance(vertices.join(largest, ["run_id", "cycle"], "left_semi"), ["run_id"]), ["run_id"])
    d = vertices.join(axes.select("run_id", *[f"e{r}{a}" for r in (1, 2) for a in "xyz"]), "run_id")
    p = Vec.cols("")
    return table, d.select("run_id", "cycle", "vid", p.dot(Vec.cols("e1")).alias("u"), p.dot(Vec.cols("e2")).alias("v"))


def colour_report(faces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statistics per run, pooled statistics, sentinel share per run). faces: (run_id, label, r, g, b)."""
    d = faces.withColumn("is_gum", F.col("label") == 0)
    return colour_reports.colour_stats(d, ["run_id"]), colour_reports.colour_stats(d, []), \
        colour_reports.sentinel_share(d, ["run_id"])


def guidance_report(counts: DataFrame, min_faces: int = temporal.MIN_FACES, cycles: int = temporal.CONFIRM_CYCLES) -> dict[str, DataFrame]:
    """Both confirmation rules replayed: first cycles, transitions and transition counts."""
    c = cut_lineage(counts)
    logs = {r: temporal.transitions(temporal.regimen(c, r, min_faces, cycles), ["stage", "target"]) for r in ("single", "sustained")}
    flips = [logs[r].groupBy("run_id").agg((F.count("*") - 1).alias("changes")).withColumn("rule", F.lit(r)) for r in logs]
    return {"labels": temporal.compare_rules(c, min_faces, cycles), **logs, "changes": flips[0].unionByName(flips[1])}


def redness_threshold(faces: DataFrame) -> DataFrame:
    from meshspark.functions import colour as col
    real = faces.filter(~col.is_sentinel(F.col("r"), F.col("g"), F.col("b"))).withColumn("pool", F.lit("all"))
    return colour_reports.otsu_threshold(real, ["pool"], col.redness(F.col("r"), F.col("g"), F.col("b")))


def experiment_board(runs: DataFrame, anchor: int, budget: int) -> DataFrame:
    return metrics.leaderboard(runs, anchor, budget)


def live_inputs(accumulated: DataFrame, max_faces: int) -> DataFrame:
    """Network input of a live cycle: capped faces per run with features; the area is that of the capped faces.

    accumulated: face geometry with corner normals keyed by run_id, as ``patch_id``.
    """
    d = cut_lineage(sampling.cap_faces(accumulated, max_faces))
    area = d.groupBy("patch_id").agg(F.sum("area").alias("area_mm2"))
    rgb = ("r", "g", "b") if {"r", "g", "b"} <= set(accumulated.columns) else None
    return nz.normalise_patch(d).select("patch_id", "fid", nz.feature_row(rgb).alias("x")).join(area, "patch_id")


def live_cycle(spark: SparkSession, fold, frames: DataFrame, batch_id: int, score, snapshot_path: str, max_faces: int, every: int = 1) -> DataFrame:
    """One micro-batch of a live run: fold chunks, read the accumulated mesh, score, derive label counts, snapshot.

    ``score`` is a DataFrame -> DataFrame function that adds ``pred`` to (patch_id, fid, ...). Use as a foreachBatch body.
    """
    from meshspark.sources import snapshots
    fold(frames, batch_id)
    acc = fold.accumulated(spark).withColumn("patch_id", F.col("run_id"))
    acc = acc.withColumn("fid", F.xxhash64("mesh_id", "fid"))
    pred = score(sampling.cap_faces(acc, max_faces))
    counts = pred.groupBy("run_id", F.lit(batch_id).cast("bigint").alias("cycle"), F.col("pred").alias("label")).agg(
        F.count("*").alias("n"), F.sum("area").alias("area_mm2"), *[F.avg("m" + a).alias("c" + a) for a in "xyz"])
    counts = cut_lineage(counts)
    snapshots.write_snapshots(counts, snapshot_path, every, batch_id)
    return counts
