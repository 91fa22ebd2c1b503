"""Patch generation: footprints, nested sweeps, whole-tooth growth, midline growth, sampling of stages and modes.

A patch is a set of rows (patch_id, arch_id, fid) with the first stage at which a face is seen, so nested masks are
stored once: stage i holds the faces with stage <= i.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshspark.functions.hashing import uniform
from meshspark.functions.labels import INCISORS
from meshspark.functions.vectors import linspace
from meshspark.operators import frames as fr
from meshspark.operators.ordinals import attach
from meshspark.operators.graph import choose_component, grow_coverage, set_components
from meshspark.operators.spatial import any_within, in_boxes
from meshspark.session import cut_lineage

PHASES = ("occlusal", "facial", "lingual")
TIE_DIGITS = 8  # squared distances that agree to so many digits are a tie


def present_labels(faces: DataFrame, teeth_only: bool = True) -> DataFrame:
    d = faces.filter(F.col("label").between(1, 16)) if teeth_only else faces
    return d.select("arch_id", "label").distinct()


def draw_patches(present: DataFrame, seed: str, epochs: int = 1, occlusality: tuple[float, float] | None = (0.2, 0.8),
                 fixed_occlusality: float = 0.6) -> DataFrame:
    """One patch per arch and epoch with its draws: seed tooth, side order, wall direction, alignment limit.

    Arches without an incisor give no patch.
    """
    one = present.filter(F.col("label").isin(INCISORS)) \
        .select("arch_id", "label", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    pick = one.groupBy("arch_id", "epoch").agg(
        F.min_by("label", F.struct(uniform(f"{seed}/tooth", "arch_id", "epoch", "label"), "label")).alias("seed_label"))
    low = F.lit(fixed_occlusality) if occlusality is None else \
        F.lit(occlusality[0]) + F.lit(occlusality[1] - occlusality[0]) * uniform(f"{seed}/occ", "arch_id", "epoch")
    return pick.select(
        F.concat_ws(":", F.col("arch_id").cast("string"), F.col("epoch").cast("string")).alias("patch_id"),
        "arch_id", F.col("epoch").cast("bigint").alias("epoch"), "seed_label",
        (uniform(f"{seed}/side", "arch_id", "epoch") < 0.5).alias("low_side_first"),
        (uniform(f"{seed}/end", "arch_id", "epoch") < 0.5).alias("from_low_end"), low.alias("min_align"))


def seed_order(patches: DataFrame, present: DataFrame) -> DataFrame:
    """Visits (patch..., tooth, step): the seed, then one whole side outwards, then the other. At most 16 rows each."""
    d = patches.join(present.withColumnRenamed("label", "tooth"), "arch_id")
    low = F.col("tooth") < F.col("seed_label")
    side = F.when(F.col("tooth") == F.col("seed_label"), 0).when(low == F.col("low_side_first"), 1).otherwise(2)
    w = Window.partitionBy("patch_id").orderBy(side, F.abs(F.col("tooth") - F.col("seed_label")))
    return d.withColumn("step", F.row_number().over(w).cast("bigint") - 1)


def end_order(patches: DataFrame, present: DataFrame) -> DataFrame:
    """Visits over the present teeth from one end of the arch to the other."""
    d = patches.join(present.withColumnRenamed("label", "tooth"), "arch_id")
    key = F.when(F.col("from_low_end"), F.col("tooth")).otherwise(-F.col("tooth"))
    w = Window.partitionBy("patch_id").orderBy(key)
    return d.withColumn("step", F.row_number().over(w).cast("bigint") - 1)


def sweep_visits(patches: DataFrame, present: DataFrame, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """(patch_id, arch_id, min_align, stage, phase, tooth): occlusal from the seed, then the walls end to end."""
    keep = ["patch_id", "arch_id", "min_align", "tooth", "step"]
    n = present.groupBy("arch_id").agg(F.count("*").alias("n_teeth"))
    out = None
    for i, phase in enumerate(phases):
        order = seed_order if phase == "occlusal" else end_order
        v = order(patches, present).select(*keep).join(n, "arch_id").select(
            "patch_id", "arch_id", "min_align", (F.col("step") + i * F.col("n_teeth")).alias("stage"),
            F.lit(phase).alias("phase"), "tooth")
        out = v if out is None else out.unionByName(v)
    return out


def _viewing_axis(facial: DataFrame) -> DataFrame:
    """Frames once per phase with the viewing axis w* (normal, facial or its negation)."""
    rows = []
    for phase in PHASES:
        axis, sign = {"occlusal": ("n", 1.0), "facial": ("f", 1.0), "lingual": ("f", -1.0)}[phase]
        rows.append(F.struct(F.lit(phase).alias("phase"),
                             *[(F.col(f"{axis}{a}") * sign).alias(f"w{a}") for a in "xyz"]))
    cols = ["arch_id", F.col("label").alias("tooth"), *[f"{p}{a}" for p in "ot" for a in "xyz"]]
    return facial.select(*cols, F.explode(F.array(*rows)).alias("_k")).select("*", "_k.*").drop("_k")


def footprints(boxes: DataFrame, geom: DataFrame, adjacency: DataFrame, min_faces: int = 5, digits: int | None = None) -> DataFrame:
    """(fp, arch_id, fid) of each box: eligible faces, their components, the component nearest to the origin (squared distances at ``digits``)."""
    slim = geom.select("arch_id", "fid", *[f"{p}{a}" for p in "mn" for a in "xyz"])
    # the boxes are one small row per footprint; written once so that their long expressions are not inlined
    hit = cut_lineage(in_boxes(slim, cut_lineage(boxes)).select("fp", "arch_id", "fid", "d2"))
    comp = set_components(hit, adjacency, "fp")
    return choose_component(comp, min_faces, "fp", digits).select("fp", "arch_id", "fid")


def sweep_stages(visits: DataFrame, geom: DataFrame, adjacency: DataFrame, width: float = 14.0, height: float = 14.0,
                 slab: float = 16.0, min_faces: int = 5) -> DataFrame:
    """Nested sweep masks (patch_id, arch_id, fid, stage, phase, tooth): each face at its first stage.

    Of components whose nearest faces are equally far from the origin (squared distance to ``TIE_DIGITS`` digits) that with the smaller face id counts.
    """
    f = fr.facial_directions(fr.tangent_axes(fr.tooth_frames(geom)), fr.arch_centers(geom))
    d = visits.join(_viewing_axis(f), ["arch_id", "tooth", "phase"])
    fp = F.concat_ws("/", "patch_id", F.col("stage").cast("string")).alias("fp")
    boxes = fr.view_boxes(d.select("*", fp), "w", width, height, slab, F.col("min_align"))
    seen = footprints(boxes, geom, adjacency, min_faces, TIE_DIGITS)
    keyed = seen.join(visits.select("patch_id", "stage", "phase", "tooth", fp), "fp")
    return first_stage(keyed, ["phase", "tooth"])


def first_stage(seen: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Accumulated masks: the smallest stage per (patch, face). A keyed minimum replaces the running union."""
    best = F.min(F.struct("stage", *carry)).alias("_s")
    return seen.groupBy("patch_id", "arch_id", "fid").agg(best).select("patch_id", "arch_id", "fid", "_s.*")


def midline_stages(frames: DataFrame, geom: DataFrame, adjacency: DataFrame, min_size: float = 8.0,
                   max_size: float = 22.0, n_stages: int = 8, slab: float = 16.0, min_align=0.6,
                   min_faces: int = 5, tooth_a: int = 8, tooth_b: int = 9, visits: DataFrame | None = None) -> DataFrame:
    """Square footprints of growing size on the boundary of two teeth: (patch_id, arch_id, fid, stage).

    visits: (patch_id, arch_id, stage, min_align), e.g. of ``midline_visits``, where several patches share a mesh or each has drawn
    its own alignment and stage; without it, one patch per mesh with all stages at ``min_align``.
    """
    m = fr.midline_frames(frames, tooth_a, tooth_b)
    if visits is None:
        visits = midline_visits(m.select(F.col("arch_id").cast("string").alias("patch_id"), "arch_id", F.lit(float(min_align)).alias("min_align")), n_stages)
    m = m.join(visits, "arch_id") \
        .withColumn("size", linspace(min_size, max_size, n_stages, F.col("stage"))) \
        .withColumn("fp", F.concat_ws("/", "patch_id", F.col("stage").cast("string")))
    m = m.withColumnsRenamed({f"n{a}": f"w{a}" for a in "xyz"})
    boxes = fr.view_boxes(m, "w", F.col("size"), F.col("size"), slab, F.col("min_align"))
    seen = footprints(boxes.drop("size", "patch_id", "stage"), geom, adjacency, min_faces)
    keyed = seen.join(m.select("fp", "patch_id", F.col("stage").cast("bigint").alias("stage")), "fp")
    return first_stage(keyed)


def midline_visits(patches: DataFrame, n_stages: int = 8) -> DataFrame:
    """(patch_id, arch_id, min_align, stage) of growing midline patches."""
    return patches.select("patch_id", "arch_id", "min_align", F.explode(F.sequence(F.lit(0), F.lit(n_stages - 1))).alias("stage"))


def dilate_teeth(geom: DataFrame, margin: float = 1.5) -> DataFrame:
    """(arch_id, tooth, fid): faces of each tooth plus every face within ``margin`` of one, by centroid.

    Done once per tooth; unions of teeth are unions of these rows.
    """
    own = geom.filter(F.col("label").between(1, 16)).select("arch_id", F.col("label").alias("tooth"), "fid")
    if margin <= 0:
        return own
    from meshspark.operators.spatial import pairs_cells
    return own.unionByName(pairs_cells(geom, margin)).distinct()


def whole_tooth_visits(patches: DataFrame, present: DataFrame) -> DataFrame:
    """(patch_id, arch_id, tooth, stage) in seed order."""
    return seed_order(patches, present).select("patch_id", "arch_id", "tooth", F.col("step").alias("stage"))


def whole_tooth_stages(patches: DataFrame, geom: DataFrame, margin: float = 1.5, visits: DataFrame | None = None) -> DataFrame:
    """Cumulative union of dilated teeth in seed order: (patch_id, arch_id, fid, stage)."""
    visits = whole_tooth_visits(patches, present_labels(geom)) if visits is None else visits
    return first_stage(attach(dilate_teeth(geom, margin), visits, ["arch_id", "tooth"], ["fid"]))


def dilate_set(members: DataFrame, geom: DataFrame, margin: float) -> DataFrame:
    """Members (arch_id, fid) plus all faces within ``margin`` of a member. margin <= 0 changes nothing."""
    if margin <= 0:
        return members.select("arch_id", "fid")
    pos = geom.select("arch_id", "fid", *[F.col("m" + a).alias(a) for a in "xyz"])
    near = any_within(pos, pos.join(members.select("arch_id", "fid").hint("merge"), ["arch_id", "fid"], "left_semi"), margin,
                      "arch_id", "fid")
    return members.select("arch_id", "fid").unionByName(near).distinct()


def stage_growth(stages: DataFrame, geom: DataFrame, visits: DataFrame) -> DataFrame:
    """Per (patch, stage): new and cumulative faces and area. Aggregated before the window: one row per stage.

    visits: (patch_id, stage) of all stages; one that adds nothing keeps its row.
    """
    area = geom.select("arch_id", "fid", "area")
    s = stages.join(area, ["arch_id", "fid"]).groupBy("patch_id", "stage") \
        .agg(F.count("*").alias("new_faces"), F.sum("area").alias("new_area"))
    s = visits.select("patch_id", "stage").distinct().join(s, ["patch_id", "stage"], "left").fillna(0, ["new_faces", "new_area"])
    w = Window.partitionBy("patch_id").orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("n_faces", F.sum("new_faces").over(w)).withColumn("area_mm2", F.sum("new_area").over(w))


def phase_increments(stages: DataFrame, geom: DataFrame) -> DataFrame:
    """Faces and area each phase adds, and its share of the whole extent."""
    s = stages.join(geom.select("arch_id", "fid", "area"), ["arch_id", "fid"])
    per = s.groupBy("patch_id", "phase").agg(F.count("*").alias("n"), F.sum("area").alias("area_mm2"))
    tot = per.groupBy("patch_id").agg(F.sum("n").alias("_n"))
    return per.join(tot, "patch_id").select("patch_id", "phase", "n", "area_mm2", (F.col("n") / F.col("_n")).alias("share"))


def shrinking_stages(growth: DataFrame) -> DataFrame:
    """Stages whose cumulative faces or area fall below the previous stage; empty when growth is monotone."""
    w = Window.partitionBy("patch_id").orderBy("stage")
    d = growth.withColumn("_n", F.lag("n_faces").over(w)).withColumn("_a", F.lag("area_mm2").over(w))
    return d.filter((F.col("n_faces") < F.col("_n")) | (F.col("area_mm2") < F.col("_a"))).drop("_n", "_a")


def stage_index(draw: Column, n_stages: Column, power: float = 2.5) -> Column:
    """Early-biased stage; truncation means the last stage is never drawn (n > 1)."""
    return F.floor(F.pow(draw, F.lit(power)) * (n_stages - 1)).cast("bigint")


def draw_stage(visits: DataFrame, seed: str, power: float = 2.5) -> DataFrame:
    """(patch_id, picked) from all visits of each patch, whether or not they add faces: no geometry is needed for the draw."""
    n = visits.groupBy("patch_id").agg(F.countDistinct("stage").alias("n_stages"))
    return n.select("patch_id", stage_index(uniform(f"{seed}/stage", "patch_id"), F.col("n_stages"), power).alias("picked"))


def up_to_drawn(visits: DataFrame, seed: str, power: float = 2.5) -> DataFrame:
    """The visits up to the drawn stage: the faces of their footprints are the sampled patch."""
    return visits.join(draw_stage(visits, seed, power), "patch_id").filter(F.col("stage") <= F.col("picked")).drop("picked")


def sample_stage(stages: DataFrame, visits: DataFrame, seed: str, power: float = 2.5) -> DataFrame:
    """Faces of one sampled stage per patch, where the stages are already at hand: rows with stage <= the drawn one."""
    return attach(stages, draw_stage(visits, seed, power), ["patch_id"], ["fid"]).filter(F.col("stage") <= F.col("picked")).drop("picked")


def choose_mode(patches: DataFrame, present: DataFrame, seed: str, whole_tooth_prob: float = 0.0,
                midline_prob: float = 0.0, is_train: bool = True) -> DataFrame:
    """Adds ``mode``: sweep, whole_tooth or midline (needs teeth 8 and 9). The two extra modes exclude each other;
    outside training both are off."""
    if whole_tooth_prob > 0 and midline_prob > 0:
        raise ValueError("whole-tooth and midline patches cannot be mixed in one run")
    p_whole, p_mid = (whole_tooth_prob, midline_prob) if is_train else (0.0, 0.0)
    central = present.filter(F.col("label").isin(8, 9)).groupBy("arch_id").agg((F.count("*") == 2).alias("both"))
    u = uniform(f"{seed}/mode", "patch_id")
    mode = F.when(F.lit(p_whole > 0) & (u < p_whole), "whole_tooth") \
        .when(F.lit(p_mid > 0) & (u < p_mid) & F.coalesce("both", F.lit(False)), "midline").otherwise("sweep")
    return patches.join(central, "arch_id", "left").withColumn("mode", mode).drop("both")


def relaxing_coverage(stages: DataFrame, geom: DataFrame, adjacency: DataFrame, axis: tuple[float, float, float],
                      n_stages: int, start: float, end: float) -> DataFrame:
    """Extent and coverage together: stage i fills its own extent down to a linearly relaxed threshold."""
    from meshspark.functions.vectors import Vec
    occ = Vec.cols("n").dot(Vec.of(*[float(v) for v in axis]))
    # written once: the seeds, the open faces and the result each read it, and the stages behind it are a long plan
    base = cut_lineage(stages.filter(F.col("stage") < n_stages)
                       .join(geom.select("arch_id", "fid", "label", occ.alias("occ")).hint("merge"), ["arch_id", "fid"]))
    each = base.withColumn("at", F.explode(F.sequence(F.col("stage"), F.lit(n_stages - 1).cast("bigint"))))
    each = each.withColumn("threshold", linspace(start, end, n_stages, F.col("at"))) \
        .withColumn("fp", F.concat_ws("/", "patch_id", F.col("at").cast("string")))
    got = grow_coverage(each.select("arch_id", "fp", "fid", "label", "occ", "threshold"), adjacency, "fp")
    return got.select("fp", "arch_id", "fid").join(each.select("fp", "fid", "patch_id", "at").hint("merge"), ["fp", "fid"]) \
        .select("patch_id", "arch_id", "fid", F.col("at").alias("stage"))
