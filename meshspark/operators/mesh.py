"""Mesh geometry: corner gather, face and vertex measures, adjacency, welding, density reduction.

Tables: vertices(arch_id, vid, x, y, z, ...), faces(arch_id, fid, v0, v1, v2, ...). ``arch_id`` names
one mesh; all keys carry a vertex, edge or cell id besides it, so one huge mesh still spreads out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshspark.functions.vectors import Vec, add_unit, add_vec, angle_between
from meshspark.operators.ordinals import attach

CORNERS = ("p", "q", "r")


def gather_corners(faces: DataFrame, vertices: DataFrame, attrs: tuple[str, ...] = ("x", "y", "z"),
                   key: str = "arch_id") -> DataFrame:
    """Attach the attributes of the three corner vertices as ``p*``, ``q*``, ``r*`` columns; a corner that is no vertex is an error."""
    out = faces
    for i, p in enumerate(CORNERS):
        v = vertices.select(F.col(key), F.col("vid").alias(f"v{i}"), *[F.col(c).alias(p + c) for c in attrs], F.lit(True).alias("_known"))
        out = out.join(v.hint("merge"), [key, f"v{i}"], "left")
        first = p + attrs[0]
        lost = F.raise_error(F.concat(F.lit("no vertex "), F.coalesce(F.col(f"v{i}").cast("string"), F.lit("null")), F.lit(" in mesh "), F.col(key).cast("string")))
        out = out.withColumn(first, F.when(F.col("_known"), F.col(first)).otherwise(lost.cast(out.schema[first].dataType))).drop("_known")
    return out


def face_measures(corners: DataFrame) -> DataFrame:
    """Centroid (cx..), unit normal (nx.., null when the area is zero) and area."""
    a, b, c = (Vec.cols(p) for p in CORNERS)
    d = add_vec(corners, "m", Vec(*[(p + q + r) / 3.0 for p, q, r in zip(a, b, c)]))
    d = add_vec(d, "_k", b.minus(a).cross(c.minus(a))).withColumn("area", Vec.cols("_k").norm() * 0.5)
    return add_unit(d, "n", Vec.cols("_k")).drop("_kx", "_ky", "_kz")


def face_geometry(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """faces + corners + centroid (mx, my, mz) + normal (nx, ny, nz) + area."""
    return face_measures(gather_corners(faces, vertices))


def vertex_normals(geom: DataFrame, weighting: str = "angle") -> DataFrame:
    """Unit vertex normals (arch_id, vid, nx, ny, nz) from adjacent faces, weighted by corner angle or evenly."""
    a, b, c = (Vec.cols(p) for p in CORNERS)
    if weighting not in ("angle", "uniform"):
        raise ValueError(f"weighting must be 'angle' or 'uniform', not {weighting!r}")
    one = F.lit(1.0)
    w = [angle_between(b.minus(a), c.minus(a)), angle_between(a.minus(b), c.minus(b)),
         angle_between(a.minus(c), b.minus(c))] if weighting == "angle" else [one, one, one]
    corner = F.explode(F.array(*[F.struct(F.col(f"v{i}").alias("vid"), w[i].alias("w")) for i in range(3)]))
    s = geom.filter(F.col("nx").isNotNull()).select("arch_id", "nx", "ny", "nz", corner.alias("k")) \
        .groupBy("arch_id", F.col("k.vid").alias("vid")) \
        .agg(*[F.sum(F.col(f"n{t}") * F.col("k.w")).alias(f"s{t}") for t in "xyz"])
    return add_unit(s, "n", Vec.cols("s")).drop("sx", "sy", "sz")


def face_edges(faces: DataFrame, keep: tuple[str, ...] = ("arch_id", "fid")) -> DataFrame:
    """Three undirected edges per face (e0 < e1); collapsed edges are left out."""
    pairs = [("v0", "v1"), ("v1", "v2"), ("v2", "v0")]
    e = F.explode(F.array(*[F.struct(F.least(p, q).alias("e0"), F.greatest(p, q).alias("e1")) for p, q in pairs]))
    return faces.select(*keep, e.alias("e")).select(*keep, "e.e0", "e.e1").filter("e0 <> e1")


def face_adjacency(faces: DataFrame) -> DataFrame:
    """(arch_id, a, b), a < b: two faces that are the only two users of an edge.

    count/min/max instead of a self-join: partial aggregation applies and a non-manifold edge costs one row.
    """
    return face_edges(faces).groupBy("arch_id", "e0", "e1") \
        .agg(F.count("*").alias("n"), F.min("fid").alias("a"), F.max("fid").alias("b")) \
        .filter("n = 2 and a <> b").select("arch_id", "a", "b").distinct()


def restrict_adjacency(adjacency: DataFrame, members: DataFrame, group: list[str]) -> DataFrame:
    """Adjacency inside each member set: (group..., arch_id, a, b). members: (group..., arch_id, fid)."""
    extra = [c for c in group if c != "arch_id"]
    left = members.select("arch_id", *extra, F.col("fid").alias("a"))
    right = members.select("arch_id", *extra, F.col("fid").alias("b"))
    return adjacency.join(left.hint("merge"), ["arch_id", "a"]).join(right.hint("merge"), ["arch_id", *extra, "b"]) \
        .select("arch_id", *extra, "a", "b")


def inner_degree(members: DataFrame, adjacency: DataFrame, group: list[str]) -> DataFrame:
    """Members plus ``degree`` = edge neighbours inside the same set; boundary faces have fewer than 3."""
    keys = list(dict.fromkeys(["arch_id", *group]))
    inside = restrict_adjacency(adjacency, members, group)
    d = inside.select(*keys, F.explode(F.array("a", "b")).alias("fid")).groupBy(*keys, "fid") \
        .agg(F.count("*").alias("degree"))
    return members.join(d.hint("merge"), [*keys, "fid"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def mesh_area(geom: DataFrame, *keys: str) -> DataFrame:
    return geom.groupBy(*keys).agg(F.sum("area").alias("area_mm2"), F.count("*").alias("n_faces"))


def target_count(area: Column, density: float, cap: int | None = None, floor: int | None = None) -> Column:
    """round(area * density), half to even, optionally capped / floored."""
    n = F.bround(area * F.lit(float(density))).cast("bigint")
    if cap is not None:
        n = F.least(n, F.lit(cap))
    return F.greatest(n, F.lit(floor)) if floor is not None else n


def cell_key(prefix: str, size) -> list[Column]:
    s = F.lit(float(size)) if not isinstance(size, Column) else size
    return [F.floor(F.col(prefix + a) / s).alias(f"v{a}") for a in "xyz"]


def voxel_size(density: float, fineness: float = 0.3) -> float:
    return fineness / density ** 0.5


def weld(vertices: DataFrame, faces: DataFrame, digits: int = 8, group: str = "run_id",
         vertex: str = "vid", attrs: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Merge vertices with equal rounded position; drop faces that collapse. Ids stay those of the first vertex."""
    pos = [F.round(F.col(a), digits).alias("_" + a) for a in "xyz"]
    keyed = vertices.select("*", *pos)
    at = [group, "_x", "_y", "_z"]
    reps = keyed.groupBy(*at).agg(F.min(vertex).alias("_rep"))
    mapping = keyed.select(group, vertex, "_x", "_y", "_z").join(reps.hint("merge"), at).select(group, vertex, "_rep")
    kept = vertices.join(mapping.filter(F.col(vertex) == F.col("_rep")).select(group, vertex).hint("merge"), [group, vertex],
                         "left_semi")
    out = remap_corners(faces, mapping.withColumnRenamed("_rep", "_to"), [group], vertex)
    return kept, out.filter("v0 <> v1 and v1 <> v2 and v2 <> v0").select(*faces.columns)


def remap_corners(faces: DataFrame, mapping: DataFrame, keys: list[str], vertex: str = "vid") -> DataFrame:
    """Replace v0..v2 by ``_to`` of mapping (keys..., vertex, _to): one join on exploded corners, one regroup."""
    rest = [c for c in faces.columns if c not in ("v0", "v1", "v2")]
    long = faces.select(*rest, F.posexplode(F.array("v0", "v1", "v2")).alias("_i", vertex))
    hit = long.join(mapping.select(*keys, vertex, "_to").hint("merge"), [*keys, vertex])
    at = [F.max(F.when(F.col("_i") == i, F.col("_to"))).alias(f"v{i}") for i in range(3)]
    return hit.groupBy(*rest).agg(*at).filter("v0 is not null and v1 is not null and v2 is not null")


def cluster_cell(area: Column, target: Column) -> Column:
    """Cell edge at which a surface of ``area`` keeps about ``target`` faces (two faces per occupied cell)."""
    return F.sqrt(F.lit(2.0) * area / target)


def reduce_density(geom: DataFrame, vertices: DataFrame, density: float, cap: int | None = None,
                   floor: int = 4) -> tuple[DataFrame, DataFrame]:
    """Vertex clustering to a face density; meshes at or below the target stay as they are.

    Returns (vertices, faces) of the reduced meshes. A clustered face keeps the smallest source face id.
    """
    plan = geom.groupBy("arch_id").agg(F.sum("area").alias("_area"), F.count("*").alias("_n")) \
        .withColumn("_target", target_count(F.col("_area"), density, cap, floor)) \
        .withColumn("_cell", F.when(F.col("_target") < F.col("_n"), cluster_cell(F.col("_area"), F.col("_target"))))
    v = attach(vertices, plan.select("arch_id", "_cell", "_target"), ["arch_id"], ["vid"])
    key = [F.when(F.col("_cell").isNotNull(), F.floor(F.col(a) / F.col("_cell"))).alias("_k" + a) for a in "xyz"]
    single = F.when(F.col("_cell").isNull(), F.col("vid")).alias("_single")
    keyed = v.select("arch_id", "vid", "x", "y", "z", *key, single)
    at = ["arch_id", "_kx", "_ky", "_kz", "_single"]
    cells = keyed.groupBy(*at).agg(F.min("vid").alias("rep"), *[F.avg(a).alias(a) for a in "xyz"])
    new_vertices = cells.select("arch_id", F.col("rep").alias("vid"), "x", "y", "z")
    mapping = keyed.alias("k").join(
        cells.hint("merge").alias("c"), [F.col(f"k.{c}").eqNullSafe(F.col(f"c.{c}")) for c in at]) \
        .select("k.arch_id", "k.vid", "c.rep")
    f = remap_corners(geom.select("arch_id", "fid", "v0", "v1", "v2"), mapping.withColumnRenamed("rep", "_to"),
                      ["arch_id"])
    f = f.withColumnsRenamed({f"v{i}": f"r{i}" for i in range(3)}).filter("r0 <> r1 and r1 <> r2 and r2 <> r0") \
        .withColumn("_set", F.array_sort(F.array("r0", "r1", "r2")))
    first = F.min(F.struct("fid", "r0", "r1", "r2")).alias("t")
    f = f.groupBy("arch_id", "_set").agg(first) \
        .select("arch_id", "t.fid", F.col("t.r0").alias("v0"), F.col("t.r1").alias("v1"), F.col("t.r2").alias("v2"))
    return new_vertices, f


def pad_faces(faces: DataFrame, targets: DataFrame) -> DataFrame:
    """Append degenerate (0, 0, 0) faces up to ``target`` per mesh. targets: (arch_id, n_faces, target, max_fid)."""
    extra = targets.filter("target > n_faces").select(
        "arch_id", F.explode(F.sequence(F.lit(1), F.col("target") - F.col("n_faces"))).alias("s"), "max_fid")
    pad = extra.select("arch_id", (F.col("max_fid") + F.col("s")).alias("fid"),
                       *[F.lit(0).cast("bigint").alias(f"v{i}") for i in range(3)])
    return faces.select("arch_id", "fid", "v0", "v1", "v2").unionByName(pad)


def shared_vertices(face_rows: DataFrame) -> DataFrame:
    """Vertex buffer back from per-face index and coordinate arrays (v array, tri array<array>)."""
    return face_rows.select("arch_id", "fid", F.posexplode(F.arrays_zip("v", "tri")).alias("k", "e")) \
        .groupBy("arch_id", F.col("e.v").alias("vid")) \
        .agg(F.max_by(F.col("e.tri"), F.struct("fid", "k")).alias("p")) \
        .select("arch_id", "vid", *[F.col("p")[i].alias(a) for i, a in enumerate("xyz")])


def face_colours(faces: DataFrame, vertices: DataFrame, key: str = "arch_id") -> DataFrame:
    """Face colour = mean of the three vertex colours, fraction cut off."""
    c = gather_corners(faces, vertices, ("r", "g", "b"), key)
    mean = {ch: F.floor((F.col("p" + ch) + F.col("q" + ch) + F.col("r" + ch)) / 3).cast("bigint") for ch in "rgb"}
    return c.select(*faces.columns, *[v.alias(k) for k, v in mean.items()])
