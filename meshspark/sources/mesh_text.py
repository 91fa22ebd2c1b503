"""Mesh text files and label sidecars as tables; coloured meshes back to text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshspark.functions import labels as lab


def stem(path_col) -> F.col:
    """File name without folder and extension."""
    return F.regexp_extract(path_col, r"([^/]+)\.[^./]+$", 1)


def read_meshes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of all .obj files below a folder; ids are 0-based file order, faces keep the vertex index only.

    A polygon becomes a fan of triangles, numbered in the order of the lines.

    The position inside the filtered line array is the id, so no sort or shuffle is needed to number the lines.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.obj").option("recursiveFileLookup", True) \
        .load(folder).select(stem(F.col("path")).alias("arch_id"), F.decode("content", "UTF-8").alias("text"))
    lines = F.split("text", r"\r?\n")

    def numbered(prefix: str, ident: str):
        own = F.filter(lines, lambda l: F.ltrim(l).startswith(prefix))
        d = raw.select("arch_id", F.posexplode(own).alias(ident, "line"))
        return d.select("arch_id", F.col(ident).cast("bigint").alias(ident), F.split(F.trim("line"), r"\s+").alias("f"))

    v = numbered("v ", "vid").select(
        "arch_id", "vid", *[F.col("f")[1 + i].cast("double").alias(a) for i, a in enumerate("xyz")],
        *[F.try_element_at("f", F.lit(5 + i)).cast("double").alias(c) for i, c in enumerate("rgb")])
    own = F.filter(lines, lambda l: F.ltrim(l).startswith("f "))
    corners = F.transform(own, lambda l: F.transform(F.slice(F.split(F.trim(l), r"\s+"), 2, 1 << 30), lambda c: _vertex_number(F.split(c, "/")[0])))
    fans = F.flatten(F.transform(F.filter(corners, lambda c: F.size(c) >= 3), _fan))
    f = raw.select("arch_id", F.posexplode(fans).alias("fid", "t")) \
        .select("arch_id", F.col("fid").cast("bigint").alias("fid"), *[F.col("t")[i].alias(f"v{i}") for i in range(3)])
    return v, f


def _vertex_number(text):
    """0-based vertex number of a corner; numbers that count back from the line are refused, never misread."""
    n = text.cast("bigint")
    return F.when(n > 0, n - 1).otherwise(F.raise_error(F.concat(F.lit("not a positive vertex number: "), F.coalesce(text, F.lit("null")))).cast("bigint"))


def _fan(corners):
    """Triangles of a polygon: the first corner with each later edge."""
    return F.transform(F.sequence(F.lit(1), F.size(corners) - 2), lambda i: F.array(F.get(corners, F.lit(0)), F.get(corners, i), F.get(corners, i + 1)))


def read_vertex_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(arch_id, vid, fdi) from JSON sidecars {"labels": [...]} with one code per vertex."""
    j = spark.read.schema("labels array<bigint>").option("multiLine", True).option("pathGlobFilter", "*.json") \
        .option("recursiveFileLookup", True).json(folder).filter(F.col("labels").isNotNull())
    return j.select(stem(F.input_file_name()).alias("arch_id"), "labels") \
        .select("arch_id", F.posexplode("labels").alias("vid", "fdi")) \
        .select("arch_id", F.col("vid").cast("bigint").alias("vid"), "fdi")


def face_labels_from_vertex_labels(faces: DataFrame, vertex_labels: DataFrame) -> DataFrame:
    """A face takes the label of its first corner; a face without one is an error, not left out."""
    value = [c for c in vertex_labels.columns if c not in ("arch_id", "vid")]
    first = vertex_labels.select("arch_id", F.col("vid").alias("v0"), *value)
    first = first.withColumn("_known", F.lit(True))
    lost = F.raise_error(F.concat(F.lit("no label for the first corner of face "), F.col("fid").cast("string"), F.lit(" of "), F.col("arch_id").cast("string")))
    d = faces.join(first, ["arch_id", "v0"], "left")
    return d.select(*faces.columns, *[F.when(F.col("_known"), F.col(c)).otherwise(lost.cast(d.schema[c].dataType)).alias(c) for c in value])


def split_labelled(meshes: DataFrame, vertex_labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of meshes with a sidecar, ids of meshes without one)."""
    known = vertex_labels.select("arch_id").distinct()
    return meshes.join(known, "arch_id", "left_semi"), \
        meshes.select("arch_id").distinct().join(known, "arch_id", "left_anti")


def labelled_faces(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, faces with label, skipped ids) of a raw folder."""
    v, f = read_meshes(spark, folder)
    codes = read_vertex_labels(spark, folder)
    f, skipped = split_labelled(f, codes)
    lf = lab.with_label_from_fdi(face_labels_from_vertex_labels(f, codes))
    return v.join(codes.select("arch_id").distinct(), "arch_id", "left_semi"), lf, skipped


def labels_from_face_colour(faces: DataFrame) -> DataFrame:
    return lab.with_label_from_rgb(faces)


def write_coloured_meshes(vertices: DataFrame, faces: DataFrame, path: str, prefix: str = "pred_") -> None:
    """One ASCII PLY file per mesh with face colours from ``label``: partition folders <prefix>arch_id=...

    Text rows carry a section and an order column; a range sort by (mesh, section, order) keeps large meshes spread
    over files whose names sort in reading order.
    """
    col = lab.label_to_rgb(F.col("label"))
    counts = vertices.groupBy("arch_id").agg(F.count("*").alias("nv")) \
        .join(faces.groupBy("arch_id").agg(F.count("*").alias("nf")), "arch_id")
    head = F.format_string(
        "ply\nformat ascii 1.0\nelement vertex %d\nproperty double x\nproperty double y\nproperty double z\n"
        "element face %d\nproperty list uchar int vertex_indices\nproperty uchar red\nproperty uchar green\n"
        "property uchar blue\nend_header", "nv", "nf")
    rows = counts.select("arch_id", F.lit(0).alias("s"), F.lit(0).cast("bigint").alias("o"), head.alias("value")) \
        .unionByName(vertices.select("arch_id", F.lit(1).alias("s"), F.col("vid").alias("o"),
                                     F.concat_ws(" ", "x", "y", "z").alias("value"))) \
        .unionByName(faces.select("arch_id", F.lit(2).alias("s"), F.col("fid").alias("o"), F.concat_ws(
            " ", F.lit("3"), "v0", "v1", "v2", col["r"], col["g"], col["b"]).alias("value")))
    rows.withColumn("mesh", F.concat(F.lit(prefix), F.col("arch_id").cast("string"))) \
        .repartitionByRange("mesh", "s", "o").sortWithinPartitions("mesh", "s", "o") \
        .select("mesh", "value").write.mode("overwrite").partitionBy("mesh").text(path)
