"""Coloured meshes in PLY files as tables, text and binary.

Text is read by lines: Spark splits large files, and a line's number is its place in its split plus the lines of all splits before
it, so no task holds a file. The header gives each element its range of lines. A mesh is one file, or a folder ``mesh=<name>`` of
part files in the order of their names, as the writer leaves it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meshspark.functions import labels as lab
from meshspark.operators.ordinals import attach
from meshspark.session import cut_lineage

# Property types of the format and their sizes.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4",
         "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
COLOURS = ("red", "green", "blue")


def parse_header(lines: list[str]) -> tuple[str, list[tuple[str, int, list[list[str]]]]]:
    """(format, [(element, count, properties)]) of the lines up to ``end_header``; a property is its words behind ``property``."""
    if not lines or lines[0].strip() != "ply" or lines[-1].strip() != "end_header":
        raise ValueError("not a PLY header")
    form, elements = "", []
    for line in lines[1:-1]:
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append(w[1:])
    for name, _, properties in elements:
        if name == "face" and (not properties or properties[0][0] != "list" or any(p[0] == "list" for p in properties[1:])):
            raise ValueError("a face must be one list of vertices, then single values")
        if name == "vertex" and (any(p[0] == "list" for p in properties) or not {"x", "y", "z"} <= {p[-1] for p in properties}):
            raise ValueError("a vertex must have single values x, y, z")
    return form, elements


_PLAN = "vertex_at bigint, face_at bigint, vertices bigint, faces bigint, place map<string,int>, tint map<string,int>"


def _plans(batches):
    """First line and count of vertices and faces, and where their values stand in a line."""
    for d in batches:
        out = []
        for mesh, header, total in zip(d["arch_id"], d["header"], d["total"]):
            form, elements = parse_header([] if header is None else list(header))
            if form == "ascii" and len(header) + sum(n for _, n, _ in elements) > total:
                raise ValueError(f"{mesh}: shorter than its header says")
            if form != "ascii":
                raise ValueError(f"{mesh}: format {form} is not text")
            at, row = len(header), {"arch_id": mesh, "place": {}, "tint": {}}
            for name, n, properties in elements:
                names = [p[-1] for p in properties]
                if name == "vertex":
                    row |= {"vertex_at": at, "vertices": n, "place": {c: names.index(c) for c in ("x", "y", "z", *COLOURS) if c in names}}
                elif name == "face":
                    row |= {"face_at": at, "faces": n, "tint": {c: names.index(c) + 3 for c in COLOURS if c in names}}
                at += n
            out.append(row)
        yield pd.DataFrame(out, columns=["arch_id", "vertex_at", "face_at", "vertices", "faces", "place", "tint"]).fillna({"vertices": 0, "faces": 0, "vertex_at": 0, "face_at": 0})


def _lines(spark: SparkSession, folder: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(arch_id, line, value) of all files and (arch_id, total); rows of one split are numbered by their place in it."""
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder) \
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    folder_name = F.regexp_extract("file", r"/mesh=([^/]+)/[^/]+$", 1)
    raw = raw.withColumn("arch_id", F.when(folder_name != "", folder_name).otherwise(F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1))) \
        .withColumn("_m", F.monotonically_increasing_id())
    splits = cut_lineage(raw.groupBy("arch_id", "file", "start").agg(F.min("_m").alias("_first"), F.count("*").alias("_n")))
    totals = splits.groupBy("arch_id").agg(F.sum("_n").alias("total"))
    before = Window.partitionBy("arch_id").orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = attach(raw, splits, ["arch_id", "file", "start"], ["_m"])
    return placed.select("arch_id", (F.col("_m") - F.col("_first") + F.col("_before")).alias("line"), "value"), totals


def read_text(spark: SparkSession, folder: str, pattern: str = "*.ply") -> tuple[DataFrame, DataFrame]:
    """(vertices(arch_id, vid, x, y, z, r, g, b), faces(arch_id, fid, v0, v1, v2, r, g, b)) of all text files below a folder.

    Ids are 0-based file order; colours are null where a file has none. Faces other than triangles, files without a
    header and files shorter than their header says are errors. Values of further properties and elements are left out.
    """
    lines, totals = _lines(spark, folder, pattern)
    ends = cut_lineage(lines.filter(F.trim("value") == "end_header").groupBy("arch_id").agg(F.min("line").alias("_end")))
    head = attach(lines, ends, ["arch_id"], ["line"]).filter(F.col("line") <= F.col("_end")) \
        .groupBy("arch_id").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("h")).select("arch_id", F.col("h.value").alias("header"))
    head = totals.join(head, "arch_id", "left")
    plans = cut_lineage(head.mapInPandas(_plans, f"arch_id string, {_PLAN}"))
    d = attach(lines, plans, ["arch_id"], ["line"])
    words = F.split(F.trim("value"), r"\s+")

    def value(where: str, name: str, kind: str):
        return F.get(words, F.col(where)[name]).cast(kind)

    v = d.filter((F.col("line") >= F.col("vertex_at")) & (F.col("line") < F.col("vertex_at") + F.col("vertices"))).select(
        "arch_id", (F.col("line") - F.col("vertex_at")).alias("vid"), *[value("place", a, "double").alias(a) for a in "xyz"],
        *[value("place", c, "bigint").alias(c[0]) for c in COLOURS])
    corner = F.when(F.get(words, F.lit(0)) == "3", words).otherwise(
        F.raise_error(F.concat(F.lit("not a triangle: "), F.col("arch_id"), F.lit(" line "), F.col("line").cast("string"))).cast("array<string>"))
    f = d.filter((F.col("line") >= F.col("face_at")) & (F.col("line") < F.col("face_at") + F.col("faces"))).withColumn("c", corner).select(
        "arch_id", (F.col("line") - F.col("face_at")).alias("fid"), *[F.get("c", F.lit(i + 1)).cast("bigint").alias(f"v{i}") for i in range(3)],
        *[value("tint", c, "bigint").alias(c[0]) for c in COLOURS])
    return v, f


_ROW = pa.schema([("arch_id", pa.string()), ("kind", pa.int32()), ("id", pa.int64()), *[(c, pa.float64()) for c in ("a", "b", "c", "r", "g", "bl")]])
CHUNK = 1 << 16


def _decoded(batches):
    """Rows of vertices (kind 0) and faces (kind 1) of whole binary files, in chunks."""
    for b in batches:
        for mesh, raw in zip(b.column("arch_id").to_pylist(), b.column("content")):
            raw = memoryview(raw.as_buffer())
            end = bytes(raw[:1 << 16]).find(b"end_header")
            if end < 0:
                raise ValueError(f"{mesh}: no PLY header")
            at = bytes(raw[:1 << 16]).index(b"\n", end) + 1
            form, elements = parse_header(bytes(raw[:at]).decode("ascii").split("\n")[:-1])
            order = {"binary_little_endian": "<", "binary_big_endian": ">"}.get(form)
            if order is None:
                raise ValueError(f"{mesh}: format {form} is not binary")
            for name, n, properties in elements:
                fields = [(p[-1], order + TYPES[p[0]]) for p in properties if p[0] != "list"]
                if name == "face":
                    fields = [("_n", order + TYPES[properties[0][1]]), ("_v", order + TYPES[properties[0][2]], (3,)), *fields]
                elif any(p[0] == "list" for p in properties):
                    raise ValueError(f"{mesh}: element {name} has lists")
                kind = np.dtype(fields)
                if at + n * kind.itemsize > len(raw):
                    raise ValueError(f"{mesh}: shorter than its header says, or not all faces are triangles")
                rows = np.frombuffer(raw, kind, n, at)
                at += n * kind.itemsize
                if name not in ("vertex", "face"):
                    continue
                if name == "face" and (rows["_n"] != 3).any():
                    raise ValueError(f"{mesh}: not all faces are triangles")
                for s in range(0, n, CHUNK):
                    part = rows[s:s + CHUNK]
                    m = len(part)
                    xyz = part["_v"].T if name == "face" else [part[a] for a in "xyz"]
                    tint = [pa.array(part[c].astype(float)) if c in (kind.names or ()) else pa.nulls(m, pa.float64()) for c in COLOURS]
                    yield pa.RecordBatch.from_arrays([pa.array([mesh] * m), pa.array(np.full(m, int(name == "face")), pa.int32()), pa.array(np.arange(s, s + m)),
                                                      *[pa.array(np.ascontiguousarray(c).astype(np.float64)) for c in xyz], *tint], schema=_ROW)


def read_binary(spark: SparkSession, folder: str, pattern: str = "*.ply") -> tuple[DataFrame, DataFrame]:
    """As ``read_text`` for binary files of either byte order. A file is one row of Spark's binary reader: 2 GB at most."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder) \
        .select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("arch_id"), "content")
    rows = raw.mapInArrow(_decoded, "arch_id string, kind int, id bigint, a double, b double, c double, r double, g double, bl double")
    tint = [F.col(c).cast("bigint").alias(n) for c, n in (("r", "r"), ("g", "g"), ("bl", "b"))]
    v = rows.filter("kind = 0").select("arch_id", F.col("id").alias("vid"), F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("z"), *tint)
    f = rows.filter("kind = 1").select("arch_id", F.col("id").alias("fid"), *[F.col(c).cast("bigint").alias(f"v{i}") for i, c in enumerate("abc")], *tint)
    return v, f


def read_labelled(spark: SparkSession, folder: str, binary: bool = False, pattern: str = "*.ply") -> tuple[DataFrame, DataFrame]:
    """(vertices, faces with ``label``): labels decoded from the face colours."""
    v, f = (read_binary if binary else read_text)(spark, folder, pattern)
    return v, lab.with_label_from_rgb(f)
