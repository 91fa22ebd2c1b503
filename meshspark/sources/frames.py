"""Captured wire frames: JSON header plus a binary blob of vertex, normal, colour and triangle sections."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

HEADER = ("type string, mesh_id bigint, modelset string, catalog string, vertex_count bigint, face_count bigint, "
          "layout struct<vertices_bytes:bigint,normals_bytes:bigint,colors_bytes:bigint,triangles_bytes:bigint>, "
          "seq bigint, source string, ts double")
SECTIONS = ("vertices", "normals", "colors", "triangles")
_DTYPE = {"vertices": "<f4", "normals": "<f4", "colors": "u1", "triangles": "<u4"}
_KIND = {"vertices": "float", "normals": "float", "colors": "smallint", "triangles": "bigint"}


def parse_headers(frames: DataFrame) -> DataFrame:
    """frames(header string, blob binary, ...) -> the header fields as columns beside the rest."""
    d = frames.withColumn("_h", F.from_json("header", HEADER))
    return d.select(*[c for c in frames.columns if c != "header"], "_h.*")


def of_type(parsed: DataFrame, kind: str) -> DataFrame:
    return parsed.filter(F.col("type") == kind)


def length_ok(parsed: DataFrame) -> DataFrame:
    """Adds ``length_ok`` (blob bytes equal the layout sum) and ``has_colour``."""
    total = sum((F.coalesce(F.col(f"layout.{s}_bytes"), F.lit(0)) for s in SECTIONS), F.lit(0))
    return parsed.withColumn("length_ok", F.coalesce(F.length("blob") == total, F.lit(False))) \
        .withColumn("has_colour", F.coalesce(F.col("layout.colors_bytes") > 0, F.lit(False)))


def frame_time(ts) -> F.col:
    """Epoch milliseconds or epoch seconds to a timestamp."""
    return F.when(ts > 1e11, F.timestamp_millis(ts.cast("bigint"))).otherwise(F.timestamp_micros((ts * 1e6).cast("bigint")))


def decode(parsed: DataFrame, keys: list[str] = ("mesh_id",)) -> DataFrame:
    """Sections as flat arrays; a section of zero bytes is null. One frame is one row: its size bounds the work."""
    keep = parsed.select(*keys, "vertex_count", "face_count", "layout", "blob")
    kinds = [f"{k} {parsed.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cols = {s: [] for s in SECTIONS}
            for blob, lay in zip(b["blob"], b["layout"]):
                at = 0
                for s in SECTIONS:
                    size = int(lay[f"{s}_bytes"] or 0)
                    raw = np.frombuffer(blob, dtype=_DTYPE[s], count=size // np.dtype(_DTYPE[s]).itemsize, offset=at)
                    cols[s].append(raw.astype({"colors": "int16", "triangles": "int64"}.get(s, "float32")) if size else None)
                    at += size
            yield pd.DataFrame({**{k: b[k] for k in keys}, "vertex_count": b["vertex_count"],
                                "face_count": b["face_count"], **cols})

    schema = ", ".join([*kinds, "vertex_count bigint", "face_count bigint", *[f"{s} array<{_KIND[s]}>" for s in SECTIONS]])
    return keep.mapInPandas(run, schema)


def _rows(decoded: DataFrame, keys: list[str], section: str, names: list[str], ident: str, extra=()) -> DataFrame:
    n = F.floor(F.size(section) / 3).cast("int")
    d = decoded.filter(F.col(section).isNotNull() & (n > 0))
    idx = F.explode(F.sequence(F.lit(0), n - 1)).alias("_i")
    d = d.select(*keys, section, *extra, idx)
    at = lambda s, j: F.get(F.col(s), F.col("_i") * 3 + j)
    cols = [at(section, j).alias(c) for j, c in enumerate(names)]
    for e, ns in (("normals", ("nx", "ny", "nz")), ("colors", ("r", "g", "b"))):
        if e in extra:
            cols += [at(e, j).alias(c) for j, c in enumerate(ns)]
    return d.select(*keys, F.col("_i").cast("bigint").alias(ident), *cols)


def vertex_rows(decoded: DataFrame, keys: list[str] = ("mesh_id",)) -> DataFrame:
    """(keys..., vid, x, y, z, nx, ny, nz, r, g, b); absent normals and colours are null."""
    return _rows(decoded, list(keys), "vertices", ["x", "y", "z"], "vid", ("normals", "colors"))


def face_rows(decoded: DataFrame, keys: list[str] = ("mesh_id",)) -> DataFrame:
    return _rows(decoded, list(keys), "triangles", ["v0", "v1", "v2"], "fid")


def encode(chunks: DataFrame) -> DataFrame:
    """chunks(mesh_id, vertices array<float>, triangles array<bigint>, [colors array<smallint>]) -> (header, blob).

    For capture files and tests; a chunk is one row.
    """
    has_colour = "colors" in chunks.columns
    take = chunks.select("mesh_id", "vertices", "triangles", *(["colors"] if has_colour else []))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        for b in batches:
            heads, blobs = [], []
            for i in range(len(b)):
                v = np.asarray(b["vertices"].iloc[i], dtype="<f4").tobytes()
                t = np.asarray(b["triangles"].iloc[i], dtype="<u4").tobytes()
                c = np.asarray(b["colors"].iloc[i], dtype="u1").tobytes() if has_colour and b["colors"].iloc[i] is not None else b""
                m = int(b["mesh_id"].iloc[i])
                heads.append(json.dumps({
                    "type": "mesh", "mesh_id": m, "seq": m, "vertex_count": len(v) // 12, "face_count": len(t) // 12,
                    "layout": {"vertices_bytes": len(v), "normals_bytes": 0, "colors_bytes": len(c), "triangles_bytes": len(t)}}))
                blobs.append(v + c + t)
            yield pd.DataFrame({"header": heads, "blob": blobs})

    return take.mapInPandas(run, "header string, blob binary")
