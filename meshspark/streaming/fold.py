"""Accumulated mesh of live runs as a chain of streams with keyed state; a batch costs what it brings.

land:    raw frames -> frames of a session; a reset control row begins a new session of its run
changed: frames -> faces of chunks that are new or whose signature changed; state (run, session, mesh)
claims:  faces -> one face per voxel; state (run, session, block of voxels)

Each stage writes a table that the next one reads as a stream, so every stage restarts from its own checkpoint. No stage
reads what an earlier batch has left but its state; ``idle`` lets go of state that no frame has touched for so long.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meshspark.operators import mesh
from meshspark.session import cut_lineage
from meshspark.sources import frames as fr
from meshspark.streaming.live import file_stream, newest_update, run_to_table, use_state_store

SESSION = ("run_id", "session")
CHUNK = "run_id bigint, session bigint, mesh_id bigint, seq bigint, ts timestamp, vertex_count bigint, face_count bigint"
LANDED = CHUNK + ", " + ", ".join(f"{s} bigint" for s in fr.SECTIONS) + ", blob binary"
FACE = ("run_id bigint, session bigint, mesh_id bigint, seq bigint, ts timestamp, fid bigint, "
        + ", ".join(f"{p}{a} double" for p in ("m", "p", "q", "r", "n", "pn", "qn", "rn") for a in "xyz")
        + ", area double, r bigint, g bigint, b bigint, vx bigint, vy bigint, vz bigint")
_VOXEL, _ORDER = ["vx", "vy", "vz"], ["seq", "mesh_id", "fid"]


class Land:
    """Batch body of the first stage: mesh frames with session and time, bad frames to quarantine, resets to their own table.

    The session of a frame is the number of its run's resets (``"action": "reset"`` in a scan_control header) up to its seq.
    A reset must not arrive in a later batch than the frames behind it. The table of resets has one row per new coordinate
    frame of a run. Frames without a time get the time of landing.
    """

    def __init__(self, path: str):
        self.path = path

    def __call__(self, frames: DataFrame, batch_id: int) -> DataFrame:
        spark = frames.sparkSession
        parsed = fr.length_ok(fr.parse_headers(frames.select("run_id", "header", "blob", F.get_json_object("header", "$.action").alias("action"))))
        control = (F.col("type") == "scan_control") & (F.col("action") == "reset") & F.col("seq").isNotNull()
        parsed.filter(control).select("run_id", "seq").write.mode("overwrite").parquet(f"{self.path}/resets/batch_id={batch_id}")
        resets = spark.read.schema("run_id bigint, seq bigint, batch_id bigint").parquet(f"{self.path}/resets") \
            .filter(F.col("batch_id") <= batch_id).groupBy("run_id").agg(F.collect_set("seq").alias("_resets"))
        good = F.coalesce(F.expr("length_ok and face_count > 0 and vertex_count > 0 and mesh_id is not null and seq is not null"), F.lit(False))
        met = parsed.filter(F.col("type") == "mesh")
        met.filter(~good).select("run_id", "mesh_id", "seq", "blob").write.mode("overwrite").parquet(f"{self.path}/quarantine/batch_id={batch_id}")
        session = F.coalesce(F.size(F.filter("_resets", lambda r: r <= F.col("seq"))), F.lit(0))
        return met.filter(good).join(resets, "run_id", "left").select(
            "run_id", F.when(F.col("_resets").isNull(), 0).otherwise(session).cast("bigint").alias("session"), "mesh_id", "seq",
            F.coalesce(fr.frame_time(F.col("ts")), F.current_timestamp()).alias("ts"), "vertex_count", "face_count",
            *[F.coalesce(F.col(f"layout.{s}_bytes"), F.lit(0)).cast("bigint").alias(s) for s in fr.SECTIONS], "blob")


class _Timed(StatefulProcessor):
    """State of a key that goes when the watermark passes its newest row by ``idle`` milliseconds (None: never)."""

    idle: int | None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def touch(self, newest: pd.Timestamp) -> None:
        if self.idle is None:
            return
        due = int(newest.timestamp() * 1000) + self.idle
        known = list(self.handle.listTimers())
        if known and max(known) >= due:
            return
        for t in known:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(due)

    def close(self) -> None:
        pass


class _Changed(_Timed):
    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "seq bigint, vertex_count bigint, face_count bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        last = tuple(self.last.get()) if self.last.exists() else (None, None, None)
        kept = []
        for seq, nv, nf in zip(pdf["seq"], pdf["vertex_count"], pdf["face_count"]):
            newer = last[0] is None or seq > last[0]
            kept.append(newer and (nv, nf) != last[1:])
            if newer:
                last = (int(seq), int(nv), int(nf))
        self.last.update(last)
        self.touch(pdf["ts"].max())
        names = [c.split()[0] for c in LANDED.split(", ")]
        yield pdf[kept].assign(run_id=key[0], session=key[1], mesh_id=key[2])[names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())


def _watched(d: DataFrame, idle_ms: int | None, late: str | None) -> DataFrame:
    """Rows may come ``late`` behind the newest, by default as late as state may idle: rows of one frame share a time and may fall
    into several batches, so a bound of nothing would lose some."""
    return d if idle_ms is None else d.withWatermark("ts", late or f"{idle_ms} milliseconds")


def changed(landed: DataFrame, idle_ms: int | None = None, late: str | None = None) -> DataFrame:
    """Frames whose (vertices, faces) signature differs from the newest frame of their mesh in the session.

    Frames go by seq; an older one than the newest seen adds nothing. A mesh forgotten after ``idle_ms`` is new when it comes again.
    """
    use_state_store(landed.sparkSession)
    return _watched(landed, idle_ms, late).groupBy(*SESSION, "mesh_id").transformWithStateInPandas(
        statefulProcessor=_Changed(idle_ms), outputStructType=LANDED, outputMode="Append", timeMode="None" if idle_ms is None else "EventTime")


def faces_of(chunks: DataFrame, density: float, voxel: float | None = None) -> DataFrame:
    """Faces of decoded chunks at the working density, with corner and face normals, colour (null without one) and voxel.

    Corner normals are angle-weighted vertex normals of the reduced chunk. A reduced face has the colour of its source face.
    """
    keys = ["run_id", "session", "mesh_id", "seq", "ts"]
    frames = chunks.select(*keys, "vertex_count", "face_count", F.struct(*[F.col(s).alias(f"{s}_bytes") for s in fr.SECTIONS]).alias("layout"), "blob")
    dec = cut_lineage(fr.decode(frames, keys))
    name = F.concat_ws("/", "run_id", "session", "mesh_id", "seq", F.unix_micros("ts")).alias("arch_id")
    v = fr.vertex_rows(dec, keys).select(name, "vid", *[F.col(a).cast("double").alias(a) for a in "xyz"], *[F.col(c).cast("bigint").alias(c) for c in "rgb"])
    f = fr.face_rows(dec, keys).select(name, "fid", "v0", "v1", "v2")
    rv, rf = mesh.reduce_density(mesh.face_geometry(f, v.drop(*"rgb")), v, density)
    geom = cut_lineage(mesh.face_geometry(rf, rv))
    corners = rv.select("arch_id", "vid").join(mesh.vertex_normals(geom), ["arch_id", "vid"], "left")
    full = mesh.gather_corners(geom, corners, ("nx", "ny", "nz"))
    colour = mesh.face_colours(f, v).select("arch_id", "fid", *"rgb")
    at = F.split("arch_id", "/")
    return full.join(colour, ["arch_id", "fid"]).select(
        *[at[i].cast("bigint").alias(k) for i, k in enumerate(keys[:4])], F.timestamp_micros(at[4].cast("bigint")).alias("ts"), "fid",
        *[f"{p}{a}" for p in ("m", "p", "q", "r", "n", "pn", "qn", "rn") for a in "xyz"], "area", *"rgb",
        *mesh.cell_key("m", voxel or mesh.voxel_size(density)))


class _Block(_Timed):
    """Order of the face that holds each voxel of a block, as one Arrow table."""

    def __init__(self, idle: int | None):
        self.idle = idle
        self.columns = [c.split()[0] for c in FACE.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "rows binary")

    def _before(self) -> pd.DataFrame:
        return pa.ipc.open_stream(self.held.get()[0]).read_pandas()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        self.touch(pdf["ts"].max())
        new = pdf.assign(_new=1)
        if self.held.exists():
            new = pd.concat([self._before().assign(_new=0), new], ignore_index=True)
        won = new.sort_values([*_VOXEL, *_ORDER, "_new"], kind="stable").drop_duplicates(_VOXEL)
        fresh = won[won["_new"] == 1]
        if len(fresh):
            table = pa.Table.from_pandas(won[[*_VOXEL, *_ORDER]], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            self.held.update((sink.getvalue().to_pybytes(),))
        yield fresh.assign(run_id=key[0], session=key[1], evicted=pd.NA)[[*self.columns, "evicted"]].astype({"evicted": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            n = len(self._before())
            self.held.clear()
            yield pd.DataFrame([{**dict.fromkeys(self.columns), "run_id": key[0], "session": key[1], "evicted": n}])


def claims(faces: DataFrame, idle_ms: int | None = None, late: str | None = None, block: int = 8) -> DataFrame:
    """The face of lowest (seq, mesh, face) holds its voxel for the session. Update mode: the newest row of a voxel counts.

    ``evicted`` is null in rows of faces; a block that is let go leaves one row with the number of voxels it held. A face that comes
    for such a voxel later takes it over.
    """
    use_state_store(faces.sparkSession)
    d = _watched(faces, idle_ms, late).withColumns({f"_b{i}": F.floor(F.col(c) / block) for i, c in enumerate(_VOXEL)})
    return d.groupBy(*SESSION, "_b0", "_b1", "_b2").transformWithStateInPandas(
        statefulProcessor=_Block(idle_ms), outputStructType=FACE + ", evicted bigint", outputMode="Update",
        timeMode="None" if idle_ms is None else "EventTime")


def advance(frames: DataFrame, path: str, density: float = 5.0, voxel: float | None = None, idle_ms: int | None = None,
            late: str | None = None, files_per_batch: int | None = None, losses: Callable[[int], None] | None = None) -> DataFrame:
    """Take the three stages through everything that ``frames`` (run_id, header, blob) has new; the table of claims.

    Called again with the same path, it goes on where it stopped. ``losses`` is told of rows behind the watermark (see ``run_to_table``).
    """
    spark = frames.sparkSession
    run_to_table(frames, f"{path}/land", each=Land(f"{path}/land"))
    landed = file_stream(spark, f"{path}/land/data", LANDED, files_per_batch)
    run_to_table(changed(landed, idle_ms, late), f"{path}/faces", each=lambda d, _: faces_of(cut_lineage(d), density, voxel), losses=losses)
    faces = file_stream(spark, f"{path}/faces/data", FACE, files_per_batch)
    return run_to_table(claims(faces, idle_ms, late), f"{path}/claims", "update", losses=losses)


def accumulated(claimed: DataFrame) -> DataFrame:
    """One row per run, session and claimed voxel."""
    return newest_update(claimed.filter("evicted is null").drop("evicted"), [*SESSION, *_VOXEL])


def evictions(claimed: DataFrame) -> DataFrame:
    """(run_id, session, evicted): voxels whose claims were let go."""
    return claimed.filter("evicted is not null").groupBy(*SESSION).agg(F.sum("evicted").alias("evicted"))


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/claims/data")
