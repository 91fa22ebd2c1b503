"""Structured Streaming operators of a live run.

State is keyed so that no key grows with the whole input: voxels by (run, block of voxels), confirmation and guidance
by run on rows that are already aggregated per cycle.
"""

from __future__ import annotations

import copy
import json
import threading
from typing import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from meshspark.session import STATE_STORE, scratch_path
from meshspark.streaming import guidance as gd

FRAME_TYPES = ("mesh", "scan_control", "status", "error")


BATCH_BYTES = 128 << 20


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Stream of a Parquet table, be it one file or a folder of part files. No operator here depends on how the rows
    fall into files or batches. A batch is bounded by bytes, since every stage writes a file per partition and batch: a bound of so many
    files would multiply the batches from stage to stage. ``files_per_batch`` bounds it by files instead."""
    bound = ("maxBytesPerTrigger", BATCH_BYTES) if files_per_batch is None else ("maxFilesPerTrigger", files_per_batch)
    return spark.readStream.schema(schema).option(*bound).option("recursiveFileLookup", True).parquet(path)


def route(frames: DataFrame, type_col: str = "type") -> dict[str, DataFrame]:
    """One stream per frame type."""
    return {t: frames.filter(F.col(type_col) == t) for t in FRAME_TYPES}


class _Drops(StreamingQueryListener):
    """Rows dropped behind the watermark by every batch of a query, however many batches it has."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.ended = threading.Condition()
        self.over: set[str] = set()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        n = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        with self.ended:
            self.rows[str(event.progress.runId)] = self.rows.get(str(event.progress.runId), 0) + n

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        with self.ended:
            self.over.add(str(event.runId))
            self.ended.notify_all()

    def of(self, run: str) -> int:
        """Events come in order, so all progress is known once the end is."""
        with self.ended:
            if not self.ended.wait_for(lambda: run in self.over, timeout=120):
                raise RuntimeError("the stream's last events did not arrive")
            return self.rows.get(run, 0)


def run_to_table(stream: DataFrame, path: str, mode: str = "append", each: Callable | None = None,
                 losses: Callable[[int], None] | None = None) -> DataFrame:
    """Run a stream over everything available and append each micro-batch to a table under the shared folder.

    A batch overwrites its own folder, so a retried batch leaves the same rows. ``losses`` is told how many rows came later than
    a watermark allows; without it such rows are an error, never silent.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        d = each(batch, batch_id) if each else batch
        d.write.mode("overwrite").parquet(f"{path}/data/batch_id={batch_id}")

    drops = _Drops()
    spark.streams.addListener(drops)
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint") \
            .trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
        late = drops.of(str(q.runId))
    finally:
        spark.streams.removeListener(drops)
    if losses is not None:
        losses(late)
    elif late:
        raise ValueError(f"{late} rows came later than the watermark allows")
    return spark.read.parquet(f"{path}/data")


def newest_update(table: DataFrame, keys: list[str]) -> DataFrame:
    """Last version of each key of an update-mode table."""
    rest = [c for c in table.columns if c not in keys and c != "batch_id"]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_v")).select(*keys, "_v.*")


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class _ClaimBlock(StatefulProcessor):
    """Winning observation per voxel of one block, as one Arrow table: one read and one write per block and batch."""

    def __init__(self, run: str, voxel: list[str], order: list[str], columns: list[str]):
        self.run, self.voxel, self.order, self.columns = run, voxel, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = [*self.voxel, *self.order]
        kept = [c for c in self.columns if c != self.run]  # the grouping columns come with the key only
        won = pa.ipc.open_stream(self.held.get()[0]).read_pandas().assign(_new=False) if self.held.exists() else None
        for pdf in rows:  # chunk by chunk: no more than the block's winners and one chunk are held
            pdf = pdf[kept].assign(_new=True)
            pdf = pdf if won is None else pd.concat([won, pdf], ignore_index=True)
            won = pdf.sort_values([*own, "_new"], kind="stable").drop_duplicates(self.voxel)
        fresh = won[won["_new"].astype(bool)]
        if len(fresh):
            table = pa.Table.from_pandas(won[own], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            self.held.update((sink.getvalue().to_pybytes(),))
        yield fresh.drop(columns="_new").assign(**{self.run: key[0]})[self.columns]

    def close(self) -> None:
        pass


HELD_ROWS = 200_000


def _first_rows(keys: list[str], order: list[str], held_rows: int = HELD_ROWS):
    """Of the rows of a task those of lowest order per key, so that one busy voxel does not send all its rows; a full table is handed on."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = held.sort_values(order, kind="stable").drop_duplicates(keys)
            if len(held) >= held_rows:
                yield held
                held = None
        if held is not None:
            yield held
    return run


def claim_voxels(stream: DataFrame, voxel: list[str], order: list[str], run: str = "run_id", block: int = 8) -> DataFrame:
    """The observation of lowest order wins each voxel for the whole run, in whatever files and batches rows arrive.

    Update mode: a row says that it holds its voxel from now on; the newest row of a voxel counts (``newest_update``). With rows
    in capture order nothing is ever taken back. The state key is (run, block of voxels), so one busy run spreads over the
    cluster, and holds at most block**n rows. A changed run id is a fresh coordinate frame and starts without claims.
    """
    use_state_store(stream.sparkSession)
    b = [F.floor(F.col(c) / block).alias(f"_b{i}") for i, c in enumerate(voxel)]
    keyed = stream.mapInPandas(_first_rows([run, *voxel], order), stream.schema).select("*", *b)
    return keyed.groupBy(run, *[f"_b{i}" for i in range(len(voxel))]).transformWithStateInPandas(
        statefulProcessor=_ClaimBlock(run, voxel, order, stream.columns), outputStructType=stream.schema,
        outputMode="Update", timeMode="None")


def claim_any(stream: DataFrame, voxel: list[str], run: str = "run_id") -> DataFrame:
    """As ``claim_voxels`` where any row of the first batch may win: built-in deduplication, state kept for good."""
    return stream.dropDuplicates([run, *voxel])


def first_delivery(stream: DataFrame, late: str, ts: str = "ts") -> DataFrame:
    """Drop repeated deliveries of a mesh within the caller's lateness bound; ``run_to_table`` counts what comes later still."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(["run_id", "mesh_id"])


class _Cycles(StatefulProcessor):
    """Cycles of a run in order, however they arrive.

    The state has the run up to the last final cycle and the rows of the open ones. With a horizon, cycles that many behind the
    newest become final; rows for a final cycle are counted as late. Open cycles are stepped through anew on a copy
    whenever rows arrive, so the newest output of a key is always that of the rows seen so far.
    """

    def __init__(self, horizon: int | None):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "doc string")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        doc = _load(self.state)
        for cycle, g in pdf.groupby("cycle"):
            if doc["final"] is not None and cycle <= doc["final"]:
                doc["late"] += len(g)
                continue
            held = doc["open"].setdefault(int(cycle), {})
            held.update({int(r["label"]): r for r in g.drop(columns=["cycle"]).to_dict("records")})
        order = sorted(doc["open"])
        out = []
        if self.horizon is not None and order:
            for cycle in [c for c in order if c <= order[-1] - self.horizon]:
                out += self.step(doc["run"], key[0], cycle, doc["open"].pop(cycle))
                doc["final"] = cycle
        _store(self.state, doc)
        run = copy.deepcopy(doc["run"])
        for cycle in sorted(doc["open"]):
            out += self.step(run, key[0], cycle, doc["open"][cycle])
        yield self.frame(run, key[0], out, doc["late"])

    def close(self) -> None:
        pass


def _load(state) -> dict:
    if not state.exists():
        return {"run": gd.new_run(), "open": {}, "final": None, "late": 0}
    doc = json.loads(state.get()[0])
    for part in ("streak", "seen_at"):
        doc["run"][part] = {int(k): v for k, v in doc["run"][part].items()}
    doc["open"] = {int(c): {int(k): v for k, v in rows.items()} for c, rows in doc["open"].items()}
    return doc


def _store(state, doc: dict) -> None:
    state.update((json.dumps(doc, default=float),))


class _Confirm(_Cycles):
    def __init__(self, min_faces: int, cycles: int, horizon: int | None):
        super().__init__(horizon)
        self.min_faces, self.cycles = min_faces, cycles

    def step(self, run, run_id, cycle, rows):
        for label in gd.confirm(run, {k: r["n"] for k, r in rows.items()}, self.min_faces, self.cycles):
            run.setdefault("confirmed_at", {})[str(label)] = cycle
        return []

    def frame(self, run, run_id, out, late):
        at = run.get("confirmed_at", {})
        return pd.DataFrame([(run_id, k, at.get(str(k)), late) for k in range(1, 17)],
                            columns=["run_id", "label", "confirmed_cycle", "late_rows"]).astype({"confirmed_cycle": "Int64"})


def confirm_labels(counts: DataFrame, min_faces: int, cycles: int, horizon: int | None = None) -> DataFrame:
    """(run_id, label, confirmed_cycle, late_rows) for labels 1..16 in update mode; null while a label is not confirmed.

    counts: (run_id, cycle, label, n) in any order and any batches; a repeated (run, cycle, label) replaces the former one.
    ``horizon`` bounds the state: cycles that many behind a run's newest are closed (None: all stay open).
    """
    use_state_store(counts.sparkSession)
    return counts.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=_Confirm(min_faces, cycles, horizon),
        outputStructType="run_id bigint, label bigint, confirmed_cycle bigint, late_rows bigint", outputMode="Update", timeMode="None")


def confirmed(table: DataFrame) -> DataFrame:
    """Confirmed labels from the table of a ``confirm_labels`` stream."""
    return newest_update(table, ["run_id", "label"]).filter("confirmed_cycle is not null").select("run_id", "label", "confirmed_cycle")


def _guide_step(run: dict, run_id, cycle: int, rows: dict, kw: dict) -> dict:
    counts = {label: int(r["n"]) for label, r in rows.items()}
    at = {label: (r["cx"], r["cy"], r["cz"]) for label, r in rows.items()}
    first = rows[min(rows)]
    return {"run_id": run_id, "cycle": cycle, **gd.cycle_step(run, counts, at, tuple(float(first[c]) for c in ("hx", "hy", "hz")), **kw)}


def _guide_cycles(run: dict, run_id, pdf: pd.DataFrame, kw: dict) -> list[dict]:
    return [_guide_step(run, run_id, cycle, {int(r["label"]): r for r in g.to_dict("records")}, kw)
            for cycle, g in pdf.groupby("cycle", sort=True)]


COLUMNS = [c.split()[0] for c in gd.GUIDANCE_SCHEMA.split(", ")]


class _Guide(_Cycles):
    def __init__(self, kw: dict, horizon: int | None):
        super().__init__(horizon)
        self.kw = kw

    def step(self, run, run_id, cycle, rows):
        return [_guide_step(run, run_id, cycle, rows, self.kw)]

    def frame(self, run, run_id, out, late):
        return pd.DataFrame(out, columns=COLUMNS).assign(late_rows=late)


def guide(rows: DataFrame, horizon: int | None = None, **kw) -> DataFrame:
    """Guidance per cycle as a stream in update mode. rows: (run_id, cycle, label, n, cx, cy, cz, hx, hy, hz), in any order."""
    use_state_store(rows.sparkSession)
    return rows.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=_Guide(kw, horizon), outputStructType=gd.GUIDANCE_SCHEMA + ", late_rows bigint", outputMode="Update", timeMode="None")


def guided(table: DataFrame) -> DataFrame:
    """One row per run and cycle from the table of a ``guide`` stream."""
    return newest_update(table, ["run_id", "cycle"]).select(*COLUMNS)


def guide_batch(rows: DataFrame, **kw) -> DataFrame:
    """The same over stored cycles; a run contributes at most 16 rows per cycle."""
    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_guide_cycles(gd.new_run(), key[0], pdf, kw), columns=COLUMNS)
    return rows.groupBy("run_id").applyInPandas(one, gd.GUIDANCE_SCHEMA)


def throughput(stream: DataFrame, period: str, late: str | None = None) -> DataFrame:
    """Frames and bytes per run, type and tumbling period; update mode.

    Without ``late`` every row counts, whenever it comes; the state is one row per period. With it, periods close that long
    after the newest frame, and ``run_to_table`` counts the rows that come later still.
    """
    d = stream.withWatermark("ts", late) if late else stream
    return d.groupBy("run_id", "frame_type", F.window("ts", period).alias("w")) \
        .agg(F.count("*").alias("n_frames"), F.sum("bytes").alias("bytes"))


_KEPT = ("run_id bigint, mesh_id bigint, fid bigint, "
         + ", ".join(f"{p}{a} double" for p in ("m", "p", "q", "r") for a in "xyz") + ", area double, vx bigint, vy bigint, vz bigint")
_SIGNATURE = "run_id bigint, mesh_id bigint, vertex_count bigint, face_count bigint"


class FoldOnce:
    """foreachBatch body: each chunk enters the accumulated mesh exactly once.

    Unchanged re-sends are skipped by signature, the rest is reduced to the working density, faces on claimed voxels are
    left out, the others appended. Frames that cannot be decoded go to the quarantine table. All tables live under ``path`` with one folder per batch, so a repeated batch replaces
    its own rows; history is only read through keyed anti-joins.
    """

    def __init__(self, path: str, density: float = 5.0, voxel: float | None = None, retention: int | None = None):
        from meshspark.operators.mesh import voxel_size
        self.path, self.density, self.retention = path, density, retention
        self.voxel = voxel or voxel_size(density)

    def _before(self, spark: SparkSession, name: str, schema: str, batch_id: int) -> DataFrame | None:
        from meshspark.sources.cache import table_exists
        if not table_exists(spark, f"{self.path}/{name}"):
            return None
        return spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{self.path}/{name}").filter(F.col("batch_id") < batch_id)

    def _write(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        target = f"{self.path}/{name}/batch_id={batch_id}"
        df.write.mode("overwrite").partitionBy("run_id").parquet(target)  # history reads prune to the runs at hand
        return df.sparkSession.read.schema(df.schema).parquet(target).select(*df.columns)

    def __call__(self, frames: DataFrame, batch_id: int) -> None:
        """frames: (run_id, header, blob) of mesh frames."""
        from meshspark.operators.mesh import cell_key, face_geometry, reduce_density
        from meshspark.operators.temporal import claim_voxels as claim, latest_frame
        from meshspark.sources import frames as fr
        spark = frames.sparkSession
        parsed = fr.length_ok(fr.of_type(fr.parse_headers(frames), "mesh"))
        good = F.coalesce(F.expr("length_ok and face_count > 0 and vertex_count > 0"), F.lit(False))
        self._write(parsed.filter(~good), "quarantine", batch_id)
        parsed = parsed.filter(good)
        newest = latest_frame(parsed, ["run_id", "mesh_id"])
        seen = self._before(spark, "signatures", _SIGNATURE, batch_id)
        if seen is not None:
            last = seen.groupBy("run_id", "mesh_id").agg(F.max_by(F.struct("vertex_count", "face_count"), "batch_id").alias("s")) \
                .select("run_id", "mesh_id", "s.*")
            newest = newest.join(last, ["run_id", "mesh_id", "vertex_count", "face_count"], "left_anti")
        fresh = self._write(newest, "fresh", batch_id)
        keys = ["run_id", "mesh_id"]
        dec = fr.decode(fresh, keys)
        chunk = F.concat_ws("/", "run_id", "mesh_id").alias("arch_id")
        v = fr.vertex_rows(dec, keys).select(chunk, "vid", *[F.col(a).cast("double").alias(a) for a in "xyz"])
        f = fr.face_rows(dec, keys).select(chunk, "fid", "v0", "v1", "v2")
        rv, rf = reduce_density(face_geometry(f, v), v, self.density)
        g = face_geometry(rf, rv).select(
            F.split("arch_id", "/")[0].cast("bigint").alias("run_id"), F.split("arch_id", "/")[1].cast("bigint").alias("mesh_id"),
            "fid", "mx", "my", "mz", "area", *[p + a for p in "pqr" for a in "xyz"], *cell_key("m", self.voxel))
        won = claim(g, ["run_id", "vx", "vy", "vz"], ["mesh_id", "fid"])
        held = self._before(spark, "accumulated", _KEPT, batch_id)
        if held is not None:
            won = won.join(held.select("run_id", "vx", "vy", "vz"), ["run_id", "vx", "vy", "vz"], "left_anti")
        self._write(won, "accumulated", batch_id)
        self._write(fresh.select(*keys, "vertex_count", "face_count"), "signatures", batch_id)

    def accumulated(self, spark: SparkSession) -> DataFrame:
        """All kept faces, cut to the retention ceiling per run where one is set."""
        from meshspark.functions.hashing import uniform
        from meshspark.operators.ordinals import take_smallest
        d = spark.read.schema(f"{_KEPT}, batch_id bigint").parquet(f"{self.path}/accumulated")
        if self.retention is None:
            return d
        return take_smallest(d, ["run_id"], uniform("keep", "run_id", "mesh_id", "fid"), ["mesh_id", "fid"], self.retention)


def smooth_gum(current: DataFrame, previous: DataFrame | None, alpha: float = 0.3, max_dist: float = 1.0) -> DataFrame:
    """Blend gum scores with the nearest face of the previous cycle: (run_id, fid, x, y, z, score, is_gum).

    current: (run_id, fid, x, y, z, r, g, b); previous: the last result. Faces without a match keep their own score.
    """
    from meshspark.functions import colour as col
    from meshspark.operators.transfer import fill_missing_colour, match_previous
    raw = fill_missing_colour(current, col.gum_score(col.redness(F.col("r"), F.col("g"), F.col("b"))), max_dist, 0.0) \
        .select("run_id", "fid", "x", "y", "z", F.col("filled").alias("raw"))
    if previous is None:
        d = raw.withColumn("score", F.col("raw"))
    else:
        prev = previous.select("run_id", F.col("fid").alias("pid"), "x", "y", "z", F.col("score").alias("old"))
        m = match_previous(raw, prev, max_dist, max_dist, "run_id", "fid", "pid", ("old",))
        d = m.withColumn("score", F.when(F.col("old").isNull(), F.col("raw")).otherwise(alpha * F.col("raw") + (1 - alpha) * F.col("old")))
    return d.select("run_id", "fid", "x", "y", "z", "score", (F.col("score") > 0.5).alias("is_gum"))
