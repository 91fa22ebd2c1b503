"""Per-cycle snapshots: one record per processed cycle, older files may lack guidance fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

OPTIONAL = {"guidance_state": ("string", "none"), "guidance_target_label": ("bigint", None),
            "guidance_target_universal": ("bigint", None), "guidance_distance_mm": ("double", None),
            "guidance_compass": ("string", None)}


def write_snapshots(df: DataFrame, path: str, every: int = 1, batch_id: int = 0) -> None:
    """Keep every n-th cycle; one folder per batch, so that a retried batch replaces its own rows."""
    if every < 1:
        raise ValueError("every must be at least 1")
    df.filter(F.col("cycle") % every == 0).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots with missing guidance columns added; order by the numeric cycle with ``in_cycle_order``."""
    d = spark.read.option("mergeSchema", True).parquet(path)
    for name, (kind, default) in OPTIONAL.items():
        value = F.lit(default).cast(kind)
        d = d.withColumn(name, F.coalesce(F.col(name).cast(kind), value) if name in d.columns else value)
    return d


def in_cycle_order(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy("run_id", F.col("cycle").cast("bigint"))


def cycle_of(name) -> F.col:
    """Numeric cycle from a file name such as cycle_0042 (all digits of the base name)."""
    base = F.regexp_extract(name, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.regexp_replace(base, r"\D", "").cast("bigint")


def coloured_faces(snapshots: DataFrame) -> DataFrame:
    """Face rows of snapshots that carry colours of the right length: (run_id, cycle, label, r, g, b).

    face_colors: array of [r, g, b]; pred_labels: array of labels.
    """
    ok = snapshots.filter(F.col("has_face_colors") & (F.size("face_colors") == F.size("pred_labels")))
    z = F.explode(F.arrays_zip("face_colors", "pred_labels")).alias("e")
    return ok.select("run_id", "cycle", z).select("run_id", "cycle", F.col("e.pred_labels").alias("label"),
                                                  *[F.col("e.face_colors")[i].alias(c) for i, c in enumerate("rgb")])
