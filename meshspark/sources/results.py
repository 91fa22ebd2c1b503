"""Result tables as CSV and per-cycle metrics logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CORRUPT = "_corrupt_record"


def read_results(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """Ragged rows are tolerated: missing cells become null; a row with too many cells is whole in ``_corrupt_record``."""
    r = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("enforceSchema", True)
    known = r.schema(schema).csv(path).schema if schema else r.csv(path).schema
    return r.option("columnNameOfCorruptRecord", CORRUPT).schema(T.StructType([*known.fields, T.StructField(CORRUPT, T.StringType())])).csv(path)


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """Union over all keys, columns in sorted order."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return u.select(*sorted(u.columns))


def write_results(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("overwrite").option("header", True).csv(path)


def write_cycle_stats(df: DataFrame, path: str, batch_id: int) -> None:
    """Counters and stage timings, one row per cycle, one folder per batch: a retried batch replaces its own rows."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def run_label(parts: dict[str, str]):
    """Version string from settings; empty ones are left out."""
    return F.concat_ws("_", *[F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(p), F.col(c))) for c, p in parts.items()])


def run_id_of(ts) -> F.col:
    return F.date_format(ts, "yyyyMMdd_HHmmss")
