"""The processed-mesh table: split lists, additive append, configuration guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# fixed values: list files per scheme and split
SPLIT_FILES = {
    (1, True): ["training_lower.txt", "training_upper.txt"], (1, False): ["testing_lower.txt", "testing_upper.txt"],
    (2, True): ["public-training-set-1.txt", "public-training-set-2.txt"], (2, False): ["private-testing-set.txt"],
}


def read_split(spark: SparkSession, folder: str, scheme: int, is_train: bool, processed: DataFrame | None = None) -> DataFrame:
    """(split_file, arch_id) of a split, restricted to already processed meshes."""
    if (scheme, is_train) not in SPLIT_FILES:
        raise ValueError(f"split scheme must be 1 or 2, not {scheme}")
    paths = [f"{folder}/{n}" for n in SPLIT_FILES[(scheme, is_train)]]
    lines = spark.read.text(paths).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("split_file"),
                                          F.trim("value").alias("arch_id")).filter("arch_id <> ''")
    if processed is None:
        return lines
    return lines.join(processed.select("arch_id").distinct(), "arch_id", "left_semi").select("split_file", "arch_id")


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def guard_config(spark: SparkSession, path: str, target_density: float, max_target_count: int | None) -> None:
    """Record the configuration of a table on first use; raise when a later one differs."""
    schema = "target_density double, max_target_count bigint"
    meta = f"{path}_config"
    now = (float(target_density), max_target_count)
    if not table_exists(spark, meta):
        spark.createDataFrame([now], schema).coalesce(1).write.json(meta)
        return
    row = spark.read.schema(schema).json(meta).first()
    if (row.target_density, row.max_target_count) != now:
        raise ValueError(f"table {path} was built with {tuple(row)}, not {now}; use another table for this configuration")


def append_new(df: DataFrame, path: str, key: str = "arch_id", buckets: int = 64) -> None:
    """Append only meshes not stored yet; stored ones are never touched. A hash bucket column prunes later reads."""
    spark = df.sparkSession
    new = df.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)))
    if table_exists(spark, path):
        have = spark.read.parquet(path).select(key).distinct()
        new = new.join(have, key, "left_anti")
    new.write.mode("append").partitionBy("bucket").parquet(path)


def is_processed(processed: DataFrame, raw: DataFrame, key: str = "arch_id") -> bool:
    return processed.select(key).distinct().count() == raw.select(key).distinct().count()
