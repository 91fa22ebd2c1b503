"""From raw documents to a training mix: quality rules, near-duplicates, decontamination, secrets, mixing.

Each stage reads what the one before has written and calls one operator. The first four return the columns of documents; the
last has a row for each time the mix takes a document, with the words taken and the place in training.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshspark.llm import cleaning, leaks, mixing, near_copies, secrets
from meshspark.llm.shared import keep, read
from meshspark.session import scratch_path, ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail the base rule or lose too much text."""
    ship_package(spark)
    return cleaning.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id stays of each group of texts linked by a five-word Jaccard similarity of 0.8 or more."""
    ship_package(spark)
    return near_copies.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship_package(spark)
    return leaks.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays."""
    ship_package(spark)
    return secrets.redact(docs, secrets.new_ledger(spark, scratch_path(spark, "secret-ledger")))


def mixing_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and pass with the words that pass takes and its position in training, sorted by position."""
    ship_package(spark)
    return mixing.training_rows(mixing.mix(docs))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination),
          ("secret scan", secret_scan), ("mixing", mixing_order)]

# Fingerprint components, the latent space and the scans have no counterpart in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; every stage is written as Parquet and read again by the next one."""
    ship_package(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
