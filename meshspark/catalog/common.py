"""Shared builders of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshspark import fixtures
from meshspark.functions.vectors import rounded
from meshspark.operators import mesh


def lattice_geometry(spark, sf) -> DataFrame:
    return mesh.face_geometry(fixtures.lattice_faces(spark, sf), fixtures.lattice_vertices(spark, sf))


def out(df: DataFrame, keys: list[str], values: list[str] = ()) -> DataFrame:
    """Keys as they are, values as doubles rounded to six digits."""
    return df.select(*keys, *[rounded(F.col(v)).alias(v) for v in values])


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})
