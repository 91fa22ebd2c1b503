"""Temporary SQL functions of a session: plain SQL expressions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from meshspark.functions.labels import COARSE_NAMES, coarse_of, universal_of
from meshspark.functions.vectors import COMPASS


def _array(values) -> str:
    return "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def definitions() -> dict[str, str]:
    upper, lower = (_array([universal_of(i, a) for i in range(17)]) for a in ("upper", "lower"))
    return {
        "redness(r DOUBLE, g DOUBLE, b DOUBLE) RETURNS DOUBLE": "r - (g + b) / 2",
        "gum_score(redness DOUBLE, threshold DOUBLE) RETURNS DOUBLE": "least(1D, greatest(0D, 0.5D + (redness - threshold) / 40D))",
        "coarse_label(label INT) RETURNS INT": f"element_at({_array([coarse_of(i) for i in range(17)])}, label + 1)",
        "coarse_name(coarse INT) RETURNS STRING": f"element_at({_array(COARSE_NAMES)}, coarse + 1)",
        "universal_number(label INT, arch STRING) RETURNS INT":
            f"CASE arch WHEN 'upper' THEN element_at({upper}, label + 1) WHEN 'lower' THEN element_at({lower}, label + 1) END",
        "compass(angle DOUBLE) RETURNS STRING": f"element_at({_array(COMPASS)}, least(cast(floor(pmod(angle + 22.5D, 360D) / 45D) AS INT), 7) + 1)",
        "area_bucket(area DOUBLE) RETURNS STRING":
            "CASE WHEN area >= 0 AND area < 100 THEN '0-100' WHEN area >= 100 AND area < 400 THEN '100-400' WHEN area >= 400 THEN '400+' ELSE 'unknown' END",
    }


def register(spark: SparkSession) -> None:
    for signature, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
