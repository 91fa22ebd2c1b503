"""All registered queries."""

import importlib

from meshspark.catalog.registry import ORACLES, QUERIES

for _name in ("mesh", "frames", "patches", "points", "features", "evaluation", "temporal", "colours", "streams", "jobs", "extra"):
    importlib.import_module(f"meshspark.catalog.{_name}")

__all__ = ["QUERIES", "ORACLES"]
