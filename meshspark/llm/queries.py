"""All registered queries of this folder."""

import importlib

from meshspark.llm.shared import ORACLES, QUERIES

for _name in ("mixing", "cleaning", "secrets", "chat", "tokens", "simhash", "nbsvm", "surrogates", "leaks", "suffixes", "resampling",
              "pieces", "collocations"):
    importlib.import_module(f"meshspark.llm.{_name}")

__all__ = ["QUERIES", "ORACLES"]
