"""All queries of the library by name, with their DuckDB equivalents."""

from __future__ import annotations

import importlib
import pkgutil

from tenderflow import plans
from tenderflow.plans.base import ORACLE_SQL, QUERIES

for _found in pkgutil.iter_modules(plans.__path__):
    if _found.name.endswith("_queries"):
        importlib.import_module(f"tenderflow.plans.{_found.name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
