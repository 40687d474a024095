"""Imports every query module so that the registry is full."""

import importlib
import pkgutil

from framescope import plans
from framescope.plans.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.endswith("_queries")):
    importlib.import_module(f"framescope.plans.{_m}")

__all__ = ["ORACLES", "QUERIES"]
