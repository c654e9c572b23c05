"""Query catalogue: importing this package registers every query."""
from __future__ import annotations

import importlib
import pkgutil

from cladeloom.plans.registry import QUERIES, SQL

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if _m.startswith("q_"):
        importlib.import_module(f"{__name__}.{_m}")

__all__ = ["QUERIES", "SQL"]
