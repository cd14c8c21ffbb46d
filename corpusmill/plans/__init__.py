"""Importing this package registers every query."""

import importlib

MODULES = ("documents", "catalog", "search", "selection", "evaluation", "tree", "traces", "timeline", "audit", "streaming")

for _m in MODULES:
    importlib.import_module(f"{__name__}.{_m}")
