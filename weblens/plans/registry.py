"""All registered queries: name -> function of (spark, sf_dir)."""

from __future__ import annotations

import importlib

MODULES = ["core", "series", "errors", "marketing", "security", "rules", "cases", "signatures", "structure", "streaming"]


def queries():
    found = {}
    for module in MODULES:
        found.update(importlib.import_module(f"weblens.plans.queries_{module}").QUERIES)
    return found
