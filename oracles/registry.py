"""All DuckDB check queries: name -> SQL text."""

import importlib

MODULES = ["core", "series", "errors", "marketing", "security", "rules", "cases", "signatures", "structure", "streaming"]


def oracle_sql():
    from oracles.chain import whole

    found = {}
    for module in MODULES:
        found.update(importlib.import_module(f"oracles.{module}").SQL)
    return {name: whole(text) for name, text in found.items()}
