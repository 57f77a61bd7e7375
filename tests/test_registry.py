"""Names of the registered queries and their SQL twins."""
import __spark_entry__ as entry
from weblens.plans import registry as plans


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_are_unique_and_follow_the_inventory():
    import importlib
    total = sum(len(importlib.import_module(f"weblens.plans.queries_{m}").QUERIES) for m in plans.MODULES)
    assert total == len(plans.queries()) and set(plans.queries()) <= set(entry.queries())
    assert all(n[0] in "spjwraktu" for n in plans.queries())


def test_flagship_on_the_smallest_data(spark):
    rows = entry.entry(spark)
    assert rows.columns[0] == "day" and rows.count() > 0
