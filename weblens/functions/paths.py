"""Address templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.operators.requests import salted_lookup
from weblens.plans.store import stored

# fixed values: identifiers inside an address
SEGMENT_ID = r"^(?:\d+|[0-9a-fA-F]{16,}|[0-9a-fA-F-]{32,36})$"
SEGMENT_NUMBERED = r"^[A-Za-z_-]{1,8}\d+[A-Za-z]?$"
SEGMENT_TAIL = r"\d+[A-Za-z]?$"
PAGE_FILE = r"\.(php|html?|aspx?|jsp)$"


def _segment(s: Column) -> Column:
    return F.when(s.rlike(SEGMENT_ID), F.lit("*")).when(s.rlike(SEGMENT_NUMBERED), F.regexp_replace(s, SEGMENT_TAIL, "*")).otherwise(s)


def segments(base: Column) -> Column:
    return F.transform(F.split(base, "/"), _segment)


def simple_template(base: Column) -> Column:
    """Template from the address alone: identifiers and numbered words become '*'."""
    return F.array_join(segments(base), "/")


def path_templates(spark, addresses: DataFrame, popular: DataFrame, min_children: int = 30) -> DataFrame:
    """base -> template: a parent with many different children collapses them into '*', level by level.

    ``popular`` holds the addresses asked by at least two IPs.  Only distinct
    addresses take part; every level is written out, so the plan stays flat.
    """
    rows = addresses.select("base").distinct().join(popular.select("base").distinct().withColumn("good", F.lit(True)), "base", "left")
    rows = stored(spark, rows.withColumn("seg", segments(F.col("base"))), "templates")
    deepest = (rows.agg(F.max(F.size("seg")).alias("d")).first().d or 1) - 1
    for depth in range(2, deepest + 1):
        here = F.element_at("seg", depth + 1)
        rows = rows.withColumn("_parent", F.array_join(F.slice("seg", 1, depth), "/"))
        open_ = (F.size("seg") > depth) & ~F.coalesce(F.try_element_at("seg", F.lit(depth + 1)), F.lit("")).isin("", "*")
        wide = rows.where(F.col("good") & open_).groupBy("_parent").agg(F.count_distinct(here).alias("_n")).where(
            F.col("_n") >= min_children).select("_parent", F.lit(True).alias("_wide"))
        joined = salted_lookup(rows, wide, "_parent", F.xxhash64("base"))
        collapse = F.col("_wide") & open_ & ~F.try_element_at("seg", F.lit(depth + 1)).rlike(PAGE_FILE)
        starred = F.transform("seg", lambda s, i: F.when(i == depth, F.lit("*")).otherwise(s))
        rows = joined.withColumn("seg", F.when(collapse, starred).otherwise(F.col("seg"))).drop("_parent", "_wide")
        rows = stored(spark, rows, "templates")
    return rows.select("base", F.array_join("seg", "/").alias("tpl"))
