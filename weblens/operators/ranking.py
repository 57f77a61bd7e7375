"""Top-n lists and code roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_values(rows: DataFrame, keys: list[str], value: Column, name: str, n: int = 3) -> DataFrame:
    """keys -> 'value: count, ...' with the n most frequent values; ties in value order.

    Values are counted first and ranked with a bounded rank, so only n values per
    key reach the final aggregation.
    """
    counts = rows.groupBy(*keys, value.cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_v").isNotNull())
    w = Window.partitionBy(*keys).orderBy(F.desc("_n"), "_v")
    best = counts.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    text = F.concat(F.col("_v"), F.lit(": "), F.col("_n").cast("string"))
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", text.alias("t")))), lambda s: s["t"]), ", ").alias(name))


def top_rows(rows: DataFrame, n: int, *order) -> DataFrame:
    """First n rows by an order that must be total."""
    return rows.orderBy(*order).limit(n)


def code_rollup(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Answer codes per key as text, split into answers and errors (499 counts as an answer: the visitor left)."""
    counts = rows.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))
    item = F.struct((-F.col("n")).alias("o"), F.col("status").alias("s"), F.concat(
        F.col("status").cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t"))
    error = (F.col("status") >= 400) & (F.col("status") != 499)
    text = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, item))), lambda s: s["t"]), ", ")
    return counts.groupBy(*keys).agg(text(~error).alias("answers"), text(error).alias("errors"))


def most_frequent(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Most frequent value per key and how many other values there are."""
    counts = rows.where(~F.coalesce(F.col(value), F.lit("")).isin("", "-")).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias(name),
                                     (F.count(F.lit(1)) - 1).alias(f"{name}_more"))
