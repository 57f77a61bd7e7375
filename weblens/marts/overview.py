"""Traffic overview: visitor groups, activity by day, channels, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import fixed_values as fv


def count_if(cond):
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def group_totals(visits: DataFrame) -> DataFrame:
    return visits.groupBy("group", "subgroup").agg(
        F.count(F.lit(1)).alias("visits"), F.count_distinct("ip").alias("ips"),
        F.sum("n_req").alias("requests"), F.sum("bytes").alias("bytes"))


def daily_activity(visits: DataFrame) -> DataFrame:
    """Visits, distinct IPs and leads of every group by day and for the whole period (day is NULL there).

    Visits are first reduced to one row per (day, group, ip): distinct counts of
    both levels then come from that table.
    """
    per_ip = visits.groupBy("day", "group", "ip").agg(F.count(F.lit(1)).alias("visits"), F.sum("n_goal").alias("leads"))

    def table(rows, *keys):
        aggs = [F.sum(F.when(F.col("group") == g, F.col("visits")).otherwise(0)).alias(f"visits_{g}") for g in fv.GROUPS]
        aggs += [F.sum(F.when(F.col("group") == g, F.col("ips")).otherwise(0)).alias(f"ips_{g}") for g in fv.GROUPS]
        aggs += [F.sum(F.when(F.col("group") == g, F.col("leads")).otherwise(0)).alias(f"leads_{g}")
                 for g in (fv.PEOPLE, fv.BOTS, fv.OWN)]
        return rows.groupBy(*keys).agg(*aggs)

    daily = per_ip.groupBy("day", "group").agg(
        F.sum("visits").alias("visits"), F.count(F.lit(1)).alias("ips"), F.sum("leads").alias("leads"))
    total = per_ip.groupBy("group", "ip").agg(F.sum("visits").alias("visits"), F.sum("leads").alias("leads")).groupBy("group").agg(
        F.sum("visits").alias("visits"), F.count(F.lit(1)).alias("ips"), F.sum("leads").alias("leads"))
    return table(daily, "day").unionByName(table(total).withColumn("day", F.lit(None).cast("date")))


def channels(people: DataFrame) -> DataFrame:
    """Visits, IPs, leads, share and conversion by channel; the window sees one row per channel."""
    by = people.groupBy("channel").agg(
        F.count(F.lit(1)).alias("visits"), F.count_distinct("ip").alias("ips"), F.sum("n_goal").alias("leads"))
    total = F.sum("visits").over(Window.partitionBy())
    return by.withColumn("share", F.round(F.col("visits") / total, 6)).withColumn(
        "conversion", F.round(F.col("leads") / F.col("visits"), 6))
