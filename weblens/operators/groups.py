"""Who is behind a visit: base groups and the first regrouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import fixed_values as fv
from weblens.operators.requests import salted_lookup
from weblens.operators.sessions import SLOT


def describe(visits: DataFrame, uas: DataFrame, ips: DataFrame) -> DataFrame:
    """Attach user agent and network attributes and the authenticity of declared robots."""
    spread = F.floor(F.col("start") / SLOT)
    rows = salted_lookup(visits, uas, "ua", spread)
    rows = salted_lookup(rows, ips.select("ip", "asn", "org", "cc", "nettype"), "ip", spread)
    return rows.withColumn("fam_verified", C.family_verified(F.col("fam"), F.col("asn")))


# group and subgroup by rule, first match wins
BASE_RULES = [
    (fv.OWN, "staff"), (fv.OWN, "monitoring"), (fv.BOTS, "fake robots"), (fv.ROBOTS, "known"), (fv.ROBOTS, "unknown"),
    (fv.BOTS, "explicit (not a browser)"), (fv.BOTS, "masked: loads no resources"), (fv.PEOPLE, ""),
]


def base_group(visits: DataFrame, staff_ips: DataFrame | None = None, rhythm_clients: DataFrame | None = None) -> DataFrame:
    """First split of visits; ``staff_ips(ip)`` and ``rhythm_clients(ip, ua)`` are optional small tables."""
    rows = visits
    staff, rhythm = F.lit(False), F.lit(False)
    if staff_ips is not None:
        rows = rows.join(staff_ips.select("ip").distinct().withColumn("_staff", F.lit(True)), "ip", "left")
        staff = F.coalesce("_staff", F.lit(False))
    if rhythm_clients is not None:
        rows = rows.join(rhythm_clients.select("ip", "ua").distinct().withColumn("_rhythm", F.lit(True)), ["ip", "ua"], "left")
        rhythm = F.coalesce("_rhythm", F.lit(False))
    declared = F.col("fam") != ""
    named = ~F.col("fam_cat").isin(fv.SCRIPT, fv.OTHER_BOTS)
    loads_nothing = (F.col("n_static") == 0) & (F.col("n_pages") >= 1) & (F.col("n_embedded") == 0)
    rule = (
        F.when(staff, 0).when(rhythm, 1).when(declared & (F.col("fam_verified") == "no"), 2).when(declared & named, 3).when(declared, 4)
        .when(~F.col("ua_browser") | (F.col("n_head") == F.col("n_req")), 5).when(loads_nothing, 6).otherwise(7))
    rows = rows.withColumn("_rule", rule)
    return rows.withColumn("group", C.pick(F.col("_rule"), [g for g, _ in BASE_RULES])).withColumn(
        "subgroup", C.pick(F.col("_rule"), [s for _, s in BASE_RULES])).drop("_rule", "_staff", "_rhythm")


def monitor_addresses(rq: DataFrame, uas: DataFrame) -> DataFrame:
    """Distinct addresses asked by every client that names itself a monitoring service."""
    named = uas.where(F.col("monitor_name").isNotNull() | (F.col("fam_cat") == fv.MONITOR)).select("ua")
    return rq.join(named, "ua", "left_semi").groupBy("ip", "ua").agg(F.count_distinct("base").alias("n_addr"))


def regroup(visits: DataFrame, addresses: DataFrame, probing_clients: DataFrame | None = None) -> DataFrame:
    """Monitors by name and behaviour, impostors, utilities and clients without a user agent."""
    rows = visits.join(addresses, ["ip", "ua"], "left").withColumn("n_addr", F.coalesce("n_addr", F.lit(1)))
    group, sub = F.col("group"), F.col("subgroup")
    rhythm = sub.isin("monitoring", "unnamed monitoring")
    spy = F.lit(False)
    if probing_clients is not None:
        rows = rows.join(probing_clients.select("ip", "ua").distinct().withColumn("_probing", F.lit(True)), ["ip", "ua"], "left")
        spy = rhythm & F.coalesce("_probing", F.lit(False))
    by_name = ((F.col("fam_cat") == fv.MONITOR) & (F.col("fam") != "")) | F.col("monitor_name").isNotNull()
    by_name = by_name & group.isin(fv.ROBOTS, fv.PEOPLE, fv.BOTS, fv.MONITORS) & (sub != "staff")
    few = F.col("n_addr") <= fv.MONITOR_MAX_ADDRESSES
    no_ua = (F.col("fam") == "No User-Agent") & group.isin(fv.ROBOTS, fv.UTILITIES)
    script = (F.col("fam_cat") == fv.SCRIPT) & (F.col("fam") != "") & group.isin(fv.ROBOTS, fv.UTILITIES)
    util = F.when(F.col("fam") == "Scripts: other", C.product_name(F.col("ua"))).otherwise(F.col("fam"))
    name = F.coalesce("monitor_name", C.product_name(F.col("ua")))
    rule = (F.when(spy, 0).when(by_name & few, 1).when(rhythm & by_name, 2).when(rhythm, 3).when(by_name, 4).when(no_ua, 5).when(script, 6).otherwise(7))
    rows, no = rows.withColumn("_rule", rule), F.col("_rule")
    new_group = F.coalesce(C.pick(no, [fv.BOTS, fv.MONITORS, fv.MONITORS, fv.MONITORS, fv.BOTS, fv.BOTS, fv.UTILITIES, None]), group)
    new_sub = (F.when(no == 0, "scheduled recon").when(no.isin(1, 2), name).when(no == 3, "unnamed monitoring").when(no == 4, "poses as monitoring")
               .when(no == 5, "no user agent").when(no == 6, util).otherwise(sub))
    return rows.withColumn("subgroup", new_sub).withColumn("group", new_group).drop("_rule", "_probing", "n_addr")
