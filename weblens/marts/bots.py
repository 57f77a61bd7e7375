"""Robots, monitors, utilities, bots and their networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import fixed_values as fv
from weblens.operators.ranking import top_values
from weblens.operators.series import count_if


def robot_families(rq: DataFrame) -> DataFrame:
    rows = rq.where("fam <> ''")
    n = F.count(F.lit(1))
    by = rows.groupBy("fam", "fam_cat").agg(
        n.alias("requests"), F.count_distinct("ip").alias("ips"), F.count_distinct("day").alias("days"), F.sum("bytes").alias("bytes"),
        F.round(count_if(F.col("status") == 200) / n * 100, 4).alias("ok_pct"), count_if(F.col("status") == 404).alias("n_404"),
        count_if(F.col("status") >= 500).alias("n_5xx"), F.round(count_if(F.col("fam_verified") == "yes") / n * 100, 4).alias("genuine_pct"))
    return by.join(top_values(rows, ["fam"], C.section(F.col("base")), "looks_at", 3), "fam")


def robot_networks(rq: DataFrame) -> DataFrame:
    return rq.where("fam <> ''").groupBy("fam", "asn").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("ip").alias("ips"))


def monitors(rq: DataFrame) -> DataFrame:
    """What monitoring systems check, how often and how often they are refused.

    Gaps are taken over distinct seconds of one client, after exact repeats are folded.
    """
    rows = rq.where("`group` = 'monitors'")
    secs = rows.groupBy("subgroup", "ip", "ts").agg(F.count(F.lit(1)).alias("k"))
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("subgroup", "ip").orderBy("ts"))
    per_ip = secs.withColumn("gap", gap).groupBy("subgroup", "ip").agg(F.median("gap").alias("gap"))
    pace = per_ip.groupBy("subgroup").agg(F.median("gap").alias("interval"))
    refused = count_if(F.col("status").isin(403, 429, 444, 503))
    by = rows.groupBy("subgroup").agg(F.count(F.lit(1)).alias("checks"), F.count_distinct("ip").alias("ips"), F.sum("bytes").alias("bytes"),
                                      refused.alias("refused"), F.round(refused / F.count(F.lit(1)), 6).alias("refused_share"))
    return by.join(pace, "subgroup").join(top_values(rows, ["subgroup"], F.col("base"), "checks_what", 2), "subgroup")


def fakes(visits: DataFrame) -> DataFrame:
    rows = visits.where("subgroup = 'fake robots'")
    return rows.groupBy("ip").agg(
        F.min("fam").alias("posed_as"), F.sum("n_req").alias("requests"), F.count(F.lit(1)).alias("visits"), F.min("cc").alias("cc"),
        F.min("nettype").alias("nettype"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def bot_classes(visits: DataFrame) -> DataFrame:
    """Bot visits (and people who sent forms) by behaviour class."""
    sub = F.col("subgroup")
    cls = (F.when(sub.startswith("form spam"), sub).when((F.col("n_pages") >= 10) & (F.col("n_static") == 0), "page parser")
           .when(F.col("ua").rlike("HeadlessChrome|Puppeteer|Playwright|PhantomJS|Lightpanda"), "headless").when(sub == "masked: loads no resources", "loads no resources"))
    rows = visits.where("`group` = 'bots' OR (`group` = 'people' AND n_goal > 0)").withColumn("class", cls).where("class IS NOT NULL")
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("ip").alias("ips"), F.sum("n_goal").alias("sent"), F.sum("n_conv").alias("accepted"))


def bot_signatures(visits: DataFrame) -> DataFrame:
    """Which sign gave the bots away."""
    rows = visits.where("`group` = 'bots'")
    by = rows.groupBy("subgroup").agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("ip").alias("ips"), F.count_distinct("asn").alias("networks"),
                                      F.count_distinct("day").alias("days"), F.sum("n_goal").alias("sent"))
    return by.join(top_values(rows, ["subgroup"], F.col("nettype"), "top_network", 1), "subgroup").join(
        top_values(rows, ["subgroup"], F.col("entry"), "top_entry", 1), "subgroup")


def bot_networks(visits: DataFrame) -> DataFrame:
    by = visits.where("`group` = 'bots'").groupBy("asn", "nettype").agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("ip").alias("ips"))
    net = F.col("nettype")
    advice = (F.when(net.startswith(fv.NET_DC), "can be blocked by subnet").when(net == fv.NET_RELAY, "by behaviour only").when(net == fv.NET_MOBILE, "do not block")
              .when(net == fv.NET_RU, "by behaviour only").when(net == fv.NET_FOREIGN, "by the audience of the site").otherwise("depends"))
    return by.withColumn("advice", advice)


def check_ips(visits: DataFrame, ips: DataFrame) -> DataFrame:
    """Answers for a given list of IPs (``ip``): seen or not, visits, requests, leads."""
    seen = visits.join(ips.select("ip").distinct(), "ip", "left_semi").groupBy("ip").agg(
        F.count(F.lit(1)).alias("visits"), F.sum("n_req").alias("requests"), F.sum("n_goal").alias("sent"), F.sum("n_conv").alias("accepted"),
        F.count_distinct("group").alias("groups"))
    return ips.select("ip").distinct().join(seen, "ip", "left").fillna(0).withColumn("in_log", F.col("visits") > 0)


def ai_robots(rq: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return rq.where("fam_cat LIKE 'AI %'").groupBy("fam_cat", "fam").agg(
        n.alias("requests"), F.count_distinct("ip").alias("ips"), F.count_distinct("day").alias("days"), F.sum("bytes").alias("bytes"),
        count_if(F.col("status") >= 400).alias("errors"), F.round(count_if(F.col("fam_verified") == "yes") / n * 100, 4).alias("genuine_pct"))


def ai_pages(rq: DataFrame, category: str = fv.AI_USER) -> DataFrame:
    return rq.where(F.col("fam_cat") == category).groupBy("base", "fam").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("day").alias("days"))


def audience(visits: DataFrame, country: str = "RU") -> DataFrame:
    """Visits of people by country and the share of the main country."""
    by = visits.where("`group` = 'people'").groupBy("cc").agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("ip").alias("ips"))
    total = F.sum("visits").over(Window.partitionBy())
    return by.withColumn("share_pct", F.round(F.col("visits") / total * 100, 4)).withColumn("is_main", F.col("cc") == country)


def staff_activity(visits: DataFrame, rq: DataFrame, staff: DataFrame, admin: str) -> DataFrame:
    inside = rq.where(F.col("base").rlike(admin)).groupBy("ip").agg(F.count(F.lit(1)).alias("admin_requests"))
    by = visits.join(staff, "ip", "left_semi").groupBy("ip").agg(
        F.count(F.lit(1)).alias("visits"), F.sum("n_req").alias("requests"), F.count_distinct("day").alias("days"), F.min("day").alias("first_day"),
        F.max("day").alias("last_day"), F.sum("n_goal").alias("sent"))
    return by.join(inside, "ip", "left").fillna(0, ["admin_requests"])


def bot_journal(visits: DataFrame) -> DataFrame:
    """Bots by day: visits, IPs, IPs never seen before, bots on ad links."""
    rows = visits.where("`group` = 'bots'")
    per = rows.groupBy("ip", "day").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("channel") == fv.CH_ADS).alias("ads"), F.sum("n_goal").alias("sent"))
    first = per.groupBy("ip").agg(F.min("day").alias("first_day"))
    return per.join(first, "ip").groupBy("day").agg(
        F.sum("n").alias("visits"), F.count(F.lit(1)).alias("ips"), count_if(F.col("day") == F.col("first_day")).alias("new_ips"),
        F.sum("ads").alias("ad_visits"), F.sum("sent").alias("sent"))


def utilities(rq: DataFrame, addresses: DataFrame, staff: DataFrame) -> DataFrame:
    """What every utility client looks like: own, scanner, integration, developer or unclear; rolled up per utility."""
    rows = rq.where("`group` = 'utilities'")
    per = rows.groupBy("subgroup", "ip", "base", "day").agg(F.count(F.lit(1)).alias("n"))
    known = per.join(addresses.select("base", (F.col("probe") != "").alias("is_probe"), (F.col("existence") == "live").alias("is_live")), "base", "left")
    by_base = known.groupBy("subgroup", "ip", "base").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("is_probe"), F.col("n")).otherwise(0)).alias("probes"), F.sum(F.when(F.col("is_live"), F.col("n")).otherwise(0)).alias("live"))
    clients = by_base.groupBy("subgroup", "ip").agg(F.sum("n").alias("n"), F.sum("probes").alias("probes"), F.sum("live").alias("live"), F.max("n").alias("top"))
    days = per.groupBy("subgroup", "ip").agg(F.count_distinct("day").alias("days"))
    clients = clients.join(days, ["subgroup", "ip"]).join(staff.select("ip", F.lit(True).alias("_staff")), "ip", "left")
    n = F.col("n")
    verdict = (F.when(F.col("_staff"), "own").when((F.col("probes") >= 3) | (F.col("probes") / n >= 0.2), "scanner")
               .when((F.col("top") / n >= 0.8) & (F.col("days") >= 3), "integration").when((n <= 300) & (F.col("live") / n >= 0.8), "developer or check").otherwise("unclear"))
    return clients.withColumn("verdict", verdict).groupBy("subgroup", "verdict").agg(
        F.count(F.lit(1)).alias("ips"), F.sum("n").alias("requests"), F.sum("probes").alias("probes"))


def ip_profile(visits: DataFrame) -> DataFrame:
    """Main group, subgroup and name of every IP by its busiest visit, and how many groups it shows up in."""
    best = F.max_by(F.struct("group", "subgroup", "fam", "nettype", "cc"), F.struct("n_req", "vid"))
    rows = visits.groupBy("ip").agg(best.alias("b"), F.count_distinct("group").alias("groups"), F.sum("n_req").alias("requests"))
    alive = F.col("b.group").isin("people", "own") & (F.col("b.subgroup") != "site server")
    label = (F.when(F.col("b.group") == "people", "people").when(F.col("b.group") == "robots", F.concat(F.lit("robots: "), F.col("b.fam")))
             .when(F.col("b.subgroup") == "fake robots", F.concat(F.lit("bots: fake "), F.col("b.fam")))
             .otherwise(F.concat_ws(": ", "b.group", F.when(F.col("b.subgroup") != "", F.col("b.subgroup")))))
    return rows.select("ip", "b.group", "b.subgroup", "b.fam", "b.nettype", "b.cc", "groups", "requests", alive.alias("is_live"), label.alias("label"))
