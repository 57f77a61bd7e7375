"""Attacker cases: features per IP, charges, verdicts, signatures and neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import fixed_values as fv
from weblens.operators.series import count_if

# fixed values: admin and login addresses; charges (id, feature, threshold, weight); severity by the top weight
ADMIN = r"^/(bitrix/admin|wp-admin|administrator|manager|admin|panel|cp|backend|dashboard|crm|lk-admin)(/|$)|^/wp-login\.php"
LOGIN = r"^/wp-login\.php$|^/bitrix/admin/(index\.php)?$|^/administrator/(index\.php)?$|^/manager/(index\.php)?$|^/admin/(index\.php)?$"
CHARGES = [
    ("leak", "leaks", 1, 100), ("spam_accepted", "accepted", 1, 95), ("attack_500", "attacks500", 1, 85), ("bruteforce", "login_post", 5, 80),
    ("spam", "forms", 1, 70), ("mass", "maxpm", 30, 60), ("attack", "attacks", 1, 55), ("admin", "admin", 5, 50), ("recon", "probes", 10, 45),
    ("odd_methods", "odd", 3, 40), ("schedule", "sched", 1, 35), ("ad_fraud", "ad_visits", 3, 30), ("mask", "mask", 1000, 20), ("noua", "noua", 500, 15),
]
WINDOW_CHARGES = {"outage": 90, "burst": 65}
IMPERSONATION_WEIGHT = 75


def ip_features(rq_attacks: DataFrame, visits: DataFrame, probes: DataFrame, leaked: DataFrame) -> DataFrame:
    """Counters per IP. Minutes are counted first, so the busiest minute comes from the same pass."""
    marked = rq_attacks.join(probes.select("base", F.lit(True).alias("_probe")), "base", "left").join(leaked.select("base", F.lit(True).alias("_leak")), "base", "left")
    st, m = F.col("status"), F.col("method")
    minutes = marked.groupBy("ip", F.floor(F.col("ts") / 60).alias("minute")).agg(
        F.count(F.lit(1)).alias("req"), count_if(F.col("is_page")).alias("pages"), count_if(F.col("_probe")).alias("probes"),
        count_if(F.col("_leak") & (st == 200) & (F.col("bytes") > 0)).alias("leaks"), count_if(F.col("attack").isNotNull()).alias("attacks"),
        count_if(F.col("attack").isNotNull() & (st >= 500)).alias("attacks500"), count_if(~m.isin("GET", "POST", "HEAD")).alias("odd"),
        count_if(F.col("base").rlike(ADMIN)).alias("admin"), count_if(F.col("base").rlike(LOGIN) & (m == "POST")).alias("login_post"),
        count_if(st >= 500).alias("e5"), F.sum("bytes").alias("bytes"), count_if(F.col("ua").isin("", "-")).alias("noua"))
    sums = ["req", "pages", "probes", "leaks", "attacks", "attacks500", "odd", "admin", "login_post", "e5", "bytes", "noua"]
    by = minutes.groupBy("ip").agg(*[F.sum(c).alias(c) for c in sums], F.max("pages").alias("maxpm"))
    bot = F.col("group") == fv.BOTS
    v = visits.groupBy("ip").agg(
        F.sum(F.when(bot, F.col("n_goal")).otherwise(0)).alias("forms"), F.sum(F.when(bot, F.col("n_conv")).otherwise(0)).alias("accepted"),
        count_if(bot & (F.col("channel") == fv.CH_ADS)).alias("ad_visits"), count_if(F.col("subgroup") == "scheduled recon").alias("sched"),
        F.sum(F.when(F.col("subgroup").startswith("masked"), F.col("n_req")).otherwise(0)).alias("mask"))
    return by.join(v, "ip", "left").fillna(0)


def case_key(profile: DataFrame) -> DataFrame:
    """IPs grouped by what they are and where they come from."""
    g, s, f, net = (F.col(c) for c in ("group", "subgroup", "fam", "nettype"))
    kind = (F.when(s == "fake robots", F.concat(F.lit("fake:"), f)).when(s == "scheduled recon", F.concat(F.lit("sched:"), F.col("ip")))
            .when(g == fv.UTILITIES, F.concat(F.lit("util:"), s, F.lit("|"), net)).when(g == fv.ROBOTS, F.concat(F.lit("robot:"), f, F.lit("|"), net))
            .when(g == fv.PEOPLE, F.concat(F.lit("human|"), net)).otherwise(F.concat(F.lit("bot:"), F.split(s, ":")[0], F.lit("|"), net)))
    return profile.withColumn("case_key", kind)


def window_shares(rq: DataFrame, case_ips: DataFrame, windows: DataFrame) -> DataFrame:
    """Share of every case in outage or burst windows (``kind, no, first_minute, last_minute``); per-minute counts joined on the minute."""
    minutes = windows.select("kind", "no", F.explode(F.sequence("first_minute", "last_minute")).alias("minute"))
    per = rq.groupBy("ip", F.floor(F.col("ts") / 60).alias("minute")).agg(F.count(F.lit(1)).alias("n")).join(minutes, "minute")
    total = per.groupBy("kind", "no").agg(F.sum("n").alias("total"))
    own = per.join(case_ips.select("ip", "case_key"), "ip").groupBy("case_key", "kind", "no").agg(F.sum("n").alias("n"))
    return own.join(total, ["kind", "no"]).withColumn("share", F.col("n") / F.col("total"))


def cases(features: DataFrame, profile: DataFrame, excluded: DataFrame, shares=None) -> DataFrame:
    """Cases with their charges, total weight and severity. ``shares`` adds outage and burst charges."""
    strong = reduce(lambda a, b: a | b, [F.col(c) >= n for c, n in (("leaks", 1), ("attacks", 1), ("probes", 10), ("login_post", 5), ("admin", 5), ("odd", 3), ("maxpm", 30))])
    rows = features.join(case_key(profile).select("ip", "group", "case_key", "nettype"), "ip").join(excluded.select("ip"), "ip", "left_anti")
    rows = rows.where(F.col("group").isin(fv.BOTS, fv.UTILITIES) | (strong & (F.col("group") != fv.OWN)))
    names = sorted({c[1] for c in CHARGES})
    by = rows.groupBy("case_key").agg(F.count(F.lit(1)).alias("ips"), F.sum("req").alias("requests"), *[(F.max if c == "maxpm" else F.sum)(c).alias(c) for c in names])
    charge = [F.when(F.col(f) >= n, F.struct(F.lit(w).alias("weight"), F.lit(i).alias("charge"))) for i, f, n, w in CHARGES]
    charge.append(F.when(F.col("case_key").startswith("fake:"), F.struct(F.lit(IMPERSONATION_WEIGHT).alias("weight"), F.lit("impersonation").alias("charge"))))
    if shares is not None:
        hit = shares.where((F.col("share") >= 0.2) | ((F.col("kind") == "outage") & (F.col("n") >= 50) & (F.col("share") >= 0.05)))
        hit = hit.groupBy("case_key").agg(F.bool_or(F.col("kind") == "outage").alias("in_outage"), F.bool_or(F.col("kind") == "burst").alias("in_burst"))
        by = by.join(hit, "case_key", "left")
        for name, flag in (("outage", "in_outage"), ("burst", "in_burst")):
            charge.append(F.when(F.col(flag), F.struct(F.lit(WINDOW_CHARGES[name]).alias("weight"), F.lit(name).alias("charge"))))
    by = by.withColumn("_c", F.sort_array(F.array_compact(F.array(*charge)), asc=False)).where(F.size("_c") > 0)
    top = F.col("_c")[0]["weight"]
    severity = F.when(top >= 80, "urgent").when(top >= 50, "important").otherwise("for information")
    return by.select("case_key", "ips", "requests", F.array_join(F.transform("_c", lambda c: c["charge"]), ", ").alias("charges"),
                     top.cast("long").alias("top_weight"), F.aggregate("_c", F.lit(0).cast("long"), lambda a, c: a + c["weight"]).alias("weight"), severity.alias("severity"))


def ip_verdicts(case_list: DataFrame, profile: DataFrame, people_ips: DataFrame, people_networks: DataFrame) -> DataFrame:
    """Keep, watch, rate-limit or block every IP of a case."""
    rows = case_key(profile).join(case_list.select("case_key", "severity"), "case_key")
    rows = rows.join(people_ips.select("ip", F.lit(True).alias("_people")), "ip", "left").join(people_networks.select("nettype", F.lit(True).alias("_shared")), "nettype", "left")
    verdict = (F.when(F.col("_people"), "keep").when(F.col("severity") == "for information", "watch")
               .when(F.col("nettype") == fv.NET_MOBILE, "rate-limit").when(F.col("_shared"), "rate-limit").otherwise("block"))
    return rows.select("ip", "case_key", "severity", verdict.alias("verdict"))


def signatures(case_list: DataFrame, visits: DataFrame, case_ips: DataFrame) -> DataFrame:
    """A stable signature per case (hash of its rule) with visits it hits and people it would touch in the same networks."""
    hits = visits.join(case_ips.select("ip", "case_key"), "ip")
    per = hits.groupBy("case_key").agg(F.count(F.lit(1)).alias("hits"))
    nets = hits.select("case_key", "asn").distinct()
    people = visits.where("`group` = 'people'").groupBy("asn").agg(F.count(F.lit(1)).alias("n"))
    touched = nets.join(people, "asn").groupBy("case_key").agg(F.sum("n").alias("people_in_networks"))
    rule = F.to_json(F.struct(F.col("case_key").alias("kind"), F.lit("case").alias("type")))
    rows = case_list.select("case_key").join(per, "case_key").join(touched, "case_key", "left").fillna(0, ["people_in_networks"])
    return rows.withColumn("signature_id", F.concat(F.lit("SIG-"), F.upper(F.substring(F.sha1(rule.cast("binary")), 1, 6))))


def case_mates(case_ips: DataFrame) -> DataFrame:
    """Cases that share /24 subnets: each subnet is a hub; counts only, no IP pairs."""
    nets = case_ips.withColumn("subnet", C.subnet24(F.col("ip"))).where("subnet <> ''").groupBy("subnet", "case_key").agg(F.count(F.lit(1)).alias("ips"))
    shared = nets.groupBy("subnet").agg(F.count(F.lit(1)).alias("cases"), F.sum("ips").alias("total_ips")).where("cases > 1")
    return nets.join(shared, "subnet").select("case_key", "subnet", "ips", "cases", "total_ips")
