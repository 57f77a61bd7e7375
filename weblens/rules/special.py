"""Rules for service checks, system agents, the site's own server, government networks, archives and unrendered visits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import fixed_values as fv
from weblens.operators.series import count_if

# fixed values: front page and service files asked by robots under a browser
SERVICE_ONLY = (r"^/$|^/(robots\.txt|sitemap\.xml|security\.txt|\.well-known/.*)$|(^|/)(favicon[^/]*\.(ico|png|svg)|apple-touch-icon[^/]*\.png)$")
ARCHIVE_ASN = [7941]
ARCHIVE_MIN_REQUESTS, ARCHIVE_SECONDS, GOV_MIN_PAGES = 5, 120, 100


def relabel(visits: DataFrame, cond, group: str, subgroup: str) -> DataFrame:
    cond = F.coalesce(cond, F.lit(False))
    return visits.withColumn("subgroup", F.when(cond, F.lit(subgroup)).otherwise(F.col("subgroup"))).withColumn(
        "group", F.when(cond, F.lit(group)).otherwise(F.col("group")))


def rendered_static(rq: DataFrame) -> DataFrame:
    """Files of a visit that a page of the same visit asked for. Joined on (visit, slot-free path), reduced per path first."""
    pages = rq.where("NOT is_static AND method IN ('GET', 'HEAD')").select("vid", F.col("base").alias("ref_path")).distinct()
    files = rq.where("is_static AND ref_internal").groupBy("vid", "ref_path").agg(F.count(F.lit(1)).alias("n"))
    return files.join(pages, ["vid", "ref_path"]).groupBy("vid").agg(F.sum("n").alias("rendered"))


def mark_unrendered(visits: DataFrame, rq: DataFrame) -> DataFrame:
    rows = visits.join(rendered_static(rq), "vid", "left")
    cond = (F.col("group") == fv.PEOPLE) & (F.col("n_pages") >= 1) & (F.col("n_static") > 0) & (F.col("n_embedded") == 0) & (F.coalesce("rendered", F.lit(0)) == 0)
    return relabel(rows, cond, fv.BOTS, "masked: loads no resources").drop("rendered")


def only_paths(rq: DataFrame, pattern: str) -> DataFrame:
    """Visits all of whose requests match a pattern."""
    return rq.groupBy("vid").agg(F.bool_and(F.col("base").rlike(pattern)).alias("only")).where("only").select("vid", F.lit(True).alias("_only"))


def mark_service_checks(visits: DataFrame, rq: DataFrame, service_asns) -> DataFrame:
    """Standard well-known addresses asked from the service's own network."""
    rows = visits.join(only_paths(rq, fv.WELL_KNOWN_STANDARD), "vid", "left")
    return relabel(rows, F.col("_only") & F.col("asn").isin(service_asns) & (F.col("group") != fv.OWN), fv.ROBOTS, "service check").drop("_only")


def mark_agents(visits: DataFrame, rq: DataFrame, device_agents: str, app_agents: str) -> DataFrame:
    """In-app browsers always, device agents when they ask only standard well-known addresses, are people."""
    rows = relabel(visits, F.col("ua").rlike(app_agents) & (F.col("group") != fv.OWN), fv.PEOPLE, "")
    rows = rows.join(only_paths(rq, fv.WELL_KNOWN_STANDARD), "vid", "left")
    return relabel(rows, F.col("_only") & F.col("ua").rlike(device_agents) & (F.col("group") != fv.OWN), fv.PEOPLE, "").drop("_only")


def own_server(visits: DataFrame, rq: DataFrame, self_check: str = fv.SELF_CHECK) -> DataFrame:
    """IPs that call self-check addresses without a user agent are the site's own server."""
    ips = rq.where(F.col("base").rlike(self_check) & F.col("ua").isin("", "-")).select("ip").distinct().withColumn("_own", F.lit(True))
    rows = visits.join(ips, "ip", "left")
    return relabel(rows, F.col("_own") & (F.col("group") != fv.OWN), fv.OWN, "site server").drop("_own")


def mark_gov(visits: DataFrame, rq: DataFrame, operators: DataFrame, signed_family: str = "CyberOK (SKIPA)") -> DataFrame:
    """Visits from government networks: signed scanners, robots by behaviour; adds gov_op and gov_kind."""
    rows = visits.drop("gov_op", "gov_kind", "gov_was").join(operators.where("operator <> ''").select("ip", F.col("operator").alias("gov_op")), "ip", "left")
    rows = rows.withColumn("gov_op", F.coalesce("gov_op", F.lit(""))).join(only_paths(rq, SERVICE_ONLY), "vid", "left")
    inside = (F.col("gov_op") != "") & (F.col("group") != fv.OWN)
    signed = inside & (F.col("fam") == signed_family)
    robot = inside & (F.col("fam") == "") & (F.col("n_goal") == 0) & (F.coalesce("_only", F.lit(False)) | (F.col("n_pages") >= GOV_MIN_PAGES))
    rows = rows.withColumn("gov_kind", F.when(signed, "security scanner").when(robot, "scanner under a browser").otherwise(""))
    rows = relabel(rows, F.col("gov_kind") == "security scanner", fv.ROBOTS, "government robots")
    return relabel(rows, F.col("gov_kind") == "scanner under a browser", fv.BOTS, "government robots").drop("_only")


def finish_gov(visits: DataFrame) -> DataFrame:
    """After all rules: people from these networks are visitors, ordinary bots are government robots."""
    todo = (F.col("gov_op") != "") & (F.col("gov_kind") == "") & (F.col("group") != fv.OWN)
    people = todo & (F.col("group") == fv.PEOPLE)
    ordinary = todo & (F.col("group") == fv.BOTS) & F.col("subgroup").rlike("^(scanner under a browser|masked|explicit)")
    rows = visits.withColumn("gov_was", F.when(ordinary, F.col("subgroup")).otherwise(""))
    rows = rows.withColumn("gov_kind", F.when(people, "visitor").when(ordinary, "scanner under a browser").when(todo, "other").otherwise(F.col("gov_kind")))
    return rows.withColumn("subgroup", F.when(F.col("gov_was") != "", "government robots").otherwise(F.col("subgroup")))


def mark_web_archive(visits: DataFrame, asns=ARCHIVE_ASN, min_requests: int = ARCHIVE_MIN_REQUESTS) -> DataFrame:
    """A page saved by a web archive: one page and its files in a short burst from the archive's network."""
    cond = (F.col("asn").isin(asns) & (F.col("fam") == "") & (F.col("n_pages") == 1) & (F.col("n_req") >= min_requests)
            & (F.col("dur") <= ARCHIVE_SECONDS) & (F.col("group") != fv.OWN))
    hit = F.col("_hit")  # fixed first: the columns it reads are overwritten below
    rows = relabel(visits.withColumn("_hit", F.coalesce(cond, F.lit(False))), hit, fv.ROBOTS, "known")
    for name, value in (("fam", "Web archive: page save"), ("fam_cat", fv.WEB_ARCHIVE), ("fam_verified", "yes")):
        rows = rows.withColumn(name, F.when(hit, value).otherwise(F.col(name)))
    return rows.drop("_hit")


def ip_sets(visits: DataFrame, rendered: DataFrame) -> DataFrame:
    """Flags per IP: real people behind it, hotlink only, suspect, own backup, service checks only."""
    rows = visits.join(rendered, "vid", "left")
    people = (F.col("group") == fv.PEOPLE) & (F.col("n_pages") >= 1) & (F.coalesce("rendered", F.lit(0)) > 0)
    hotlink = (F.col("subgroup") == "hotlink") & F.col("group").isin(fv.PEOPLE, fv.EXTERNAL_SITES)
    backup = (F.col("group") == fv.OWN) & (F.col("subgroup") == "took a backup")
    flags = rows.groupBy("ip").agg(
        F.bool_or(people).alias("has_people"), F.bool_and(hotlink).alias("hotlink_only"), F.bool_or((F.col("group") == fv.SUSPECTS) | backup).alias("_suspect"),
        F.bool_or(F.col("group").isin(fv.BOTS, fv.UTILITIES)).alias("_bad"), F.bool_or(backup).alias("own_backup"), F.bool_and(F.col("subgroup") == "service check").alias("service_check_only"))
    return flags.withColumn("suspect", F.col("_suspect") & ~F.col("_bad")).drop("_suspect", "_bad")


def host_dim(rq: DataFrame, site_hosts, not_site=(), pages_min: int = 10) -> DataFrame:
    """Kind of every host: site, subdomain with pages, guessed subdomain, IP, other domain."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim("vhost")), r":\d+$", ""), r"^www\.", "")
    name = F.when(name == "-", "").otherwise(name)
    page = (F.col("method") == "GET") & ~F.col("is_static") & F.col("status").between(200, 299)
    by = rq.groupBy(name.alias("vhost")).agg(F.count(F.lit(1)).alias("requests"), count_if(page).alias("pages"))
    h = F.col("vhost")
    sub = C.any_of([h.endswith("." + s) for s in site_hosts])
    ip = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | h.rlike(r"^[0-9a-f]*:[0-9a-f:.]*:[0-9a-f:.]*$")
    kind = (F.when(h == "", "site").when(h.isin(list(not_site)), "not site").when(ip, "ip").when(h.isin(list(site_hosts)), "site")
            .when(sub & (F.col("pages") >= pages_min), "site").when(sub, "guessed subdomain").otherwise("other domain"))
    return by.withColumn("kind", kind)


def ip_host_stats(rq: DataFrame, ip_hosts: DataFrame, seconds: int = 600) -> DataFrame:
    """Visitors of the bare IP host: answers, and how many of the people-like ones reach the site within ten minutes."""
    on_ip = rq.join(ip_hosts.select("vhost"), "vhost", "left_semi")
    people = on_ip.where("`group` = 'people'").select("ip", F.col("ts").alias("t")).distinct().withColumn("blk", F.explode(
        F.sequence(F.floor(F.col("t") / seconds), F.floor((F.col("t") + seconds) / seconds))))
    site = rq.where("host_site").select(F.col("ip").alias("s_ip"), F.col("ts").alias("s_ts"), F.floor(F.col("ts") / seconds).alias("s_blk")).distinct()
    reached = people.join(site, (F.col("ip") == F.col("s_ip")) & (F.col("blk") == F.col("s_blk")) & (F.col("s_ts") >= F.col("t")) & (F.col("s_ts") <= F.col("t") + seconds), "left_semi")
    total = on_ip.agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("ip").alias("ips"), count_if(F.col("status").between(200, 399)).alias("answered"),
                      F.count_distinct(F.when(F.col("group") == "people", F.col("ip"))).alias("people_ips"))
    return total.withColumn("reached_site_ips", reached.agg(F.count_distinct("ip")).scalar())
