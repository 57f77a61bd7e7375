"""Requests, user agents, networks, visits and the overview tables."""

from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.marts import overview
from weblens.operators import groups, network, requests, sessions
from weblens.plans.prepare import WebLog


def _log(fn):
    """Register a function of a WebLog as a query of (spark, sf_dir)."""
    return lambda spark, sf_dir: fn(WebLog.prepared(spark, sf_dir))


def _rules(fn):
    """The same for the log before the rules."""
    return _log(lambda w: fn(w.base))


GOOGLE_CIDRS = [("Googlebot", "10.4.0.0/25"), ("Googlebot", "10.0.0.0/24"), ("YandexBot", "10.1.0.0/16")]
OPERATOR_CIDRS = [("10.0.0.0/8", "wide"), ("10.2.0.0/16", "regional"), ("10.2.0.0/26", "office")]


def _verify(w):
    official = w.spark.createDataFrame(GOOGLE_CIDRS, "fam string, cidr string")
    v = network.verify_robots(w.visits, official)
    return v.where("fam <> ''").groupBy("fam", "fam_verified", "group", "subgroup").agg(F.count(F.lit(1)).alias("visits"))


def _operator(w):
    cidrs = w.spark.createDataFrame(OPERATOR_CIDRS[1:], "cidr string, operator string")
    asns = w.spark.createDataFrame([(24940, "hoster"), (8359, "mobile")], "asn int, operator string")
    return network.net_operator(w.ip_dim, cidrs, asns)


def _grouped(w):
    base = groups.base_group(groups.describe(w.visits_raw, w.ua_dim, w.ip_dim))
    return groups.regroup(base, groups.monitor_addresses(w.log, w.ua_dim))


QUERIES = {
    "p01_p02_p05_request_features": _log(lambda w: w.features.select(
        "req_id", "ext", "is_static", "ref_host", "ref_internal", "ref_path", "host_site", "day", "hour",
        C.section(F.col("base")).alias("section"))),
    "p03_p04_user_agents": _log(lambda w: requests.ua_dim(w.log).drop("monitor_name")),
    "p17_j01_ip_networks": _log(lambda w: network.ip_dim(w.log, w.ranges, w.ranges)),
    "p18_impossible_ua": _log(lambda w: w.ua_dim.select("ua", C.impossible_ua(F.col("ua"), F.lit(2024)).alias("impossible"))),
    "w01_sessionize": _log(lambda w: sessions.with_visit(w.marked, w.visits_raw).select("req_id", "vid")),
    "w02_w03_page_flags": _log(lambda w: w.marked.select("req_id", "is_dup", "is_redirect_hop", "is_page")),
    "w05_p13_visits": _log(lambda w: sessions.fold_visits(sessions.fold_slots(w.marked)).drop("n_embedded")),
    "w06_returning": _log(lambda w: sessions.returning(w.visits_raw).groupBy("is_returning").agg(
        F.count(F.lit(1)).alias("visits"), F.count_distinct("ip").alias("ips"))),
    "r01_r02_groups": _log(lambda w: _grouped(w).select("vid", "group", "subgroup", "fam_verified", "nettype")),
    "j02_net_operator": _log(_operator),
    "j03_verify_robots": _log(_verify),
    "j04_requests_by_group": _log(lambda w: w.rq.groupBy("group", "subgroup", "channel").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"))),
    "a01_group_totals": _log(lambda w: overview.group_totals(w.visits)),
    "a02_daily_activity": _log(lambda w: overview.daily_activity(w.visits)),
    "a03_channels": _log(lambda w: overview.channels(w.people)),
}
