"""Pages, facets, inventories, intake, engine and purpose of the site, set operations."""

from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import paths
from weblens.marts import structure as T
from weblens.operators import ranking
from weblens.plans.queries_core import _log, _operator
from weblens.rules import special

PARAMS = [("utm_*", "ads and analytics", 3, 4), ("utm_source", "ad source", 3, 4), ("yclid", "ads and analytics", 2, 4), ("color", "catalog filter", 1, 4),
          ("si*", "sizes", 2, 4), ("s*", "anything", 3, 1)]
_dictionary = lambda w: w.spark.createDataFrame(PARAMS, "pattern string, param_group string, priority int, level int")
_calls = r"^/(contacts/send|cart/add)/"


def _encoded_facets(w):
    """Facets where every second parameter value is the checksum of a path facet value."""
    f = T.facets(w.rq)
    code = F.crc32(F.concat(F.lit("b"), F.substring("value", 2, 9)).cast("binary")).cast("string")
    return f.withColumn("value", F.when((F.col("origin") == "parameters") & (F.col("requests") % 2 == 0), code).otherwise(F.col("value")))


def _gov(w):
    return T.gov_robots(w.rq, special.finish_gov(special.mark_gov(w.visits, w.rq, _operator(w))))


def _archive(w):
    minutes = w.outages.select(F.explode(F.sequence(F.floor(F.col("degraded_from") / 60), F.floor(F.col("degraded_to") / 60))).alias("minute"))
    return T.web_archive(w.rq, special.mark_web_archive(w.visits, [8359], 3), minutes)


def _actors(w):
    """People and robot IPs as sets: both, only people, only robots."""
    people, robots = (w.visits.where(f"`group` = '{g}'").select("ip").distinct() for g in ("people", "bots"))
    tag = lambda df, kind: df.groupBy().agg(F.count(F.lit(1)).alias("ips")).withColumn("kind", F.lit(kind))
    return tag(people.intersect(robots), "both").unionByName(tag(people.exceptAll(robots), "people only")).unionByName(tag(robots.join(people, "ip", "left_anti"), "bots only"))


QUERIES = {
    "w04_embedded_templates": _log(lambda w: T.embedded_templates(w.rq_tpl, 0.05, 50)),
    "a04_top_pages": _log(lambda w: T.top_pages(w.rq_tpl, w.addresses, F.col("base"), 500)),
    "a04_top_sections": _log(lambda w: T.top_pages(w.rq_tpl, w.addresses, C.section(F.col("base")), 100, False)),
    "a04_page_types": _log(lambda w: T.top_pages(w.rq_tpl, w.addresses, F.col("tpl"), 200)),
    "a04_leads_by_page": _log(lambda w: T.leads_by_page(w.rq)),
    "a05_facets": _log(lambda w: T.facets(w.rq)),
    "a06_decode_facets": _log(lambda w: T.decode_facets(_encoded_facets(w)).where("decoded IS NOT NULL").select("section", "key", "value", "decoded")),
    "a08_pd_in_get": _log(lambda w: T.pd_in_get(w.rq)),
    "a65_files_inventory": _log(lambda w: T.files_inventory(w.rq, w.addresses)),
    "a66_params_inventory": _log(lambda w: T.params_inventory(w.rq, _dictionary(w))),
    "a66_param_companions": _log(lambda w: T.param_companions(w.rq)),
    "j16_match_params": _log(lambda w: T.match_params(T.query_pairs(w.rq).select("key"), _dictionary(w))),
    "a67_embedded_blocks": _log(lambda w: T.embedded_blocks(w.rq_tpl)),
    "a68_site_structure": _log(lambda w: T.site_structure(w.rq_tpl, w.addresses)),
    "a69_receivers": _log(lambda w: T.receivers(w.rq, w.addresses)),
    "r26_post_kinds": _log(lambda w: T.classify_posts(w.rq_tpl, w.goals, r"^/admin/$")),
    "a70_intake": _log(lambda w: T.intake(T.classify_posts(w.rq_tpl, w.goals, r"^/admin/$"), T.receivers(w.rq, w.addresses))),
    "a71_engines": _log(lambda w: T.detect_engines(w.rq.withColumn("base", F.when(F.col("req_id") % 7 == 0, F.concat(F.lit("/bitrix/js"), "base")).otherwise(F.col("base"))))),
    "a71_server": _log(lambda w: T.detect_server(w.rq, w.error_log)),
    "a71_ad_parameters": _log(lambda w: T.ad_parameters(w.visits)),
    "a72_site_profile": _log(lambda w: T.site_profile(w.rq, w.visits, w.goals)),
    "a73_gov_robots": _log(_gov),
    "a74_web_archive": _log(_archive),
    "a76_summary": _log(lambda w: T.summary(w.rq, w.visits)),
    "r17_shop": _log(lambda w: T.detect_shop(w.rq, 5, 1.0, r"^/cart/$", r"^/cart/checkout/", r"^/cart/success/").fillna(-1.0, ["lift"])),
    "k01_time_order": _log(lambda w: w.rq.select("ts", "req_id", "base").orderBy("ts", "req_id")),
    "k03_top_rows": _log(lambda w: ranking.top_rows(w.visits.select("vid", "n_req", "bytes"), 50, F.desc("n_req"), F.desc("bytes"), "vid")),
    "u01_union_chunks": _log(lambda w: w.log.where("req_id % 2 = 0").unionByName(w.log.where("req_id % 2 = 1")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))),
    "u02_first_per_key": _log(lambda w: w.rq.groupBy("ip").agg(F.min_by(F.struct("req_id", "base"), F.struct("ts", "req_id")).alias("f")).select("ip", "f.req_id", "f.base")),
    "u03_ip_sets": _log(_actors),
    "u04_site_cut": _log(lambda w: w.rq.join(w.visits.where("host_site").select("vid"), "vid", "left_semi").groupBy("vhost").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vid").alias("visits"))),
    "p27_actor_labels": _log(lambda w: w.log.select("ua").distinct().select("ua", C.product_name(F.col("ua")).alias("program"))),
    "p06_simple_templates": _log(lambda w: w.addresses.select("base", paths.simple_template(F.col("base")).alias("tpl"))),
}
