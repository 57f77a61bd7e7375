"""Address registry and error tables."""

from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import paths
from weblens.marts import errors as E
from weblens.operators import addresses as A
from weblens.operators import ranking
from weblens.plans.queries_core import _log

_dim = lambda w: w.addresses
_codes = lambda w: E.address_codes(w.rq)
_sources = lambda w: E.error_sources(w.rq, paths.simple_template)

QUERIES = {
    "p08_address_form": _log(lambda w: A.address_form(w.log)),
    "p09_address_registry": _log(lambda w: A.address_dim(w.rq)),
    "p10_probe_addresses": _log(lambda w: A.probe_addresses(_dim(w))),
    "p12_constructs": _log(lambda w: A.constructs(w.rq_constructs, w.construct_addresses).drop("last_day")),
    "p22_error_types": _log(lambda w: w.error_log.select("line_no", E.errlog_type(F.col("msg")).alias("type"))),
    "p25_owner_origin_state": _log(lambda w: w.rq.groupBy(
        E.who().alias("who"), E.origin().alias("origin"), E.state(F.col("status")).alias("state")).agg(F.count(F.lit(1)).alias("n"))),
    "a09_errors_by_day": _log(lambda w: E.errors_by_day(w.rq)),
    "a09_status_codes": _log(lambda w: E.status_codes(w.rq)),
    "a10_errors_5xx": _log(lambda w: E.errors_5xx(w.rq_tpl)),
    "a10_sections_5xx": _log(lambda w: E.sections_5xx(E.errors_5xx(w.rq.withColumn("tpl", F.col("base"))))),
    "a11_entry_404": _log(lambda w: E.entry_404(w.people)),
    "a12_broken_links": _log(lambda w: E.broken_links(w.rq_tpl)),
    "a12_broken_link_sources": _log(lambda w: E.broken_link_sources(w.rq)),
    "a12_links_internal": _log(lambda w: E.links_between_templates(w.rq_tpl, _dim(w), paths.simple_template, True)),
    "a12_links_external": _log(lambda w: E.links_between_templates(w.rq_tpl, _dim(w), paths.simple_template, False)),
    "a13_missing_static": _log(lambda w: E.missing_static(w.rq)),
    "a14_service_files": _log(lambda w: E.service_files(w.rq)),
    "a14_service_file_health": _log(lambda w: E.service_file_health(w.rq)),
    "a15_search_errors": _log(lambda w: E.search_errors(w.rq_tpl)),
    "a16_ad_errors": _log(lambda w: E.ad_errors(w.people)),
    "a17_soft_groups": _log(lambda w: E.soft_groups(w.rq, min_addresses=8)),
    "a18_tiny_pages": _log(lambda w: E.tiny_pages(w.rq)),
    "a19_errlog_summary": _log(lambda w: E.errlog_summary(w.error_log)),
    "a20_address_codes": _log(_codes),
    "a20_error_families": _log(lambda w: E.error_families(_codes(w))),
    "a21_error_sources": _log(_sources),
    "a22_criticality": _log(lambda w: E.criticality(_codes(w), _sources(w), w.people)),
    "a23_error_journal": _log(lambda w: E.error_journal(w.rq)),
    "a23_error_summary": _log(lambda w: E.error_summary(w.rq)),
    "a24_slowness": _log(lambda w: E.slowness(w.rq, w.error_log, 1).fillna(-1, ["aborted_pct"])),
    "a75_unknown_extensions": _log(lambda w: A.unknown_extensions(w.construct_addresses, top=30)),
    "j23_slash_twins": _log(lambda w: E.slash_twins(w.rq)),
    "k02_top_values": _log(lambda w: ranking.top_values(w.rq, ["group"], F.col("base"), "top_pages", 5)),
    "k04_code_rollup": _log(lambda w: ranking.code_rollup(w.rq, ["base"])),
    "k05_most_frequent_ua": _log(lambda w: ranking.most_frequent(w.rq, ["ip"], "ua", "ua")),
    "p07_section_totals": _log(lambda w: w.rq.groupBy(C.section(F.col("base")).alias("section")).agg(F.count(F.lit(1)).alias("n"))),
}
