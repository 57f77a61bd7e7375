"""Load, security, bots and search robots."""

from pyspark.sql import functions as F

from weblens.functions import personal
from weblens.marts import bots as B
from weblens.marts import security as S
from weblens.marts import seo
from weblens.operators.addresses import real_addresses
from weblens.plans.queries_core import _log

ROBOT_FILE_REDIRECTS = seo.ROBOT_FILES


def _pd_queries(w):
    """Distinct query strings and the text of conversations rewritten as query pairs."""
    return w.rq.select("query").distinct()


QUERIES = {
    "p11_attack_kinds": _log(lambda w: w.rq_attacks.groupBy("attack").agg(F.count(F.lit(1)).alias("n")).where("attack IS NOT NULL")),
    "p19_has_pd": _log(lambda w: _pd_queries(w).select("query", personal.has_pd(F.col("query")).alias("has_pd"))),
    "p20_mask_query": _log(lambda w: _pd_queries(w).select("query", personal.mask_query(F.col("query")).alias("masked"))),
    "p21_external_link": _log(lambda w: _pd_queries(w).where(personal.external_link(F.col("query"), w.site_hosts))),
    "r14_staff_ips": _log(lambda w: S.staff_ips(w.rq, w.admin)),
    "r21_ip_profile": _log(lambda w: B.ip_profile(w.visits)),
    "a25_heat": _log(lambda w: S.heat(w.rq)),
    "a26_peaks": _log(lambda w: S.peaks(w.rq)),
    "a27_load_sources": _log(lambda w: S.load_sources(w.rq)),
    "a27_people_load": _log(lambda w: S.people_load(w.rq)),
    "a28_mass_requests": _log(lambda w: S.mass_requests(w.rq, 2)),
    "a29_file_types": _log(lambda w: S.file_types(w.rq)),
    "a29_heavy_files": _log(lambda w: S.heavy_files(w.rq, 200)),
    "a30_hotlinks": _log(lambda w: S.hotlinks(w.rq)),
    "a31_parasites": _log(lambda w: S.parasites(w.rq_tpl, 2)),
    "a31_crawler_traps": _log(lambda w: S.crawler_traps(w.rq_tpl, 3)),
    "a32_admin_access": _log(lambda w: S.admin_access(w.rq, w.admin, w.staff)),
    "a33_service_sections": _log(lambda w: S.service_sections(w.rq, r"^/(admin|cart|go)/", w.staff)),
    "a34_scanners": _log(lambda w: S.scanners(w.rq, w.probes)),
    "a34_scanner_ips": _log(lambda w: S.scanner_ips(w.rq, w.probes)),
    "a35_leaks": _log(lambda w: S.leaks(w.rq, w.probes, w.staff)),
    "a36_attacks": _log(lambda w: S.attacks(w.rq_attacks)),
    "a37_webshells": _log(lambda w: S.webshells(w.rq)),
    "a39_open_redirects": _log(lambda w: S.open_redirects(w.rq, w.site_hosts, r"^/go/")),
    "a40_tokens": _log(lambda w: S.tokens(w.rq)),
    "a41_server_filter": _log(lambda w: S.server_filter(w.rq)),
    "a42_methods": _log(lambda w: S.methods(w.rq)),
    "a43_security_journal": _log(lambda w: S.security_journal(w.rq, w.probes)),
    "a44_robot_families": _log(lambda w: B.robot_families(w.rq)),
    "a44_robot_networks": _log(lambda w: B.robot_networks(w.rq)),
    "a45_monitors": _log(lambda w: B.monitors(w.rq)),
    "a46_fakes": _log(lambda w: B.fakes(w.visits)),
    "a46_bot_classes": _log(lambda w: B.bot_classes(w.visits)),
    "a46_bot_signatures": _log(lambda w: B.bot_signatures(w.visits)),
    "a48_bot_networks": _log(lambda w: B.bot_networks(w.visits)),
    "a48_check_ips": _log(lambda w: B.check_ips(w.visits, w.spark.range(1, 21).select(F.concat(F.lit("10.1.0."), F.col("id").cast("string")).alias("ip")))),
    "a49_ai_robots": _log(lambda w: B.ai_robots(w.rq)),
    "a49_ai_pages": _log(lambda w: B.ai_pages(w.rq, "AI training")),
    "a50_audience": _log(lambda w: B.audience(w.visits)),
    "a50_staff_activity": _log(lambda w: B.staff_activity(w.visits, w.rq, w.staff, w.admin)),
    "a51_bot_journal": _log(lambda w: B.bot_journal(w.visits)),
    "r19_utilities": _log(lambda w: B.utilities(w.rq, w.addresses, w.staff)),
    "a62_crawl": _log(lambda w: seo.crawl(w.rq)),
    "a62_crawl_sections": _log(lambda w: seo.crawl_sections(w.rq)),
    "j09_redirect_outcome": _log(lambda w: seo.redirect_outcome(w.rq)),
    "a63_robot_files": _log(lambda w: seo.robot_files(w.rq, seo.redirect_outcome(w.rq))),
    "a63_search_redirects": _log(lambda w: seo.search_redirects(w.rq)),
    "a64_authenticity": _log(lambda w: seo.authenticity(w.visits)),
    "a64_seo_journal": _log(lambda w: seo.seo_journal(w.rq, w.visits)),
    "j14_uncrawled": _log(lambda w: seo.uncrawled(w.rq, real_addresses(w.addresses), 1)),
}
