"""Bounded time joins, cases, findings, declarative rules and exports."""

from pyspark.sql import functions as F

from weblens.marts import bots as B
from weblens.marts import errors as E
from weblens.marts import findings as D
from weblens.marts import marketing as M
from weblens.marts import security as S
from weblens.operators import components, series
from weblens.operators import windows as W
from weblens.plans.queries_core import _log
from weblens.plans.store import stored
from weblens.rules import cases as K
from weblens.rules import forms, signatures, special
from weblens.sources import sinks

_files = lambda w: w.visits.where("n_pages = 0 AND n_static > 0")
_pages = lambda w: w.people.where("n_pages > 0")
_outage = lambda w: w.outages
_outage_minutes = lambda w: _outage(w).select(F.explode(F.sequence(F.floor(F.col("degraded_from") / 60), F.floor(F.col("degraded_to") / 60))).alias("minute"))
CHECKOUT, SUCCESS = r"^/cart/checkout/", r"^/cart/success/"

SIGNATURE_LISTS = {"clouds": [24940, 15169]}
SIGNATURES = [
    {"id": "env_probe", "scope": "request", "match": {"base": {"re": r"^/\.(env|git)"}, "method": {"ne": "POST"}}},
    {"id": "cloud_errors", "scope": "request", "match": {"all": [{"asn": {"in_list": "clouds"}}, {"any": [{"status": {"gte": 500}}, {"status": 403}]}, {"not": {"is_static": True}}]}},
    {"id": "busy_hour", "scope": "window", "window": "hour", "key": "ip_ua", "where": {"is_page": True}, "require": [
        {"agg": "count", "op": ">=", "value": 3}, {"agg": "distinct", "field": "base", "op": ">=", "value": 2}]},
    {"id": "busy_day", "scope": "window", "window": "day", "where": {"ip": {"cidr": ["10.1.0.0/16", "10.3.0.0/16"]}}, "require": [
        {"agg": "burst", "window": 60, "op": ">=", "value": 5}, {"agg": "span", "op": ">", "value": 3600}]},
    {"id": "form_after_item", "scope": "session", "sequence": [
        {"match": {"base": {"re": "^/catalog/"}}, "first_page_in_session": True}, {"match": {"base": "/contacts/send/"}, "within": 60, "max_pages_between": 1},
        {"match": {"base": "/thanks/"}, "within": 10}], "require": [{"agg": "count", "match": {"is_static": True}, "op": ">=", "value": 1}]},
]


def _hits(w):
    return signatures.apply_signatures(w.rq, SIGNATURES, SIGNATURE_LISTS)


def _features(w):
    return K.ip_features(w.rq_attacks, w.visits, w.probes, S.leaks(w.rq, w.probes, w.staff).where("verdict LIKE 'executed%' OR verdict = 'check'"))


def _windows(w):
    return _outage(w).select(F.lit("outage").alias("kind"), F.col("degraded_from").alias("no"), F.floor(F.col("degraded_from") / 60).alias("first_minute"),
                             F.floor(F.col("degraded_to") / 60).alias("last_minute"))


def _cases(w):
    profile = B.ip_profile(w.visits)
    shares = K.window_shares(w.rq, K.case_key(profile), _windows(w))
    return K.cases(_features(w), profile, w.staff, shares)


def _verdicts(w):
    sets = special.ip_sets(w.visits, special.rendered_static(w.rq))
    return K.ip_verdicts(w.cases, B.ip_profile(w.visits), sets.where("has_people"), w.people.select("nettype").distinct())


def _findings(w):
    """Detectors over the marts of this log; limits of rare events are the reference ones, so small logs find little."""
    people = w.people
    five = E.errors_5xx(w.rq_tpl)
    entry = E.entry_404(people).groupBy("channel").agg(F.sum("visits").alias("n"))
    goals = w.rq.where("goal_success AND `group` = 'bots'").agg(F.count(F.lit(1)).alias("n"))
    ad = M.ad_visits(people)
    return D.collect(
        D.detect(_outage(w), "errors", "outage", F.col("peak_from"), (F.col("peak_minutes") >= 2) & (F.col("pages_5xx") >= 10), "urgent", F.col("pages_5xx"), F.col("cause")),
        D.detect(five, "errors", "5xx", F.col("tpl"), F.col("human_errors") >= 5, F.when(F.col("human_errors") >= 20, "urgent").otherwise("important"), F.col("human_errors")),
        D.detect(entry, "errors", "404_entry", F.col("channel"), F.col("channel").isin("ads", "maps", "search", "social", "ai assistants", "aggregators") & (F.col("n") >= 3),
                 F.when(F.col("channel") == "ads", "urgent").otherwise("important"), F.col("n")),
        D.detect(E.broken_links(w.rq_tpl).agg(F.sum("visits").alias("n")), "errors", "broken_links", "site", F.col("n") >= 10, "important", F.col("n")),
        D.detect(E.errlog_summary(w.error_log), "errors", "errlog", F.col("type"), F.col("type").isin("database", "disk full", "PHP Fatal"),
                 F.when(F.col("type") == "PHP Fatal", "important").otherwise("urgent"), F.col("messages")),
        D.detect(S.webshells(w.rq), "security", "webshell", F.col("base"), F.col("ok") > 0, "urgent", F.col("ok")),
        D.detect(S.heavy_files(w.rq), "security", "heavy_images", F.col("base"), F.col("mean_bytes") > 500 * 1024, "important", F.col("bytes")),
        D.detect(goals, "overview", "bot_leads", "all", F.col("n") > 0, "urgent", F.col("n")),
        D.detect(B.fakes(w.visits).agg(F.count(F.lit(1)).alias("n")), "bots", "fake_crawlers", "all", F.col("n") > 0, "important", F.col("n")),
        D.detect(ad.where("entry_status >= 400").agg(F.count(F.lit(1)).alias("n")), "marketing", "ad_landing_errors", "all", F.col("n") > 0, "urgent", F.col("n")))


def _compare(w):
    """The second half of the log against the first: 404 entries by address."""
    half = lambda cond: w.people.where(cond).where("entry_status = 404").groupBy(F.col("entry").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("metric"))
    return D.compare_runs(half("day >= DATE'2024-01-16'"), half("day < DATE'2024-01-16'"))


def _edited(w):
    f = w.findings
    removed = f.where("type = 'heavy_images'").select("key")
    updated = f.where("type = 'webshell'").select("key", F.lit("important").alias("severity"), F.lit("checked by hand").alias("facts"))
    added = f.where("type = 'errlog'").select(F.concat("key", F.lit(":copy")).alias("key"), "block", F.lit("manual").alias("type"), "object", F.lit("remark").alias("severity"), "facts", "metric")
    return D.apply_edits(f, removed, updated, added)


def _limits(w):
    sizes = w.people.agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.lit("visits")).unionByName(w.rq.agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.lit("requests")))
    rules = w.spark.createDataFrame([("key_used_by_people", "visits", 0.0002, 3), ("block_on_action", "visits", 0.0005, 3), ("torn_key", "requests", 0.0001, 10)],
                                    "name string, base string, share double, minimum long")
    return D.thresholds(sizes, rules)


def _prepared_roundtrip(w):
    """Requests written by day and read back with a day filter."""
    path = stored_path(w, "prepared")
    sinks.write_prepared(w.rq, path)
    return w.spark.read.parquet(path).where("day >= DATE'2024-01-10' AND day < DATE'2024-01-13'").groupBy("day").agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"))


def _csv_roundtrip(w):
    path = stored_path(w, "csv")
    sinks.write_big_csv(w.visits.select("vid", "ip", "n_req"), path, 100)
    return w.spark.read.option("sep", ";").option("header", "true").schema("vid string, ip string, n_req long").csv(path)


def stored_path(w, name):
    from weblens.plans.store import fresh_path
    return fresh_path(w.spark, name)


def _indicators(w):
    span = w.rq.groupBy("ip").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return sinks.indicators(_verdicts(w), w.cases, span, 1706745600).groupBy("type").agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("id").alias("ids"))


def _snapshot(w):
    marts = {"channels": M.channel_cleaning(w.visits), "findings": w.findings}
    cols = {"channels": ["channel", "visits", "people", "bots"], "findings": ["key", "severity", "metric"]}
    path = stored_path(w, "snapshot")
    sinks.write_snapshot(sinks.snapshot("run-1", marts, cols), path)
    return w.spark.read.parquet(path).groupBy("run_id", "mart").agg(F.count(F.lit(1)).alias("rows"))


def _evidence(w):
    spam = stored(w.spark, forms.mark_form_spam(w.visits, w.rq), "spam")
    return components.spam_evidence(spam).groupBy("kind", "strength").agg(F.count_distinct("ip").alias("ips"), F.count_distinct("value").alias("signs"))


def _operators(w):
    spam = stored(w.spark, forms.mark_form_spam(w.visits, w.rq), "spam")
    return components.operator_summary(components.link_operators(w.spark, components.spam_evidence(spam), spam), spam)


QUERIES = {
    "j10_redirect_ends": _log(lambda w: W.redirect_ends(w.rq)),
    "j11_neighbours": _log(lambda w: W.neighbours(_files(w), _pages(w), 600)),
    "j12_lost_orders": _log(lambda w: W.lost_orders(w.rq, CHECKOUT, SUCCESS)),
    "j15_in_outages": _log(lambda w: W.in_outages(w.rq, _outage(w))),
    "j24_trace": _log(lambda w: W.trace(w.rq, w.rq.where("base = '/cart/success/'").select(F.col("req_id").cast("string").alias("name"), "ip", F.col("ts").alias("at")))),
    "w11_status_history": _log(lambda w: W.status_history(w.rq, _outage_minutes(w))),
    "w15_probe_tempo": _log(lambda w: W.probe_tempo(w.rq, w.probes)),
    "w16_call_profile": _log(lambda w: W.call_profile(w.rq, r"^/(contacts/send|cart/add|callback)/", 45, 30)),
    "w17_spread_files": _log(lambda w: W.spread_files(w.rq.where("is_static"))),
    "w18_list_crawl": _log(lambda w: W.list_crawl(w.rq.where("is_static"), 5, 0.1)),
    "w19_first_orders": _log(lambda w: W.first_orders(w.rq, SUCCESS, "order_id").drop("vid")),
    "w22_sequence": _log(lambda w: signatures.sequence_sessions(w.rq, ["vid"], SIGNATURES[4]["sequence"])),
    "r16_order_steps": _log(lambda w: W.order_steps(w.addresses, [CHECKOUT], ["^/admin/", "^/cart/add/"])),
    "r25_signature_hits": _log(_hits),
    "r25_signature_summary": _log(lambda w: signatures.signature_summary(_hits(w))),
    "r20_ip_features": _log(_features),
    "r22_cases": _log(_cases),
    "r23_ip_verdicts": _log(_verdicts),
    "r24_signatures": _log(lambda w: K.signatures(w.cases, w.visits, K.case_key(B.ip_profile(w.visits)))),
    "j22_case_mates": _log(lambda w: K.case_mates(K.case_key(B.ip_profile(w.visits)))),
    "j17_operator_evidence": _log(_evidence),
    "j18_operators": _log(_operators),
    "r31_findings": _log(_findings),
    "r27_calibrated": _log(lambda w: D.calibrate(w.findings, w.people.agg(F.count(F.lit(1))).scalar())),
    "r28_alarms": _log(lambda w: D.alarms(w.findings, w.addresses.where("probe <> ''").select("base")).groupBy("severity", "before_alarm").agg(F.count(F.lit(1)).alias("n"))),
    "r29_coverage": _log(lambda w: D.coverage(w.findings, w.spark.createDataFrame(
        [("outage", ""), ("5xx", ""), ("hotlink", ""), ("errlog", "error log"), ("operator", "forms"), ("placements_off", "ads"), ("-slow pages", "")], "type string, needs string"),
        w.rq.where("goal <> ''").select(F.lit("forms").alias("needs")).distinct())),
    "r30_proofs": _log(lambda w: D.proofs(w.findings, w.rq)),
    "j20_compare_runs": _log(_compare),
    "j21_edits": _log(_edited),
    "p26_thresholds": _log(_limits),
    "s11_write_prepared": _log(_prepared_roundtrip),
    "s12_big_csv": _log(_csv_roundtrip),
    "s13_indicators": _log(_indicators),
    "s14_snapshot": _log(_snapshot),
}
