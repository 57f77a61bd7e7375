"""Visit rules and interval joins."""

from pyspark.sql import functions as F

from weblens.marts import errors as E
from weblens.plans.queries_core import _log, _operator, _rules
from weblens.rules import files_only, forms, scanners, special

_label = lambda v: v.select("vid", "group", "subgroup")
_probes = lambda w: w.probe_strength
_suspects = lambda w: w.visits.join(scanners.signatures(w.rq, _probes(w)), "vid", "left_semi").where("`group` = 'people'")
_empty_staff = lambda w: w.staff


def _archive(w):
    """Page saves judged on the mobile network of the log instead of the archive's own."""
    return special.mark_web_archive(w.visits, [8359]).select("vid", "group", "fam", "fam_verified")


def _gov(w):
    v = special.finish_gov(special.mark_gov(w.visits, w.rq, _operator(w)))
    return v.select("vid", "group", "subgroup", "gov_op", "gov_kind", "gov_was")


def _chain(w):
    return w.visits.groupBy("group", "subgroup").agg(F.count(F.lit(1)).alias("visits"))


def _demoted(w):
    """Forms that the code calls accepted and nothing confirms, and what the visits lose by it."""
    return w.demoted.join(w.visits.select("vid", "group", "n_goal", "n_conv"), "vid")


_sent = lambda w: w.visits.where("n_goal > 0 AND entry_ref_internal")
_quick = lambda w: w.visits.where("n_goal > 0 AND n_pages <= 2 AND dur < 120")
_hosts = lambda w: special.host_dim(w.rq, w.site_hosts, ["shop.site.ru"])

QUERIES = {
    "r03_signatures": _rules(lambda w: scanners.signatures(w.rq, _probes(w))),
    "r03_mark_scanners": _rules(lambda w: _label(scanners.mark_scanners(w.visits, w.rq, _probes(w)))),
    "r04_actor_kind": _rules(lambda w: scanners.actor_kind(_suspects(w), w.visits, w.rq, _probes(w))),
    "r05_backups": _rules(lambda w: _label(scanners.mark_backups(w.visits, w.rq, w.staff, w.admin))),
    "r06_files_only": _rules(lambda w: files_only.mark_files_only(w.visits, w.rq, w.addresses, ["other1.example"]).select("vid", "group", "subgroup", "evidence_people", "evidence_bot")),
    "j19_rendered_static": _rules(lambda w: special.rendered_static(w.rq)),
    "r07_unrendered": _rules(lambda w: _label(special.mark_unrendered(w.visits, w.rq))),
    "r08_service_checks": _rules(lambda w: _label(special.mark_service_checks(w.visits, w.rq, [15169]))),
    "r09_agents": _rules(lambda w: _label(special.mark_agents(w.visits, w.rq, "iPhone", "Telegram-Android"))),
    "r10_own_server": _rules(lambda w: _label(special.own_server(w.visits, w.rq))),
    "j05_same_user": _rules(lambda w: forms.same_user_flag(_sent(w), w.visits, w.rq, 86400)),
    "j06_ip_switch": _rules(lambda w: forms.ip_switch_flag(w.visits.where("entry_ref_internal"), w.visits)),
    "j07_caught_week": _rules(lambda w: forms.caught_week_flag(_quick(w), w.visits.where("n_goal > 0 AND entry_status = 404"))),
    "r11_form_spam": _rules(lambda w: _label(forms.mark_form_spam(w.visits, w.rq))),
    "j08_confirm_forms": _rules(lambda w: forms.confirm_forms(w.rq).drop("vid")),
    "a07_leads": _log(lambda w: forms.leads(w.rq, w.visits)),
    "r12_gov": _rules(_gov),
    "r13_web_archive": _rules(_archive),
    "r18_ip_sets": _log(lambda w: special.ip_sets(w.visits, special.rendered_static(w.rq))),
    "p23_hosts": _log(_hosts),
    "p24_split_error_log": _log(lambda w: E.split_error_log(w.error_log, _hosts(w)).groupBy("host", "host_kind").agg(F.count(F.lit(1)).alias("n"))),
    "j13_ip_host": _log(lambda w: special.ip_host_stats(w.rq, special.host_dim(w.rq, w.site_hosts).where("kind = 'ip'"))),
    "r_chain_groups": _log(_chain),
    "r_chain_visits": _log(lambda w: w.visits.select("vid", "group", "subgroup", "n_goal", "n_conv")),
    "r_chain_demoted": _log(_demoted),
}
