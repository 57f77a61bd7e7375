"""The rule chain: the order is part of the meaning, every rule sees the groups left by the ones before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.operators import network
from weblens.plans.store import stored
from weblens.rules import files_only, forms, scanners, special


NOBODY = r"(?!)"  # matches no user agent


def apply_rules(spark, visits: DataFrame, rq: DataFrame, addresses: DataFrame, staff: DataFrame, gov_operators: DataFrame,
                admin: str, service_asns=(), device_agents: str = NOBODY, app_agents: str = NOBODY, own_hosts=(), official: DataFrame | None = None) -> DataFrame:
    """Visits after all rules. The table is cut in the middle and at the end, so later rules do not recompute earlier ones.

    ``official`` (fam, cidr) are networks that robots publish: declared robots from elsewhere are fakes before any rule looks at them.
    """
    probes = stored(spark, scanners.probe_dim(addresses), "probe-strength")
    v = special.mark_web_archive(visits if official is None else network.verify_robots(visits, official))
    v = special.mark_gov(v, rq, gov_operators)
    v = special.relabel(v, v["ua"].rlike(app_agents) & (v["group"] != "own"), "people", "")
    v = stored(spark, v, "rules-1")
    v = stored(spark, scanners.mark_scanners(v, rq, probes), "rules-2")
    v = stored(spark, scanners.mark_backups(v, rq, staff, admin), "rules-3")
    v = stored(spark, files_only.mark_files_only(v, rq, addresses, own_hosts), "rules-files")
    v = special.mark_unrendered(v, rq)
    v = special.mark_service_checks(v, rq, list(service_asns) or [0])
    v = special.mark_agents(v, rq, device_agents, app_agents)
    v = stored(spark, special.own_server(v, rq), "rules-4")
    v = forms.mark_form_spam(v, rq)
    return stored(spark, special.finish_gov(v), "rules-5")


def demoted(rq: DataFrame) -> DataFrame:
    """req_id, vid of sent forms that the answer's code calls accepted and nothing afterwards confirms."""
    accepted = rq.where("goal <> '' AND method = 'POST' AND goal_success").select("req_id", "vid")
    refuted = forms.confirm_forms(rq).where("NOT goal_success").select("req_id")
    return accepted.join(refuted, "req_id", "left_semi")


def confirm(visits: DataFrame, rq: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visits and requests whose unconfirmed forms count as not accepted. Only requests with a form are joined."""
    fewer = lost.groupBy("vid").agg(F.count("*").alias("_lost"))
    visits = visits.join(fewer, "vid", "left").withColumn("n_conv", F.col("n_conv") - F.coalesce("_lost", F.lit(0))).drop("_lost")
    posts = rq.where("goal <> ''").join(lost.select("req_id", F.lit(True).alias("_lost")), "req_id", "left")
    posts = posts.withColumn("goal_success", F.col("goal_success") & F.col("_lost").isNull()).select(rq.columns)
    return visits, rq.where("goal = '' OR goal IS NULL").unionByName(posts)
