"""Marketing tables."""

from pyspark.sql import functions as F

from weblens.functions import ads
from weblens.marts import marketing as M
from weblens.operators.goals import form_goals
from weblens.plans.queries_core import _log

_ad = lambda w: M.ad_visits(w.visits)
_adp = lambda w: _ad(w).where("`group` = 'people'")
REGIONS = [("c0", "City zero", "a1", 3), ("c1", "City one", "a1", 3), ("c2", "Area two", "r1", 2), ("a1", "Area one", "r1", 2),
           ("r1", "Country", None, 1), ("c3", "Village", "t3", 4), ("t3", "Town", "a1", 3)]


def _regions(w):
    codes = ads.parse_ad(w.visits).where("campaign <> ''").select(F.col("campaign").alias("region"))
    return ads.region_names(w.spark, codes, w.spark.createDataFrame(REGIONS, "code string, name string, parent string, level int"))


QUERIES = {
    "p14_parse_ad": _log(lambda w: _ad(w).select("vid", "utm_source", "utm_medium", "campaign", "phrase", "raw_macro", "placement_type")),
    "p15_placement_type": _log(lambda w: w.rq.select("ref_host").distinct().withColumn(
        "kind", ads.placement_type(F.col("ref_host"), F.lit("context")))),
    "p16_phrase_labels": _log(lambda w: _adp(w).groupBy(ads.phrase_label(F.col("phrase")).alias("label")).agg(F.count(F.lit(1)).alias("n"))),
    "p16_region_names": _log(_regions),
    "r15_form_goals": _log(lambda w: form_goals(w.features, w.ua_dim)),
    "a52_visit_metrics": _log(lambda w: M.visit_metrics(w.people, "channel", "channel_sub")),
    "a53_cuts": _log(lambda w: M.cuts(w.people)),
    "a53_entry_pages": _log(lambda w: M.visit_metrics(w.people, "entry")),
    "a54_channel_cleaning": _log(lambda w: M.channel_cleaning(w.visits)),
    "a54_channel_quality": _log(lambda w: M.channel_quality(w.visits)),
    "a55_organic": _log(lambda w: M.organic(w.people)),
    "a56_ads_by_campaign": _log(lambda w: M.visit_metrics(_adp(w), "channel_sub", "campaign")),
    "a56_ads_by_placement_type": _log(lambda w: M.visit_metrics(_adp(w), "channel_sub", "placement_type")),
    "a57_placements": _log(lambda w: M.placements(_ad(w), "campaign")),
    "a58_landings": _log(lambda w: M.landings(_adp(w))),
    "a58_broken_labels": _log(lambda w: M.broken_labels(_adp(w))),
    "a59_ad_bots": _log(lambda w: M.ad_bots(_ad(w), "campaign")),
    "a60_week_heat": _log(lambda w: M.week_heat(w.people)),
    "a60_marketing_journal": _log(lambda w: M.marketing_journal(w.visits)),
    "a61_goal_funnel": _log(lambda w: M.goal_funnel(w.rq)),
    "a61_order_funnel": _log(lambda w: M.order_funnel(w.rq, r"^/cart/", r"^/cart/checkout/", r"^/cart/success/", r"^/cart/add/")),
}
