"""Marketing: one visit metric for every cut, ads, placements, quality of channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.functions import ads
from weblens.functions import fixed_values as fv
from weblens.operators.series import count_if


def visit_metric_columns() -> list[Column]:
    n = F.count(F.lit(1))
    bounce = (F.col("n_pages") <= 1) & (F.col("dur") < 10)
    return [
        n.alias("visits"), F.count_distinct("ip").alias("ips"), F.round(F.avg("n_pages"), 4).alias("pages_per_visit"),
        F.round(count_if(bounce) / n * 100, 4).alias("bounce_pct"), F.sum("n_goal").alias("sent"), F.sum("n_conv").alias("accepted"),
        F.round(F.sum("n_conv") / n * 100, 4).alias("conversion_pct")]


def visit_metrics(visits: DataFrame, *keys) -> DataFrame:
    return visits.groupBy(*keys).agg(*visit_metric_columns())


def cuts(people: DataFrame) -> DataFrame:
    """Device, in-app browser, hour, weekday and new/returning in one pass over GROUPING SETS."""
    first = people.groupBy("ip").agg(F.min("start").alias("_first"))
    rows = people.join(first, "ip").select(
        "ip", "n_pages", "dur", "n_goal", "n_conv", "hour", "weekday",
        F.when(F.col("ua_mobile"), "mobile").otherwise("desktop").alias("device"),
        F.when(F.col("ua_webview"), "in-app browser").otherwise("browser").alias("browser"),
        F.when(F.col("start") > F.col("_first"), "returning").otherwise("first").alias("visit"))
    keys = ["device", "browser", "hour", "weekday", "visit"]
    sets = rows.groupingSets([[F.col(k)] for k in keys], *keys).agg(*visit_metric_columns(), *[F.grouping(k).alias("g_" + k) for k in keys])
    cut, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in keys:
        cut = F.when(F.col("g_" + k) == 0, k).otherwise(cut)
        value = F.when(F.col("g_" + k) == 0, F.col(k).cast("string")).otherwise(value)
    return sets.withColumn("cut", cut).withColumn("value", value).drop(*keys, *["g_" + k for k in keys])


def wasted() -> Column:
    """A bot on an ad link or a person landing on an error (499 is slowness, not a broken page)."""
    return (F.col("group") == fv.BOTS) | ((F.col("group") == fv.PEOPLE) & (F.col("entry_status") >= 400) & (F.col("entry_status") != 499))


def channel_cleaning(visits: DataFrame) -> DataFrame:
    return visits.groupBy("channel").agg(
        F.count(F.lit(1)).alias("visits"), count_if(F.col("group") == fv.PEOPLE).alias("people"), count_if(F.col("group") == fv.BOTS).alias("bots"),
        F.sum("n_pages_raw").alias("pages_raw"), F.sum("n_pages").alias("pages"), F.sum("n_dup").alias("double_loads"), F.sum("n_redirect").alias("redirects"))


def channel_quality(visits: DataFrame) -> DataFrame:
    """People and bots by channel with the share of false leads."""
    p, b = F.col("group") == fv.PEOPLE, F.col("group") == fv.BOTS
    q = visits.where(p | b).groupBy("channel").agg(
        count_if(p).alias("people"), count_if(b).alias("bots"), F.sum(F.when(p, F.col("n_conv")).otherwise(0)).alias("people_leads"),
        F.sum(F.when(b, F.col("n_conv")).otherwise(0)).alias("bot_leads"))
    pct = lambda a, t: F.round(F.col(a) / F.greatest(t, F.lit(1)) * 100, 4)
    return (q.withColumn("bots_pct", pct("bots", F.col("people") + F.col("bots")))
            .withColumn("false_leads_pct", pct("bot_leads", F.col("people_leads") + F.col("bot_leads")))
            .withColumn("conversion_pct", pct("people_leads", F.col("people"))))


def organic(people: DataFrame) -> DataFrame:
    return people.where(f"channel = '{fv.CH_SEARCH}'").groupBy("day", "channel_sub").agg(F.count(F.lit(1)).alias("visits"))


def ad_visits(visits: DataFrame) -> DataFrame:
    rows = ads.parse_ad(visits.where(f"channel = '{fv.CH_ADS}'"))
    kind = ads.placement_type(F.col("ad_source"), F.col("ad_source_type"))
    return rows.withColumn("placement_type", F.when(F.col("channel_sub") == "Yandex Direct", kind).otherwise(F.col("channel_sub")))


def ad_bots(ad: DataFrame, key: str) -> DataFrame:
    """Bots, wasted clicks and broken landings of one ad dimension."""
    bot, human = F.col("group") == fv.BOTS, F.col("group") == fv.PEOPLE
    return ad.groupBy(F.col(key).alias("value")).agg(
        F.count(F.lit(1)).alias("visits"), count_if(bot).alias("bots"), count_if(F.col("group") == fv.ROBOTS).alias("robots"),
        count_if(human & wasted()).alias("landing_errors"), count_if(wasted()).alias("wasted"),
        F.sum(F.when(bot, F.col("n_conv")).otherwise(0)).alias("bot_leads"), F.round(count_if(bot) / F.count(F.lit(1)) * 100, 4).alias("bots_pct"))


def placements(ad: DataFrame, key: str = "ad_source") -> DataFrame:
    """Verdict on every placement."""
    p = F.col("group") == fv.PEOPLE
    t = ad.groupBy(F.col(key).alias("placement")).agg(
        count_if(p).alias("people"), count_if(F.col("group") == fv.BOTS).alias("bots"), F.sum(F.when(p, F.col("n_conv")).otherwise(0)).alias("accepted"),
        F.count(F.lit(1)).alias("visits"))
    bots_pct = F.col("bots") / F.col("visits") * 100
    verdict = (
        F.when(F.lower("placement") == "none", "search, not a placement").when((bots_pct >= 50) & (F.col("people") + F.col("bots") >= 20), "switch off: mostly bots")
        .when((F.col("people") >= 30) & (F.col("accepted") == 0), "switch off: traffic without leads").when(F.col("accepted") > 0, "works").otherwise("too little data"))
    return t.withColumn("verdict", verdict)


def landings(ad_people: DataFrame) -> DataFrame:
    return visit_metrics(ad_people, "entry", "entry_status")


def broken_labels(ad_people: DataFrame) -> DataFrame:
    q = F.col("entry_query")
    problem = F.explode(F.array_compact(F.array(
        F.when(F.col("raw_macro"), "macro not replaced"), F.when(q.contains("yclid=") & ~q.contains("utm_"), "click id without UTM"))))
    return ad_people.select(problem.alias("problem"), "entry_query").groupBy("problem").agg(F.count(F.lit(1)).alias("clicks"), F.min("entry_query").alias("example"))


def week_heat(people: DataFrame) -> DataFrame:
    return people.groupBy("weekday", "hour").agg(F.count(F.lit(1)).alias("visits"), F.sum("n_conv").alias("accepted"))


def marketing_journal(visits: DataFrame) -> DataFrame:
    """Visits of people by channel, ad clicks, leads; by day and in total (day is NULL there)."""
    p, ad, ch = F.col("group") == fv.PEOPLE, F.col("channel") == fv.CH_ADS, F.col("channel")
    total = lambda cond, c="n_conv": F.sum(F.when(cond, F.col(c)).otherwise(0))
    return visits.rollup("day").agg(
        count_if(p).alias("people"), count_if(p & ad).alias("people_ads"), count_if(p & (ch == fv.CH_SEARCH)).alias("people_search"),
        count_if(p & ~ch.isin(fv.CH_ADS, fv.CH_SEARCH)).alias("people_other"), count_if(ad & (F.col("group") == fv.BOTS)).alias("ad_bots"),
        count_if(ad & wasted()).alias("ad_wasted"), total(p, "n_goal").alias("sent"), total(p).alias("accepted"),
        total(p & ad).alias("accepted_ads"), total(F.col("group") == fv.BOTS).alias("accepted_bots"))


def goal_funnel(rq: DataFrame) -> DataFrame:
    """Visits, posts and accepted posts of people by goal."""
    rows = rq.where("goal <> '' AND `group` = 'people'")
    return rows.groupBy("goal").agg(F.count_distinct("vid").alias("visits"), F.count(F.lit(1)).alias("sent"), count_if(F.col("goal_success")).alias("accepted"))


def order_funnel(rq: DataFrame, cart: str, checkout: str, success: str, action: str) -> DataFrame:
    """People -> product action -> cart -> checkout -> order; steps in any order, distinct visits."""
    rows = rq.where("`group` = 'people'")
    hit = lambda rx: F.bool_or(F.col("base").rlike(rx))
    per = rows.groupBy("vid", "slot").agg(hit(action).alias("a"), hit(cart).alias("c"), hit(checkout).alias("k"), hit(success).alias("s"))
    per = per.groupBy("vid").agg(*[F.bool_or(x).alias(x) for x in "acks"])
    one = per.agg(F.count(F.lit(1)).alias("people"), count_if(F.col("a")).alias("action"), count_if(F.col("c")).alias("cart"),
                  count_if(F.col("k")).alias("checkout"), count_if(F.col("s")).alias("order"))
    steps = ["people", "action", "cart", "checkout", "order"]
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(s).alias("step"), F.col(s).alias("visits")) for i, s in enumerate(steps)])))
