"""Form spam and confirmation of sent forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import fixed_values as fv

# fixed values: success marks of the page after a form; spam signs in order
SUCCESS_PAGE = r"(?i)(?:^|&)(success|formresult|result|sent|ok|status)=(?!$|0|false|error)|thank|spasibo|blagodar"
SPAM_SIGNS = ["form spam: broken entry, then the form", "form spam: sent without viewing pages", "form spam: page opened by another IP",
              "form spam: fast walk and a bunch of forms", "form spam: IP switched inside the visit", "form spam: quick form from an IP caught within a week"]


def entry_path() -> Column:
    return C.ref_path(F.col("entry_ref"))


def buckets(first: Column, last: Column, width: int) -> Column:
    """Time blocks an interval touches: an equality key for interval joins."""
    return F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))


def two_ips(rows: DataFrame, keys: list[str], ip: str, latest: str | None = None, earliest: str | None = None) -> DataFrame:
    """Of every key the two IPs that reach ``latest`` last and the two that have ``earliest`` first: (keys, ip, latest, earliest), the other value NULL.

    Whether some *other* IP reaches a moment is seen from these alone: if the best one is the asker itself, the second decides.  Rows are
    reduced to one per key and IP in the tasks, and only two of a key leave a task for the ranking, so a hot key is four rows for whoever asks.
    """
    sides = []
    for col, best, order in ((latest, F.max, F.desc_nulls_last), (earliest, F.min, F.asc_nulls_last)):
        if col:
            per_ip = rows.where(F.col(col).isNotNull()).groupBy(*keys, ip).agg(best(col).alias(col))
            rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order(col), ip))
            sides.append(per_ip.withColumn("_rank", rank).where("_rank <= 2").drop("_rank"))
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1], allowMissingColumns=True)


def same_user_flag(candidates: DataFrame, visits: DataFrame, rq: DataFrame, window: int = 1800) -> DataFrame:
    """vid of visits whose referrer page was opened within 30 minutes before by another IP with the same browser.

    A page counts from the start of its visit to ``window`` after its end, at least a whole time block, so in a block it counts either from the block's
    beginning (the latest ends decide) or up to the block's end (the earliest starts do): two IPs of each kind hold all there is to know.
    """
    left = candidates.select("vid", "ip", "ua", F.col("start").alias("t"), entry_path().alias("path")).where("path NOT IN ('', '/')")
    left = left.withColumn("blk", F.floor(F.col("t") / window))
    people = visits.where("`group` = 'people' AND n_pages > 0").select("vid", F.col("ip").alias("o_ip"), "ua", "start", "end")
    opened = rq.select("vid", F.col("base").alias("path")).join(left.select("path").distinct(), "path", "left_semi").distinct()
    right = opened.join(people, "vid").withColumn("blk", buckets(F.col("start"), F.col("end") + window, window))
    whole = F.col("start") <= F.col("blk") * window
    right = right.select("path", "ua", "blk", "o_ip", F.when(whole, F.col("end") + window).alias("until"), F.when(~whole, F.col("start")).alias("since"))
    seen = two_ips(right, ["path", "ua", "blk"], "o_ip", "until", "since")
    on = [left[k] == seen[k] for k in ("path", "ua", "blk")] + [left["ip"] != seen["o_ip"], (seen["until"] >= left["t"]) | (seen["since"] <= left["t"])]
    return left.join(seen, on, "left_semi").select("vid")


def ip_switch_flag(candidates: DataFrame, visits: DataFrame, window: int = 7200) -> DataFrame:
    """vid of visits that came from a page another IP had entered with 404 up to two hours before.

    In the visit's own block the earliest entries of a page decide, in the one before the latest, two IPs of each.
    """
    left = candidates.select("vid", "ip", F.col("start").alias("t"), entry_path().alias("path")).withColumn(
        "blk", buckets(F.col("t") - window, F.col("t"), window)).withColumnRenamed("ip", "c_ip")
    right = visits.where("entry_status = 404").select(F.col("entry").alias("e_path"), F.col("ip").alias("e_ip"), F.floor(F.col("start") / window).alias("e_blk"),
                                                     F.col("start").alias("last"), F.col("start").alias("first"))
    seen = two_ips(right, ["e_path", "e_blk"], "e_ip", "last", "first").withColumn("e_t", F.coalesce("last", "first"))
    cond = (F.col("path") == F.col("e_path")) & (F.col("blk") == F.col("e_blk")) & (F.col("c_ip") != F.col("e_ip"))
    return left.join(seen, cond & (F.col("e_t") <= F.col("t")) & (F.col("e_t") >= F.col("t") - window), "left_semi").select("vid").distinct()


def _ends(rows: DataFrame, ip: str, t: str, window: int) -> DataFrame:
    """First and last moment of an IP in every time block: (ip, blk, lo, hi)."""
    return rows.groupBy(F.col("ip").alias(ip), F.floor(F.col(t) / window).alias("e_blk")).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))


def caught_week_flag(quick: DataFrame, caught: DataFrame, window: int = 7 * 86400) -> DataFrame:
    """vid of quick forms from an IP caught within seven days: of the block before, the last moment counts, of the next the first, of its own any."""
    left = quick.select("vid", "ip", F.col("start").alias("t")).withColumn("blk", buckets(F.col("t") - window, F.col("t") + window, window))
    right = _ends(caught, "k_ip", "start", window)
    near = (F.col("hi") >= F.col("t") - window) & (F.col("lo") <= F.col("t") + window)
    return left.join(right, (F.col("ip") == F.col("k_ip")) & (F.col("blk") == F.col("e_blk")) & near, "left_semi").select("vid").distinct()


def mark_form_spam(visits: DataFrame, rq: DataFrame) -> DataFrame:
    """Six behaviours in order; only people and bots are relabelled."""
    sent = F.col("n_goal") > 0
    direct = F.col("entry_ref").isin("-", "")
    outside = ~F.col("entry_ref_internal") & ~direct & ~F.col("entry_ref_host").rlike(fv.REF_SEARCH)
    broken = sent & (F.col("entry_status") == 404) & (direct | outside) & (F.col("n_pages") <= 6)
    blind = sent & (F.col("n_pages") == 0) & ~broken
    flags = same_user_flag(visits.where(blind & F.col("entry_ref_internal")), visits, rq).withColumn("_same", F.lit(True))
    rows = visits.join(flags, "vid", "left").withColumn("_same", F.coalesce("_same", F.lit(False)))
    hosted = F.col("nettype").startswith(fv.NET_DC) | (F.col("nettype") == fv.NET_RELAY)
    fast = sent & (F.col("n_goal") >= 2) & (F.col("n_pages") >= 5) & (F.col("n_pages") / F.greatest("dur", F.lit(1)) > 0.4)
    rows = rows.withColumn("_sign", F.when(broken, 0).when(blind & (F.col("n_static") == 0) & ~F.col("_same"), 1)
                           .when(blind & (F.col("n_static") > 0) & F.col("entry_ref_internal") & ~F.col("_same") & hosted, 2).when(fast, 3))
    switch = ip_switch_flag(rows.where(sent & F.col("entry_ref_internal") & F.col("_sign").isNull()), visits).withColumn("_switch", F.lit(True))
    rows = rows.join(switch, "vid", "left").withColumn("_sign", F.coalesce("_sign", F.when(F.col("_switch"), 4)))
    quick = sent & direct & (F.col("n_pages") <= 2) & (F.col("dur") < 120) & F.col("_sign").isNull()
    caught = caught_week_flag(rows.where(quick), rows.where("_sign IS NOT NULL")).withColumn("_caught", F.lit(True))
    rows = rows.join(caught, "vid", "left").withColumn("_sign", F.coalesce("_sign", F.when(F.col("_caught"), 5)))
    hit = F.col("_sign").isNotNull() & F.col("group").isin(fv.PEOPLE, fv.BOTS)
    return (rows.withColumn("subgroup", F.when(hit, C.pick(F.col("_sign"), SPAM_SIGNS)).otherwise(F.col("subgroup")))
            .withColumn("group", F.when(hit, fv.BOTS).otherwise(F.col("group"))).drop("_same", "_switch", "_caught", "_sign"))


def confirm_forms(rq: DataFrame, seconds: int = 10) -> DataFrame:
    """What confirmed every sent form: the next non-POST request of the same IP with a success mark or back on the form page.

    Returns req_id, goal, status, goal_success after demotion and the kind of confirmation.
    """
    posts = rq.where("goal <> '' AND method = 'POST'").select("req_id", "ip", "ts", "goal", "status", "goal_success", "ref_path", "vid")
    near = posts.select("req_id", "ip", F.col("ts").alias("t"), F.col("ref_path").alias("page")).withColumn(
        "blk", buckets(F.col("t"), F.col("t") + seconds, 16))
    mark = F.col("query").rlike(SUCCESS_PAGE) | F.col("base").rlike(SUCCESS_PAGE)
    after = rq.where("method <> 'POST' AND NOT is_static").select(
        F.col("ip").alias("n_ip"), F.col("ts").alias("n_ts"), F.col("req_id").alias("n_id"), F.col("base").alias("n_base"), mark.alias("n_mark"),
        F.floor(F.col("ts") / 16).alias("n_blk"))
    hit = near.join(after, (F.col("ip") == F.col("n_ip")) & (F.col("blk") == F.col("n_blk"))).where(
        (F.col("n_ts") >= F.col("t")) & (F.col("n_ts") <= F.col("t") + seconds) & (F.col("n_mark") | ((F.col("page") != "") & (F.col("n_base") == F.col("page")))))
    how = F.when(F.col("n_mark"), "page with a success mark").otherwise("back on the form page")
    first = hit.groupBy("req_id").agg(F.min_by(how, F.struct("n_ts", "n_id")).alias("confirmed_by"))
    rows = posts.join(first, "req_id", "left").withColumn("confirmed_by", F.coalesce("confirmed_by", F.lit("")))
    kept = F.col("goal_success") & ~(F.col("status").isin(302, 303) & (F.col("confirmed_by") == ""))
    return rows.select("req_id", "vid", "goal", "status", kept.alias("goal_success"), "confirmed_by")


def leads(rq: DataFrame, visits: DataFrame, window: int = 1800) -> DataFrame:
    """Every sent form with its context, outcome and what the visitor did within half an hour."""
    posts = rq.where("goal <> ''").select("req_id", "ip", "ts", "goal", "status", "goal_success", "vid", "group", "channel")
    good = _ends(posts.where("goal_success"), "g_ip", "ts", window)
    bad = posts.where("NOT goal_success").withColumn("blk", buckets(F.col("ts"), F.col("ts") + window, window))
    later = bad.join(good, (F.col("ip") == F.col("g_ip")) & (F.col("blk") == F.col("e_blk")) & (F.col("hi") > F.col("ts")) & (F.col("lo") <= F.col("ts") + window), "left_semi")
    rows = posts.join(later.select("req_id").distinct().withColumn("_later", F.lit(True)), "req_id", "left").join(
        visits.select("vid", "start", "n_pages", "n_static", "entry", "nettype"), "vid")
    st = F.col("status")
    why = (F.when(F.col("goal_success"), "accepted").when(st == 499, "visitor left (499)").when(st >= 500, "server error").when(st >= 400, "refused by the server")
           .when(st.isin(302, 303), "redirected, not confirmed").otherwise("refused by the form"))
    then = F.when(F.col("goal_success"), "").when(F.col("_later"), "sent successfully later").otherwise("did not send again")
    return rows.select("req_id", "ip", "ts", "goal", "status", "group", "channel", why.alias("outcome"), then.alias("then"), "n_pages", "n_static",
                       (F.col("ts") - F.col("start")).alias("seconds_from_entry"), "entry", "nettype")
