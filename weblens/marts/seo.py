"""Search robots: crawling, robot files, redirects, authenticity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import fixed_values as fv
from weblens.operators.ranking import top_values
from weblens.operators.series import count_if
from weblens.operators.sessions import SLOT

# fixed values: robot family -> engine; files made for robots; addresses that are not site pages
ENGINES = {"YandexBot": "Yandex", "YandexRenderResourcesBot": "Yandex", "YandexImages": "Yandex", "Googlebot": "Google",
           "Googlebot-Image": "Google", "Bingbot": "Bing"}
ROBOT_FILES = r"(?i)^/robots\.txt$|sitemap[\w.-]*\.xml(\.gz)?$"
NOT_PAGE = r"(?i)^/(bitrix|local|upload|manager|admin|cgi-bin)/|/index\.php$|\.(php|html?)$|/filter/"


def genuine() -> Column:
    return (F.col("fam_cat") == fv.SEARCH) & (F.col("fam_verified") == "yes")


def engine(fam: Column, other: Column) -> Column:
    expr = other
    for f, e in ENGINES.items():
        expr = F.when(fam == f, e).otherwise(expr)
    return expr


def crawl(rq: DataFrame) -> DataFrame:
    """Crawling by robot: answers by class, pages with parameters, wasted requests."""
    rows, n, st = rq.where(genuine()), F.count(F.lit(1)), F.col("status")
    page, q = F.col("is_page"), F.col("query") != ""
    pct = lambda cond: F.round(count_if(cond) / n * 100, 4)
    return rows.groupBy("fam").agg(
        n.alias("requests"), count_if(page).alias("pages"), F.count_distinct(F.when(page, F.col("base"))).alias("addresses"),
        pct(st.between(200, 299)).alias("ok_pct"), pct(st.between(300, 399)).alias("redirect_pct"), pct(st.between(400, 499)).alias("e4_pct"), pct(st >= 500).alias("e5_pct"),
        F.sum("bytes").alias("bytes"), F.max("day").alias("last_day"), pct((st >= 300) | (page & q)).alias("wasted_pct"), pct(st >= 300).alias("missed_pct"))


def crawl_sections(rq: DataFrame) -> DataFrame:
    rows = rq.where(genuine() & F.col("is_page"))
    e = engine(F.col("fam"), F.lit("other"))
    return rows.groupBy(C.section(F.col("base")).alias("section")).agg(
        F.count(F.lit(1)).alias("requests"), *[count_if(e == x).alias(x.lower()) for x in ("Yandex", "Google", "Bing", "other")],
        F.round(count_if(F.col("status") >= 400) / F.count(F.lit(1)) * 100, 4).alias("errors_pct"))


def redirect_outcome(rq: DataFrame, files: str = ROBOT_FILES, seconds: int = 60, steps: int = 3) -> DataFrame:
    """What followed every 3xx: 'ok' (200 on the same path), 'denied' (403) or ''.

    First the same client within a few requests, then the same verified robot from
    any address.  Both look at most ``seconds`` ahead: rows are spread over (key,
    time block) and blocks borrow the rows of the next one, so a robot that makes a
    third of the traffic is not a single partition.
    """
    block = F.floor(F.col("ts") / SLOT)
    borrowed = F.array_compact(F.array(block, F.when(F.col("ts") < block * SLOT + seconds + 1, block - 1)))
    # only clients that ever got a 3xx on such a file
    wanted = rq.where(F.col("base").rlike(files) & F.col("status").between(300, 399)).select("ip", "ua").distinct()
    rows = rq.join(wanted, ["ip", "ua"], "left_semi").withColumn("blk", F.explode(borrowed))
    w = Window.partitionBy("ip", "ua", "blk").orderBy("ts", "req_id")
    verdict = lambda s: F.when(s == 200, "ok").when(s == 403, "denied").otherwise("")
    follow = F.lit(None).cast("string")
    for k in range(steps, 0, -1):
        t, b, s = (F.lead(c, k).over(w) for c in ("ts", "base", "status"))
        hit = (b == F.col("base")) & (t - F.col("ts") <= seconds)
        follow = F.when(hit, F.when(s.between(300, 399), "").otherwise(verdict(s))).otherwise(follow)
    own = rows.withColumn("same_client", follow).where(
        (F.col("blk") == block) & F.col("base").rlike(files) & F.col("status").between(300, 399)).select(
        "req_id", "ts", "base", "fam", "fam_verified", "status", F.coalesce("same_client", F.lit("")).alias("same_client"))
    left = own.where("same_client = '' AND fam_verified = 'yes' AND fam <> ''").select("req_id", "ts", "base", "fam")
    pool = rq.where(F.col("base").rlike(files) & (F.col("fam_verified") == "yes") & ~F.col("status").between(300, 399)).select(
        F.col("ts").alias("t2"), F.col("req_id").alias("r2"), F.col("status").alias("s2"), "base", "fam").withColumn("blk", F.floor(F.col("t2") / SLOT))
    near = left.withColumn("blk", F.explode(F.array_distinct(F.array(block, F.floor((F.col("ts") + seconds) / SLOT)))))
    later = near.join(pool, ["fam", "base", "blk"]).where((F.col("t2") >= F.col("ts")) & (F.col("t2") - F.col("ts") <= seconds))
    other = later.groupBy("req_id").agg(F.min_by("s2", F.struct("t2", "r2")).alias("s2")).select("req_id", verdict(F.col("s2")).alias("same_robot"))
    return own.join(other, "req_id", "left").select(
        "req_id", "base", F.when(F.col("same_client") != "", F.col("same_client")).otherwise(F.coalesce("same_robot", F.lit(""))).alias("outcome"))


def robot_files(rq: DataFrame, outcome: DataFrame) -> DataFrame:
    rows = rq.where(F.col("base").rlike(ROBOT_FILES))
    st, n = F.col("status"), F.count(F.lit(1))
    by = rows.groupBy("base").agg(
        n.alias("requests"), count_if(genuine()).alias("search"), F.max_by("status", F.struct("ts", "req_id")).alias("last_status"),
        count_if(st.between(300, 399)).alias("redirects"), count_if(st >= 400).alias("errors"))
    bad = outcome.groupBy("base").agg(count_if(F.col("outcome") == "").alias("bad_redirects"), count_if(F.col("outcome") == "denied").alias("denied_redirects"))
    rows = by.join(bad, "base", "left").fillna(0, ["bad_redirects", "denied_redirects"])
    verdict = (F.when(F.col("errors") / F.col("requests") >= 0.5, "does not answer").when(F.col("bad_redirects") / F.col("requests") >= 0.5, "answers by redirect").otherwise("answers"))
    return rows.withColumn("verdict", verdict).where("search > 0 OR requests >= 20")


def search_redirects(rq: DataFrame) -> DataFrame:
    rows = rq.where(genuine() & F.col("status").between(300, 399))
    by = rows.groupBy("base").agg(F.count(F.lit(1)).alias("redirects"))
    return by.join(top_values(rows, ["base"], F.col("fam"), "robots", 3), "base")


def authenticity(visits: DataFrame) -> DataFrame:
    rows = visits.where(f"fam_cat = '{fv.SEARCH}'")
    ok, fake = F.col("fam_verified") == "yes", F.col("fam_verified") == "no"
    by = rows.groupBy("fam").agg(
        F.count_distinct("ip").alias("ips"), F.count_distinct(F.when(ok, F.col("ip"))).alias("genuine_ips"), F.count_distinct(F.when(fake, F.col("ip"))).alias("fake_ips"),
        F.sum("n_req").alias("requests"), F.sum(F.when(fake, F.col("n_req")).otherwise(0)).alias("fake_requests"), F.bool_or(F.col("fam_verified") != "").alias("can_be_checked"))
    return by.withColumn("fake_pct", F.round(F.col("fake_requests") / F.greatest("requests", F.lit(1)) * 100, 4))


def seo_journal(rq: DataFrame, visits: DataFrame) -> DataFrame:
    st, e = F.col("status"), engine(F.col("fam"), F.lit("other"))
    robots = rq.where(genuine()).groupBy("day").agg(
        count_if(e == "Yandex").alias("yandex"), count_if(e == "Google").alias("google"), count_if(~e.isin("Yandex", "Google")).alias("other"),
        count_if(st.between(300, 399)).alias("redirects"), count_if(st.between(400, 499)).alias("e4"), count_if(st >= 500).alias("e5"))
    people = visits.where(f"`group` = 'people' AND channel = '{fv.CH_SEARCH}'").groupBy("day").agg(
        F.count(F.lit(1)).alias("search_visits"), F.sum("n_conv").alias("search_leads"))
    return robots.join(people, "day", "full").fillna(0)


def uncrawled(rq: DataFrame, real: DataFrame, min_people: int = 3) -> DataFrame:
    """Pages people open that search robots never do, and the reverse."""
    page = rq.where("is_page")
    people = page.where("`group` = 'people' AND status = 200").groupBy("base").agg(F.count_distinct("vid").alias("n"))
    robots = page.where(genuine()).groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    pages = people.where(F.col("n") >= min_people).where(~F.col("base").rlike(NOT_PAGE)).join(real, "base", "left_semi")
    a = pages.join(robots.select("base"), "base", "left_anti").withColumn("kind", F.lit("people only"))
    b = robots.join(people.select("base"), "base", "left_anti").withColumn("kind", F.lit("robots only"))
    return a.unionByName(b)
