"""Errors: who got which answers, where broken links come from, how addresses change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import fixed_values as fv
from weblens.operators.ranking import top_values
from weblens.operators.series import count_if

WHO = ["people", "search robots", "robots", "monitors", "utilities", "bots", "own"]
STATUS = F.col


def search_ok() -> Column:
    """A genuine search robot."""
    return F.col("fam").isin(fv.SEARCH_FAMILIES) & (F.col("fam_verified") == "yes")


def who() -> Column:
    g = F.col("group")
    return (F.when(g == "people", "people").when(search_ok(), "search robots").when(g == "robots", "robots")
            .when(g == "monitors", "monitors").when(g == "utilities", "utilities").when(g == "own", "own").otherwise("bots"))


def origin() -> Column:
    return F.when(F.col("ref_internal"), "site pages").when(F.col("ref_host").isin("", "-"), "direct").otherwise("other sites")


def state(status: Column) -> Column:
    return (F.when((status < 300) | (status == 304), "works").when(status < 400, "redirect")
            .when(status.isin(404, 410), "missing").when(status < 500, "refused").otherwise("server error"))


def error_class(status: Column) -> Column:
    return (F.when(status >= 500, "5xx").when(status == 499, "499").when(status == 404, "404")
            .when(status >= 400, "4xx other").otherwise("normal"))


def page_or_post() -> Column:
    return F.col("is_page") | (F.col("method") == "POST")


def errors_by_day(rq: DataFrame) -> DataFrame:
    owner = (F.when(F.col("group") == "people", "people").when(search_ok(), "search robots").when(F.col("group") == "robots", "robots")
             .when(F.col("group") == "own", "own").otherwise("bots"))
    counts = rq.groupBy("day", owner.alias("who"), error_class(F.col("status")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    classes = ["5xx", "499", "404", "4xx other", "normal"]
    names = dict(zip(classes, ["n_5xx", "n_499", "n_404", "n_4xx_other", "n_normal"]))
    return counts.groupBy("day", "who").agg(*[F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(names[c]) for c in classes])


def status_codes(rq: DataFrame) -> DataFrame:
    return rq.groupBy("status").agg(*[count_if(who() == w).alias(w.replace(" ", "_")) for w in WHO])


def errors_5xx(rq: DataFrame) -> DataFrame:
    """5xx of pages and forms by template, with people touched and successful answers of the template."""
    page, human, bad = page_or_post(), F.col("group") == "people", F.col("status") >= 500
    t = rq.where(page).groupBy("tpl").agg(
        count_if(bad).alias("errors"), count_if(bad & human).alias("human_errors"),
        F.count_distinct(F.when(bad & human, F.col("vid"))).alias("human_visits"), F.count_distinct(F.when(bad, F.col("base"))).alias("addresses"),
        F.min(F.when(bad, F.col("day"))).alias("first_day"), F.max(F.when(bad, F.col("day"))).alias("last_day"),
        F.count_distinct(F.when(bad, F.col("day"))).alias("days"), count_if(F.col("status") < 400).alias("ok"))
    return t.where(F.col("errors") > 0).withColumn("section", C.section(F.col("tpl")))


def sections_5xx(templates: DataFrame, min_errors: int = 5, min_templates: int = 3) -> DataFrame:
    """Sections with several bad templates where none holds half of the errors."""
    by = templates.where(F.col("human_errors") >= min_errors).groupBy("section").agg(
        F.count(F.lit(1)).alias("templates"), F.sum("human_errors").alias("human_errors"), F.max("human_errors").alias("worst"))
    return by.where((F.col("templates") >= min_templates) & (F.col("worst") < 0.5 * F.col("human_errors")))


def entry_404(people: DataFrame) -> DataFrame:
    rows = people.where("entry_status = 404")
    by = rows.groupBy("entry", "channel").agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("ip").alias("ips"))
    return by.join(top_values(rows, ["entry", "channel"], F.col("entry_ref_host"), "referrers", 2), ["entry", "channel"])


def _broken(rq: DataFrame, static: bool) -> DataFrame:
    kind = F.col("is_static") if static else ~F.col("is_static")
    return rq.where((F.col("group") == "people") & (F.col("status") == 404) & kind & ~C.looks_vulnerable(F.col("base")))


def broken_links(rq: DataFrame) -> DataFrame:
    """Links of site pages to missing pages, by target template."""
    rows = _broken(rq, False).where("ref_internal")
    by = rows.groupBy("tpl").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("vid").alias("visits"),
                                 F.min("base").alias("example"), F.count_distinct("ref_path").alias("source_pages"))
    return by.join(top_values(rows, ["tpl"], F.col("ref_path"), "main_sources", 2), "tpl")


def broken_link_sources(rq: DataFrame) -> DataFrame:
    rows = _broken(rq, False).where("ref_internal")
    return rows.groupBy("ref_path").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("base").alias("addresses"))


def links_between_templates(rq: DataFrame, addresses: DataFrame, templates, internal: bool = True) -> DataFrame:
    """Broken links template to template (internal) or source to template (external).

    ``templates`` is a function of an address column.  Page addresses that are not
    probes are picked by a join on the reduced error rows only.
    """
    st = F.col("status")
    bad = rq.where((st >= 400) & (st != 499))
    o, ad = origin(), F.col("query").rlike(fv.AD_MARK)
    if internal:
        rows = bad.where((o == "site pages") & (F.col("ref_path") != F.col("base")))
        rows = rows.withColumn("source", templates(F.col("ref_path"))).withColumn("kind", F.lit("internal")).withColumn("page", F.col("ref_path"))
    else:
        rows = bad.where((o == "other sites") | ad)
        kind = F.when(ad, "ads").when(F.col("ref_host").rlike(fv.REF_SEARCH), "search").otherwise("sites")
        rows = rows.withColumn("kind", kind).withColumn("source", F.when(F.col("ref_host").isin("", "-"), "no referrer").otherwise(F.col("ref_host")))
        rows = rows.withColumn("page", F.col("source"))
    pages = addresses.where("form = 'page' AND probe = ''").select("base")
    rows = rows.join(pages, "base", "left_semi")
    return rows.groupBy("kind", "source", F.col("tpl").alias("target")).agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("vid").alias("visits"), count_if(F.col("group") == "people").alias("people"),
        count_if(search_ok()).alias("search"), F.count_distinct("page").alias("source_pages"), F.count_distinct("base").alias("addresses"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def missing_static(rq: DataFrame) -> DataFrame:
    """Missing files asked by pages, folded by folder (placeholders stay alone, touch icons together)."""
    rows = _broken(rq, True).where("ext <> 'map'")
    files = rows.groupBy("base").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("vid").alias("visits"))
    folder = (F.when(F.col("base").rlike(fv.INVISIBLE_FILES), F.col("base"))
              .when(F.col("base").rlike(r"/apple-touch-icon[\w-]*\.png$"), F.lit("/apple-touch-icon*.png"))
              .otherwise(F.regexp_replace("base", r"[^/]+$", "*")))
    return files.groupBy(folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("requests").alias("requests"), F.max("visits").alias("max_visits"))


def service_files(rq: DataFrame) -> DataFrame:
    """robots.txt, sitemaps, feeds by day: requests, codes and mean size."""
    rows = rq.where(F.col("base").rlike(fv.SERVICE_ADDRESSES))
    by = rows.groupBy("base", "day").agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg("bytes") / 1024, 4).alias("kb"))
    return by.join(top_values(rows, ["base", "day"], F.col("status"), "codes", 3), ["base", "day"])


def service_file_health(rq: DataFrame) -> DataFrame:
    """Failing and absent service files: answers to expected robots, 2xx ever, the last fifth of requests, share of 404.

    The last fifth is found by request rank within counts per second, not by sorting raw rows of a file.
    """
    st = F.col("status")
    rows = rq.where(F.col("base").rlike(fv.SERVICE_ADDRESSES))
    legit = F.col("fam_cat").isin(fv.SEARCH, fv.ADS, "feeds and marketplaces", fv.GOOGLE_SVC)
    answered = (st < 300) | (st >= 400)
    total = rows.groupBy("base").agg(
        F.count(F.lit(1)).alias("requests"), count_if(legit).alias("legit"), count_if(legit & (st >= 400)).alias("legit_bad"),
        count_if(st == 200).alias("ok"), count_if(answered).alias("answered"), count_if(st == 404).alias("missing"))
    secs = rows.groupBy("base", "ts", (st >= 400).alias("bad")).agg(F.count(F.lit(1)).alias("n"), F.max("req_id").alias("last_req"))
    w = Window.partitionBy("base").orderBy(F.desc("ts"), F.desc("last_req"), "bad").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = secs.withColumn("_to", F.sum("n").over(w)).join(total.select("base", F.greatest(F.lit(1), F.floor(F.col("requests") / 5)).alias("_fifth")), "base")
    used = F.greatest(F.lit(0), F.least(F.col("n"), F.col("_fifth") - (F.col("_to") - F.col("n"))))
    tail = tail.groupBy("base").agg((F.sum(F.when(F.col("bad"), used).otherwise(0)) / F.sum(used)).alias("tail_bad"))
    rows = total.join(tail, "base")
    failing = ((F.col("legit") >= 10) & (F.col("legit_bad") / F.col("legit") > 0.8)) | ((F.col("ok") >= 5) & (F.col("tail_bad") > 0.8))
    absent = F.col("base").rlike(r"^/(robots\.txt|sitemap\.xml)$") & (F.col("answered") > 0) & (F.col("missing") / F.col("answered") > 0.9)
    return rows.select("base", "requests", "legit", "ok", F.round("tail_bad", 6).alias("tail_bad"),
                       F.when(failing, "failing").when(absent, "absent").otherwise("fine").alias("verdict"))


def optional_files(rq: DataFrame) -> DataFrame:
    st = F.col("status")
    rx = "|".join(f"(?:{p})" for p in fv.OPTIONAL_FILES)
    by = rq.where(F.col("base").rlike(rx)).groupBy("base").agg(
        F.count(F.lit(1)).alias("requests"), count_if((st >= 200) & (st < 300)).alias("ok"), count_if(st >= 500).alias("e5"))
    ai = F.col("base").rlike("|".join(f"(?:{p})" for p in fv.AI_FILES))
    return by.withColumn("is_ai_index", ai).withColumn("is_failing", F.col("e5") / F.col("requests") >= 0.5)


def search_errors(rq: DataFrame) -> DataFrame:
    rows = rq.where(search_ok())
    bad = F.col("status") >= 400
    by = rows.groupBy("fam", "tpl").agg(F.count(F.lit(1)).alias("requests"), count_if(bad).alias("errors")).where("errors > 0")
    codes = top_values(rows.where(bad), ["fam", "tpl"], F.col("status"), "codes", 3)
    return by.join(codes, ["fam", "tpl"])


def ad_errors(people: DataFrame) -> DataFrame:
    return people.where(f"channel = '{fv.CH_ADS}' AND entry_status >= 400").groupBy("entry", "entry_status").agg(
        F.count(F.lit(1)).alias("clicks"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def tiny_pages(rq: DataFrame, limit: int = 300) -> DataFrame:
    rows = rq.where(F.col("is_page") & (F.col("status") == 200) & (F.col("method") != "HEAD") & (F.col("bytes") < limit))
    return rows.groupBy("base").agg(F.count(F.lit(1)).alias("answers"))


def soft_groups(rq: DataFrame, tolerance: float = 0.02, min_addresses: int = 200, max_size: int = 20000) -> DataFrame:
    """200-pages that answer the same size on many addresses.

    Sizes are whole numbers below ``max_size``, so the ordered fold that cuts them
    into groups runs on one bounded array; addresses are counted in parallel.
    """
    pages = rq.where(F.col("is_page") & (F.col("status") == 200) & (F.col("method") != "HEAD"))
    per = pages.groupBy("base", "bytes", who().alias("who")).agg(F.count(F.lit(1)).alias("n")).where(F.col("bytes") < max_size)
    sizes = per.select("bytes").distinct().agg(F.array_sort(F.collect_list("bytes")).alias("sizes"))
    step = lambda acc, v: F.when((F.size(acc) > 0) & (v <= F.element_at(acc, -1)["start"] * (1 + tolerance)),
                                 F.concat(acc, F.array(F.struct(v.alias("bytes"), F.element_at(acc, -1)["start"].alias("start"))))).otherwise(
        F.concat(acc, F.array(F.struct(v.alias("bytes"), v.alias("start")))))
    empty = F.expr("cast(array() as array<struct<bytes:bigint,start:bigint>>)")
    groups = sizes.select(F.inline(F.aggregate("sizes", empty, step)))
    rows = per.join(F.broadcast(groups), "bytes")  # at most max_size rows
    by = rows.groupBy("start").agg(
        F.min("bytes").alias("size_from"), F.max("bytes").alias("size_to"), F.count_distinct("base").alias("addresses"), F.sum("n").alias("requests"),
        *[F.round(F.sum(F.when(F.col("who") == w, F.col("n")).otherwise(0)) / F.sum("n") * 100, 4).alias(f"{a}_pct")
          for w, a in (("people", "people"), ("search robots", "search"), ("bots", "bots"))],
        F.count_distinct(F.when(~F.col("base").endswith("/"), F.col("base"))).alias("no_slash"))
    by = by.where(F.col("addresses") >= min_addresses)
    medians = pages.groupBy("base").agg(F.median("bytes").alias("median"))
    in_group = rows.join(by.select("start"), "start", "left_semi").select("start", "base").distinct().where(~F.col("base").endswith("/"))
    twins = in_group.withColumn("base", F.concat("base", F.lit("/"))).join(medians, "base")
    twins = twins.groupBy("start").agg(F.count(F.lit(1)).alias("twins"), count_if(F.abs(F.col("median") - F.col("start")) > 0.1 * F.col("start")).alias("different"))
    size_404 = rq.where("is_page AND status = 404").groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).agg(
        F.min_by("bytes", F.struct((-F.col("n")).alias("n"), "bytes")).alias("size_404"))
    out = by.join(twins, "start", "left").fillna(0, ["twins", "different"]).withColumn("size_404", size_404.scalar())
    pairs = (F.col("twins") >= F.greatest(F.lit(20.0), 0.1 * F.col("no_slash"))) & (F.col("different") > F.col("twins") / 2)
    kind = (F.when((F.col("no_slash") > F.col("addresses") / 2) & pairs, "no trailing slash")
            .when(F.abs(F.col("size_404") - F.col("start")) <= tolerance * F.col("start"), "not found with code 200").otherwise("same page, check"))
    return out.select("start", "size_from", "size_to", "addresses", "requests", "people_pct", "search_pct", "bots_pct", kind.alias("kind"))


def slash_twins(rq: DataFrame) -> DataFrame:
    """Addresses asked both with and without the trailing slash."""
    per = rq.groupBy("base").agg(F.count(F.lit(1)).alias("requests"), count_if(F.col("status") < 300).alias("ok"))
    key = F.regexp_replace("base", r"/+$", "")
    both = per.where(F.col("base") != "/").groupBy(key.alias("address")).agg(
        F.max(F.when(F.col("base").endswith("/"), F.col("requests"))).alias("with_slash"),
        F.max(F.when(~F.col("base").endswith("/"), F.col("requests"))).alias("without_slash"), F.sum("ok").alias("ok"))
    return both.where("with_slash IS NOT NULL AND without_slash IS NOT NULL")


def errlog_type(msg: Column) -> Column:
    return C.first_match(msg, [(p, F.lit(n)) for n, p in fv.ERROR_TYPES], F.lit("other"))


def errlog_summary(error_log: DataFrame) -> DataFrame:
    rows = error_log.withColumn("type", errlog_type(F.col("msg"))).withColumn("day", C.log_day(F.col("ts")))
    by = rows.groupBy("type").agg(F.count(F.lit(1)).alias("messages"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return by.join(top_values(rows, ["type"], F.col("request"), "requests", 2), "type")


def split_error_log(error_log: DataFrame, hosts: DataFrame) -> DataFrame:
    """Error log with the kind of its host; messages without a known host stay with the site."""
    kinds = hosts.select(F.col("vhost").alias("host"), F.col("kind").alias("host_kind"))
    return error_log.join(kinds, "host", "left").withColumn("host_kind", F.coalesce("host_kind", F.lit("site")))


def address_codes(rq: DataFrame) -> DataFrame:
    """Address x code for 4xx and 5xx: requests by owner and origin, IPs, days and the most frequent source."""
    rows = rq.where("status >= 400")
    keys = ["base", "status"]
    by = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("ip").alias("ips"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        *[count_if(who() == w).alias(w.replace(" ", "_")) for w in WHO],
        *[count_if(origin() == o).alias(o.replace(" ", "_")) for o in ("site pages", "direct", "other sites")])
    source = F.when(origin() == "site pages", F.col("ref_path")).when(origin() == "other sites", F.col("ref_host"))
    top = rows.withColumn("_s", source).where("_s <> ''").groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.min_by("_s", F.struct((-F.col("_n")).alias("n"), F.col("_s").alias("s"))).alias("source"))
    return by.join(top, keys, "left").withColumn("source", F.coalesce("source", F.lit("")))


def error_families(codes: DataFrame) -> DataFrame:
    s = F.col("status")
    family = F.when(s == 404, "404").when(s >= 500, "5xx").when(s == 499, "499").otherwise("403 and other 4xx")
    return codes.groupBy("base", family.alias("family")).agg(
        F.sum("requests").alias("requests"), F.max("ips").alias("ips"), F.sum("people").alias("people"), F.sum("search_robots").alias("search_robots"),
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "requests"))),
                                 lambda x: F.concat(x["status"].cast("string"), F.lit(": "), x["requests"].cast("string"))), ", ").alias("codes"))


def error_sources(rq: DataFrame, templates) -> DataFrame:
    """Where requests with errors come from: address, code, kind of source, detail."""
    ad, o = F.col("query").rlike(fv.AD_MARK), origin()
    host = F.trim(F.split("ref_host", ",")[0])
    kind = (F.when(ad, "ads").when((o == "site pages") & (F.col("ref_path") != F.col("base")), "site pages")
            .when((o == "other sites") & host.rlike(fv.REF_SEARCH), "search").when(o == "other sites", "sites").otherwise("direct"))
    rows = rq.where("status >= 400").withColumn("kind", kind)
    detail = F.when(F.col("kind") == "site pages", templates(F.col("ref_path"))).when(F.col("kind").isin("search", "sites"), host).otherwise("")
    return rows.groupBy("base", "status", "kind", detail.alias("detail")).agg(F.count(F.lit(1)).alias("n"))


def criticality(codes: DataFrame, sources: DataFrame, human_visits: DataFrame) -> DataFrame:
    """Why an error matters: ads lead here, linked from the site, 5xx for people or search robots, many people."""
    e = codes.where("status <> 499").groupBy("base").agg(
        F.sum("people").alias("people"), F.sum(F.when(F.col("status") >= 500, F.col("people")).otherwise(0)).alias("p5"),
        F.sum(F.when(F.col("status") >= 500, F.col("search_robots")).otherwise(0)).alias("s5"))
    s = sources.where("status <> 499").groupBy("base").agg(count_if(F.col("kind") == "ads").alias("ads"), count_if(F.col("kind") == "site pages").alias("site"))
    mass = human_visits.agg(F.greatest(F.lit(10.0), 0.001 * F.count(F.lit(1))).alias("mass"))
    rows = e.join(s, "base", "left").withColumn("mass", mass.scalar())
    reasons = F.array_compact(F.array(
        F.when(F.col("ads") > 0, "ads lead here"), F.when(F.col("site") > 0, "linked from the site"), F.when(F.col("p5") > 0, "5xx for people"),
        F.when(F.col("s5") > 0, "5xx for search robots"), F.when(F.col("people") >= F.col("mass"), "many people")))
    return rows.select("base", F.array_join(reasons, "; ").alias("why")).where("why <> ''")


def error_journal(rq: DataFrame) -> DataFrame:
    """5xx and 4xx by owner, 499 of people and search robots, by day and in total (day is NULL there)."""
    st = F.col("status")
    c4 = (st >= 400) & (st < 500) & (st != 499)
    per = rq.groupBy("day", who().alias("who")).agg(
        count_if(st >= 500).alias("e5"), count_if(c4).alias("e4"), count_if(st == 499).alias("e499"), count_if(st < 400).alias("ok"))
    aggs = [F.sum(F.when(F.col("who") == w, F.col(c)).otherwise(0)).alias(f"{c}_{w.replace(' ', '_')}") for c in ("e5", "e4") for w in WHO]
    aggs += [F.sum(F.when(F.col("who") == w, F.col("e499")).otherwise(0)).alias(f"e499_{w.replace(' ', '_')}") for w in WHO[:2]]
    return per.rollup("day").agg(*aggs)


def error_summary(rq: DataFrame) -> DataFrame:
    st = F.col("status")
    return rq.groupBy(who().alias("who")).agg(
        F.count(F.lit(1)).alias("requests"), count_if(st < 400).alias("ok"), count_if((st >= 400) & (st < 500) & (st != 499)).alias("e4"),
        count_if(st >= 500).alias("e5"), count_if(st == 499).alias("n499"))


def slowness(rq: DataFrame, error_log: DataFrame, min_requests: int = 50) -> DataFrame:
    """Share of aborted requests of people, gateway errors and timeouts by day and hour."""
    human = F.col("group") == "people"
    by = rq.groupBy("day", "hour").agg(
        count_if(human).alias("human_requests"), count_if(human & (F.col("status") == 499)).alias("aborted"),
        count_if(F.col("status").isin(502, 504)).alias("gateway_errors"))
    late = error_log.where(F.col("msg").rlike(fv.TIMEOUT_MESSAGE)).groupBy(
        C.log_day(F.col("ts")).alias("day"), C.log_hour(F.col("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("timeouts"))
    share = F.when(F.col("human_requests") >= min_requests, F.round(F.col("aborted") / F.col("human_requests") * 100, 4))
    return by.join(late, ["day", "hour"], "left").fillna(0, ["timeouts"]).withColumn("aborted_pct", share).drop("aborted")
