"""Load and security tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import fixed_values as fv
from weblens.functions import personal
from weblens.marts.errors import search_ok
from weblens.operators.ranking import top_values
from weblens.operators.series import count_if

MB = 1024 * 1024
# fixed values: attack kinds, first match wins; refusals; method notes; outsiders' probes of logs and folders
ATTACK_KINDS = [
    ("path traversal", r"\.\./|%2e%2e%2f|/etc/passwd"),
    ("SQL injection", r"(?i)union(\s|%20|\+)+select|'(\s|%20|\+)*or(\s|%20|\+)*'?1'?=|sleep\(|benchmark\("),
    ("XSS", r"(?i)<script|%3Cscript|javascript:"), ("Log4Shell", r"(?i)\$\{jndi:"),
    ("command execution", r"(?i)cmd=|exec\(|base64_decode|wget(\s|%20)http|curl(\s|%20)http"),
]
REFUSALS = [403, 429, 444, 503]
AD_CHECKERS = ["YaDirectFetcher", "AdsBot-Google"]
FOLDER_PROBE = r"(?i)\.log$|/logs?/|^/(upload|uploads|images|files|bitrix|local)/$"
EXECUTABLE_UPLOAD = r"(?i)^/(upload|uploads|files|images|media)/.*\.(php\d?|phtml|phar|jsp|asp|aspx|cgi|pl|py|sh)$"
PLAIN_METHODS = ["GET", "POST", "HEAD"]


def attack_kind(query: Column, base: Column, link_probe: Column) -> Column:
    """Kind of attack in an address, NULL when there is none."""
    text = F.concat(query, F.lit("|"), base)
    kind = C.first_match(text, [(p, F.lit(n)) for n, p in ATTACK_KINDS], F.lit("other"))
    attacked = query.rlike(fv.ATTACK) | base.rlike(fv.ATTACK)
    return F.when(link_probe & (~attacked | (kind == "other")), "SSRF").when(attacked, kind)


def with_attack(rq: DataFrame, site_hosts, redirect_handlers: str = r"(?i)^/go/") -> DataFrame:
    """Attack kind of every request, computed once per distinct query and address is not needed: one projection."""
    probe = personal.external_link(F.col("query"), site_hosts) & ~F.col("base").rlike(redirect_handlers)
    return rq.withColumn("attack", attack_kind(F.col("query"), F.col("base"), probe))


def heat(rq: DataFrame) -> DataFrame:
    """Requests by day and hour: everybody, people, programs, aborted requests of people, busy for both."""
    human, program = F.col("group") == "people", F.col("group").isin("robots", "bots")
    by = rq.groupBy("day", "hour").agg(
        F.count(F.lit(1)).alias("requests"), count_if(human).alias("people"), count_if(program).alias("programs"),
        count_if(human & (F.col("status") == 499)).alias("aborted"))
    q = by.agg(F.percentile("people", F.lit(0.75)).alias("p"), F.percentile("programs", F.lit(0.75)).alias("b"))
    both = (F.col("people") >= q.select("p").scalar()) & (F.col("programs") >= q.select("b").scalar())
    return by.withColumn("both_busy", both)


def peaks(rq: DataFrame, n: int = 20) -> DataFrame:
    """Busiest minutes with their main IP and robot."""
    per = rq.groupBy(F.floor(F.col("ts") / 60).alias("minute"), "ip", "fam").agg(F.count(F.lit(1)).alias("n"))
    minutes = per.groupBy("minute").agg(F.sum("n").alias("requests")).orderBy(F.desc("requests"), "minute").limit(n)
    rows = per.join(F.broadcast(minutes), "minute")  # n rows
    ip = rows.groupBy("minute", "requests", "ip").agg(F.sum("n").alias("k")).groupBy("minute", "requests").agg(
        F.min_by("ip", F.struct((-F.col("k")).alias("k"), "ip")).alias("top_ip"), F.max("k").alias("top_ip_requests"))
    fam = rows.where("fam <> ''").groupBy("minute", "fam").agg(F.sum("n").alias("k")).groupBy("minute").agg(
        F.min_by("fam", F.struct((-F.col("k")).alias("k"), "fam")).alias("top_robot"))
    return ip.join(fam, "minute", "left").withColumn("top_robot", F.coalesce("top_robot", F.lit("")))


def load_sources(rq: DataFrame) -> DataFrame:
    """Category, type and suspect with requests, traffic share and the most requests per minute."""
    g, named = F.col("group"), F.col("fam") != ""
    suspect = (F.when(g == "robots", F.col("fam")).when(g == "own", F.col("ip")).when((g == "bots") & named, F.col("fam"))
               .when(g.isin("bots", "people"), "").otherwise(F.col("subgroup")))
    kind = F.when(g == "people", "visitors").otherwise(F.col("subgroup"))
    minutes = rq.groupBy(g.alias("category"), kind.alias("type"), suspect.alias("suspect"), F.floor(F.col("ts") / 60).alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), count_if(~F.col("is_static")).alias("pages"))
    by = minutes.groupBy("category", "type", "suspect").agg(
        F.sum("n").alias("requests"), F.sum("pages").alias("pages"), F.sum("bytes").alias("bytes"), F.max("n").alias("max_per_minute"))
    return by.withColumn("traffic_pct", F.round(F.col("bytes") / F.sum("bytes").over(Window.partitionBy()) * 100, 4))


def people_load(rq: DataFrame) -> DataFrame:
    minutes = rq.where("`group` = 'people'").groupBy("channel", F.floor(F.col("ts") / 60).alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("is_page")).alias("p"), F.sum("bytes").alias("bytes"))
    return minutes.groupBy("channel").agg(F.sum("n").alias("requests"), F.sum("p").alias("pages"), F.sum("bytes").alias("bytes"), F.max("p").alias("max_pages_per_minute"))


def mass_requests(rq: DataFrame, per_minute: int = 30) -> DataFrame:
    """IPs that asked many pages in some minute, over the whole period."""
    minutes = rq.groupBy("ip", F.floor(F.col("ts") / 60).alias("minute")).agg(
        count_if(F.col("is_page")).alias("pages"), F.count(F.lit(1)).alias("n"), count_if(F.col("status").isin(403, 429, 444)).alias("refused"))
    hot = F.col("pages") >= per_minute
    return minutes.groupBy("ip").agg(
        F.max("pages").alias("max_pages"), count_if(hot).alias("minutes"), F.min(F.when(hot, F.col("minute"))).alias("first_minute"),
        F.max(F.when(hot, F.col("minute"))).alias("last_minute"), F.sum("n").alias("requests"), F.sum("refused").alias("refused")).where("minutes > 0")


def file_types(rq: DataFrame) -> DataFrame:
    by = rq.where("is_static").groupBy("ext").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"), F.round(count_if(F.col("status") == 304) / F.count(F.lit(1)), 6).alias("cached"),
        F.round(F.avg("bytes"), 4).alias("mean_bytes"))
    return by.withColumn("traffic_pct", F.round(F.col("bytes") / rq.agg(F.sum("bytes")).scalar() * 100, 4))


def heavy_files(rq: DataFrame, top: int | None = None) -> DataFrame:
    """Traffic of every static file, or of the ``top`` by bytes."""
    rows = rq.where("is_static AND status = 200")
    by = rows.groupBy("base").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"), F.round(F.avg("bytes"), 4).alias("mean_bytes"),
        count_if(F.col("ref_internal")).alias("from_site"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return by if top is None else by.orderBy(F.desc("bytes"), "base").limit(top)


def hotlinks(rq: DataFrame) -> DataFrame:
    """Files embedded by other sites."""
    rows = rq.where((F.col("ref_host") != "") & ~F.col("ref_internal") & F.col("ext").isin(fv.MEDIA_EXTENSIONS) & (F.col("status") == 200)
                    & ~F.col("ref_host").rlike(fv.REF_SEARCH))
    by = rows.groupBy("ref_host").agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"), F.count_distinct("base").alias("files"),
                                      F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    kind = (F.when(F.col("ref_host").rlike(r"^[\d.]+$"), "ip without a domain")
            .when(F.col("ref_host").rlike("dev|test|stage|staging|demo|local"), "looks like a test copy").otherwise("external site"))
    return by.withColumn("verdict", kind)


def parasites(rq: DataFrame, min_variants: int = 300) -> DataFrame:
    """Page templates with many query variants for search robots and the keys to blame."""
    rows = rq.where(F.col("is_page") & search_ok())
    distinct = rows.groupBy("tpl", "query").agg(F.count(F.lit(1)).alias("n"))
    by = distinct.groupBy("tpl").agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("requests")).where(F.col("variants") >= min_variants)
    pairs = distinct.select("tpl", F.explode(F.split("query", "&")).alias("pair")).where("pair <> ''").distinct()
    keys = top_values(pairs, ["tpl"], F.split("pair", "=", 2)[0], "guilty_keys", 3)
    return by.join(keys, "tpl", "left").withColumn("guilty_keys", F.coalesce("guilty_keys", F.lit("")))


def crawler_traps(rq: DataFrame, min_variants: int = 500) -> DataFrame:
    rows = rq.where("is_page AND `group` <> 'people'")
    return rows.groupBy("tpl").agg(F.count_distinct("query").alias("variants")).where(F.col("variants") >= min_variants)


def admin_access(rq: DataFrame, admin: str, staff: DataFrame) -> DataFrame:
    rows = rq.where(F.col("base").rlike(admin))
    by = rows.groupBy("ip").agg(
        F.count(F.lit(1)).alias("requests"), count_if(F.col("status") == 200).alias("ok"), count_if(F.col("method") == "POST").alias("posts"),
        F.count_distinct("day").alias("days"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("cc").alias("cc"))
    return by.join(staff.select("ip").withColumn("staff", F.lit(True)), "ip", "left").withColumn("staff", F.coalesce("staff", F.lit(False)))


def staff_ips(rq: DataFrame, admin: str, min_pages: int = 5) -> DataFrame:
    """IPs that work in the admin area: logged in (POST, then the root answers something else than the login form) or enough working pages.

    The login form of a section is the median 200-answer of its root to clients that never posted there.
    """
    folder = F.regexp_replace(F.regexp_extract("base", admin, 0), r"[^/]*$", "")
    rows = rq.where(F.col("base").rlike(admin) & F.col("ua_browser")).withColumn("section", folder)
    rows = rows.withColumn("root", (F.col("base") == F.col("section")) | (F.col("base") == F.concat("section", F.lit("index.php"))))
    posted = F.col("root") & (F.col("method") == "POST")
    ok = (F.col("status") == 200) & (F.col("bytes") > 0)
    sizes = rows.groupBy("section", "ip", "bytes", "root", "method", F.col("base").rlike("(?i)login|auth").alias("loginish")).agg(
        count_if(ok).alias("ok"), count_if(posted).alias("posts"))
    posters = sizes.groupBy("section", "ip").agg((F.sum("posts") > 0).alias("poster"))
    sizes = sizes.join(posters, ["section", "ip"])
    form = sizes.where("root AND method = 'GET' AND NOT poster AND ok > 0").groupBy("section").agg(
        F.percentile("bytes", F.lit(0.5), F.col("ok")).alias("form"))
    judged = sizes.join(form, "section", "left")
    is_form = F.coalesce(F.abs(F.col("bytes") - F.col("form")) <= F.greatest(F.lit(300.0), 0.05 * F.col("form")), F.lit(False))
    n = lambda cond: F.sum(F.when(cond, F.col("ok")).otherwise(0))
    by = judged.groupBy("section", "ip", "poster").agg(
        n(F.col("root") & ~is_form & (F.col("method") == "GET")).alias("inside"), n(~F.col("root") & ~is_form & ~F.col("loginish")).alias("work"),
        n(is_form).alias("forms"))
    staff = (F.col("poster") & (F.col("inside") > 0)) | ((F.col("work") >= min_pages) & (F.col("work") > F.col("forms")))
    return by.where(staff).select("ip").distinct()


def service_sections(rq: DataFrame, admin: str, staff: DataFrame) -> DataFrame:
    """Service sections: who gets answers, who posts to the login, who is inside without a login."""
    rows = rq.where(F.col("base").rlike(admin)).withColumn("section", C.section(F.col("base")))
    rows = rows.join(staff.select("ip").withColumn("_staff", F.lit(True)), "ip", "left")
    per = rows.groupBy("section", "ip").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("status") == 200).alias("ok"), count_if(F.col("method") == "POST").alias("posts"),
        count_if((F.col("status") == 200) & (F.col("base") != F.col("section"))).alias("inner_ok"), F.max("_staff").alias("staff"))
    outsider = F.col("staff").isNull()
    return per.groupBy("section").agg(
        F.sum("n").alias("requests"), F.count(F.lit(1)).alias("ips"), F.sum("ok").alias("ok"), count_if(~outsider).alias("staff_ips"),
        count_if(outsider & (F.col("posts") > 0)).alias("failed_login_ips"), count_if(outsider & (F.col("posts") == 0) & (F.col("inner_ok") > 0)).alias("inside_without_login"),
        (F.sum("ok") > 0).alias("is_real"))


def scanners(rq: DataFrame, probes: DataFrame) -> DataFrame:
    """Scanner targets: attempts, IPs, answers with content."""
    rows = rq.join(probes, "base", "left_semi")
    target = C.first_match(F.col("base"), [(p, F.lit(n)) for n, p in fv.SCAN_TARGETS], F.lit("other"))
    served = (F.col("status") == 200) & (F.col("bytes") > 0)
    return rows.groupBy(target.alias("target")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("ip").alias("ips"), count_if(served).alias("served"),
        F.count_distinct(F.when(served, F.col("ip"))).alias("ips_served"), F.count_distinct("base").alias("addresses"))


def scanner_ips(rq: DataFrame, probes: DataFrame) -> DataFrame:
    rows = rq.join(probes, "base", "left_semi")
    return rows.groupBy("ip").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("day").alias("days"), F.min("day").alias("first_day"),
                                  F.max("day").alias("last_day"), count_if(F.col("status") == 200).alias("served"))


def leaks(rq: DataFrame, probes: DataFrame, staff: DataFrame) -> DataFrame:
    """Service files served to outsiders: content or a stub, judged by how common the answer size is.

    An answer whose size (rounded to 100) is among the five most frequent sizes of
    non-probe pages, tiny or very variable is a stub; an executable answer stays to check.
    """
    rows = rq.join(staff.select("ip"), "ip", "left_anti")
    sizes = rows.where("status = 200 AND bytes > 0").groupBy("base", F.floor(F.col("bytes") / 100).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.join(probes, "base", "left_anti").groupBy("size").agg(F.count_distinct("base").alias("addresses")).orderBy(F.desc("addresses"), "size").limit(5)
    served = (F.col("status") == 200) & (F.col("bytes") > 0)
    files = rows.join(probes, "base", "left_semi").groupBy("base").agg(
        count_if(served).alias("served"), F.count_distinct(F.when(served, F.col("ip"))).alias("ips"), F.median(F.when(served, F.col("bytes"))).alias("size_typical"),
        F.min(F.when(served, F.col("bytes"))).alias("size_min"), F.max(F.when(served, F.col("bytes"))).alias("size_max"),
        F.min(F.when(served, F.col("day"))).alias("first_day"), F.max(F.when(served, F.col("day"))).alias("last_day"),
        F.max_by(served, F.struct("ts", "req_id")).alias("last_served")).where("served > 0")
    files = files.withColumn("size", F.floor(F.col("size_typical") / 100)).join(
        F.broadcast(common.select("size", F.lit(True).alias("_common"))), "size", "left")  # five rows
    verdict = (F.when(F.col("base").rlike(r"(?i)\.(php\d?|phtml|asp|aspx|jsp|cgi)$"), "executed, content unknown").when(F.col("_common"), "stub: common page size")
               .when(F.col("size_typical") < 20, "stub: almost empty").when(F.col("size_max") > 3 * F.col("size_min"), "varies: not a file").otherwise("check"))
    return files.select("base", "served", "ips", "size_typical", "first_day", "last_day", F.col("last_served").alias("open_at_last_request"), verdict.alias("verdict"))


def attacks(rq: DataFrame) -> DataFrame:
    """Attacks by address and kind; unusual 200 answers differ from every normal answer size of the address.

    Normal sizes are distinct per address and spread over size buckets, so the nearest-size test is an equi-join.
    """
    hits = rq.where("attack IS NOT NULL")
    normal = rq.where("attack IS NULL AND status = 200").join(hits.select("base").distinct(), "base", "left_semi").select("base", "bytes").distinct()
    answers = hits.where("status = 200").groupBy("base", "attack", "bytes").agg(F.count(F.lit(1)).alias("n"))
    tolerance = F.greatest(F.lit(200.0), 0.02 * F.col("bytes"))
    near = answers.select("base", "bytes").distinct().withColumn("tol", tolerance).withColumn(
        "cell", F.explode(F.sequence(F.floor((F.col("bytes") - F.col("tol")) / 400), F.floor((F.col("bytes") + F.col("tol")) / 400))))
    cells = normal.select("base", F.col("bytes").alias("usual"), F.floor(F.col("bytes") / 400).alias("cell"))
    usual = near.join(cells, ["base", "cell"]).where(F.abs(F.col("usual") - F.col("bytes")) <= F.col("tol")).select("base", "bytes").distinct()
    odd = answers.join(usual, ["base", "bytes"], "left_anti").groupBy("base", "attack").agg(F.sum("n").alias("unusual"))
    by = hits.groupBy("base", "attack").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("ip").alias("ips"), count_if(F.col("status") == 200).alias("served"),
        count_if(F.col("status") >= 500).alias("e5"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    top = hits.groupBy("base", "attack", "ip").agg(F.count(F.lit(1)).alias("n")).groupBy("base", "attack").agg(
        F.min_by("ip", F.struct((-F.col("n")).alias("n"), "ip")).alias("top_ip"))
    return by.join(top, ["base", "attack"]).join(odd, ["base", "attack"], "left").withColumn("unusual", F.coalesce("unusual", F.lit(0)))


def webshells(rq: DataFrame) -> DataFrame:
    rows = rq.where(F.col("base").rlike(EXECUTABLE_UPLOAD))
    return rows.groupBy("base").agg(F.count(F.lit(1)).alias("requests"), count_if(F.col("status") == 200).alias("ok"), F.count_distinct("ip").alias("ips"),
                                    F.max("day").alias("last_day"))


def human_probers(visits: DataFrame, min_days: int = 2) -> DataFrame:
    """Clients judged as a human researcher on several days."""
    rows = visits.where("subgroup LIKE 'human researcher%'")
    return rows.groupBy("ip", "ua").agg(F.count_distinct("day").alias("days"), F.count(F.lit(1)).alias("visits"), F.sum("n_req").alias("requests")).where(
        F.col("days") >= min_days)


def open_redirects(rq: DataFrame, site_hosts, handlers: str) -> DataFrame:
    """Known redirect handlers called with a foreign link, minus the sizes they answer to ordinary calls."""
    rows = rq.where(F.col("base").rlike(handlers) & F.col("status").between(300, 399))
    outside = personal.external_link(F.col("query"), site_hosts)
    flagged = rows.withColumn("_out", outside)
    usual = flagged.where("NOT _out").select("base", "bytes").distinct()
    found = flagged.where("_out").join(usual, ["base", "bytes"], "left_anti")
    return found.groupBy("base").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("ip").alias("ips"), F.count_distinct("query").alias("links"))


def tokens(rq: DataFrame) -> DataFrame:
    rows = rq.withColumn("param", personal.secret_key(F.col("query"))).where("param <> ''")
    own = F.col("group") == "own"
    return rows.groupBy("base", "param").agg(F.count(F.lit(1)).alias("requests"), count_if(own).alias("own"), count_if(~own).alias("outsiders"),
                                             count_if(search_ok()).alias("search"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def server_filter(rq: DataFrame) -> DataFrame:
    """Refusals to genuine search robots, ad checkers and people who really browse; probes do not count."""
    browsing = rq.where("`group` = 'people' AND is_page AND status = 200").select("vid").distinct()
    people = rq.where("`group` = 'people'").join(browsing, "vid", "left_semi").withColumn("filter_group", F.lit("people")).withColumn("who", F.lit("people"))
    robots = rq.where("`group` <> 'people'").withColumn("filter_group", F.when(search_ok(), "search robots").when(
        F.col("fam").isin(AD_CHECKERS) & (F.col("fam_verified") == "yes"), "ad checkers")).where("filter_group IS NOT NULL").withColumn("who", F.col("fam"))
    rows = people.unionByName(robots)
    total = rows.groupBy("who").agg(F.count(F.lit(1)).alias("total"))
    refused = rows.where(F.col("status").isin(REFUSALS) & ~C.looks_vulnerable(F.col("base")) & ~F.col("base").rlike(FOLDER_PROBE))
    by = refused.groupBy("filter_group", "who", "status", "nettype", "cc").agg(F.count(F.lit(1)).alias("answers"), F.count_distinct("day").alias("days"))
    return by.join(total, "who").withColumn("pct", F.round(F.col("answers") / F.col("total") * 100, 4)).drop("total")


def method_kind(method: Column) -> Column:
    return (F.when(method.rlike(r"^\\x16\\x03"), "TLS on an HTTP port").when(method.rlike(r"^\\x") | ~method.rlike(r"^[A-Z-]{1,12}$"), "garbage and alien protocols")
            .otherwise(method))


def methods(rq: DataFrame) -> DataFrame:
    return rq.groupBy(method_kind(F.col("method")).alias("kind")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("ip").alias("ips"), count_if(F.col("status").between(200, 299)).alias("accepted"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def security_journal(rq: DataFrame, probes: DataFrame) -> DataFrame:
    """Requests by group, traffic, peak minute and probes by day; probe addresses are matched after reducing to (day, address)."""
    minutes = rq.groupBy("day", F.floor(F.col("ts") / 60).alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), *[count_if(F.col("group") == g).alias(g) for g in fv.GROUPS])
    days = minutes.groupBy("day").agg(F.sum("n").alias("requests"), F.sum("bytes").alias("bytes"), F.max("n").alias("peak"), *[F.sum(g).alias(g) for g in fv.GROUPS])
    hits = rq.groupBy("day", "base").agg(F.count(F.lit(1)).alias("n")).join(probes, "base", "left_semi").groupBy("day").agg(F.sum("n").alias("probes"))
    return days.join(hits, "day", "left").fillna(0, ["probes"])
