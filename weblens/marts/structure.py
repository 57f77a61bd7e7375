"""Site structure and inventories: pages, facets, files, parameters, intake points, engine and purpose of the site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import fixed_values as fv
from weblens.functions import personal
from weblens.functions.ads import decode_plus
from weblens.functions.columns import decode_path
from weblens.operators.ranking import top_values
from weblens.operators.requests import salted_lookup
from weblens.operators.series import count_if
from weblens.operators.sessions import SLOT
from weblens.plans.store import stored

# fixed values: facet words, facet keys, service keys; attack values in parameters; key shapes; address kinds
FACET_WORDS = {
    "rooms": "Rooms", "room": "Rooms", "komnat": "Rooms", "house_num": "House", "house": "House", "dom": "House", "total_area": "Area", "area": "Area",
    "square": "Area", "complete_date": "Completion", "deadline": "Completion", "project": "Project", "district": "District", "finishing": "Finishing",
    "price": "Price", "cost": "Price", "floor": "Floor", "section": "Section", "brand": "Brand", "manufacturer": "Manufacturer", "color": "Color",
    "colour": "Color", "size": "Size", "material": "Material", "category": "Category", "type": "Type", "city": "City", "region": "Region"}
FACET_SEGMENT = r"(?i)^([a-z][a-z0-9_]*)-(is|from|to)-(.+)$"
FACET_COLON = r"(?i)^([a-z][a-z0-9_]*)[:=](.+)$"
FACET_KEY = r"(?i)(filter|^f$|^f\[|\[\]$|_(min|max|from|to)$|^pa_|^attr|^prop|^price|^brand|^color|^size)"
NOT_FACET = r"(?i)^(set_filter|del_filter|ajax\w*|sort\w*|order\w*|view|page|pagen_\d+|utm_\w+|yclid|gclid|fbclid|bxajaxid|clear_cache)$"
OPAQUE = r"^(\d{6,}|[0-9a-f]{32}|[0-9a-f]{40})$"
SMALL_NUMBERS = 2000
ATTACK_VALUE = (r"(?i)\.\./|169\.254\.|file://|/etc/passwd|/proc/self|call_user_func|<script|union[\s+]+select|phpinfo|\$\{jndi|/bin/(ba)?sh|cmd\.exe"
                r"|wget\s|curl\s|base64_decode|eval\(")
KEY_SHAPE = r"^[\w\[\]\-.() ;]{1,40}$"
NAV_KEYS = r"(?i)^(q|query|s|search|page|p|pagen_\d+|sort|order|view|filter|color|size|brand|price\w*)$"
AUTO_ASKED = (r"(?i)^/(robots\.txt|sitemap[\w-]*\.xml(\.gz)?|llms(-full)?\.txt|ai\.txt|ads\.txt|app-ads\.txt|\.well-known/security\.txt|favicon\.ico"
              r"|apple-touch-icon[\w-]*\.png)$")
SCRIPTS = r"(?i)\.php\d?$|/ajax|/api/|/services/|/tools/|/rest/|\.ashx$|\.aspx$|\.cgi$|\.pl$"
BLOCK_KINDS = [
    (r"/filter/.*/apply/", "catalog filter load"), (r"(?i)galer|gallery|photo|foto|slider|lightbox", "gallery"),
    (r"(?i)form|modal|popup|callback|getprice|consult|feedback", "forms and windows"), (r"\.html?$", "embedded pages"), (r"(?i)ajax|component", "ajax blocks"),
]
PURPOSE = {"cart": r"(?i)/(cart|basket|korzina|checkout|order)", "cabinet": r"(?i)/(lk|cabinet|account|personal|profile|dashboard)",
           "content": r"(?i)/(news|blog|articles?|stat|posts?)", "api": r"(?i)/(api|rest|graphql)/"}
TOP_CHANNELS = [fv.CH_ADS, fv.CH_SEARCH, fv.CH_DIRECT, fv.CH_MAPS, fv.CH_LINKS, fv.CH_INTERNAL]


def top_pages(rq: DataFrame, addresses: DataFrame, by: Column, n: int | None = None, existing_only: bool = True) -> DataFrame:
    """Pages, sections or templates by visits of people, with errors, leads sent from them and channels.

    Rows are reduced to one per (unit, address, visit) before anything is counted twice.
    """
    probes = addresses.where("probe <> ''").select("base")
    pages = rq.where("is_page AND `group` = 'people'").join(probes, "base", "left_anti")
    per = pages.groupBy(by.alias("unit"), "base", "vid", "ip", "channel").agg(
        F.count(F.lit(1)).alias("views"), count_if(F.col("status").between(200, 299)).alias("ok"), count_if((F.col("status") >= 400) & (F.col("status") != 499)).alias("errors"))
    by_visit = per.groupBy("unit", "vid", "ip", "channel").agg(F.sum("views").alias("views"), F.sum("errors").alias("errors"), F.sum("ok").alias("ok"))
    known = F.col("channel").isin(TOP_CHANNELS)
    t = by_visit.groupBy("unit").agg(
        F.sum("views").alias("views"), F.count(F.lit(1)).alias("visits"), F.count_distinct("ip").alias("ips"), F.sum("errors").alias("errors"), F.sum("ok").alias("ok"),
        *[count_if(F.col("channel") == c).alias("ch_" + c.replace(" ", "_")) for c in TOP_CHANNELS], count_if(~known).alias("ch_other"))
    t = t.where("ok > 0") if existing_only else t
    t = t.join(per.groupBy("unit").agg(F.count_distinct("base").alias("addresses")), "unit")
    return t if n is None else t.orderBy(F.desc("visits"), "unit").limit(n)


def leads_by_page(rq: DataFrame) -> DataFrame:
    return rq.where("goal <> '' AND method = 'POST' AND `group` = 'people'").groupBy(F.col("ref_path").alias("page")).agg(F.count(F.lit(1)).alias("leads"))


def facet_name(key: Column) -> Column:
    name = key
    for word in sorted(FACET_WORDS, key=len):
        name = F.when(F.lower(key).rlike(rf"(^|[_\[]){word}($|[_\]])"), FACET_WORDS[word]).otherwise(name)
    return name


def facets(rq: DataFrame) -> DataFrame:
    """What people choose: facets in the path and in filter parameters."""
    ok = rq.where("is_page AND `group` = 'people' AND status = 200").groupBy("base", "query", "ip").agg(F.count(F.lit(1)).alias("n"))
    section = F.concat(F.lit("/"), F.split(F.regexp_replace("base", "^/+|/+$", ""), "/")[0], F.lit("/"))
    segs = ok.select(section.alias("section"), "ip", "n", F.explode(F.split(F.regexp_replace("base", "^/+|/+$", ""), "/")).alias("raw")).withColumn("seg", decode_path(F.col("raw")))
    m = lambda i: F.regexp_extract("seg", FACET_SEGMENT, i)
    key = F.when(m(1) != "", m(1)).otherwise(F.regexp_extract("seg", FACET_COLON, 1))
    op = F.when(m(1) != "", m(2)).otherwise("is")
    value = F.when(m(1) != "", m(3)).otherwise(F.regexp_extract("seg", FACET_COLON, 2))
    path = segs.where(F.col("seg").rlike(FACET_SEGMENT) | F.col("seg").rlike(FACET_COLON)).select(
        "section", F.when(m(1) != "", F.concat(key, F.lit("-"), op)).otherwise(key).alias("key"), F.explode(F.split(value, "-or-|,")).alias("value"),
        F.concat(facet_name(key), F.when(op == "from", " from").when(op == "to", " to").otherwise("")).alias("condition"), "ip", "n", F.lit("path").alias("origin"))
    pairs = ok.where("query <> ''").select(section.alias("section"), "ip", "n", F.explode(F.split("query", "&")).alias("p"))
    k, v = decode_path(F.split("p", "=", 2)[0]), F.coalesce(F.try_element_at(F.split("p", "=", 2), F.lit(2)), F.lit(""))
    pairs = pairs.withColumn("key", k).withColumn("value", v).where((F.col("value") != "") & ~F.col("key").rlike(NOT_FACET) & F.col("key").rlike(FACET_KEY))
    stem = F.regexp_replace("key", r"(?i)_(min|max|from|to)$", "")
    tail = F.when(F.col("key").rlike(r"(?i)_(min|from)$"), " from").when(F.col("key").rlike(r"(?i)_(max|to)$"), " to").otherwise("")
    named = facet_name(stem)
    query = pairs.select("section", "key", decode_path(F.col("value")).alias("value"), F.when(named != stem, F.concat(named, tail)).otherwise(F.col("key")).alias("condition"),
                         "ip", "n", F.lit("parameters").alias("origin"))
    both = path.unionByName(query).withColumn("value", F.trim("value"))
    return both.groupBy("section", "key", "value", "condition", "origin").agg(F.sum("n").alias("requests"), F.count_distinct("ip").alias("people"))


def decode_facets(facet_table: DataFrame) -> DataFrame:
    """Opaque facet values that are a checksum of a known value or a small number.

    Candidates carry their crc32, md5 and sha1, so the match is one equality join.
    """
    spark = facet_table.sparkSession
    numbers = spark.range(0, SMALL_NUMBERS + 1).select(F.col("id").cast("string").alias("text"))
    words = facet_table.where("origin = 'path'").select(F.explode(F.array("value", F.initcap("value"), F.upper("value"), F.lower("value"))).alias("text"))
    cands = numbers.unionByName(words).distinct()
    codes = cands.select("text", F.explode(F.array(F.crc32(F.col("text").cast("binary")).cast("string"), F.md5(F.col("text").cast("binary")), F.sha1(F.col("text").cast("binary")))).alias("code"))
    first = codes.groupBy("code").agg(F.min("text").alias("decoded"))
    tail = F.regexp_extract("key", r"_([^_]*)$", 1)
    flag = F.lower("value").isin("y", "on", "1", "true") & F.lower(tail).rlike(OPAQUE)
    opaque = F.when(flag, F.lower(tail)).when(F.lower("value").rlike(OPAQUE), F.lower("value"))
    return facet_table.withColumn("code", opaque).join(first, "code", "left").drop("code")


def pd_in_get(rq: DataFrame) -> DataFrame:
    """Personal data sent by GET, masked; patterns run once per distinct query."""
    hit = rq.where("method = 'GET' AND query <> ''").groupBy("base", "query", "group").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ip").alias("ips"))
    rows = hit.where(personal.has_pd(F.col("query")))
    return rows.select("base", personal.mask_query(F.col("query")).alias("masked"), "group", "n", "ips")


def files_inventory(rq: DataFrame, addresses: DataFrame, min_requests: int = 3, fold_from: int = 3) -> DataFrame:
    """Files of the site by group, same-kind files of one folder folded; files nobody ever got and nobody links to are dropped."""
    st = F.col("status")
    people = F.col("group").isin("people", "own")
    per = rq.groupBy("base").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"), count_if(st.between(200, 299) | (st == 304)).alias("ok"), count_if(F.col("ref_internal")).alias("from_site"),
        count_if(F.col("ref_internal") & people).alias("_asked"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), count_if(F.col("fam") != "").alias("robots"))
    files = per.join(addresses.where("form = 'file'").select("base", "file_group"), "base")
    files = files.where((F.col("requests") >= min_requests) & ((F.col("ok") > 0) | (F.col("_asked") > 0) | F.col("base").rlike(AUTO_ASKED)))
    seg = F.regexp_extract("base", r"^(/[^/]+/[^/]+/|/[^/]+/)", 1)
    ext = F.lower(F.regexp_extract("base", r"\.([A-Za-z0-9]+)$", 1))
    files = files.withColumn("seg", seg).withColumn("ext", ext)
    sizes = files.where("seg <> '' AND file_group <> 'for robots'").groupBy("seg", "ext", "file_group").agg(F.count(F.lit(1)).alias("k"))
    files = files.join(sizes, ["seg", "ext", "file_group"], "left")
    key = F.when(F.col("k") >= fold_from, F.concat("seg", F.when(F.col("ext") == "", "*").otherwise(F.concat(F.lit("*."), "ext")))).otherwise(F.col("base"))
    return files.groupBy(key.alias("file"), "file_group").agg(
        F.count(F.lit(1)).alias("files"), F.sum("requests").alias("requests"), F.sum("from_site").alias("from_site"), F.sum("robots").alias("robots"),
        F.round(F.sum("bytes") / F.sum("requests"), 4).alias("mean_bytes"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def query_pairs(rq: DataFrame) -> DataFrame:
    """Distinct queries with their counters, one row per key=value pair. Requests are reduced per query before they are split."""
    people, st = F.col("group") == "people", F.col("status")
    queries = rq.where("query <> ''").groupBy("query").agg(
        F.count(F.lit(1)).alias("n"), count_if(people).alias("people_n"), count_if(F.col("is_page") & (F.col("method") == "GET")).alias("page_n"),
        count_if(people & F.col("is_page")).alias("page_people_n"), count_if(people & F.col("ref_internal")).alias("inner_n"), count_if(st >= 400).alias("error_n"),
        count_if(F.col("fam_cat") == "vulnerability scanner").alias("scan_n"), count_if(F.col("group") == "own").alias("own_n"))
    rows = queries.withColumn("pair", F.explode(F.split("query", "&")))
    key = F.trim(decode_path(F.split("pair", "=", 2)[0]))
    value = F.coalesce(F.try_element_at(F.split("pair", "=", 2), F.lit(2)), F.lit(""))
    return rows.withColumn("key", F.lower(key)).withColumn("value", value).where(F.col("key").rlike(KEY_SHAPE))


def key_family(key: Column) -> Column:
    stem = F.regexp_extract(key, r"^(.*?[A-Za-z])_[^_]*\d", 1)
    return F.when(stem != "", F.concat(stem, F.lit("_*"))).otherwise(key)


def match_params(keys: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Best dictionary entry per key: exact before wildcard, then priority, confirmation level and pattern length.

    Exact entries join by equality.  Wildcards ('utm_*') become prefixes and join on the
    first characters of the key, so keys and patterns are never paired freely.
    """
    d = dictionary.select("pattern", "param_group", "priority", "level")
    names = keys.select("key").distinct()
    exact = names.join(d.where(~F.col("pattern").contains("*")).withColumn("key", F.lower("pattern")), "key").withColumn("wild", F.lit(1))
    wild = d.where(F.col("pattern").contains("*")).withColumn("prefix", F.lower(F.regexp_extract("pattern", r"^([^*]*)", 1)))
    prefixes = names.withColumn("prefix", F.explode(F.expr("transform(sequence(0, length(key)), i -> substring(key, 1, i))")))
    # the text before the first '*' is already equal; what follows it must end the key the same way
    tail = F.lower(F.regexp_extract("pattern", r"\*([^*]*)$", 1))
    loose = prefixes.join(wild.withColumn("tail", tail), "prefix").where(F.endswith("key", "tail")).withColumn("wild", F.lit(2)).drop("prefix", "tail")
    order = F.struct("wild", "priority", (-F.col("level")).alias("l"), (-F.length("pattern")).alias("n"), "pattern")
    return exact.unionByName(loose).groupBy("key").agg(F.min_by(F.struct("pattern", "param_group"), order).alias("m")).select("key", "m.pattern", "m.param_group")


def params_inventory(rq: DataFrame, dictionary: DataFrame, people_min: int = 3, inner_min: int = 3) -> DataFrame:
    """Every parameter (or family of keys): who uses it, values, where it comes from; attack, dictionary, then behaviour decide the group."""
    pairs = query_pairs(rq)
    families = pairs.groupBy(key_family(F.col("key")).alias("family"), "key").agg(F.count(F.lit(1)).alias("_")).groupBy("family").agg(F.count(F.lit(1)).alias("keys"))
    pairs = pairs.withColumn("family", key_family(F.col("key"))).join(families, "family").withColumn("param", F.when(F.col("keys") >= 2, F.col("family")).otherwise(F.col("key")))
    attack = personal.decode_plus(F.col("value")).rlike(ATTACK_VALUE)
    per_query = pairs.groupBy("param", "query").agg(*[F.max(c).alias(c) for c in ("n", "people_n", "page_n", "page_people_n", "inner_n", "error_n", "scan_n", "own_n")],
                                                    F.bool_or(attack).alias("attack"))
    s = lambda c: F.sum(c).alias(c)
    t = per_query.groupBy("param").agg(s("n"), s("people_n"), s("page_n"), s("page_people_n"), s("inner_n"), s("error_n"), s("scan_n"), s("own_n"),
                                       F.sum(F.when(F.col("attack"), F.col("n")).otherwise(0)).alias("attack_n"))
    values = pairs.groupBy("param").agg(F.count_distinct("value").alias("values"), F.count_distinct("key").alias("keys"))
    known = match_params(t.select(F.col("param").alias("key")), dictionary).select(F.col("key").alias("param"), "param_group")
    t = t.join(values, "param").join(known, "param", "left")
    by_people = (F.col("people_n") >= people_min) & (F.col("inner_n") >= inner_min)
    nav = F.col("param").rlike(NAV_KEYS) & (F.col("page_n") >= 0.5 * F.col("n")) & (F.col("page_people_n") >= 2)
    dead = (F.col("people_n") <= F.greatest(F.lit(1.0), 0.02 * F.col("n"))) & (F.col("error_n") >= 0.9 * F.col("n"))
    group = (F.when((F.col("attack_n") >= 0.5 * F.col("n")) | ((F.col("scan_n") >= 0.5 * F.col("n")) & (F.col("people_n") == 0)) | dead, "attacks and probes")
             .when(F.col("param_group").isNotNull(), F.col("param_group")).when(nav, "search and navigation").when(by_people, "site logic")
             .when(F.col("own_n") >= 0.5 * F.col("n"), "site logic").otherwise("unknown"))
    return t.select("param", "keys", group.alias("param_group"), F.col("n").alias("requests"), F.col("people_n").alias("people_requests"), "values", F.col("error_n").alias("errors"))


def param_companions(rq: DataFrame, share: float = 0.9, slices: int = 64) -> DataFrame:
    """Keys that come with another key in at least 90% of its requests (``share`` above 0).

    Pairs are not listed for all of a key's queries. A companion lacks at most 1 - share of the requests, so in any part of the queries that weighs more
    than twice that it holds at least half; such a part is made of the key's queries with the fewest keys (equal ones by slices of a hash), and the
    few keys that are often enough there are the only ones counted in the other queries. A query of very many keys, or a key in very many queries,
    thus costs as many pairs as the key has candidates.
    """
    pairs = query_pairs(rq)
    queries = pairs.groupBy("query").agg(F.max("n").alias("n"), F.collect_set("key").alias("keys"))
    queries = queries.withColumn("spread", F.xxhash64("query")).withColumn("place", F.struct(F.size("keys").alias("size"), F.pmod("spread", F.lit(slices)).alias("slice"))).drop("query")
    queries = stored(rq.sparkSession, queries, "key_sets")
    rows = queries.withColumn("key", F.explode("keys"))
    # one row for each key and place: as many as a key has different query sizes, times the slices
    places = rows.groupBy("key", "place").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("key")
    places = places.withColumn("total", F.sum("n").over(w)).withColumn("before", F.sum("n").over(w.orderBy("place")) - F.col("n"))
    spared = F.col("total") - share * F.col("total")
    parts = places.where(F.col("before") <= 2 * spared).groupBy("key", "total").agg(F.max("place").alias("until"), F.sum("n").alias("part"))
    parts = stored(rq.sparkSession, parts, "key_parts")
    short = salted_lookup(rows, parts.select("key", "until"), "key", F.col("spread")).where(F.col("place") <= F.col("until"))
    met = short.select("n", "key", F.explode("keys").alias("companion")).where("key <> companion").groupBy("key", "companion").agg(F.sum("n").alias("met"))
    enough = F.col("met") >= F.col("part") - spared * (1 + 1e-9)
    candidates = met.join(parts, "key").where(enough).groupBy("key", "total").agg(F.collect_set("companion").alias("among"))
    counted = salted_lookup(rows, candidates, "key", F.col("spread")).select("n", "key", "total", F.explode(F.array_intersect("among", "keys")).alias("companion"))
    both = counted.groupBy("key", "companion", "total").agg(F.sum("n").alias("n"))
    return both.where(F.col("n") >= share * F.col("total")).select("key", "companion", "n", "total")


def embedded_blocks(rq: DataFrame) -> DataFrame:
    """Blocks that browsers load inside pages or on an action: non-page answers to people from site pages."""
    rows = rq.where("`group` = 'people' AND ref_internal AND NOT is_static AND (is_embedded OR method = 'POST')")
    kind = C.first_match(F.col("base"), [(p, F.lit(n)) for p, n in BLOCK_KINDS], F.lit("unrecognised"))
    return rows.groupBy("tpl", kind.alias("kind")).agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("vid").alias("visits"), F.count_distinct("ref_path").alias("pages"))


def site_structure(rq: DataFrame, addresses: DataFrame) -> DataFrame:
    """Sections and levels: addresses, templates, pages, files, people and errors."""
    per = rq.groupBy("base", "tpl").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("group") == "people").alias("people"), count_if(F.col("status") >= 400).alias("errors"),
                                        count_if(F.col("query") != "").alias("with_query"))
    rows = per.join(addresses.select("base", "form", "section", "existence"), "base")
    depth = F.size(F.filter(F.split("base", "/"), lambda s: s != ""))
    return rows.groupBy("section", depth.alias("level")).agg(
        F.count(F.lit(1)).alias("addresses"), F.count_distinct("tpl").alias("templates"), count_if(F.col("form") == "page").alias("pages"), count_if(F.col("form") == "file").alias("files"),
        count_if(F.col("existence") == "live").alias("live"), F.sum("n").alias("requests"), F.sum("people").alias("people_requests"), F.sum("errors").alias("errors"),
        F.sum("with_query").alias("with_query"))


def receivers(rq: DataFrame, addresses: DataFrame, min_requests: int = 3) -> DataFrame:
    """Addresses that receive data by GET: search and filters on pages, API points, scripts."""
    rows = rq.where("method = 'GET' AND query <> ''").join(addresses.where("form = 'page' AND probe = ''").select("base", "for_people"), "base")
    keys = F.filter(F.transform(F.split("query", "&"), lambda p: F.lower(F.split(p, "=", 2)[0])), lambda k: ~k.isin(fv.AD_PARAMS))
    kind = (F.when(F.col("base").rlike(r"(?i)/(api|rest)/"), "api").when(F.col("base").rlike(SCRIPTS), F.when(F.col("for_people"), "service script").otherwise("scanner"))
            .when(F.exists(keys, lambda k: k.rlike(r"^(q|query|s|search|text)$")), "search").when(F.exists(keys, lambda k: k.rlike(FACET_KEY)), "filter"))
    by = rows.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("base", "kind").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("ip").alias("ips"), count_if(F.col("status") < 400).alias("ok"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return by.where(F.col("requests") >= min_requests)


def classify_posts(rq: DataFrame, goals: DataFrame, login: str, wordpress: bool = False, min_requests: int = 3) -> DataFrame:
    """What every address that gets POST is: lead form, login, admin, scanner, upload, service script or page load."""
    posts = rq.where("method = 'POST'")
    st, n = F.col("status"), F.col("requests")
    by = posts.groupBy("tpl").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("ip").alias("ips"), count_if(st.between(200, 399) & (st != 301)).alias("_ok"), count_if(st.isin(404, 405)).alias("_gone"),
        count_if(st.isin(404, 405, 301, 302)).alias("_bad"), count_if(st == 403).alias("_403"), count_if(F.col("ref_internal")).alias("_own"), count_if(F.col("group") == "own").alias("own"),
        count_if(F.col("group") != "own").alias("outsiders"), count_if((F.col("group") != "own") & (st == 200)).alias("outsiders_ok")).where(n >= min_requests)
    rows = by.join(goals.where(F.col("rule").startswith("goal")).select(F.col("key").alias("tpl"), F.lit(True).alias("_goal")), "tpl", "left")
    a = F.col("tpl")
    wp = a.rlike(r"/wp-|wordpress|xmlrpc|^/wp/") & F.lit(not wordpress)
    kind = (F.when(F.col("_goal"), "lead").when(a.rlike(login), "login").when(a.rlike(r"/bitrix/admin/|/wp-admin/|/administrator/"), "admin").when(wp, "scanner")
            .when(F.col("_gone") >= 0.8 * n, "scanner").when(F.col("_bad") >= 0.8 * n, "scanner").when(F.col("_403") >= 0.5 * n, "scanner").when(a.contains("upload"), "file upload")
            .when(a.rlike(r"ajax|/tools/|/services/|autosave|\.php$") & (a != "/index.php") & (F.col("_ok") >= 0.5 * n), "service script").when(F.col("_own") >= 0.8 * n, "page load")
            .otherwise("scanner"))
    return rows.select(a.alias("address"), F.lit("POST").alias("method"), kind.alias("kind"), "requests", "ips", "own", "outsiders", "outsiders_ok")


def intake(posts: DataFrame, gets: DataFrame) -> DataFrame:
    """Registry of intake points: POST addresses and GET receivers."""
    g = gets.select(F.col("base").alias("address"), F.lit("GET").alias("method"), "kind", "requests", "ips")
    return posts.select("address", "method", "kind", "requests", "ips").unionByName(g)


def detect_engines(rq: DataFrame) -> DataFrame:
    """Site engines by addresses that browsers get with 200 or 304; every pattern is a flag of one pass over distinct addresses."""
    rows = rq.where("ua_browser AND status IN (200, 304)").groupBy("base", "ip").agg(F.count(F.lit(1)).alias("n"))
    flags = F.array_compact(F.array(*[F.when(F.col("base").rlike(p), F.lit(e)) for e, p in fv.ENGINES]))
    return rows.withColumn("engine", F.explode(flags)).groupBy("engine").agg(F.sum("n").alias("requests"), F.count_distinct("ip").alias("ips"))


def detect_server(rq: DataFrame, error_log: DataFrame) -> DataFrame:
    """Server facts: aborted requests, kinds of PHP messages, server paths."""
    php = F.regexp_extract("msg", r"PHP (Fatal error|Warning|Notice|Deprecated|Parse error)", 1)
    path = F.regexp_extract("msg", r"(/home/bitrix/www|/var/www/[\w.-]+|/usr/share/nginx/html|/srv/[\w.-]+|/home/[\w.-]+/[\w.-]+)", 1)
    rows = error_log.select(F.explode(F.array(F.struct(F.lit("php").alias("fact"), php.alias("value")), F.struct(F.lit("path").alias("fact"), path.alias("value")))).alias("f")).select("f.*")
    facts = rows.where("value <> ''").groupBy("fact", "value").agg(F.count(F.lit(1)).alias("n"))
    aborted = rq.where("status = 499").agg(F.count(F.lit(1)).alias("n")).select(F.lit("nginx 499").alias("fact"), F.lit("").alias("value"), "n")
    return facts.unionByName(aborted)


def ad_parameters(visits: DataFrame) -> DataFrame:
    """Ad and other parameters on entries of people."""
    keys = visits.where("`group` = 'people' AND NOT entry_ref_internal AND entry_query <> ''").select(F.explode(F.split("entry_query", "&")).alias("p")).select(F.lower(F.split("p", "=", 2)[0]).alias("key"))
    return keys.where("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("entries")).withColumn("is_ad", F.col("key").isin(fv.AD_PARAMS))


def site_profile(rq: DataFrame, visits: DataFrame, goals: DataFrame) -> DataFrame:
    """Purpose of the site from shares of one aggregate."""
    rows = rq.where("`group` = 'people' AND is_page AND status = 200 AND method = 'GET'")
    per = rows.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    top3 = per.orderBy(F.desc("n"), "base").limit(3).agg(F.sum("n").alias("top3"))
    share = lambda rx: F.count_distinct(F.when(F.col("base").rlike(rx), F.col("vid")))
    one = rows.agg(F.count(F.lit(1)).alias("views"), F.count_distinct("base").alias("pages"), F.count_distinct("vid").alias("visits"), share(PURPOSE["cart"]).alias("cart"),
                   share(PURPOSE["cabinet"]).alias("cabinet"), count_if(F.col("base").rlike(PURPOSE["content"])).alias("content"), count_if(F.col("base").rlike(PURPOSE["api"])).alias("api"))
    one = one.withColumn("top3", top3.scalar()).withColumn("forms", goals.where("rule LIKE 'goal%'").agg(F.count(F.lit(1))).scalar())
    total = visits.where("`group` = 'people'").agg(F.count(F.lit(1))).scalar()
    one = one.withColumn("people_visits", total)
    kind = (F.when(F.col("api") >= 0.5 * F.col("views"), "web service or API").when(F.col("cabinet") >= 0.5 * F.col("people_visits"), "closed platform")
            .when((F.col("cart") >= 0.005 * F.col("people_visits")) & (F.col("cart") >= 20), "online shop")
            .when((F.col("pages") <= 10) | ((F.col("top3") >= 0.8 * F.col("views")) & (F.col("pages") <= 30)), "landing page")
            .when(F.col("content") >= 0.4 * F.col("views"), "content site").when(F.col("forms") > 0, "catalog with leads").otherwise("corporate site"))
    return one.withColumn("purpose", kind)


def gov_robots(rq: DataFrame, gov_visits: DataFrame) -> DataFrame:
    """Government robots by IP and kind: requests, refusals, addresses. ``gov_visits`` carries gov_op and gov_kind."""
    rows = rq.join(gov_visits.where("gov_op <> ''").select("vid", "gov_op", "gov_kind"), "vid")
    return rows.groupBy("ip", "gov_op", "gov_kind").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("base").alias("addresses"), count_if(F.col("status").isin(403, 429, 444) | (F.col("status") >= 500)).alias("refused"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def web_archive(rq: DataFrame, archive_visits: DataFrame, outage_minutes: DataFrame) -> DataFrame:
    """Archive robots: requests, refusals and how many of them fell into outages."""
    rows = rq.join(archive_visits.where(f"fam_cat = '{fv.WEB_ARCHIVE}'").select("vid", F.col("fam").alias("archive")), "vid")
    rows = rows.join(outage_minutes.select("minute", F.lit(True).alias("_out")).distinct(), F.floor(F.col("ts") / 60) == F.col("minute"), "left")
    n = F.count(F.lit(1))
    refused = count_if(F.col("status").isin(403, 429, 444) | (F.col("status") >= 500))
    return rows.groupBy("archive").agg(n.alias("requests"), F.count_distinct("ip").alias("ips"), F.count_distinct("base").alias("addresses"), refused.alias("refused"),
                                       F.round(refused / n * 100, 4).alias("refused_pct"), count_if(F.col("_out")).alias("in_outage"))


def summary(rq: DataFrame, visits: DataFrame) -> DataFrame:
    """Cleaning statistics and denominators in one row."""
    p = F.col("group") == "people"
    v = visits.agg(F.count(F.lit(1)).alias("visits"), count_if(p).alias("people_visits"), F.sum("n_pages_raw").alias("pages_raw"), F.sum("n_pages").alias("pages"),
                   F.sum("n_dup").alias("double_loads"), F.sum("n_redirect").alias("redirects"), F.sum("n_goal").alias("sent"), F.sum("n_conv").alias("accepted"),
                   F.count_distinct(F.when(p, F.col("ip"))).alias("people_ips"))
    r = rq.agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("ip").alias("ips"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return v.select("*", *[r.select(c).scalar().alias(c) for c in ("requests", "ips", "first_ts", "last_ts")])


def embedded_templates(rq: DataFrame, min_share: float = 0.85, min_hits: int = 200, seconds: int = 3) -> DataFrame:
    """Templates that browsers load right after another request of the visit (part of the page, not a view).

    The previous request matters only within seconds: rows are spread over (visit, slot) and slots borrow a few seconds.
    """
    borrow = F.array_compact(F.array(F.col("slot"), F.when(F.col("ts") >= (F.col("slot") + 1) * SLOT - seconds, F.col("slot") + 1)))
    rows = rq.select("vid", "slot", "ts", "req_id", "tpl", "method", "is_static", "ua_browser", "ref_internal").withColumn("blk", F.explode(borrow))
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("vid", "blk").orderBy("ts", "req_id"))
    rows = rows.withColumn("soon", F.coalesce(gap <= seconds, F.lit(False)) & F.col("ref_internal")).where((F.col("blk") == F.col("slot")) & (F.col("method") == "GET") & ~F.col("is_static") & F.col("ua_browser"))
    by = rows.groupBy("tpl").agg(F.count(F.lit(1)).alias("hits"), F.round(count_if(F.col("soon")) / F.count(F.lit(1)), 6).alias("share"))
    return by.where((F.col("share") >= min_share) & (F.col("hits") >= min_hits))


def detect_shop(rq: DataFrame, min_refs: int = 20, min_lift: float = 2.0, cart: str = r"(?i)/(cart|basket|korzina)/?$", checkout: str = r"(?i)/(checkout|order/make|oformlenie)",
                success: str = r"(?i)/(success|confirm|thank)") -> DataFrame:
    """Cart, checkout and success pages by name, and product actions by behaviour: called from many pages, visits with them reach the cart more often."""
    people = rq.where("`group` = 'people'")
    role = F.when(F.col("base").rlike(success), "success").when(F.col("base").rlike(checkout), "checkout").when(F.col("base").rlike(cart), "cart")
    pages = people.where("method = 'GET' AND status < 400").withColumn("role", role).where("role IS NOT NULL").groupBy("base", "role").agg(
        F.count_distinct("vid").alias("visits"), F.lit(None).cast("double").alias("lift"))
    reach = people.groupBy("vid").agg(F.bool_or(F.col("base").rlike(checkout) | F.col("base").rlike(cart)).alias("reached"))
    base_rate = reach.agg(F.avg(F.col("reached").cast("double"))).scalar()
    calls = people.where("ref_internal AND NOT is_static AND NOT is_page").groupBy("base", "vid").agg(F.count(F.lit(1)).alias("n"))
    refs = people.where("ref_internal AND NOT is_static AND NOT is_page").groupBy("base").agg(F.count_distinct("ref_path").alias("refs")).where(F.col("refs") >= min_refs)
    acts = calls.join(refs, "base").join(reach, "vid").groupBy("base").agg(F.count(F.lit(1)).alias("visits"), F.avg(F.col("reached").cast("double")).alias("rate"))
    acts = acts.withColumn("lift", F.round(F.col("rate") / base_rate, 6)).where(F.col("lift") >= min_lift).select("base", F.lit("product action").alias("role"), "visits", "lift")
    return pages.unionByName(acts)
