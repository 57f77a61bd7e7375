"""Ad labels: UTM parts, packed content, placement kinds, phrase and region names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.plans.store import stored

# fixed values: names of packed call-tracking parts, placement domains, phrase labels
TRACKING_PARTS = {"c": "cid", "gb": "gid", "ad": "aid", "ph": "pid", "st": "source_type", "pt": "position_type", "s": "source",
                  "dt": "device", "reg": "region"}
PLACEMENT_TLDS = ("ru com net org su рф info io tv me pro online site xyz by kz ua app media top ai cc de").split()
OWN_APPS = r"^(ru|com)\.yandex|^ru\.kinopoisk|edadeal|^ru\.beru"
AD_FIELDS = ["aid", "source", "source_type", "region", "device"]


def query_value(query: Column, key: str) -> Column:
    """Last value of a query parameter (key compared without case), '' when absent."""
    pairs = F.filter(F.split(query, "&"), lambda p: F.lower(F.split(p, "=", 2)[0]) == key)
    pairs = F.filter(pairs, lambda p: p.contains("="))
    return F.when(F.size(pairs) > 0, F.substring(F.element_at(pairs, -1), len(key) + 2, 2000)).otherwise("")


def decode_plus(text: Column) -> Column:
    safe = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), text)


def _part(items: Column, key: str, sep: str) -> Column:
    hits = F.filter(items, lambda p: p.startswith(key + sep))
    return F.when(F.size(hits) > 0, F.substring(F.element_at(hits, -1), len(key) + 2, 500))


def parse_ad(visits: DataFrame, column: str = "entry_query") -> DataFrame:
    """Ad columns of a visit: source, medium, campaign, phrase, packed parts and the unexpanded macro flag."""
    q = F.col(column)
    content = F.split(query_value(q, "utm_content"), r"\||%7C")
    tracking = F.split(query_value(q, "calltouch_tm"), "_")
    rows = visits.withColumn("utm_source", query_value(q, "utm_source")).withColumn("utm_medium", query_value(q, "utm_medium"))
    short = {v: k for k, v in TRACKING_PARTS.items()}
    part = lambda name: F.coalesce(_part(content, name, "."), _part(tracking, short[name], ":"), F.lit(""))
    campaign = decode_plus(query_value(q, "utm_campaign"))
    rows = rows.withColumn("campaign", F.when(campaign == "", part("cid")).otherwise(campaign))
    rows = rows.withColumn("phrase", decode_plus(query_value(q, "utm_term")))
    for name in AD_FIELDS:
        rows = rows.withColumn("ad_" + name, part(name))
    return rows.withColumn("raw_macro", q.contains("{") | q.contains("%7B"))


def placement_type(source: Column, system: Column) -> Column:
    s = F.lower(F.coalesce(source, F.lit("")))
    parts = F.split(s, r"\.")
    site = (F.size(parts) >= 2) & F.element_at(parts, -1).isin(PLACEMENT_TLDS) & ~parts[0].isin(PLACEMENT_TLDS)
    none = (system == "search") | s.isin("none", "")
    return (F.when(none, F.when(system.isin("search", ""), "search").otherwise("not given")).when(site, "network: sites")
            .when(s.rlike(OWN_APPS), "network: own apps").otherwise("network: other apps"))


def phrase_label(phrase: Column) -> Column:
    p = F.trim(F.coalesce(phrase, F.lit("")))
    return (F.when(F.lower(p).startswith("---autotargeting"), "autotargeting").when(p.startswith("{") & p.endswith("}"), "(macro not replaced)")
            .when(p == "", "(phrase not given)").otherwise(p))


def region_names(spark, codes: DataFrame, regions: DataFrame) -> DataFrame:
    """Name and parent area (nearest ancestor of level 2) of region codes by walking the hierarchy.

    ``regions`` has code, name, parent, level; the walk goes up until no code has an ancestor left, at most once for each region (a
    circle of parents ends there).
    """
    step = regions.select(F.col("code").alias("_c"), F.col("name").alias("_n"), F.col("parent").alias("_p"), F.col("level").alias("_l"))
    rows = codes.select("region").distinct().join(regions.select(F.col("code").alias("region"), "name"), "region", "left")
    rows = rows.withColumn("_at", F.col("region")).withColumn("area", F.lit(None).cast("string"))
    rows = stored(spark, rows, "regions")
    for _ in range(regions.count() + 1):
        rows = rows.join(step, F.col("_at") == F.col("_c"), "left")
        rows = rows.withColumn("area", F.coalesce("area", F.when(F.col("_l") == 2, F.col("_n"))))
        rows = rows.withColumn("_at", F.when(F.col("area").isNull(), F.col("_p"))).drop("_c", "_n", "_p", "_l")
        rows = stored(spark, rows, "regions")
        if rows.where("_at IS NOT NULL").isEmpty():
            break
    return rows.select("region", F.coalesce("name", F.lit("")).alias("name"),
                       F.coalesce(F.when(F.col("area") != F.col("name"), F.col("area")), F.lit("")).alias("area"))
