"""The address registry: form, existence and meaning of every requested address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import fixed_values as fv
from weblens.operators.series import count_if


def address_form(addresses: DataFrame) -> DataFrame:
    """base -> form (page / file / construct), file group, extension, unknown extension."""
    raw = F.regexp_replace("base", r"^https?://[^/]+", "")
    raw = F.when(raw == "", "/").otherwise(raw)
    path = C.decode_path(F.col("_raw"))
    leaf = F.regexp_extract(F.regexp_replace("_path", r"/+$", ""), r"([^/]*)$", 1)
    hidden = F.col("_leaf").startswith(".") & (F.length("_leaf") > 1)
    ext = F.when(F.col("_leaf").startswith("."), F.lower(F.split(F.substring("_leaf", 2, 500), r"\.")[0])).otherwise(
        F.lower(F.regexp_extract("_leaf", r"\.([A-Za-z0-9]{1,10})$", 1)))
    rows = addresses.select("base").distinct().withColumn("_raw", raw).withColumn("_path", path).withColumn("_leaf", leaf).withColumn("ext", ext)
    by_address = C.first_match(F.col("_path"), [("(?i)" + p, F.lit(g)) for g, p in fv.FILE_GROUPS_BY_ADDRESS], F.lit(None).cast("string"))
    by_ext = F.lit(None).cast("string")
    for group, extensions in reversed(fv.FILE_GROUPS_BY_EXTENSION):
        by_ext = F.when(F.col("ext").isin(extensions.split()), group).otherwise(by_ext)
    hidden_name = F.lower(F.substring("_leaf", 2, 500))
    page_like = (F.col("ext") == "") | F.col("ext").isin(fv.PAGE_EXTENSIONS + fv.TLD_TAILS) | F.col("ext").rlike(r"^\d+$")

    def verdict(form, group, ext_col, unknown):
        return F.struct(F.lit(form).alias("form"), group.alias("file_group"), ext_col.alias("extension"), unknown.alias("unknown_ext"))

    none, no = F.lit(""), F.lit(False)
    construct = F.col("_raw").rlike(fv.CONSTRUCT) | F.col("_path").rlike(fv.CONSTRUCT)
    rows = rows.withColumn("_by_address", by_address).withColumn("_by_ext", by_ext)
    rows = rows.withColumn("_v", (
        F.when(construct, verdict("construct", none, none, no))
        .when(F.col("_by_address").isNotNull(), verdict("file", F.col("_by_address"), F.col("ext"), no))
        .when(hidden, verdict("file", F.lit("configs"), hidden_name, ~hidden_name.isin(fv.HIDDEN_FILES)))
        .when(page_like, verdict("page", none, F.col("ext"), no))
        .otherwise(verdict("file", F.coalesce("_by_ext", F.lit("unknown kind")), F.col("ext"), F.col("_by_ext").isNull()))))
    return rows.select("base", "_v.form", "_v.file_group", "_v.extension", "_v.unknown_ext")


def address_dim(rq: DataFrame, engine_pages: str = r"^$", site_is_wordpress: bool = False) -> DataFrame:
    """One row per address: form, probe strength, existence and whether people get it.

    ``rq`` needs base, status, group, fam and ref_internal.  Counters are summed per
    address before anything else, so a popular address is not a hot key.
    """
    st, who = F.col("status"), F.col("group").isin("people", "own")
    hit = lambda a, b: (st >= a) & (st < b)
    stats = rq.groupBy("base").agg(
        F.count(F.lit(1)).alias("requests"), count_if(who & hit(200, 300)).alias("_ok"), count_if(hit(200, 300)).alias("_ok_any"),
        count_if(who & hit(300, 400)).alias("_r3"), count_if(hit(400, 500)).alias("_e4"), count_if(st >= 500).alias("_e5"),
        count_if(F.col("fam") != "").alias("_robots"), count_if(F.col("ref_internal")).alias("_inner"))
    rows = address_form(stats).join(stats, "base")
    probe = C.probe_strength(F.col("base"), site_is_wordpress)
    existence = (F.when((F.col("_ok") > 0) | (F.col("_ok_any") > 0), "live").when(F.col("_r3") > 0, "redirect")
                 .when(F.col("_e5") > 0, "broken").otherwise("missing"))
    feed = (F.col("file_group") == "widget data") & F.col("extension").isin("xml", "yml", "csv", "tsv")
    feed = feed & (F.col("_robots") >= 0.5 * F.col("requests")) & (F.col("_inner") < 0.2 * F.col("requests"))
    group = F.when(feed, "feeds and exports").otherwise(F.col("file_group"))
    service = F.col("base").rlike("(?i)" + engine_pages) | (F.col("file_group") == "service (.well-known)")
    foreign = F.col("base").startswith("/.well-known/") & ~F.col("file_group").isin("service (.well-known)", "ownership proofs")
    cleared = (F.col("_probe") == "weak") & ((F.col("_ok") > 0) | F.col("base").rlike("(?i)" + engine_pages))
    return rows.withColumn("_probe", probe).select(
        "base", "form", group.alias("file_group"), "extension", "unknown_ext",
        F.when(cleared, "").otherwise(F.col("_probe")).alias("probe"), existence.alias("existence"),
        (F.col("_ok") > 0).alias("for_people"), service.alias("service_page"), (foreign & (F.col("_ok_any") > 0)).alias("foreign_well_known"),
        F.regexp_extract("base", r"^(/[^/]*/?)", 1).alias("section"), "requests")


def probe_addresses(addresses: DataFrame) -> DataFrame:
    """Addresses that look like a probe and are neither pages people get nor service pages of the engine."""
    cleared = (F.col("probe") == "") & (F.col("for_people") | F.col("service_page"))
    return addresses.where(C.looks_vulnerable(F.col("base")) & ~cleared).select("base")


def real_addresses(addresses: DataFrame) -> DataFrame:
    return addresses.where(F.col("for_people") & (F.col("probe") != "strong")).select("base")


def unknown_extensions(addresses: DataFrame, min_requests: int = 3, top: int | None = None) -> DataFrame:
    """Extensions of unknown kind by requests: all, or the ``top``."""
    rows = addresses.where(F.col("unknown_ext") & (F.col("probe") == "") & (F.col("existence") != "missing"))
    by = rows.groupBy("extension").agg(F.sum("requests").alias("requests"), F.count(F.lit(1)).alias("addresses"), F.min("base").alias("example"))
    often = by.where(F.col("requests") >= min_requests)
    return often if top is None else often.orderBy(F.desc("requests"), "extension").limit(top)


def constructs(rq: DataFrame, addresses: DataFrame) -> DataFrame:
    """Addresses glued by scripts (templates, quotes, string joins) and who asks for them.

    Constructs are found on the registry; rows are reduced per address before joining it.
    """
    people = F.col("group").isin("people", "own")
    self_ref = F.col("ref_path") == F.col("base")
    from_site = F.col("ref_internal") & people & ~self_ref
    per = rq.groupBy("base").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("ip").alias("ips"), count_if(people).alias("people"),
        count_if(F.col("group") == "robots").alias("robots"), count_if(from_site).alias("from_site"), F.max("day").alias("last_day"))
    rows = per.join(addresses.where("form = 'construct'").select("base"), "base")
    verdict = (F.when(F.col("from_site") > 0, "broken page code").when(F.col("people") > 0, "broken outside link")
               .when(F.col("robots") > 0, "broken link on the web").otherwise("injection or probe by outsiders"))
    return rows.withColumn("verdict", verdict)
