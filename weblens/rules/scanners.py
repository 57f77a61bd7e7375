"""Scanner signatures and who stands behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import fixed_values as fv
from weblens.operators.requests import salted_lookup
from weblens.operators.series import count_if
from weblens.plans.store import stored

# signatures in order of strength
SIGNATURES = ["strong probe", "series of probes", "variants of one file", "fan of 404", "fan of 404 from one address"]
SCANNER, ONCE, REGULAR = "scanner under a browser", "human researcher, once", "human researcher, regular"


def probe_dim(addresses: DataFrame) -> DataFrame:
    """Probe addresses with their strength; the patterns run once per distinct address."""
    return addresses.select("base").distinct().withColumn("strength", C.probe_strength(F.col("base"))).where("strength <> ''")


def self_chosen():
    """The client picked the address itself: not a link or resource taken from a site page."""
    return ~F.col("ref_internal") | (F.col("ref_path") == F.col("base"))


def signatures(rq: DataFrame, probes: DataFrame) -> DataFrame:
    """vid -> number of the first matching signature and the count of strong probe requests."""
    st = F.col("status")
    e4 = st.between(400, 499)
    hits = rq.join(probes, "base")
    weak = (F.col("strength") == "weak") & self_chosen() & e4
    by_visit = hits.groupBy("vid").agg(
        count_if(F.col("strength") == "strong").alias("strong"), F.count_distinct(F.when(weak, F.col("base"))).alias("weak"))
    weak_clients = hits.where(weak).groupBy("ip", "ua").agg(F.count_distinct("base").alias("n")).where(F.col("n") >= fv.PROBE_SERIES_MIN).select("ip", "ua", F.lit(True).alias("_weak_client"))
    stem = F.regexp_extract("base", r"/(\.?[^/.]+)[^/]*$", 1)
    variants = rq.where(e4 & self_chosen() & F.col("base").contains(".") & (stem != "")).groupBy("vid", stem.alias("stem")).agg(
        F.count_distinct("base").alias("n")).where(F.col("n") >= fv.VARIANTS_MIN).select("vid").distinct().withColumn("_variants", F.lit(True))
    pages = rq.where(F.col("is_page") & self_chosen())

    def fan(keys, minimum, name):
        by = pages.groupBy(*keys).agg(F.count_distinct("base").alias("n"), F.bool_and(e4).alias("all4"))
        return by.where((F.col("n") >= minimum) & F.col("all4")).select(*keys, F.lit(True).alias(name))

    clients = rq.select("vid", "ip", "ua").distinct()
    rows = (clients.join(by_visit, "vid", "left").join(weak_clients, ["ip", "ua"], "left").join(variants, "vid", "left")
            .join(fan(["vid"], fv.FAN_404_MIN, "_fan"), "vid", "left").join(fan(["ip", "ua"], fv.FAN_404_IP_MIN, "_fan_client"), ["ip", "ua"], "left"))
    no = (F.when(F.col("strong") > 0, 0).when((F.col("weak") >= fv.PROBE_SERIES_MIN) | F.col("_weak_client"), 1).when(F.col("_variants"), 2)
          .when(F.col("_fan"), 3).when(F.col("_fan_client"), 4))
    return rows.withColumn("signature", no).where("signature IS NOT NULL").select("vid", "signature", F.coalesce("strong", F.lit(0)).alias("strong"))


def actor_kind(suspects: DataFrame, visits: DataFrame, rq: DataFrame, probes: DataFrame) -> DataFrame:
    """(ip, ua) -> scanner or human researcher, from weighted signs of a living person.

    ``suspects`` are the visits already proved suspicious.
    """
    clients = suspects.select("ip", "ua").distinct()
    days = suspects.groupBy("ip", "ua").agg(F.count_distinct("day").alias("days"))
    browsers = suspects.groupBy("ip").agg(F.count_distinct("ua").alias("browsers"))
    own = visits.join(clients, ["ip", "ua"], "left_semi").groupBy("ip", "ua").agg(
        F.sum("n_req").alias("req"), F.sum("dur").alias("dur"), F.min("nettype").alias("net"), F.bool_or("ua_browser").alias("browser"))
    rows = rq.join(clients, ["ip", "ua"], "left_semi").join(probes, "base", "left")
    probe = F.col("strength").isNotNull()
    acts = rows.groupBy("ip", "ua").agg(
        count_if(F.col("is_page") & F.col("status").between(200, 299) & ~probe).alias("pages_ok"), count_if(probe).alias("probes"),
        count_if(F.col("is_static") & F.col("ref_internal")).alias("rendered"))
    seconds = rows.where(probe).groupBy("ip", "ua", "ts").agg(F.count(F.lit(1)).alias("k"))
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("ip", "ua").orderBy("ts"))
    gaps = seconds.withColumn("g", gap).select("ip", "ua", F.inline(F.array(F.struct(F.col("g").alias("gap"), F.lit(1).cast("long").alias("w")), F.struct(F.lit(0).cast("long").alias("gap"), (F.col("k") - 1).alias("w")))))
    tempo = gaps.where("gap IS NOT NULL AND w > 0").groupBy("ip", "ua").agg(F.percentile("gap", F.lit(0.5), F.col("w")).alias("gap"))
    asked = rows.where(probe).select("ip", "ua", "base").distinct()
    popular = asked.groupBy("base").agg(F.count_distinct("ip").alias("askers"))
    shared = asked.join(popular, "base").groupBy("ip", "ua").agg(F.avg(F.when(F.col("askers") > fv.SHARED_LIST_IPS, 1.0).otherwise(0.0)).alias("shared"))
    all_ = own.join(acts, ["ip", "ua"], "left").join(tempo, ["ip", "ua"], "left").join(shared, ["ip", "ua"], "left").join(days, ["ip", "ua"]).join(browsers, "ip")
    dc = F.col("net").startswith(fv.NET_DC)
    w = fv.HUMAN_WEIGHTS
    points = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), w[name]).otherwise(0)
    score = (points(F.col("rendered") >= fv.HUMAN_RESOURCES_MIN, "loads_resources")
             + points(F.col("req") / F.greatest("dur", F.lit(1)) < fv.HUMAN_TEMPO_RPS, "live_tempo")
             + points(~(dc | (F.col("net") == fv.NET_RELAY)), "home_network") + points(F.col("browser"), "browser") + points(F.col("pages_ok") > 0, "walks_site"))
    human = ((score >= fv.HUMAN_SCORE_MIN) & ~dc & ~F.coalesce(F.col("gap") < fv.HUMAN_PROBE_GAP_MIN, F.lit(False))
             & (F.coalesce("shared", F.lit(0.0)) < fv.SHARED_LIST_SHARE) & (F.col("browsers") <= fv.MAX_BROWSERS_PER_IP) & (F.coalesce("probes", F.lit(0)) <= fv.HUMAN_MAX_PROBES))
    kind = F.when(human & (F.col("days") >= fv.HUMAN_REGULAR_DAYS), REGULAR).when(human, ONCE).otherwise(SCANNER)
    return all_.select("ip", "ua", kind.alias("kind"), score.alias("score"))


def mark_scanners(visits: DataFrame, rq: DataFrame, probes: DataFrame) -> DataFrame:
    """People visits with a scanner signature become bots named after the kind of actor and the signature."""
    found = visits.join(signatures(rq, probes), "vid", "left")
    suspicious = F.col("signature").isNotNull() & (F.col("group") == fv.PEOPLE)
    kinds = actor_kind(found.where(suspicious), visits, rq, probes).select("ip", "ua", "kind")
    rows = found.join(kinds, ["ip", "ua"], "left")
    kind = F.when(F.col("strong") >= fv.STRONG_PROBES_SCANNER, SCANNER).otherwise(F.coalesce("kind", F.lit(SCANNER)))
    label = F.concat(kind, F.lit(": "), C.pick(F.col("signature"), SIGNATURES))
    return rows.withColumn("subgroup", F.when(suspicious, label).otherwise(F.col("subgroup"))).withColumn(
        "group", F.when(suspicious, fv.BOTS).otherwise(F.col("group"))).drop("signature", "strong", "kind")


def mark_backups(visits: DataFrame, rq: DataFrame, staff: DataFrame, admin: str) -> DataFrame:
    """Backup seekers, own transfers, mass and single downloads of sensitive files.

    The patterns run once per distinct address; the requests of addresses that match one are stored and read by every step.
    """
    sensitive = "(?i)" + "|".join(f"(?:{p})" for p in fv.SENSITIVE)
    archive = r"(?i)\.(zip|rar|7z|tar|tar\.gz|tgz|gz|bz2|sql|dump|bak|wpress|jpa)(\.\d+)?$"
    spark, kinds = visits.sparkSession, {"_sensitive": sensitive, "_archive": archive, "_admin": admin, "_move": "(?i)" + "|".join(fv.TRANSFER)}
    known = stored(spark, rq.select("base").distinct().select("base", *[F.col("base").rlike(p).alias(k) for k, p in kinds.items()]), "backup-addresses")
    hit = C.any_of([F.col(k) for k in kinds])
    hits = salted_lookup(rq.select("vid", "ip", "ua", "ts", "base", "status", "bytes"), known.where(hit), "base", F.coalesce("ts", F.lit(0)))
    hits = stored(spark, hits.where(hit), "backup-requests")
    rows = hits.where("_sensitive")
    paths = rows.groupBy("ip").agg(F.count_distinct("base").alias("paths"))
    seekers = paths.where(F.col("paths") >= fv.BACKUP_SEARCH_MIN_PATHS)
    touched = hits.where("_sensitive OR _archive").join(seekers, "ip", "left_semi").select("vid").distinct()
    got = rows.where("status = 200 AND bytes > 0")
    downloads = got.groupBy("ip", "ua", "base").agg(F.min("ts").alias("t"))
    crowd = got.groupBy("base").agg(F.count_distinct("ip").alias("crowd"))
    logins = hits.where("_admin AND status = 200").join(staff, "ip", "left_semi")
    first_ip = logins.groupBy("ip").agg(F.min("ts").alias("t_ip"))
    first_ua = logins.groupBy("ua").agg(F.min("ts").alias("t_ua"))
    moves = hits.where("_move AND status < 400")
    last_ip = moves.groupBy("ip").agg(F.max("ts").alias("m_ip"))
    last_ua = moves.groupBy("ua").agg(F.max("ts").alias("m_ua"))
    d = (downloads.join(crowd, "base").join(paths, "ip").join(first_ip, "ip", "left").join(first_ua, "ua", "left")
         .join(last_ip, "ip", "left").join(last_ua, "ua", "left"))
    login = F.least("t_ip", "t_ua")
    before = login <= F.col("t")
    transfer = before & (F.greatest("m_ip", "m_ua") >= login)
    many = ((F.col("paths") - 1) >= fv.BACKUP_SEARCH_MIN_PATHS) | (F.col("crowd") >= fv.BACKUP_MANY_IPS)
    rank = F.when(F.coalesce(transfer, F.lit(False)), 2).when(many, 1).otherwise(0)
    verdicts = got.select("vid", "ip", "ua", "base").distinct().join(d.withColumn("rank", rank), ["ip", "ua", "base"]).groupBy("vid").agg(F.max("rank").alias("rank"))
    out = visits.join(touched.withColumn("_seek", F.lit(True)), "vid", "left").join(verdicts, "vid", "left")
    taken = F.col("rank").isNotNull() & ~F.col("group").isin(fv.ROBOTS, fv.MONITORS)
    seek = F.col("_seek") & (F.col("group") == fv.PEOPLE)
    return (out.withColumn("subgroup", F.when(taken, "took a backup").when(seek, SCANNER + ": backup search").otherwise(F.col("subgroup")))
            .withColumn("group", F.when(taken, C.pick(F.col("rank"), [fv.SUSPECTS, fv.BOTS, fv.OWN])).when(seek, fv.BOTS).otherwise(F.col("group")))
            .drop("_seek", "rank"))
