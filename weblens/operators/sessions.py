"""Visits: sessionizing requests, cleaning page views and folding them.

A client is (ip, user agent, site host or not).  Time is cut into slots that are
shorter than the visit gap, therefore all requests of a client inside one slot
always belong to the same visit and only slots have to be chained.  Requests are
shuffled once by (client, slot); a client that sends a third of all traffic is
spread over as many tasks as there are slots in the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import fixed_values as fv

CLIENT = ["ip", "ua", "host_site"]
SLOT = 600  # seconds; any value up to the visit gap gives the same visits
ENTRY = ["base", "query", "status", "ref", "ref_host", "ref_internal"]
_SUMS = ["n_req", "n_pages", "n_dup", "n_redirect", "n_embedded", "n_static", "bytes", "n_post", "n_head",
         "n_err4", "n_err5", "n_goal", "n_conv"]


def slot_of(ts):
    return F.floor(ts / SLOT)


def mark_pages(rq: DataFrame) -> DataFrame:
    """Add slot, is_page, is_dup, is_redirect_hop and is_embedded.

    The previous page within 5 s and the next page within 3 s decide, so page rows
    near a slot edge are also sent to the neighbouring slot as context and dropped
    after the window.
    """
    embedded = F.col("_embedded") if "_embedded" in rq.columns else F.lit(False)
    raw = F.col("method").isin("GET", "HEAD") & ~F.col("is_static")
    rows = rq.withColumn("is_embedded", raw & embedded).withColumn("_page", raw & ~embedded).drop("_embedded")
    own, ts = slot_of(F.col("ts")), F.col("ts")
    after = F.when(F.col("_page") & (ts >= (own + 1) * SLOT - fv.DOUBLE_LOAD_GAP), own + 1)
    before = F.when(F.col("_page") & (ts < own * SLOT + fv.REDIRECT_GAP), own - 1)
    rows = rows.withColumn("slot", F.explode(F.array_compact(F.array(own, after, before))))
    rows = rows.repartition(*CLIENT, "slot")
    w = Window.partitionBy("slot", *CLIENT, "_page").orderBy("ts", "req_id")  # numbers first: rows are sorted by them and seldom by the long strings
    same = (F.lag("base").over(w) == F.col("base")) & (F.lag("query").over(w) == F.col("query"))
    dup = F.col("_page") & F.coalesce(same & (ts - F.lag("ts").over(w) <= fv.DOUBLE_LOAD_GAP), F.lit(False))
    hop = F.col("_page") & F.col("status").isin(301, 302, 303, 307, 308) & F.coalesce(
        F.lead("ts").over(w) - ts <= fv.REDIRECT_GAP, F.lit(False))
    marked = rows.withColumn("is_dup", dup).withColumn("is_redirect_hop", hop)
    return (
        marked.withColumn("is_page", F.col("_page") & ~F.col("is_dup") & ~F.col("is_redirect_hop"))
        .where(F.col("slot") == slot_of(F.col("ts")))
        .drop("_page")
    )


def _count(cond):
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def fold_slots(marked: DataFrame) -> DataFrame:
    """Counters and first rows per client slot. Needs no exchange after mark_pages."""
    position, entry = F.struct("ts", "req_id"), F.struct(*ENTRY)
    goal = F.col("goal") != "" if "goal" in marked.columns else F.lit(False)
    conv = F.col("goal_success") if "goal_success" in marked.columns else F.lit(False)
    st = F.col("status")
    slots = marked.groupBy("slot", *CLIENT).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_req"),
        _count(F.col("is_page")).alias("n_pages"), _count(F.col("is_dup")).alias("n_dup"),
        _count(F.col("is_redirect_hop")).alias("n_redirect"), _count(F.col("is_embedded")).alias("n_embedded"),
        _count(F.col("is_static")).alias("n_static"), F.sum("bytes").alias("bytes"),
        _count(F.col("method") == "POST").alias("n_post"), _count(F.col("method") == "HEAD").alias("n_head"),
        _count((st >= 400) & (st < 500)).alias("n_err4"), _count(st >= 500).alias("n_err5"),
        _count(goal).alias("n_goal"), _count(conv).alias("n_conv"),
        F.min_by(entry, position).alias("first_any"),
        F.min_by(entry, F.when(F.col("is_page"), position)).alias("first_page"),
    )
    return slots.select(*CLIENT, "slot", *slots.columns[len(CLIENT) + 1:])


def chain_slots(slots: DataFrame, gap: int = fv.VISIT_GAP) -> DataFrame:
    """Give every client slot the start of its visit. Works on one row per slot."""
    w = Window.partitionBy(*CLIENT).orderBy("slot")
    new = F.coalesce(F.col("first_ts") - F.lag("last_ts").over(w) > gap, F.lit(True))
    starts = slots.withColumn("_start", F.when(new, F.col("first_ts")))
    return starts.withColumn("start", F.last("_start", ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_start")


def visit_id():
    return F.md5(F.concat_ws("|", "ip", "ua", F.col("host_site").cast("string"), F.col("start").cast("string")))


def fold_visits(slots: DataFrame, gap: int = fv.VISIT_GAP) -> DataFrame:
    """One row per visit; reuses the client partitioning of chain_slots."""
    first_page_slot = F.when(F.col("first_page").isNotNull(), F.col("slot"))
    visits = chain_slots(slots, gap).groupBy(*CLIENT, "start").agg(
        F.max("last_ts").alias("end"), *[F.sum(c).alias(c) for c in _SUMS],
        F.min_by("first_any", "slot").alias("_any"), F.min_by("first_page", first_page_slot).alias("_page"))
    entry = F.coalesce("_page", "_any")
    for name in ENTRY:
        target = "entry" if name == "base" else f"entry_{name}"
        visits = visits.withColumn(target, entry[name])
    return (
        visits.withColumn("vid", visit_id())
        .withColumn("n_pages_raw", F.col("n_pages") + F.col("n_dup") + F.col("n_redirect"))
        .withColumn("dur", F.col("end") - F.col("start"))
        .withColumn("day", C.log_day(F.col("start")))
        .withColumn("hour", C.log_hour(F.col("start")))
        .withColumn("weekday", F.pmod(F.floor(F.col("start") / 86400) + 3, F.lit(7)).cast("int"))
        .withColumn("_c", C.channel_no(F.col("entry_ref_host"), F.col("entry_ref_internal"), F.col("entry_query"), F.col("entry_ref")))
        .withColumn("channel", C.pick(F.col("_c"), C.CHANNELS))
        .withColumn("channel_sub", C.channel_source(F.col("_c"), F.col("entry_ref_host"), F.col("entry_query")))
        .drop("_c", "_any", "_page")
    )


def with_visit(marked: DataFrame, visits: DataFrame, *attributes: str) -> DataFrame:
    """Requests with their visit id and visit attributes.

    Joined on (client, slot), not on the visit id: a visit that lasts the whole log
    is spread over its slots.
    """
    spans = visits.select(*CLIENT, "vid", *attributes, F.explode(
        F.sequence(slot_of(F.col("start")), slot_of(F.col("end")))).alias("slot"))
    return marked.join(spans, [*CLIENT, "slot"])


def returning(visits: DataFrame) -> DataFrame:
    """Flag visits that are not the first one of their IP."""
    first = visits.groupBy("ip").agg(F.min("start").alias("_first"))
    return visits.join(first, "ip").withColumn("is_returning", F.col("start") > F.col("_first")).drop("_first")
