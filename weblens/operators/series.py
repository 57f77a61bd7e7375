"""Time series of a log: minutes, hours and days.

Requests are reduced to one row per minute, hour or day first (a partial
aggregation, so no key is hot); ordered windows run inside a day, and what goes on
from day to day is carried in one row a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.plans.store import stored


def count_if(cond):
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def full_grid(counts: DataFrame, key: str, block: int = 1440) -> DataFrame:
    """Add the missing integers of ``key`` between its minimum and maximum; other columns become 0.

    The grid is made block by block (a day of minutes), so a stray timestamp only adds blocks, not a longer list in one row.
    """
    bounds = counts.agg(F.min(key).alias("_a"), F.max(key).alias("_b"))
    blocks = bounds.select("_a", "_b", F.explode(F.sequence(F.floor(F.col("_a") / block), F.floor(F.col("_b") / block))).alias("_blk")).repartition("_blk")
    first, last = F.greatest(F.col("_blk") * block, F.col("_a")), F.least((F.col("_blk") + 1) * block - 1, F.col("_b"))
    return blocks.select(F.explode(F.sequence(first, last)).alias(key)).join(counts, key, "left").fillna(0)


def hour_gaps(rq: DataFrame, *keys: str) -> DataFrame:
    """Hours inside the period (of every key) without a single line."""
    hours = rq.select(*keys, F.floor(F.col("ts") / 3600).alias("hour_no")).distinct()
    bounds = hours.groupBy(*keys).agg(F.min("hour_no").alias("_a"), F.max("hour_no").alias("_b"))
    return bounds.select(*keys, F.explode(F.sequence("_a", "_b")).alias("hour_no")).join(hours, [*keys, "hour_no"], "left_anti")


def day_span(rq: DataFrame) -> DataFrame:
    """First and last second of every log day and whether the day is complete."""
    days = rq.groupBy("day").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    minute = lambda c: F.floor(F.col(c) % 86400 / 60)
    return days.withColumn("is_full", (minute("first_ts") <= 5) & (minute("last_ts") >= 23 * 60 + 55))


def _days(keys) -> Window:
    """Days of a key in order. Without keys it is one group of one row a day."""
    return Window.partitionBy(*(keys or [F.floor(F.col("_blk") * 0)])).orderBy("_blk")


def islands(rows: DataFrame, flag: Column, order: str, gap: int, name: str, keys=(), block: int = 1440) -> DataFrame:
    """Number runs of flagged rows whose distance is at most ``gap`` (per key); unflagged rows get NULL.

    Two levels: rows are compared and numbered inside blocks (days of minutes); last positions and numbers are carried from block to block in one row each.
    """
    marked = rows.withColumn("_blk", F.floor(F.col(order) / block)).withColumn("_at", F.when(flag, F.col(order)))
    w = Window.partitionBy(*keys, "_blk").orderBy(order)
    earlier = _days(keys).rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("_in", F.last("_at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    carried = marked.groupBy(*keys, "_blk").agg(F.max("_at").alias("_last")).select(*keys, "_blk", F.max("_last").over(earlier).alias("_carried"))
    marked = marked.join(carried, [*keys, "_blk"])
    last = F.coalesce("_in", "_carried")
    marked = marked.withColumn("_new", F.when(F.col("_at").isNotNull() & (last.isNull() | (F.col("_at") - last > gap)), 1).otherwise(0))
    offsets = marked.groupBy(*keys, "_blk").agg(F.sum("_new").alias("_n")).select(*keys, "_blk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    numbered = marked.join(offsets, [*keys, "_blk"]).withColumn(name, F.when(F.col("_at").isNotNull(), F.col("_offset") + F.sum("_new").over(w)))
    return numbered.drop("_blk", "_at", "_in", "_carried", "_new", "_offset")


def spread_island(rows: DataFrame, name: str, order: str, keys=(), block: int = 1440) -> DataFrame:
    """Extend an island number to the unflagged rows between its first and last row; numbers rise with the order. In two levels, as ``islands``."""
    rows = rows.withColumn("_blk", F.floor(F.col(order) / block))
    w, days = Window.partitionBy(*keys, "_blk").orderBy(order), _days(keys)
    ends = rows.groupBy(*keys, "_blk").agg(F.min(name).alias("_lo"), F.max(name).alias("_hi")).select(
        *keys, "_blk", F.max("_hi").over(days.rowsBetween(Window.unboundedPreceding, -1)).alias("_was"), F.min("_lo").over(days.rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    rows = rows.join(ends, [*keys, "_blk"])
    before = F.coalesce(F.last(name, ignorenulls=True).over(w), "_was")
    after = F.coalesce(F.first(name, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)), "_next")
    both = rows.withColumn("_b", before).withColumn("_a", after)
    return both.withColumn(name, F.when(F.col("_b") == F.col("_a"), F.col("_b"))).drop("_b", "_a", "_blk", "_was", "_next")


def episodes(minutes: DataFrame, gap: int = 3, keys=()) -> DataFrame:
    """Runs of consecutive minutes (column ``minute``, per key) with their length."""
    runs = islands(minutes.select(*keys, "minute").distinct(), F.lit(True), "minute", gap, "episode", keys)
    return runs.groupBy(*keys, "episode").agg(
        F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"), F.count(F.lit(1)).alias("minutes"))


def minute_norm(rq: DataFrame) -> DataFrame:
    """Requests of every minute and the usual number for its hour of day (median over the full grid)."""
    counts = rq.groupBy(F.floor(F.col("ts") / 60).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    grid = full_grid(counts, "minute").withColumn("hod", (F.floor(F.col("minute") / 60) % 24).cast("int"))
    norm = grid.groupBy("hod").agg(F.median("n").alias("norm"))
    return grid.join(F.broadcast(norm), "hod")  # 24 rows


DB_MESSAGE = (r"Too many connections|MySQL server has gone away|Lost connection|Can.t connect to|SQLSTATE|DB query error"
              r"|Deadlock|marked as crashed|mysqli|Connection refused.*3306")  # fixed value: database messages
UPSTREAM_MESSAGE = r"upstream timed out|connect\(\) failed"  # fixed value: backend messages


def outages(rq: DataFrame, error_log: DataFrame, gap: int = 3) -> DataFrame:
    """Outage and degradation windows with their likely cause.

    The log is read once, into a stored table of minutes; the runs in it are numbered one kind after the other, each stored, since every step reads its rows several times.
    """
    keep = lambda rows: stored(rq.sparkSession, rows, "outage-minutes")
    st, page = F.col("status"), F.col("is_page") | (F.col("method") == "POST")
    minute = F.floor(F.col("ts") / 60).alias("minute")
    per = rq.groupBy(minute).agg(
        count_if(page & (st >= 500)).alias("p5"), count_if(page & (st == 499)).alias("p499"), count_if(page).alias("p"),
        F.count(F.lit(1)).alias("n"), count_if(F.col("is_static") & (st < 400)).alias("s_ok"), count_if(F.col("is_static")).alias("s"),
        F.count_distinct(F.when(page & (st >= 500), F.col("ip"))).alias("ip5"))
    logged = error_log.groupBy(minute).agg(
        count_if(F.col("msg").rlike(DB_MESSAGE)).alias("db_messages"), count_if(F.col("msg").rlike(UPSTREAM_MESSAGE)).alias("up_messages"))
    grid = full_grid(per, "minute").join(logged, "minute", "left").fillna(0)
    grid = grid.withColumn("hod", F.floor(F.col("minute") / 60) % 24)
    grid = keep(grid.withColumn("share", (F.col("p5") + F.col("p499")) / F.greatest("p", F.lit(1))))
    usual = grid.groupBy("hod").agg(
        F.coalesce(F.median(F.when(F.col("p") >= 5, F.col("share"))), F.lit(0.0)).alias("base_share"), F.median("n").alias("base_n"))
    m = grid.join(F.broadcast(usual), "hod")  # 24 rows
    m = m.withColumn("peak", (F.col("p5") >= 3) & (F.col("ip5") >= 3) & (F.col("p5") / F.greatest("p", F.lit(1)) >= 0.25))
    m = m.withColumn("bad", (F.col("p") >= 5) & (F.col("share") >= F.greatest(3 * F.col("base_share"), F.lit(0.2))) | F.col("peak"))
    drop = (F.col("n") < 0.3 * F.col("base_n")) & (F.col("base_n") >= 20)
    m = keep(islands(keep(m), F.col("bad") | drop, "minute", gap, "wide"))
    m = keep(islands(m, F.col("bad"), "minute", gap, "narrow"))
    m = keep(spread_island(spread_island(m, "wide", "minute"), "narrow", "minute"))
    of_wide = Window.partitionBy("wide")
    m = m.withColumn("wide_peak", F.max("peak").over(of_wide))
    key = F.when(F.col("wide_peak"), F.concat(F.lit("w"), "wide")).when(F.col("narrow").isNotNull(), F.concat(F.lit("n"), "narrow"))
    m = m.withColumn("window", key).where(F.col("window").isNotNull())
    own = Window.partitionBy("window")
    first_peak = F.min(F.when(F.col("peak"), F.col("minute"))).over(own)
    last_peak = F.max(F.when(F.col("peak"), F.col("minute"))).over(own)
    m = m.withColumn("a", F.min("minute").over(own)).withColumn("b", F.max("minute").over(own))
    m = m.withColumn("pa", F.coalesce(first_peak, "a")).withColumn("pb", F.coalesce(last_peak, "b")).withColumn("has_peak", first_peak.isNotNull())
    inner = (F.col("minute") >= F.col("pa")) & (F.col("minute") <= F.col("pb"))
    w = m.groupBy("window", "a", "b", "pa", "pb", "has_peak").agg(
        F.sum("p5").alias("pages_5xx"), F.sum("p499").alias("aborted_499"), F.sum("s_ok").alias("_s_ok"), F.sum("s").alias("_s"),
        F.sum("db_messages").alias("db_messages"), F.sum("up_messages").alias("up_messages"),
        F.sum(F.when(inner, F.col("p5"))).alias("_p5"), F.sum(F.when(inner, F.col("p"))).alias("_p"),
        F.avg(F.when(inner, F.col("n"))).alias("_n"), F.avg(F.when(inner, F.col("base_n"))).alias("_base_n"))
    lost = F.col("pages_5xx") + F.col("aborted_499")
    length, peak_length = F.col("b") - F.col("a") + 1, F.col("pb") - F.col("pa") + 1
    w = w.where(F.col("has_peak") | ((length >= 10) & (lost >= 20))).where((peak_length >= 2) | (lost >= 20))
    static_ok = F.col("_s_ok") / F.greatest("_s", F.lit(1))
    cause = F.array_compact(F.array(
        F.when(F.col("db_messages") > 0, "database"), F.when(F.col("up_messages") > 0, "backend"),
        F.when((static_ok > 0.9) & (F.col("pages_5xx") > 0), "static fine, dynamic failed"),
        F.when(F.col("_n") < 0.3 * F.col("_base_n"), "traffic dropped")))
    return w.select(
        (F.col("a") * 60).alias("degraded_from"), (F.col("pa") * 60).alias("peak_from"), (F.col("pb") * 60 + 59).alias("peak_to"),
        (F.col("b") * 60 + 59).alias("degraded_to"), F.when(F.col("has_peak"), peak_length).otherwise(0).alias("peak_minutes"),
        length.alias("total_minutes"), "pages_5xx", "aborted_499", F.round(F.col("_p5") / F.greatest("_p", F.lit(1)), 4).alias("peak_share"),
        F.floor("_n").alias("requests_per_minute"), F.floor("_base_n").alias("usual_per_minute"),
        F.round(static_ok, 4).alias("static_ok"), F.concat_ws("; ", cause).alias("cause"))


def bursts(rq: DataFrame, outage_windows: DataFrame, gap: int = 10, factor: float = 3, extra: int = 500, excess_min: int = 2000) -> DataFrame:
    """Load bursts: minutes far above the norm, merged, with the main client and the kind of crowd behind them.

    Details are taken from per-minute counts by client and group, joined on the minute.
    """
    norm = minute_norm(rq)
    limit = F.greatest(F.lit(factor) * F.col("norm"), F.col("norm") + extra)
    runs = spread_island(islands(norm, F.col("n") >= limit, "minute", gap, "burst"), "burst", "minute").where(F.col("burst").isNotNull())
    totals = runs.groupBy("burst").agg(
        F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"), F.sum("n").alias("requests"), F.max("n").alias("max_per_minute"),
        F.sum(F.col("n") - F.col("norm")).alias("excess"), F.round(F.avg("norm"), 4).alias("usual_per_minute")).where(F.col("excess") >= excess_min)
    minutes = runs.select("minute", "burst")
    by_client = rq.groupBy(F.floor(F.col("ts") / 60).alias("minute"), "ip", "group", "fam").agg(F.count(F.lit(1)).alias("n"))
    inside = by_client.join(minutes, "minute")
    ips = inside.groupBy("burst", "ip").agg(F.sum("n").alias("n"))
    top_ip = ips.groupBy("burst").agg(F.count(F.lit(1)).alias("ips"), F.max_by(F.struct("ip", "n"), F.struct("n", "ip")).alias("_ip"))
    fams = inside.where("fam <> ''").groupBy("burst", "fam").agg(F.sum("n").alias("n"))
    top_fam = fams.groupBy("burst").agg(F.max_by(F.struct("fam", "n"), F.struct("n", "fam")).alias("_fam"))
    people = inside.groupBy("burst").agg(F.sum(F.when(F.col("group") == "people", F.col("n")).otherwise(0)).alias("people_requests"))
    hit = outage_windows.select(F.explode(F.sequence(F.floor(F.col("degraded_from") / 60), F.floor(F.col("degraded_to") / 60))).alias("minute"))
    in_outage = minutes.join(hit.distinct(), "minute").groupBy("burst").agg(F.count(F.lit(1)).alias("outage_minutes"))
    rows = totals.join(top_ip, "burst").join(top_fam, "burst", "left").join(people, "burst").join(in_outage, "burst", "left")
    share = lambda n: n / F.col("requests")
    picture = (
        F.when(share(F.col("_ip.n")) >= 0.5, "single ip").when(share(F.coalesce(F.col("_fam.n"), F.lit(0))) >= 0.5, "robot")
        .when(share(F.col("people_requests")) >= 0.6, "people").when((F.col("ips") >= 50) & (share(F.col("_ip.n")) < 0.1), "distributed").otherwise("mixed"))
    return rows.select(
        "first_minute", "last_minute", "requests", "max_per_minute", "excess", "usual_per_minute", "ips",
        F.col("_ip.ip").alias("top_ip"), F.round(share(F.col("_ip.n")), 4).alias("top_ip_share"), F.coalesce("_fam.fam", F.lit("")).alias("top_robot"),
        "people_requests", picture.alias("picture"), F.coalesce("outage_minutes", F.lit(0)).alias("outage_minutes"))


def waves(days: DataFrame, *keys: str) -> DataFrame:
    """Ranges of consecutive days per key (rows: keys + ``day``)."""
    rows = days.select(*keys, "day").distinct()
    w = Window.partitionBy(*keys).orderBy("day")
    rows = rows.withColumn("_r", F.date_sub("day", F.row_number().over(w)))
    return rows.groupBy(*keys, "_r").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days")).drop("_r")


def status_changes(pages: DataFrame, key: str, min_hits: int = 50) -> DataFrame:
    """Days on which the dominant answer class of a template differs from its previous day."""
    st = F.col("status")
    cls = F.when(st >= 500, "5xx").when(st == 404, "404").when(st < 400, "OK").otherwise("4xx")
    rank = F.when(F.col("cls") == "404", 0).when(F.col("cls") == "4xx", 1).when(F.col("cls") == "5xx", 2).otherwise(3)
    per = pages.groupBy(key, "day", cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    daily = per.groupBy(key, "day").agg(F.max_by("cls", F.struct("n", -rank)).alias("now"), F.sum("n").alias("n"))
    w = Window.partitionBy(key)
    daily = daily.withColumn("total", F.sum("n").over(w)).withColumn("was", F.lag("now").over(w.orderBy("day")))
    return daily.where((F.col("total") >= min_hits) & (F.col("was") != F.col("now"))).select(key, "day", "was", "now")


def rhythm(rq: DataFrame, min_hits: int = 300, min_gaps: int = 50, min_median: int = 20, max_cv: float = 0.5) -> DataFrame:
    """Clients asking one address on a schedule.

    Exact repeats at the same second are counted first; gaps are then taken over
    distinct seconds of a client and address, never over raw rows.
    """
    hits = rq.groupBy("ip", "ua", "base", "ts").agg(F.count(F.lit(1)).alias("k"))
    busy = hits.groupBy("ip", "ua", "base").agg(F.sum("k").alias("hits")).where(F.col("hits") >= min_hits)
    rows = hits.join(busy, ["ip", "ua", "base"])
    w = Window.partitionBy("ip", "ua", "base").orderBy("ts")
    gaps = rows.withColumn("gap", F.col("ts") - F.lag("ts").over(w))
    one = F.when(F.col("gap").isNotNull(), F.array(F.col("gap"))).otherwise(F.array().cast("array<bigint>"))
    zeros = F.array_repeat(F.lit(0).cast("long"), (F.col("k") - 1).cast("int"))
    gaps = gaps.select("ip", "ua", "base", "hits", F.explode(F.concat(one, zeros)).alias("gap"))
    stat = gaps.groupBy("ip", "ua", "base", "hits").agg(
        F.count(F.lit(1)).alias("gaps"), F.median("gap").alias("median_gap"), F.stddev_pop("gap").alias("_sd"), F.avg("gap").alias("_avg"))
    stat = stat.withColumn("cv", F.round(F.col("_sd") / (F.col("_avg") + 1e-9), 6))
    return stat.where((F.col("gaps") > min_gaps) & (F.col("median_gap") > min_median) & (F.col("cv") < max_cv)).drop("_sd", "_avg")


def burst(events: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Most events of a key inside any window of ``seconds``.

    A window that starts at an event touches at most two neighbouring blocks of that
    length, so rows are spread over (key, block) and each block borrows the next one.
    """
    block = F.floor(F.col("ts") / seconds)
    per = events.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("n")).withColumn("own", block)
    both = per.withColumn("block", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    w = Window.partitionBy(*keys, "block").orderBy("ts").rangeBetween(0, seconds)
    dense = both.withColumn("burst", F.sum("n").over(w)).where(F.col("own") == F.col("block"))
    return dense.groupBy(*keys).agg(F.max("burst").alias("burst"))
