"""Joins and windows over time that are bounded by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.marts.errors import state
from weblens.operators.series import count_if
from weblens.operators.sessions import SLOT
from weblens.rules.forms import buckets


def redirect_ends(rq: DataFrame, seconds: int = 3, hops: int = 5) -> DataFrame:
    """Where redirects of an address end: next requests of the visit, a few seconds apart, on related addresses.

    Only chains of at most ``hops`` steps of ``seconds`` are followed, so rows are spread
    over (visit, time slot) and each slot borrows the first seconds of the next one.
    """
    reach = seconds * hops
    borrowed = F.array_compact(F.array(F.col("slot"), F.when(F.col("ts") <= F.col("slot") * SLOT + reach, F.col("slot") - 1)))
    rows = rq.select("vid", "slot", "ts", "req_id", "base", "status").withColumn("blk", F.explode(borrowed))
    w = Window.partitionBy("vid", "blk").orderBy("ts", "req_id")
    rows = rows.withColumn("nxt", F.array(*[F.struct(F.lead("ts", k).over(w).alias("ts"), F.lead("base", k).over(w).alias("base"), F.lead("status", k).over(w).alias("status")) for k in range(1, hops + 1)]))
    red = lambda s: s.between(300, 399) & (s != 304)
    sec = lambda b: F.regexp_extract(b, r"^(/[^/]*)", 1)
    related = lambda a, b: (sec(a) == sec(b)) | (b == "/") | (F.regexp_replace(a, "/+$", "") == F.regexp_replace(b, "/+$", ""))
    start = F.struct(F.col("ts").alias("ts"), F.col("base").alias("base"), F.col("status").alias("status"), F.lit(0).alias("hops"), F.lit(True).alias("go"))

    def step(acc, n):
        ok = acc["go"] & F.coalesce((n["ts"] - acc["ts"] <= seconds) & related(acc["base"], n["base"]), F.lit(False))
        return F.when(ok, F.struct(n["ts"].alias("ts"), n["base"].alias("base"), n["status"].alias("status"), (acc["hops"] + 1).alias("hops"), red(n["status"]).alias("go"))).otherwise(
            F.struct(acc["ts"].alias("ts"), acc["base"].alias("base"), acc["status"].alias("status"), acc["hops"].alias("hops"), F.lit(False).alias("go")))

    ends = rows.where(red(F.col("status")) & (F.col("blk") == F.col("slot"))).withColumn("e", F.aggregate("nxt", start, step))
    first = F.when(F.col("e.hops") > 0, F.col("nxt")[0]["base"]).otherwise("")
    final = F.when(F.col("e.hops") > 0, F.col("e.status")).otherwise(-1)
    per = ends.groupBy("base", "status", first.alias("target"), final.alias("final_status")).agg(F.count(F.lit(1)).alias("n"), F.max("e.hops").alias("hops"))
    best = per.groupBy("base").agg(F.min_by(F.struct("status", "target", "final_status"), F.struct((-F.col("n")).alias("n"), "status", "target", "final_status")).alias("b"),
                                   F.max("hops").alias("hops"), F.sum("n").alias("redirects"))
    return best.select("base", "b.status", "b.target", "b.final_status", "hops", "redirects")


def status_history(rq: DataFrame, in_outage: DataFrame) -> DataFrame:
    """State of every failing address by day for people, own and search robots, folded into runs, and whether it fails now.

    ``in_outage`` has minutes inside outages; 5xx there is a state of its own.
    """
    bad = rq.where((F.col("status") >= 400) & (F.col("status") != 499)).select("base").distinct()
    rows = rq.where("status <> 499").join(in_outage.select("minute", F.lit(True).alias("_out")).distinct(), F.floor(F.col("ts") / 60) == F.col("minute"), "left")
    now = F.when((F.col("status") >= 500) & F.col("_out"), "server error in outage").otherwise(state(F.col("status")))
    own = F.col("group").isin("people", "own") | ((F.col("fam_verified") == "yes") & F.col("fam_cat").isin("search engine"))
    per = rows.groupBy("base", "day", now.alias("state"), own.alias("own")).agg(F.count(F.lit(1)).alias("n")).join(bad, "base", "left_semi")
    seen = per.groupBy("base").agg(F.bool_or("own").alias("has_own"))
    per = per.join(seen, "base").where(F.col("own") | ~F.col("has_own"))
    daily = per.groupBy("base", "day", "state").agg(F.sum("n").alias("n")).groupBy("base", "day").agg(F.min_by("state", F.struct((-F.col("n")).alias("n"), "state")).alias("state"))
    w = Window.partitionBy("base").orderBy("day")
    runs = daily.withColumn("new", F.when(F.lag("state").over(w) == F.col("state"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    runs = runs.groupBy("base", "run", "state").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    text = F.concat("state", F.lit(" "), F.col("a").cast("string"), F.when(F.col("a") != F.col("b"), F.concat(F.lit(".."), F.col("b").cast("string"))).otherwise(""))
    last = rq.agg(F.max("day").alias("last"), F.count_distinct("day").alias("days"))
    recent = last.select(F.date_sub(F.col("last"), (F.greatest(F.lit(2), F.round(F.col("days") * 0.1)) - 1).cast("int"))).scalar()
    out = runs.groupBy("base").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", text.alias("t")))), lambda x: x["t"]), " -> ").alias("history"),
        F.max_by("state", "run").alias("last_state"), F.max("b").alias("last_day"), F.max("run").alias("runs"))
    fails = F.col("last_state").isin("refused", "missing", "server error", "server error in outage")
    return out.withColumn("is_actual", fails & (F.col("last_day") >= recent))


def lost_orders(rq: DataFrame, step_pattern: str, success_pattern: str, hours: int = 3) -> DataFrame:
    """Checkout errors of people: recovered by an order of the same IP within hours, or lost."""
    st = F.col("status")
    errors = rq.where(F.col("base").rlike(step_pattern) & (F.col("group") == "people") & (st >= 400) & (st != 499)).select("req_id", "ip", "ts", "status")
    width = hours * 3600
    orders = rq.where(F.col("base").rlike(success_pattern)).select(F.col("ip").alias("o_ip"), F.col("ts").alias("o_ts"), F.floor(F.col("ts") / width).alias("o_blk")).distinct()
    near = errors.withColumn("blk", buckets(F.col("ts"), F.col("ts") + width, width))
    cond = (F.col("ip") == F.col("o_ip")) & (F.col("blk") == F.col("o_blk")) & (F.col("o_ts") > F.col("ts")) & (F.col("o_ts") <= F.col("ts") + width)
    done = near.join(orders, cond, "left_semi").select("req_id", F.lit(True).alias("_done")).distinct()
    return errors.join(done, "req_id", "left").select("req_id", "ip", "ts", "status", F.when(F.col("_done"), "recovered").otherwise("lost").alias("outcome"))


def neighbours(files_only: DataFrame, pages: DataFrame, minutes: int = 30) -> DataFrame:
    """Visits of files only with page visits of people from the same IP around them (intervals overlap within the window)."""
    width = minutes * 60
    left = files_only.select("vid", "ip", F.col("start").alias("a"), F.col("end").alias("b")).withColumn("blk", buckets(F.col("a") - width, F.col("b") + width, 3600))
    right = pages.select(F.col("ip").alias("p_ip"), F.col("start").alias("p_a"), F.col("end").alias("p_b")).withColumn("p_blk", buckets(F.col("p_a"), F.col("p_b"), 3600))
    cond = (F.col("ip") == F.col("p_ip")) & (F.col("blk") == F.col("p_blk")) & (F.col("p_a") <= F.col("b") + width) & (F.col("p_b") >= F.col("a") - width)
    return left.join(right, cond, "left_semi").select("vid").distinct()


def in_outages(rq: DataFrame, windows: DataFrame) -> DataFrame:
    """Errors, requests and people visits inside every outage; windows become minutes, so the join is by equality."""
    minutes = windows.select("degraded_from", F.explode(F.sequence(F.floor(F.col("degraded_from") / 60), F.floor(F.col("degraded_to") / 60))).alias("minute"))
    rows = rq.select("vid", "group", "status", "channel", F.floor(F.col("ts") / 60).alias("minute")).join(minutes, "minute")
    people = F.col("group") == "people"
    return rows.groupBy("degraded_from").agg(
        F.count(F.lit(1)).alias("requests"), count_if(F.col("status") >= 500).alias("e5"), F.count_distinct(F.when(people, F.col("vid"))).alias("people_visits"),
        F.count_distinct(F.when(people & (F.col("channel") == "ads"), F.col("vid"))).alias("ad_visits"))


def trace(rq: DataFrame, experiments: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests of an IP around the time of an experiment (``name, ip, at``)."""
    around = experiments.select("name", F.col("ip").alias("x_ip"), "at").withColumn("x_blk", buckets(F.col("at") - seconds, F.col("at") + seconds, SLOT))
    rows = rq.withColumn("blk", F.floor(F.col("ts") / SLOT))
    return rows.join(around, (F.col("ip") == F.col("x_ip")) & (F.col("blk") == F.col("x_blk")) & (F.abs(F.col("ts") - F.col("at")) <= seconds)).select(
        "name", "req_id", "ip", "ts", "method", "base", "status")


def probe_tempo(rq: DataFrame, probes: DataFrame) -> DataFrame:
    """Median pause between probes of a client and the share of its probes that more than three IPs ask for."""
    rows = rq.join(probes.select("base"), "base", "left_semi")
    secs = rows.groupBy("ip", "ua", "ts").agg(F.count(F.lit(1)).alias("k"))
    secs = secs.withColumn("g", F.col("ts") - F.lag("ts").over(Window.partitionBy("ip", "ua").orderBy("ts")))
    gaps = secs.select("ip", "ua", F.inline(F.array(F.struct(F.col("g").alias("gap"), F.lit(1).cast("long").alias("w")), F.struct(F.lit(0).cast("long").alias("gap"), (F.col("k") - 1).alias("w")))))
    tempo = gaps.where("gap IS NOT NULL AND w > 0").groupBy("ip", "ua").agg(F.percentile("gap", F.lit(0.5), F.col("w")).alias("median_gap"))
    asked = rows.select("ip", "ua", "base").distinct()
    popular = asked.groupBy("base").agg(F.count_distinct("ip").alias("askers"))
    shared = asked.join(popular, "base").groupBy("ip", "ua").agg(F.round(F.avg(F.when(F.col("askers") > 3, 1.0).otherwise(0.0)), 6).alias("shared"))
    return shared.join(tempo, ["ip", "ua"], "left").withColumn("median_gap", F.coalesce("median_gap", F.lit(-1.0)))


def call_profile(rq: DataFrame, calls: str, seconds: int = 3, close: int = 2) -> DataFrame:
    """Script calls after page loads in people visits: background, extra, in bursts, and the share of pages followed by one.

    The last page before a call matters only within ``seconds`` and the neighbour call within ``close``, so rows are
    spread over (visit, slot) and slots borrow a few seconds from each other.
    """
    call = F.col("method").isin("GET", "POST") & F.col("base").rlike(calls)
    rows = rq.where((F.col("group") == "people") & (F.col("is_page") | call)).withColumn("call", call)
    borrow = F.array_compact(F.array(F.col("slot"), F.when(F.col("ts") >= (F.col("slot") + 1) * SLOT - max(seconds, close), F.col("slot") + 1)))
    rows = rows.select("vid", "slot", "ts", "req_id", "base", "call").withColumn("blk", F.explode(borrow))
    w = Window.partitionBy("vid", "blk").orderBy("ts", "req_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    page = F.last(F.when(~F.col("call"), F.struct("ts", "req_id")), ignorenulls=True).over(before)
    rows = rows.withColumn("page", page).withColumn("prev_call", F.last(F.when(F.col("call"), F.col("ts")), ignorenulls=True).over(before))
    rows = rows.where(F.col("blk") == F.col("slot"))
    hits = rows.where("call").withColumn("background", F.coalesce(F.col("ts") - F.col("page.ts") <= seconds, F.lit(False)))
    pages = rows.where("NOT call").agg(F.count(F.lit(1))).scalar()
    by = hits.groupBy("base").agg(
        F.count(F.lit(1)).alias("calls"), count_if(F.col("background")).alias("background"), count_if(~F.col("background")).alias("extra"),
        count_if(F.coalesce(F.col("ts") - F.col("prev_call") <= close, F.lit(False))).alias("in_burst"),
        F.count_distinct(F.when(F.col("background"), F.col("page.req_id"))).alias("pages_followed"))
    return by.withColumn("share_of_pages", F.round(F.col("pages_followed") / pages, 6))


def spread_files(requests: DataFrame, hours: int = 6, max_share: float = 0.5) -> DataFrame:
    """Files whose densest window of ``hours`` holds less than half of their requests (spread, not a mailing).

    A window holds the running sum at its end less the one before its start: the ends are put between the seconds of a block as rows of their own, so a block costs two sorts however dense it is.
    """
    width = hours * 3600
    per = requests.groupBy("base", "ts").agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.floor(F.col("ts") / width))
    both = per.withColumn("blk", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    running = lambda *order: F.sum("n").over(Window.partitionBy("base", "blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    none = F.lit(None).cast("long")
    second = F.struct(F.col("ts").alias("at"), F.lit(False).alias("end"), F.col("n").alias("n"), none.alias("before"), none.alias("own_n"))
    end = F.struct((F.col("ts") + width).alias("at"), F.lit(True).alias("end"), F.lit(0).cast("long").alias("n"), F.col("before"), F.col("n").alias("own_n"))
    points = both.withColumn("before", running("ts") - F.col("n")).select(
        "base", "blk", F.inline(F.array_compact(F.array(second, F.when(F.col("own") == F.col("blk"), end)))))
    peak = points.withColumn("dense", running("at", "end") - F.col("before")).where("end").groupBy("base").agg(F.max("dense").alias("peak"), F.sum("own_n").alias("requests"))
    return peak.withColumn("is_spread", F.col("peak") < max_share * F.col("requests"))


def list_crawl(requests: DataFrame, minimum: int = 10, share: float = 0.8) -> DataFrame:
    """Clients that take files in order: consecutive numbers or one folder. Works on the first request of every (client, file)."""
    first = requests.groupBy("ip", "ua", "base").agg(F.min(F.struct("ts", "req_id")).alias("f"))
    number = F.regexp_extract("base", r"(\d+)\.[A-Za-z0-9]+$", 1).try_cast("long")
    first = first.withColumn("num", F.coalesce(number, F.lit(-10))).withColumn("slot", F.floor(F.col("f.ts") / SLOT)).withColumn("dir", F.regexp_replace("base", r"[^/]*$", ""))
    ends = first.groupBy("ip", "ua", "slot").agg(F.max_by("num", "f").alias("end"))
    ends = ends.select("ip", "ua", "slot", F.lag("end").over(Window.partitionBy("ip", "ua").orderBy("slot")).alias("carried"))
    w = Window.partitionBy("ip", "ua", "slot").orderBy("f")
    rows = first.join(ends, ["ip", "ua", "slot"]).withColumn("step", F.col("num") - F.coalesce(F.lag("num").over(w), "carried"))
    files = rows.groupBy("ip", "ua").agg(F.count(F.lit(1)).alias("files"), count_if(F.col("step") == 1).alias("consecutive"))
    folder = rows.groupBy("ip", "ua", "dir").agg(F.count(F.lit(1)).alias("n")).groupBy("ip", "ua").agg(F.max("n").alias("top_folder"))
    both = files.join(folder, ["ip", "ua"]).where(F.col("files") >= minimum)
    crawl = (F.col("consecutive") / (F.col("files") - 1) >= share) | (F.col("top_folder") / F.col("files") >= share)
    return both.withColumn("is_crawl", crawl)


def first_orders(rq: DataFrame, success: str, param: str) -> DataFrame:
    """First sight of every order number on the success page of the site."""
    order = F.regexp_extract("query", rf"(?:^|&){param}=([^&]+)", 1)
    rows = rq.where(F.col("base").rlike(success) & F.col("host_site")).withColumn("order_id", order).where("order_id <> ''")
    return rows.groupBy("order_id").agg(F.min_by(F.struct("req_id", "ts", "vid", "status"), F.struct("ts", "req_id")).alias("f")).select("order_id", "f.*")


def order_steps(addresses: DataFrame, steps, not_goals) -> DataFrame:
    """Checkout steps and non-goals among distinct addresses."""
    any_rx = lambda rx: C.any_of([F.col("base").rlike(r) for r in rx]) if rx else F.lit(False)
    return addresses.select("base").distinct().select("base", any_rx(steps).alias("is_step"), any_rx(not_goals).alias("is_not_goal"))
