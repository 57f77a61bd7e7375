"""Log sources, minutes, days, templates."""

from pyspark.sql import functions as F

from weblens.functions import paths
from weblens.operators import series
from weblens.plans.prepare import WebLog
from weblens.plans.queries_core import _log
from weblens.plans.store import fresh_path
from weblens.sources import access_log

def _two_files(w):
    """The log as two files with an overlap: the second one starts 10 days in and loses some lines after day 20."""
    first = w.log.where("ts < 1705536000").withColumn("src", F.lit("site.ru-access.log"))
    second = w.log.where("ts >= 1704931200 AND NOT (ts >= 1705363200 AND req_id % 97 = 0)").withColumn("src", F.lit("site.ru-access.log.1"))
    return first.unionByName(second)


def _lines(w):
    """Access and error lines of two files with their line numbers."""
    access = access_log.access_lines(w.log).select(F.lit("site.ru-access.log").alias("src"), F.col("req_id").alias("line_no"), "line")
    return access.unionByName(w.error_lines.select(F.lit("site.ru-error.log").alias("src"), "line_no", "line"))


def _files(w):
    """The log written as plain and gzip files and read again: requests by kind of file, and how many line numbers are missing or given twice."""
    path = fresh_path(w.spark, "files")
    access_log.access_lines(w.log.where("method = 'GET'")).select("line").write.text(f"{path}/plain")
    access_log.access_lines(w.log.where("method <> 'GET'")).select("line").write.option("compression", "gzip").text(f"{path}/packed")
    lines = access_log.parse_access(access_log.read_lines(w.spark, path))
    files = lines.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum("line_no").alias("numbers"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    off = F.abs(F.col("numbers") - F.expr("n * (n - 1) div 2"))
    return files.groupBy(F.col("src").endswith(".gz").alias("packed")).agg(
        F.sum("n").alias("lines"), F.sum("bytes").alias("bytes"), F.min("a").alias("first_ts"), F.max("z").alias("last_ts"), F.sum(off).alias("misnumbered"))


def _templates(w):
    ok = w.rq.where("method = 'GET' AND NOT is_static AND ua_browser AND status = 200")
    popular = ok.groupBy("base").agg(F.count_distinct("ip").alias("n")).where("n >= 2")
    return paths.path_templates(w.spark, w.rq, popular, min_children=5)


def _burst(w):
    return series.burst(w.log, ["ip", "ua"], 3600).where("burst >= 4")


def _outages(w):
    return series.outages(w.rq, w.error_log)


QUERIES = {
    "s01_read_lines": _log(_files),
    "s02_parse_access": _log(lambda w: access_log.parse_access(access_log.access_lines(w.log)).drop("tail", "user", "proto", "tz_offset")),
    "s03_parse_error": _log(lambda w: access_log.parse_error(w.error_lines).select("line_no", "ts", "level", "msg", "client", "request", "host")),
    "s04_sniff": _log(lambda w: access_log.sniff(_lines(w), 1000)),
    "s05_file_inventory": _log(lambda w: access_log.file_inventory(
        _lines(w).withColumn("src", F.concat(F.lit("part-"), (F.col("line_no") % 3).cast("string"))))),
    "s06_hour_gaps": _log(lambda w: series.hour_gaps(w.log, "vhost")),
    "s07_drop_overlaps": _log(lambda w: access_log.drop_overlaps(_two_files(w)).groupBy("src").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("bytes"))),
    "s07_overlap_report": _log(lambda w: access_log.overlap_report(_two_files(w))),
    "s08_site_hosts": _log(lambda w: access_log.site_hosts(_two_files(w))),
    "s08_site_by_referrer": _log(lambda w: access_log.site_hosts_from_referrers(w.log, 5)),
    "p06_path_templates": _log(_templates),
    "w07_episodes": _log(lambda w: series.episodes(w.log.select("vhost", F.floor(F.col("ts") / 60).alias("minute")), keys=["vhost"])),
    "w08_minute_norm": _log(lambda w: series.minute_norm(w.log)),
    "w09_outages": _log(_outages),
    "w10_bursts": _log(lambda w: series.bursts(w.rq, w.outages, factor=3, extra=5, excess_min=20)),
    "w12_waves": _log(lambda w: series.waves(w.rq.where("status >= 400"), "ip", "status")),
    "w13_status_changes": _log(lambda w: series.status_changes(
        w.rq_tpl.where("(is_page OR method = 'POST') AND `group` = 'people'"), "tpl")),
    "w14_rhythm": _log(lambda w: series.rhythm(w.log, min_hits=10, min_gaps=5, max_cv=2.0)),
    "w20_day_span": _log(lambda w: series.day_span(w.rq)),
    "w21_burst": _log(_burst),
}
