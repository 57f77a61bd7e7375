"""Reading and parsing access and error logs."""

from __future__ import annotations

import gzip
import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weblens.functions import columns as C

# fixed values: line formats (optional byte order mark, optional host after the user, optional tail)
_HEAD = (r'^\uFEFF?(\S+) \S+ (\S+)(?: ([A-Za-z0-9.:-]+))? \[(\d\d/\w\w\w/\d{4}:\d\d:\d\d:\d\d) ([+-]\d{4})\] "(.*?)" (\d{3}) (\d+|-)')
COMBINED = _HEAD + r' "(.*?)" "(.*?)"(.*)$'
COMMON = _HEAD + r"\s*$"
ACCESS = _HEAD + r'(?: "(.*?)" "(.*?)"(.*)|\s*)$'  # either of the two
NGINX_ERROR = r"^\uFEFF?(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d) \[(\w+)\] \d+#\d+: (?:\*\d+ )?(.*)$"
APACHE_ERROR = r"^\uFEFF?\[\w{3} (\w{3} \d\d \d\d:\d\d:\d\d)(?:\.\d+)? (\d{4})\] \[([\w:]+)\] (.*)$"
SITE_IN_NAME = r"(?i)((?:[a-z0-9-]+\.)+[a-z]{2,})(?=[._-](?:access|error|ssl))"
LIMITS = {"method": 12, "base": 500, "query": 1000, "proto": 12, "ref": 500, "ua": 400, "tail": 200, "junk": 300}  # optional
ERROR_LIMITS = {"msg": 600, "client": 600, "server": 600, "request": 400, "upstream": 200, "host": 600, "referrer": 300}  # optional


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines of plain and gzip files below ``paths``: file name, number from 0 and text. Hidden files are skipped by Spark itself.

    A split of a file numbers its own lines while it is read; where it begins is the sum of the counts of the splits before it, one row a split.
    So no file is read by one task for its numbers, and nothing is sorted but the splits of a file. Both scans cut the files alike, as they read
    the same list of files under the same settings.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*").text(paths)
    rows = text.select(F.col("_metadata.file_name").alias("src"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_split"),
                       F.col("value").alias("line"), F.monotonically_increasing_id().alias("_at")).where(~F.col("src").endswith(".zip"))
    splits = rows.groupBy("_path", "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_split")) - F.col("_n")
    splits = splits.select("_path", "_split", (before - F.col("_first")).alias("_shift"))
    return rows.join(splits, ["_path", "_split"]).select("src", (F.col("_at") + F.col("_shift")).alias("line_no"), "line")


def read_zip_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines of the members of zip archives; one archive is one task, its members are streamed in batches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(paths)

    def members(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                archive = zipfile.ZipFile(io.BytesIO(content))
                for name in archive.namelist():
                    leaf = name.rsplit("/", 1)[-1]
                    if not leaf or leaf.startswith("."):
                        continue
                    raw = archive.open(name)
                    raw = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw
                    lines, source = [], f"{path.rsplit('/', 1)[-1]}:{name}"
                    for no, line in enumerate(io.TextIOWrapper(raw, encoding="utf-8", errors="replace")):
                        lines.append((source, no, line.rstrip("\n")))
                        if len(lines) == 10000:
                            yield pd.DataFrame(lines, columns=["src", "line_no", "line"])
                            lines = []
                    yield pd.DataFrame(lines, columns=["src", "line_no", "line"])

    return files.select("path", "content").mapInPandas(members, "src string, line_no long, line string")


def _log_time(text: Column, fmt: str) -> Column:
    """Log-local wall clock as epoch seconds; the offset of the line is not applied."""
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit(fmt)))


def parse_access(lines: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Access lines (``line`` plus any other columns) to request columns; lines of other formats are dropped.

    Fields are whole unless ``limits`` (such as LIMITS) names the most characters of some.
    """
    limits = limits or {}
    parts = F.split(F.regexp_replace("line", ACCESS, "\u0001".join(f"${i}" for i in range(1, 12))), "\u0001")
    rows = lines.withColumn("_f", F.explode(F.when(F.size(parts) == 11, F.array(parts))))
    field = lambda i: F.col("_f")[i - 1]
    request = F.split(field(6), " ")
    words = F.size(request)
    url = F.when(words.isin(2, 3), request[1]).otherwise(_first(field(6), limits.get("junk")))
    rows = rows.withColumn("_url", F.split(url, r"\?", 2)).withColumn("ts", _log_time(field(4), "dd/MMM/yyyy:HH:mm:ss"))
    cut = lambda c, name: _first(c, limits.get(name)).alias(name)
    keep = [c for c in lines.columns if c != "line"]
    return rows.where(F.col("ts").isNotNull()).select(
        *keep, "ts", field(5).alias("tz_offset"), field(1).alias("ip"), field(2).alias("user"),
        F.lower(field(3)).alias("vhost"), cut(F.when(words.isin(2, 3), request[0]).otherwise("-"), "method"),
        cut(F.col("_url")[0], "base"), cut(F.coalesce(F.try_element_at("_url", F.lit(2)), F.lit("")), "query"),
        cut(F.when(words == 3, request[2]).otherwise(""), "proto"), field(7).cast("int").alias("status"),
        F.when(field(8) == "-", 0).otherwise(field(8).try_cast("long")).alias("bytes"),
        cut(field(9), "ref"), cut(field(10), "ua"), cut(F.trim(field(11)), "tail"))


def _first(text: Column, characters: int | None) -> Column:
    return text if characters is None else F.substring(text, 1, characters)


def parse_error(lines: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """nginx and Apache error lines to messages with client, request, upstream, host and referrer, whole unless ``limits`` (such as ERROR_LIMITS) says otherwise."""
    limits = limits or {}
    line = F.col("line")
    nginx = line.rlike(NGINX_ERROR)
    text = F.when(nginx, F.regexp_extract(line, NGINX_ERROR, 3)).otherwise(F.regexp_extract(line, APACHE_ERROR, 4))
    apache_time = F.concat_ws(" ", F.regexp_extract(line, APACHE_ERROR, 2), F.regexp_extract(line, APACHE_ERROR, 1))
    ts = F.when(nginx, _log_time(F.regexp_extract(line, NGINX_ERROR, 1), "yyyy/MM/dd HH:mm:ss")).otherwise(
        _log_time(apache_time, "yyyy MMM dd HH:mm:ss"))
    level = F.when(nginx, F.regexp_extract(line, NGINX_ERROR, 2)).otherwise(F.regexp_extract(line, APACHE_ERROR, 3))
    field = lambda name: _first(F.regexp_extract(text, f', {name}: "?([^",]*)"?', 1), limits.get(name)).alias(name)
    keep = [c for c in lines.columns if c != "line"]
    return lines.where(nginx | line.rlike(APACHE_ERROR)).select(
        *keep, ts.alias("ts"), level.alias("level"), _first(F.split(text, ", client:")[0], limits.get("msg")).alias("msg"),
        field("client"), field("server"), field("request"), field("upstream"), field("host"), field("referrer"))


def line_kind(line: Column) -> Column:
    return (F.when(line.rlike(COMBINED), "access:combined").when(line.rlike(COMMON), "access:common")
            .when(line.rlike(NGINX_ERROR), "error:nginx").when(line.rlike(APACHE_ERROR), "error:apache").otherwise("unknown"))


def sniff(lines: DataFrame, first: int = 50) -> DataFrame:
    """Kind of every file by majority of its first lines (``src, line_no, line``).

    The first lines come from the line number, so the whole file is never sorted.
    """
    head = lines.where((F.col("line_no") < first) & (F.col("line") != ""))
    counts = head.groupBy("src", line_kind(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_no"))
    return counts.groupBy("src").agg(F.max_by("kind", F.struct("n", -F.col("first_no"))).alias("kind"))


def file_inventory(lines: DataFrame) -> DataFrame:
    """Lines, unparsed lines, period and dominant time zone of every file."""
    parsed = parse_access(lines.select("src", "line"))
    zones = parsed.groupBy("src", "tz_offset").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    good = zones.groupBy("src").agg(
        F.sum("n").alias("parsed"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.max_by("tz_offset", F.struct("n", "tz_offset")).alias("tz_offset"))
    total = lines.groupBy("src").agg(F.count(F.lit(1)).alias("lines"))
    rows = total.join(good, "src", "left").fillna(0, ["parsed"])
    return rows.withColumn("unparsed", F.col("lines") - F.col("parsed")).drop("parsed")


def overlap_minutes(rq: DataFrame) -> DataFrame:
    """Minutes present in several files: duplicate (same count as the earliest file) or partial (another count)."""
    per = rq.groupBy("src", F.floor(F.col("ts") / 60).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    order = per.groupBy("src").agg(F.min("minute").alias("src_first"))
    per = per.join(order, "src")
    w = Window.partitionBy("minute").orderBy("src_first", "src")
    ranked = per.withColumn("reference_n", F.first("n").over(w)).withColumn("_rank", F.row_number().over(w))
    later = ranked.where(F.col("_rank") > 1)
    return later.select("src", "minute", "n", F.when(F.col("n") == F.col("reference_n"), "duplicate").otherwise("partial").alias("kind"))


def drop_overlaps(rq: DataFrame) -> DataFrame:
    """Requests without the minutes already seen in an earlier file."""
    duplicate = overlap_minutes(rq).where("kind = 'duplicate'").select("src", "minute")
    keyed = rq.withColumn("minute", F.floor(F.col("ts") / 60))
    return keyed.join(duplicate, ["src", "minute"], "left_anti").drop("minute")


def overlap_report(rq: DataFrame) -> DataFrame:
    m = overlap_minutes(rq)
    dup = F.col("kind") == "duplicate"
    return m.groupBy("src").agg(
        F.count_if(dup).alias("minutes_duplicate"), F.count_if(~dup).alias("minutes_partial"),
        F.sum(F.when(dup, F.col("n")).otherwise(0)).alias("lines_duplicate"))


def site_by_name(src: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(src, r"([^:/]*)$", 1), SITE_IN_NAME, 1))


def site_hosts(rq: DataFrame) -> DataFrame:
    """Site names: from file names, else the most frequent referrer host. One row per host, best first."""
    named = rq.select(site_by_name(F.col("src")).alias("host")).where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    host = C.ref_host(F.col("ref"))
    referred = rq.select(host.alias("host")).where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    best = referred.orderBy(F.desc("n"), "host").limit(1)
    both = named.withColumn("by", F.lit("file name")).unionByName(best.withColumn("by", F.lit("referrer")))
    return both.withColumn("_named", F.count_if(F.col("by") == "file name").over(Window.partitionBy())).where(
        (F.col("by") == "file name") | (F.col("_named") == 0)).drop("_named")


def site_hosts_from_referrers(rq: DataFrame, top: int = 1) -> DataFrame:
    host = C.ref_host(F.col("ref"))
    counts = rq.select(host.alias("host")).where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "host").limit(top)


def access_lines(rq: DataFrame) -> DataFrame:
    """Requests written as combined-format lines with the host after the user."""
    stamp = F.date_format(F.timestamp_seconds("ts"), "dd/MMM/yyyy:HH:mm:ss")
    url = F.concat("base", F.when(F.col("query") != "", F.concat(F.lit("?"), "query")).otherwise(""))
    return rq.select("req_id", F.concat(
        "ip", F.lit(" - - "), "vhost", F.lit(" ["), stamp, F.lit(' +0300] "'), "method", F.lit(" "), url, F.lit(' HTTP/1.1" '),
        F.col("status").cast("string"), F.lit(" "), F.col("bytes").cast("string"), F.lit(' "'), "ref", F.lit('" "'), "ua", F.lit('"')).alias("line"))
