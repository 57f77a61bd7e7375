"""Prepared tables, big lists, indicator export and run snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_LIST = 10_000
INDICATOR_DAYS = {"block": 90, "rate-limit": 30, "watch": 30}
NAMESPACE = "weblens"


def write_prepared(requests: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Requests by day. Rows of one day are spread by client, so a busy day is not one file and a hot client not one task per day."""
    lean = requests.drop("user", "proto", "tail")
    lean.repartition("day", F.pmod(F.xxhash64("ip", F.floor(F.col("ts") / 600)), F.lit(64))).write.mode(mode).partitionBy("day").parquet(path)


def write_big_csv(rows: DataFrame, path: str, limit: int = ROWS_PER_LIST) -> bool:
    """Full list as ';' CSV, and whether it is longer than a page (the count stops at the limit)."""
    rows.write.mode("overwrite").option("sep", ";").option("header", "true").csv(path)
    return rows.limit(limit + 1).count() > limit


def read_ip_ranges(spark: SparkSession, path: str, country: bool = False) -> DataFrame:
    schema = "range_start long, range_end long, cc string" if country else "range_start long, range_end long, asn int, org string"
    return spark.read.schema(schema).csv(path)


def read_rules(spark: SparkSession, path: str, list_field: str) -> DataFrame:
    """One rule dictionary (a JSON document with a list of entries) as a table."""
    doc = spark.read.option("multiLine", "true").json(path)
    return doc.select(F.inline(list_field))


def indicators(verdicts: DataFrame, case_list: DataFrame, first_last: DataFrame, run_ts: int) -> DataFrame:
    """Indicator, case and link objects as JSON with ids that stay the same between runs."""
    uid = lambda kind, *parts: F.concat(F.lit(kind + "--"), F.sha1(F.concat_ws("|", F.lit(NAMESPACE), F.lit(kind), *parts)))
    days = F.when(F.col("verdict") == "block", INDICATOR_DAYS["block"]).otherwise(INDICATOR_DAYS["rate-limit"])
    rows = verdicts.where("verdict <> 'keep'").join(first_last, "ip")
    ip_obj = rows.select(uid("indicator", "ip").alias("id"), F.lit("indicator").alias("type"), F.to_json(F.struct(
        uid("indicator", "ip").alias("id"), F.concat(F.lit("[ipv4-addr:value = '"), "ip", F.lit("']")).alias("pattern"), "verdict",
        F.col("first_ts").alias("valid_from"), (F.lit(run_ts) + days * 86400).alias("valid_until"))).alias("object"))
    case_obj = case_list.select(uid("case", "case_key").alias("id"), F.lit("case").alias("type"), F.to_json(F.struct(
        uid("case", "case_key").alias("id"), "case_key", "charges", "severity")).alias("object"))
    link = rows.select(uid("link", "ip", "case_key").alias("id"), F.lit("relationship").alias("type"), F.to_json(F.struct(
        uid("link", "ip", "case_key").alias("id"), uid("indicator", "ip").alias("source"), uid("case", "case_key").alias("target"))).alias("object"))
    return ip_obj.unionByName(case_obj).unionByName(link)


def write_indicators(objects: DataFrame, path: str) -> None:
    objects.select(F.col("object").alias("value")).write.mode("overwrite").text(path)


def snapshot(run_id: str, marts: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """Rows of all marts as JSON with their fingerprint, ready to be stored per run."""
    parts = None
    for name, mart in marts.items():
        body = F.to_json(F.struct(*columns[name]), {"ignoreNullFields": "false"})
        rows = mart.select(F.lit(run_id).alias("run_id"), F.lit(name).alias("mart"), body.alias("row"), F.sha2(body, 256).alias("fingerprint"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def write_snapshot(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("run_id").parquet(path)
