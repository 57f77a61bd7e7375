"""Findings: detectors over marts, calibration, alarms, comparison of runs, edits, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: severities from worst to mildest, calibration limits, alarm rules
SEVERITIES = ["alarm", "urgent", "important", "for information", "remark"]
SMALL_SHARE, SMALL_MIN, HOT_CHANNELS = 0.001, 20, ["maps", "search", "ads"]
PEOPLE_METRIC = ["5xx", "404_entry"]
MERGED_TYPES = ["5xx", "404_entry", "missing_static", "trap", "campaign_zero", "unknown_robot", "placement_type_low"]
ALARM_TYPES = ["webshell", "upload_outsiders"]
PERSONAL_DATA_ALARM, COMPARE_THRESHOLD = 5, 0.3
COLUMNS = ["key", "block", "type", "object", "severity", "facts", "metric"]


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def detect(mart: DataFrame, block: str, type_: str, obj, condition, severity, metric, facts=None) -> DataFrame:
    """Rows of a mart that satisfy a condition as findings with the stable key block:type:object."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    rows = mart.where(condition)
    o = as_col(obj).cast("string")
    facts = facts if facts is not None else F.lit("")
    return rows.select(F.concat_ws(":", F.lit(block), F.lit(type_), o).alias("key"), F.lit(block).alias("block"), F.lit(type_).alias("type"), o.alias("object"),
                       as_col(severity).alias("severity"), as_col(facts).alias("facts"), as_col(metric).cast("double").alias("metric"))


def collect(*found: DataFrame) -> DataFrame:
    """All findings, one per key (the worst severity, then the largest metric)."""
    rows = reduce(lambda a, b: a.unionByName(b), found)
    best = F.min_by(F.struct(*COLUMNS), F.struct(rank(F.col("severity")).alias("r"), (-F.coalesce("metric", F.lit(0.0))).alias("m"), "facts"))
    return rows.groupBy("key").agg(best.alias("f")).select("f.*")


def calibrate(findings: DataFrame, human_visits: int | Column) -> DataFrame:
    """Hot channels up, small impact down, same-type findings of one severity merged into one."""
    small = F.greatest(F.lit(float(SMALL_MIN)), SMALL_SHARE * F.lit(human_visits) if not isinstance(human_visits, Column) else SMALL_SHARE * human_visits)
    hot = (F.col("type") == "404_entry") & F.col("object").isin(HOT_CHANNELS)
    little = F.col("type").isin(PEOPLE_METRIC) & ~hot & (F.col("metric") < small) & ~F.col("severity").isin("for information", "remark")
    severity = F.when(hot & (F.col("severity") == "for information"), "important").when(little, "for information").otherwise(F.col("severity"))
    rows = findings.withColumn("severity", severity)
    mergeable = F.col("type").isin(MERGED_TYPES) & (F.col("severity") != "urgent")
    groups = rows.where(mergeable).groupBy("block", "type", "severity").agg(
        F.count(F.lit(1)).alias("merged"), F.sum("metric").alias("metric"), F.min("key").alias("one_key"), F.min("object").alias("one_object"), F.min("facts").alias("facts"))
    label = F.when(F.col("severity") == "for information", "minor").otherwise("group")
    merged = groups.select(
        F.when(F.col("merged") > 1, F.concat_ws(":", "block", "type", label)).otherwise(F.col("one_key")).alias("key"), "block", "type",
        F.when(F.col("merged") > 1, label).otherwise(F.col("one_object")).alias("object"), "severity", "facts", "metric", "merged")
    return rows.where(~mergeable).select(*COLUMNS, F.lit(1).cast("long").alias("merged")).unionByName(merged)


def alarms(findings: DataFrame, open_leaks: DataFrame) -> DataFrame:
    """Raise to alarm what does harm now; the severity before the alarm is kept, so a second call starts from it."""
    before = F.coalesce("before_alarm", "severity") if "before_alarm" in findings.columns else F.col("severity")
    rows = findings.withColumn("severity", before).join(open_leaks.select(F.col("base").alias("object"), F.lit(True).alias("_open")).distinct(), "object", "left")
    raised = F.col("type").isin(ALARM_TYPES) | ((F.col("type") == "pd_in_get") & (F.col("metric") >= PERSONAL_DATA_ALARM)) | ((F.col("type") == "exposed") & F.coalesce("_open", F.lit(False)))
    return rows.withColumn("before_alarm", F.col("severity")).withColumn("severity", F.when(raised, "alarm").otherwise(F.col("severity"))).drop("_open")


def compare_runs(current: DataFrame, previous: DataFrame, threshold: float = COMPARE_THRESHOLD) -> DataFrame:
    """New, worse, partly fixed, kept or fixed, by key."""
    old = previous.select("key", F.col("metric").alias("was"), F.lit(True).alias("_old"))
    rows = current.select("key", F.col("metric").alias("now"), F.lit(True).alias("_new")).join(old, "key", "full")
    change = (F.col("now") - F.col("was")) / F.abs("was")
    status = (F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "fixed").when(change >= threshold, "worse").when(change <= -threshold, "partly fixed").otherwise("kept"))
    return rows.select("key", "was", "now", status.alias("status"))


def apply_edits(findings: DataFrame, removed: DataFrame, updated: DataFrame, added: DataFrame) -> DataFrame:
    """Analyst edits: remove keys, overwrite severity and facts, add findings."""
    rows = findings.join(removed.select("key"), "key", "left_anti")
    new = updated.select("key", F.col("severity").alias("_s"), F.col("facts").alias("_f"))
    rows = rows.join(new, "key", "left").withColumn("severity", F.coalesce("_s", "severity")).withColumn("facts", F.coalesce("_f", "facts"))
    return rows.select(*COLUMNS).unionByName(added.select(*COLUMNS))


def coverage(findings: DataFrame, registry: DataFrame, applicable: DataFrame) -> DataFrame:
    """Every check: found, clean, not applicable or no detector. ``registry`` has type, needs; ``applicable`` has needs."""
    found = findings.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    rows = registry.join(found, "type", "left").join(applicable.select("needs", F.lit(True).alias("_can")), "needs", "left")
    state = (F.when(F.col("n") > 0, "found").when(F.col("type").startswith("-"), "no detector").when((F.col("needs") != "") & F.col("_can").isNull(), "not applicable").otherwise("clean"))
    return rows.select("type", state.alias("state"), F.coalesce("n", F.lit(0)).alias("found"))


def proofs(findings: DataFrame, rq: DataFrame) -> DataFrame:
    """One request as a proof for findings whose object is an address: the latest one with an error."""
    objects = findings.where(F.col("object").startswith("/")).select("key", F.col("object").alias("base"))
    rows = rq.where("status >= 400").groupBy("base").agg(F.max_by(F.struct("ts", "ip", "status"), F.struct("ts", "req_id")).alias("p"))
    return objects.join(rows, "base").select("key", "base", "p.ts", "p.ip", "p.status")


def thresholds(sizes: DataFrame, rules: DataFrame) -> DataFrame:
    """Limits scaled to the log: max(minimum, ceil(share x base)). ``sizes``: base, n; ``rules``: name, base, share, minimum."""
    return rules.join(sizes, "base").select("name", F.greatest(F.col("minimum"), F.ceil(F.round(F.col("share") * F.col("n"), 9)).cast("long")).alias("limit"))
