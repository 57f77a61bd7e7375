"""Linking clients by shared evidence: connected components without listing pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import fixed_values as fv
from weblens.operators.requests import salted_lookup
from weblens.plans.store import stored
from weblens.rules.forms import SPAM_SIGNS, entry_path

WAVE = 7200  # fixed value: sends within two hours are one wave


def connect(spark, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, hub) links -> node, label: the smallest node of its component.

    Nodes that share a hub are connected through it, so a group of n members costs n
    links.  Labels travel node -> hub -> node, then every node takes the label of its
    label's node, so a chain halves each round; it ends when nothing changes.  Each
    round is written out.
    """
    links = stored(spark, links.select("node", "hub").distinct(), "links")
    labels = stored(spark, nodes.select("node").distinct().withColumn("label", F.col("node")), "labels")
    while True:
        at_hub = links.join(labels, "node").groupBy("hub").agg(F.min("label").alias("hub_label"))
        offered = salted_lookup(links, at_hub, "hub", F.xxhash64("node")).groupBy("node").agg(F.min("hub_label").alias("offer"))
        nearer = stored(spark, labels.join(offered, "node", "left").select(
            "node", F.least("label", F.coalesce("offer", "label")).alias("label"), (F.col("offer") < F.col("label")).alias("changed")), "labels")
        beyond = nearer.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        jumped = salted_lookup(nearer, beyond, "label", F.xxhash64("node"))
        moved = stored(spark, jumped.select("node", F.least("label", F.coalesce("beyond", "label")).alias("label"), "changed"), "labels")
        changed = moved.where("changed").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels


def spam_evidence(visits: DataFrame, human_direct_max: int = 5) -> DataFrame:
    """Evidence of spam IPs as (ip, kind, strength, value): IPs with the same kind and value are linked by it.

    Strong: the same broken entry that people rarely use, or an IP switched inside a visit.  Medium: a busier
    broken entry, the referrer is another spammer's entry, the same entry trick.  Weak: browser, network.
    """
    spam = visits.where(F.col("subgroup").startswith("form spam"))
    broken = visits.where("entry_status = 404 AND fam_verified <> 'yes'")
    direct = F.col("entry_ref").isin("-", "")
    people = broken.where((F.col("group") == fv.PEOPLE) & direct).groupBy("entry").agg(F.count_distinct("ip").alias("n"))
    spam_ips = spam.select("ip").distinct()
    entries = broken.join(spam_ips, "ip", "left_semi").select("ip", "entry").distinct().join(people, "entry", "left")
    rare = F.coalesce("n", F.lit(0)) <= human_direct_max
    shared = entries.select("ip", F.lit("shared broken entry").alias("kind"), F.when(rare, "strong").otherwise("medium").alias("strength"), F.col("entry").alias("value"))
    came = spam.where("entry_ref_internal").select("ip", entry_path().alias("value"))
    came = came.join(entries.select(F.col("entry").alias("value")).distinct(), "value", "left_semi")
    hosts = entries.select("ip", F.col("entry").alias("value"))
    referrer = came.select("ip", "value").union(hosts.select("ip", "value").join(came.select("value").distinct(), "value", "left_semi")).distinct()
    referrer = referrer.select("ip", F.lit("referrer is a broken entry").alias("kind"), F.lit("medium").alias("strength"), "value")
    section = F.regexp_extract("entry", r"^(/[^/]+/)", 1)
    trick = spam.where(F.col("subgroup") == SPAM_SIGNS[0]).select(
        "ip", F.lit("same entry trick").alias("kind"), F.lit("medium").alias("strength"),
        F.concat(F.when(section == "", "/").otherwise(section), F.when(F.col("entry").endswith("/"), "+").otherwise("-")).alias("value"))
    first = spam.groupBy("ip").agg(F.min_by(F.struct("ua", "asn"), F.struct("start", "vid")).alias("f"))
    browser = first.select("ip", F.lit("same browser").alias("kind"), F.lit("weak").alias("strength"), F.col("f.ua").alias("value"))
    network = first.where("f.asn > 0").select("ip", F.lit("same network").alias("kind"), F.lit("weak").alias("strength"), F.col("f.asn").cast("string").alias("value"))
    return shared.unionByName(referrer).unionByName(trick).unionByName(browser).unionByName(network).distinct()


def waves_within(members: DataFrame, sends: DataFrame, key: str) -> DataFrame:
    """(node, hub) links of members of one ``key`` group whose sends follow each other within a wave.

    Sends of a group are cut into runs (gap <= WAVE) over (group, time block) summaries, so a big group is not one partition.
    """
    rows = members.join(sends, "node").select("node", key, "t").withColumn("blk", F.floor(F.col("t") / WAVE))
    blocks = rows.groupBy(key, "blk").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    w = Window.partitionBy(key).orderBy("blk")
    runs = blocks.withColumn("new", F.when(F.col("a") - F.lag("b").over(w) <= WAVE, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return rows.join(runs.select(key, "blk", "run"), [key, "blk"]).select("node", F.concat_ws("|", F.lit("wave"), F.col(key), F.col("run").cast("string")).alias("hub")).distinct()


def link_operators(spark, evidence: DataFrame, visits: DataFrame) -> DataFrame:
    """ip -> operator label: strong evidence first, then groups that share a medium sign and one more, to a fix-point."""
    evidence = stored(spark, evidence.withColumnRenamed("ip", "node").withColumn("sign", F.concat_ws("|", "kind", "value")), "evidence")
    nodes = evidence.select("node").distinct()
    strong = evidence.where("strength = 'strong'").select("node", F.col("sign").alias("hub"))
    sends = stored(spark, visits.where(F.col("subgroup").startswith("form spam")).select(F.col("ip").alias("node"), F.col("start").alias("t")).distinct(), "sends")
    labels = connect(spark, nodes, strong)
    groups = None
    while True:  # a round that merges no groups is the last
        held = evidence.where("strength <> 'strong'").join(labels, "node").select("label", "kind", "strength", "sign").distinct()
        medium = held.where("strength = 'medium'").select("label", F.col("kind").alias("m_kind"), F.col("sign").alias("m_sign"))
        second = held.select("label", "kind", "sign")
        both = medium.join(second, "label").where("m_kind <> kind").select(F.col("label").alias("node"), F.concat_ws("&", "m_sign", "sign").alias("hub"))
        group_sends = sends.join(labels, "node").select(F.col("label").alias("node"), "t").distinct()
        wave = waves_within(medium.select(F.col("label").alias("node"), "m_sign").distinct(), group_sends, "m_sign")
        merged = connect(spark, labels.select(F.col("label").alias("node")), both.unionByName(wave))
        labels = stored(spark, labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("new")), "label").select("node", F.col("new").alias("label")), "labels")
        now = labels.select("label").distinct().count()
        if now == groups:
            break
        groups = now
    return labels.select(F.col("node").alias("ip"), F.col("label").alias("operator"))


def operator_summary(labels: DataFrame, visits: DataFrame) -> DataFrame:
    rows = visits.join(labels, "ip")
    return rows.groupBy("operator").agg(
        F.count_distinct("ip").alias("ips"), F.count_distinct("day").alias("days"), F.sum("n_goal").alias("sent"), F.sum("n_conv").alias("accepted"),
        F.count_distinct("asn").alias("networks"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
