"""Networks of clients: range lookup, CIDR lists, network types and robot authenticity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.functions import columns as C

BITS = 32


def _blocks(ranges: DataFrame) -> DataFrame:
    """Rows with ``range_start`` and ``range_end`` cut into CIDR blocks: ``_shift`` (bits left free) and ``_block`` (the bits before them).

    A CIDR stays one row.  Of the aligned blocks of one size inside a range only the first and the last can belong to
    the shortest cover, and they do if the block of twice the size sticks out; so a range makes at most 62 rows.
    Ranges that end before they start make none.
    """
    s, e = F.col("range_start"), F.col("range_end") + 1

    def of_size(k):
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))
        first, last = F.ceil(s / size), F.floor(e / size) - 1

        def part(i):
            outside = ((i - F.pmod(i, F.lit(2))) * size < s) | ((i - F.pmod(i, F.lit(2)) + 2) * size > e) | (k == BITS)
            return F.when((first <= last) & outside, F.struct(k.cast("int").alias("_shift"), i.cast("long").alias("_block")))

        return F.array(part(first), part(last))

    cover = F.array_distinct(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BITS)), of_size))))
    return ranges.withColumn("_c", F.explode(cover)).select(*ranges.columns, "_c._shift", "_c._block")


def _probes(addresses: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every address (``num``) once for each block size that occurs, at most 33 times, with its block of that size."""
    sizes = blocks.agg(F.sort_array(F.collect_set("_shift")).alias("_sizes")).scalar()
    probes = addresses.where("num IS NOT NULL").withColumn("_sizes", sizes).withColumn("_shift", F.explode("_sizes")).drop("_sizes")
    return probes.withColumn("_block", F.call_function("shiftright", F.col("num"), F.col("_shift")))


def range_lookup(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """Distinct addresses (``ip``, ``num``, ...) to the range that holds them, of several the one with the smallest block; unmatched rows keep NULLs.

    A flat trie: blocks and addresses meet by equality of (block size, block), so there are no copies of wide ranges and no
    key with more addresses than its block can hold.
    """
    blocks = _blocks(ranges)
    taken = F.struct("_shift", *ranges.columns)
    best = _probes(addresses.select("num").distinct(), blocks).join(blocks, ["_shift", "_block"]).groupBy("num").agg(F.min(taken).alias("_hit"))
    return addresses.join(best, "num", "left").select(*addresses.columns, *[F.col(f"_hit.{c}").alias(c) for c in ranges.columns])


def ip_dim(clients: DataFrame, asn_ranges: DataFrame, country_ranges: DataFrame) -> DataFrame:
    """One row per IP: network number, owner, country, bounds of the network and its type."""
    ips = clients.select("ip").distinct().withColumn("num", C.ip_to_long(F.col("ip")))
    nets = range_lookup(ips, asn_ranges.select("range_start", "range_end", "asn", "org"))
    nets = nets.select("ip", "num", "asn", "org", F.col("range_start").alias("net_first"), F.col("range_end").alias("net_last"))
    both = range_lookup(nets, country_ranges.select("range_start", "range_end", "cc"))
    asn, org, cc = F.coalesce("asn", F.lit(0)), F.coalesce("org", F.lit("")), F.coalesce("cc", F.lit(""))
    return both.select(
        "ip", asn.alias("asn"), org.alias("org"), cc.alias("cc"),
        F.coalesce("net_first", F.lit(-1)).alias("net_first"), F.coalesce("net_last", F.lit(-1)).alias("net_last"),
        C.network_type(asn, org, cc).alias("nettype"),
    )


def cidr_ranges(cidrs: DataFrame) -> DataFrame:
    """IPv4 ``cidr`` strings to numeric bounds and prefix length."""
    prefix = F.split("cidr", "/")[1].cast("int")
    size = F.pow(F.lit(2), 32 - prefix).cast("long")
    start = C.ip_to_long(F.split("cidr", "/")[0])
    start = F.floor(start / size) * size
    return cidrs.where(F.col("cidr").rlike(r"^[\d.]+/\d+$")).withColumn("prefix", prefix).withColumn(
        "range_start", start).withColumn("range_end", start + size - 1)


def net_operator(ips: DataFrame, cidrs: DataFrame, asns: DataFrame) -> DataFrame:
    """Operator of each IP: the longest matching CIDR (``cidr, operator``), else its ASN (``asn, operator``)."""
    ranges = cidr_ranges(cidrs).select("range_start", "range_end", F.col("operator").alias("by_cidr"))
    best = range_lookup(ips.select("ip", "asn").withColumn("num", C.ip_to_long(F.col("ip"))), ranges)
    named = best.join(asns.select("asn", F.col("operator").alias("by_asn")), "asn", "left")
    return named.select("ip", F.coalesce("by_cidr", "by_asn", F.lit("")).alias("operator"))


def verify_robots(visits: DataFrame, official: DataFrame) -> DataFrame:
    """Authenticity of declared robots: published CIDR lists (``fam, cidr``) override the ASN table."""
    listed = official.select("fam").distinct().withColumn("_listed", F.lit(True))
    blocks = _blocks(cidr_ranges(official).select("fam", "range_start", "range_end")).select("fam", "_shift", "_block")
    pairs = visits.where(F.col("fam") != "").select("fam", "ip").distinct().withColumn("num", C.ip_to_long(F.col("ip")))
    ok = _probes(pairs.join(listed, "fam", "left_semi"), blocks).join(blocks, ["fam", "_shift", "_block"], "left_semi").distinct()
    ok = ok.select("fam", "ip").withColumn("_ok", F.lit(True))
    checked = visits.join(listed, "fam", "left").join(ok, ["fam", "ip"], "left")
    verdict = F.when(F.col("_listed"), F.when(F.col("_ok"), "yes").otherwise("no")).otherwise(F.col("fam_verified"))
    fake = (verdict == "no") & (F.col("fam") != "") & F.col("group").isin("robots", "people")
    return (
        checked.withColumn("fam_verified", verdict)
        .withColumn("subgroup", F.when(fake, "fake robots").otherwise(F.col("subgroup")))
        .withColumn("group", F.when(fake, "bots").otherwise(F.col("group")))
        .drop("_listed", "_ok")
    )
