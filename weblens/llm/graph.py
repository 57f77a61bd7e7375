"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al., 2014).

A step sends every neighbour of a node to the node's smallest neighbour.  The rounds grow with the logarithm of the graph's size; each is written to the shared
folder.  Minima are aggregated before they are shuffled, and in the joins that follow the links of a hub are dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.shared import discard, heavy, met, saved


def _star(links: DataFrame, larger_only: bool, hot: DataFrame) -> DataFrame:
    """One step over links (u, v) with u > v. hot: nodes of many links, whose links are dealt to several tasks."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    if larger_only:
        up = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
        moved = met(up, least, "u", "v", hot).select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
    else:
        moved = met(links, least, "u", "v", hot).select("v", "m").union(least.select("u", "m")).toDF("u", "v")
    return moved.where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node that links lead to) for every node that has a link.

    links: two columns of comparable ids, in any order and number; a link with a null or of a node to itself says nothing.
    """
    a, b = (F.col(c) for c in links.columns)
    now = saved(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(now)
    while state[0]:
        hot = heavy(now.select("u").union(now.select("v")), 2 * state[0])
        last, now = now, saved(_star(_star(now, True, hot), False, hot))
        discard(last, hot)
        before, state = state, _state(now)
        if state == before:
            break
    hubs = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(hubs)
