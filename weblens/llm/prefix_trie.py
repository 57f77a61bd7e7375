"""A z-fast trie (Belazzougui, Boldi, Pagh, Vigna) of conversations, built and searched by joins.

A conversation is a string whose symbols are its turns; its prefixes are known by chained 128-bit hashes.  The trie is compacted: a node stands for the prefix down to its own depth, and for all
those between it and its parent.  The hash table has a node under its handle: its prefix at the 2-fattest depth between its parent's depth and its own (the one with most trailing zeros).  A fat
binary search asks for one handle a round and needs about log2(depth) rounds to find the deepest node that a string passes whole; one more lookup, of the edge that goes on from there,
tells where the string leaves the trie.

Strings are inserted in batches: of all strings that leave at one point by one turn, one goes in; edges that strings leave or end on are split there, and their nodes get new handles.  The others
went on along the new edge, so they leave deeper and search on from there.  At last the edges are expanded: every prefix is a row again, and what hangs below is summed up along the paths.

Strings are made distinct first, lookups salt the keys that many strings ask for, and no step holds the strings of a node together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.llm import text as T
from weblens.llm.shared import heavy, met, partitions, saved

ROOT = xxhash.xxh3_128_digest(b"")
#: Ids that are joined into one text in one step: blocks of 2**8, then of 2**16, then of 2**24 consecutive ids.
ID_BITS = (8, 16, 24)
NODE = "node binary, depth int, parent int, handle binary, first binary, path array<binary>, words array<long>"


def hashed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turns (hash and number of words of each, in order): a row for every conversation that has an id."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                _, _, _, n = T.words(*T.buffer(part.column("text")))
                roles, texts = part.column("role").to_pylist(), part.column("text").to_pylist()
                digests = [xxhash.xxh3_128_digest(len(r := role.encode()).to_bytes(8, "little") + r + text.encode()) for role, text in zip(roles, texts, strict=True)]
                yield pa.record_batch([part.column("conv"), part.column("turn"), pa.array(digests, pa.binary()), pa.array(n, pa.int64())], names=["conv", "turn", "hash", "words"])

    plain = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    turns = plain.where("conv is not null").mapInArrow(go, "conv long, turn long, hash binary, words long")
    return turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "hash", "words"))).alias("turns")).withColumn("turns", F.transform("turns", lambda t: F.struct(t.hash.alias("hash"), t.words.alias("words"))))


def rebuilt(convs: DataFrame, block: int, most: int) -> DataFrame:
    """conv, turns: of each conversation c the first h turns of conversation c - c % block and its own behind its first h, where h is crc32(c) % most."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    heads = convs.where(F.col("conv") % block == 0).select(F.col("conv").alias("lead"), F.slice("turns", 1, most - 1).alias("head"))
    both = convs.withColumn("h", h).withColumn("lead", F.col("conv") - F.col("conv") % block).join(heads, "lead", "left")
    empty = F.slice("turns", 1, 0)
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", empty), F.lit(1), F.col("h"))).otherwise(empty)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv", F.concat(head, own).alias("turns"))


def chained(convs: DataFrame) -> DataFrame:
    """conv, sid, path (hashes of the prefixes of 1, 2, ... turns), words (of each turn)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column("turns")
            hashes, sizes = turns.flatten().field("hash").to_pylist(), np.diff(turns.offsets.to_numpy())
            out, at = [], 0
            for n in sizes.tolist():
                now = ROOT
                for turn in hashes[at : at + n]:
                    now = xxhash.xxh3_128_digest(now + turn)
                    out.append(now)
                at += n
            ends = np.append(0, np.cumsum(sizes))
            offsets = pa.array(ends, pa.int32())
            last = [out[e - 1] if n else ROOT for e, n in zip(ends[1:].tolist(), sizes.tolist(), strict=True)]
            path, words = pa.ListArray.from_arrays(offsets, pa.array(out, pa.binary())), pa.ListArray.from_arrays(offsets, turns.flatten().field("words"))
            yield pa.record_batch([batch.column("conv"), pa.array(last, pa.binary()), path, words], names=["conv", "sid", "path", "words"])

    return convs.mapInArrow(go, "conv long, sid binary, path array<binary>, words array<long>")


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with most trailing zeros: high without the bits below the first one in which both differ."""
    gap = low.bitwiseXOR(high)
    bits = F.length(F.bin(gap)) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


def _node(depth: Column, parent: Column) -> list[Column]:
    """Columns of a node at a depth of `path`, below a parent at another: handle and first, the hash of the first turn of its edge."""
    return [depth.alias("depth"), parent.alias("parent"), F.get("path", depth - 1).alias("node"), F.get("path", fattest(parent, depth) - 1).alias("handle"), F.get("path", parent).alias("first")]


def exits(strings: DataFrame, nodes: DataFrame, hot: DataFrame) -> DataFrame:
    """strings (with sid, path, and depth of a node that the string passes whole) with edge (the node on whose edge the string goes on from the deepest such node, or null) and point (depth at which it leaves the trie)."""
    now = strings.withColumnRenamed("depth", "low").withColumn("high", F.size("path"))
    table = nodes.select("handle", F.col("depth").alias("n_depth"), F.get("path", F.col("depth") - 1).alias("n_last"))
    low, high = F.col("low"), F.col("high")
    while now.where(low < high).limit(1).count():
        at = fattest(low, high)
        asked = met(now.withColumn("handle", F.when(low < high, F.get("path", at - 1))), table, "handle", "sid", hot)
        whole = F.coalesce(F.get("path", F.col("n_depth") - 1) == F.col("n_last"), F.lit(False))
        # the handle is not there, or it is but not the whole node: no deeper node is passed whole
        next_high = F.when((low < high) & ~whole, at - 1).otherwise(high)
        asked = asked.withColumn("to", F.when(whole, F.col("n_depth")).otherwise(low)).withColumn("high", next_high)
        now = saved(asked.drop("handle", "n_depth", "n_last", "low").withColumnRenamed("to", "low"))
    edges = nodes.select("first", F.col("node").alias("edge"), F.col("path").alias("n_path"))
    asked = met(now.withColumn("first", F.get("path", low)), edges, "first", "sid", hot)
    # prefixes of different depths have different hashes, so what two paths have in common is a prefix of both
    point = F.when(F.col("edge").isNotNull(), F.size(F.array_intersect("path", "n_path"))).otherwise(low)
    return saved(asked.withColumn("point", point).drop("first", "n_path", "high", "low"))


def insert(strings: DataFrame, hot: DataFrame) -> DataFrame:
    """The compacted trie of distinct strings (sid, path, words): rows of NODE, path and words down to the node. The root has no row."""
    nodes = strings.sparkSession.createDataFrame([], NODE)
    names = nodes.columns
    todo = strings.where(F.size("path") > 0).withColumn("depth", F.lit(0))
    found = saved(todo.drop("depth").withColumn("edge", F.lit(None).cast("binary")).withColumn("point", F.lit(0)))  # all leave at the root
    while True:
        # where strings leave edges or end on them, these are split
        cuts = saved(found.where("edge is not null").select(F.col("edge").alias("node"), "point").distinct().groupBy("node").agg(F.sort_array(F.collect_list("point")).alias("points")))  # an edge's length at most
        split = nodes.join(cuts, "node").select("path", "words", F.concat(F.array("parent"), "points", F.array("depth")).alias("p"))
        split = split.select("path", "words", "p", F.posexplode("p").alias("k", "depth")).where("k > 0").withColumn("parent", F.get("p", F.col("k") - 1)).drop("p", "k")
        split = split.withColumns({c: F.slice(c, F.lit(1), F.col("depth")) for c in ("path", "words")})
        # of the strings that go on by one turn, one goes in
        on = found.where(F.col("point") < F.size("path")).withColumn("turn", F.get("path", F.col("point")))
        chosen = saved(on.groupBy("turn").agg(F.min("sid").alias("sid")))
        leaves = on.join(chosen, ["turn", "sid"], "left_semi").select("path", "words", F.size("path").alias("depth"), F.col("point").alias("parent"))
        new = split.unionByName(leaves).select("path", "words", *_node(F.col("depth"), F.col("parent"))).select(names)
        nodes = saved(nodes.join(cuts, "node", "left_anti").select(names).unionByName(new))
        todo = saved(on.join(chosen, ["turn", "sid"], "left_anti").select("sid", "path", "words", F.col("point").alias("depth")))
        if not todo.limit(1).count():
            return nodes
        found = exits(todo, nodes, hot)


def expanded(nodes: DataFrame, strings: DataFrame) -> DataFrame:
    """A row for every prefix: node, depth, up (node of the parent), conv, convs, children, leaves, saved (words). strings: sid, convs, least, path."""
    spark = nodes.sparkSession
    ends = strings.select(F.col("sid").alias("node"), F.col("convs").alias("ends"), "least")
    kids = nodes.where("parent > 0").select(F.get("path", F.col("parent") - 1).alias("node")).groupBy("node").agg(F.count("*").alias("kids"))
    compact = nodes.join(ends, "node", "left").join(kids, "node", "left").withColumn("leaf", F.col("kids").isNull().cast("long"))
    compact = saved(compact.select("node", "depth", "parent", "path", "words", F.coalesce("ends", F.lit(0)).alias("ends"), "least", F.coalesce("kids", F.lit(0)).alias("kids"), "leaf"))
    # every node counts for all prefixes on its path
    below = compact.select(F.explode("path").alias("node"), "ends", "least", "leaf").groupBy("node").agg(F.sum("ends").alias("convs"), F.min("least").alias("conv"), F.sum("leaf").alias("leaves"))
    edge = compact.withColumn("at", F.explode(F.sequence(F.col("parent") + 1, F.col("depth"))))
    edge = edge.select(F.get("path", F.col("at") - 1).alias("node"), F.col("at").alias("depth"), F.when(F.col("at") > 1, F.get("path", F.col("at") - 2)).otherwise(F.lit(ROOT)).alias("up"),
                       F.when(F.col("at") == F.col("depth"), F.col("kids")).otherwise(F.lit(1)).alias("children"), F.get("words", F.col("at") - 1).alias("words"), F.col("node").alias("owner"))
    plain = edge.join(below, "node").withColumn("own", (F.col("convs") - 1) * F.col("words"))
    # what the prefixes of an edge save: from each of them down to the edge's end, and in all for the prefixes above
    plain = saved(plain.withColumn("down", F.sum("own").over(Window.partitionBy("owner").orderBy(F.desc("depth")))))
    totals = plain.groupBy(F.col("owner").alias("node")).agg(F.sum("own").alias("total"))
    above = compact.where("parent > 0").join(totals, "node").select(F.explode(F.slice("path", F.lit(1), F.col("parent"))).alias("node"), "total").groupBy("node").agg(F.sum("total").alias("above"))
    rows = plain.join(above, "node", "left").select("node", "depth", "up", "conv", "convs", "children", "leaves", (F.col("down") + F.coalesce("above", F.lit(0))).alias("saved"))
    whole = strings.agg(F.sum("convs").alias("convs"), F.min("least").alias("conv")).first()
    under = plain.agg(F.sum("own").alias("saved")).first()
    tops = compact.agg(F.sum("leaf").alias("leaves"), F.count_if(F.col("parent") == 0).alias("children")).first()
    root = [(ROOT, 0, None, whole.conv, whole.convs, tops.children, tops.leaves or 1, under.saved or 0)] if whole.convs else []
    return rows.unionByName(spark.createDataFrame(root, "node binary, depth int, up binary, conv long, convs long, children long, leaves long, saved long"))


def digests(members: DataFrame) -> DataFrame:
    """node, digest: SHA-256 of the ids (conv) of each node, ascending and joined by commas.

    Blocks of consecutive ids are joined to texts in steps, each block of the next step having 256 of the last one's, so that the ids of a node with very many are dealt to many tasks; the digest of a
    node, which must be taken in order, reads its few blocks one after another.
    """
    now = members.select("node", "conv", F.col("conv").cast("string").alias("ids"))
    for bits in ID_BITS:
        block = F.call_function("shiftright", F.col("conv"), F.lit(bits))
        parts = F.sort_array(F.collect_list(F.struct("conv", "ids")))
        now = now.groupBy("node", block.alias("block")).agg(parts.alias("x")).select("node", F.get("x", F.lit(0))["conv"].alias("conv"), F.array_join(F.col("x.ids"), ",").alias("ids"))
    now = now.repartition(partitions(members.sparkSession), "node").sortWithinPartitions("node", "conv")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        last, state = None, None
        for batch in batches:
            nodes, out = [], []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node != last:
                    if last is not None:
                        nodes.append(last)
                        out.append(state.hexdigest())
                    last, state = node, hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array(out, pa.string())], names=["node", "digest"])
        if last is not None:
            yield pa.record_batch([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["node", "digest"])

    return now.select("node", "ids").mapInArrow(go, "node binary, digest string")


def prefix_trie(rows: DataFrame, block: int = 20, most: int = 4, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for every distinct sequence of first turns of the rebuilt conversations, the empty one included: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (words that sharing the prefixes below, this one included, saves), ends_sha256 (of the ids of the conversations that end here).

    Turns are ordered by turn (null first), then by hash of role and text; null roles and texts count as empty. Repeated rows are turns of their own. Rows without a conversation id are left out; other
    columns are ignored. No conversation, no row. A conversation is one row of hashes, however long.
    """
    convs = saved(chained(rebuilt(saved(hashed(rows, conv_col, turn_col, role_col, text_col)), block, most)))
    strings = saved(convs.groupBy("sid").agg(F.count("*").alias("convs"), F.min("conv").alias("least"), F.first("path").alias("path"), F.first("words").alias("words")))
    hot = heavy(strings.select(F.explode(F.concat(F.array(F.lit(ROOT)), "path"))), strings.count())
    nodes = insert(strings.select("sid", "path", "words"), hot)
    prefixes = saved(expanded(nodes, strings))
    names = prefixes.select(F.col("node").alias("up"), F.col("conv").alias("parent_conv_id"))
    ends = digests(convs.select(F.col("sid").alias("node"), "conv"))
    out = met(prefixes, names, "up", "node", hot).join(ends, "node", "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("convs").alias("n_convs"), F.col("children").cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
