"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint has 64 bits; bit i is 1 if it is set in over half the XXH64 hashes of the document's word shingles.  Two fingerprints link if at most `errors` bits
differ.  The bits are cut into errors + r blocks, r of which must then be equal: for each choice of r blocks the fingerprints are turned so that these lead, and dealt by
their value.  r is 2 where 1 would leave too many fingerprints of no kinship together.  Inside, the distinct fingerprints form a binary trie (ranges of a sorted
array); pairs of trie nodes go down together, add up differing bits, and are dropped when these exceed the budget.  Pairs that meet enter a forest at once; only its
edges leave a task.

With a similarity, texts link at that Jaccard similarity of their shingle sets and above, computed exactly.  Candidates come from the join of tries, of the same fingerprints and at
the same `errors`, and where their long fingerprints do not lie far apart.  Pairs that this leaves apart and that may still be similar come from a join of prefixes: in one order of all
shingles, two sets of at least that similarity share one among the first `n - ceil(similarity n) + 1` of each.  No link is lost by it.  The order puts rare shingles first: a sketch of bounded
size counts all shingles of all texts, so what many texts share is in the prefix of those only that have little else.  Candidates whose long fingerprints lie far apart are dropped;
what candidates connect is compared shingle by shingle.

Groups of any size are cut into chunks, each of which is compared with its own rows and with the group's first row; copies and near copies meet there.  Only rows that did not reach the first
row's side are then compared with all chunks.  So a group of n near copies costs n rows, not n^2.

In the join of fingerprints, a value that over CHUNK fingerprints have (near copies share most bits) is dealt into chunks by the hash of its rows, and each pair of chunks, one with itself included, is
a group of its own: it starts at the pair of both chunks' nodes.  So no group holds more than two chunks, and every pair is still met.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.llm import text as T
from weblens.llm.graph import components
from weblens.llm.shared import dealt, discard, met, partitions, saved, sifted

SEED = 42
#: Pairs of trie nodes that are expanded at once, and pairs of leaves below which a pair of nodes is compared leaf by leaf.
FRONT, LEAVES = 1 << 16, 16
#: Fingerprints that are compared in one piece, and the bits that a chunk's number may take in a key.
CHUNK, CHUNK_BITS = 1 << 9, 18
#: Fingerprints that chance may leave together before two blocks must be equal instead of one.
CROWD = 1 << 9
#: For a similarity: 64-bit words of a long fingerprint, and its differing bits above which two texts cannot be similar (at 0.8, 78 of 512 are expected with a standard
#: deviation of 8, and 256 with 11 of unrelated texts).
WORDS, APART = 8, 160
#: Rows of one shingle of which all pairs are listed, and bytes of text that a chunk of a group of candidates holds.
LISTED, CHUNK_BYTES = 8, 1 << 23
#: Counters of the sketch of shingles, and those that one row of it holds.
COUNTERS, PER_ROW = 1 << 20, 1 << 14


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, some at a time."""
    parts = text.lower().split()
    if not parts:
        return
    count = max(1, len(parts) - width + 1)
    joined = b" ".join(parts)
    past = np.cumsum([len(w) + 1 for w in parts])
    starts, ends = np.append(0, past[: count - 1]).tolist(), (past[min(width, len(parts)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for low in range(0, count, 1 << 14):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[low : low + (1 << 14)], ends[low : low + (1 << 14)], strict=True)], np.uint64)


def _folded(pieces: list[np.ndarray], words: int) -> np.ndarray:
    votes, count = np.zeros((words, 64), np.int64), max(1, sum(map(len, pieces)))
    for hashes in pieces:
        for k in range(words):
            own = T.mix(hashes + np.uint64(k * T.BYTE_BASE & (1 << 64) - 1)) if k else hashes
            votes[k] += np.unpackbits(own.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > count, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(text: bytes, width: int, words: int = 1) -> np.ndarray:
    """The 64 bits of XXH64, and with more words 64 more each from a bijection of it."""
    return _folded(list(shingle_hashes(text, width)), words)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Hashes of the distinct shingles in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def frequencies(docs: DataFrame, width: int, text_col: str = "text") -> np.ndarray:
    """A sketch of how often every shingle occurs: the logarithm (of 2, whole) of the count of its counter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COUNTERS, np.int64)
        for whole in batches:
            for batch in T.slices(whole, "text", 1 << 20):
                for _, at in _windows(batch.column("text"), width):
                    sums += np.bincount(at, minlength=COUNTERS)
        rows = sums.reshape(-1, PER_ROW)
        yield pa.record_batch([pa.array(np.arange(len(rows))), pa.array([T.pack(x) for x in rows], pa.binary())], names=["row", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, parts in T.grouped(batches, "row"):
            total = sum(T.unpack(x.as_py(), np.int64)[0] for part in parts for x in part.column("counts"))
            yield pa.record_batch([pa.array([row], pa.int64()), pa.array([T.pack(total)], pa.binary())], names=["row", "counts"])

    parts = dealt(docs.select(F.col(text_col).alias("text")).mapInArrow(T.releasing(count), "row long, counts binary"), "row")
    out = np.zeros(COUNTERS, np.int64)
    for r in parts.mapInArrow(add, "row long, counts binary").collect():  # COUNTERS numbers
        out[r.row * PER_ROW : (r.row + 1) * PER_ROW] = T.unpack(bytes(r.counts), np.int64)[0]
    return np.log2(out + 1).astype(np.uint8)


def _windows(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bounds of the texts' shingles in the numbering of all, and the counter of each; once for a column. A text of fewer words than `width` has one shingle."""
    data, at = T.buffer(column)
    data = np.where((data > 64) & (data < 91), data + np.uint8(32), data)
    hashes, _, _, n = T.words(data, at)
    ends = np.cumsum(n)
    counts = np.where(n > 0, np.maximum(1, n - width + 1), 0)
    rolled = T.rolling(hashes, width)
    first = np.repeat(ends - n, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    short = np.repeat(n < width, counts)
    bins = np.zeros(len(first), np.uint64)
    bins[~short] = rolled[first[~short]]
    bins[short] = hashes[first[short]]  # its first word stands for it: the counter is only an order
    yield np.append(0, np.cumsum(counts)), (bins & np.uint64(COUNTERS - 1)).astype(np.int64)


def fingerprints(docs: DataFrame, width: int = 4, words: int = 1, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, often: np.ndarray | None = None) -> DataFrame:
    """id, bits (array of `words` longs, 64 bits each) of every row. Null text counts as empty: bits 0.

    With `similarity` also: same (binary, equal for texts of equal words), prefix (hashes of the first distinct shingles, by `often` (frequencies) and hash, enough for that similarity). Its bits are of
    distinct shingles but for the first word, which is the fingerprint.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(often)  # COUNTERS bytes

    def one(text: bytes, bins: np.ndarray) -> tuple[np.ndarray, bytes, np.ndarray]:
        pieces = list(shingle_hashes(text, width))
        distinct, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *pieces]), return_index=True)
        bits = _folded([distinct[k : k + (1 << 14)] for k in range(0, len(distinct), 1 << 14)], words)
        bits[0] = _folded(pieces, 1)[0]
        n = len(distinct)
        by_rarity = distinct[np.argsort(ranks.value[bins[place]], kind="stable")]
        return bits, xxhash.xxh3_128_digest(b" ".join(text.lower().split())), by_rarity[: n - math.ceil(similarity * n - 1e-9) + 1]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text", *([] if similarity is None else [1 << 20])):
                data, at = T.buffer(batch.column("text"))
                raw = data.tobytes()
                if similarity is None:
                    found = [(fingerprint(raw[a:b], width, words),) for a, b in pairwise(at)]
                else:
                    ((ends, bins),) = _windows(batch.column("text"), width)
                    found = [one(raw[a:b], bins[x:y]) for (a, b), (x, y) in zip(pairwise(at), pairwise(ends), strict=True)]
                bits = np.array([f[0] for f in found], np.uint64).reshape(-1)
                columns = [batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * words, pa.int32()), pa.array(bits.view(np.int64)))]
                if similarity is not None:
                    ends = np.cumsum([0, *(len(f[2]) for f in found)])
                    least = np.concatenate([np.zeros(0, np.uint64), *(f[2] for f in found)]).view(np.int64)
                    columns += [pa.array([f[1] for f in found], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(least))]
                yield pa.record_batch(columns, names=["id", "bits", "same", "prefix"][: len(columns)])

    id_type = dict(docs.dtypes)[id_col]
    more = ", same binary, prefix array<long>" if similarity is not None else ""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(T.releasing(go), f"id {id_type}, bits array<long>{more}")


class Forest:
    """Smallest row that links lead to, kept flat."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                break
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _leaf_pairs(a: np.ndarray, a_past: np.ndarray, b: np.ndarray, b_past: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of leaves of pairs of nodes, some at a time."""
    n = (a_past - a) * (b_past - b)
    for k in np.flatnonzero(n > LEAVES):
        for x in range(a[k], a_past[k]):
            yield np.full(b_past[k] - b[k], x), np.arange(b[k], b_past[k])
    few = n <= LEAVES
    a, b, wide, n = a[few], b[few], (b_past - b)[few], n[few]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(wide, n)
    yield np.repeat(a, n) + at // wide, np.repeat(b, n) + at % wide


def _nodes(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Pairs of nodes to start from: a group with itself, or its side 0 with its side 1 if it has both."""
    cuts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (side[1:] != side[:-1]))) if len(group) else np.zeros(0, np.int64)
    past = np.append(cuts[1:], len(group))
    other = np.append(group[cuts][1:] == group[cuts][:-1], False) if len(cuts) else np.zeros(0, bool)
    alone = (side[cuts] == 0) & ~other & (past - cuts > 1)
    left = np.flatnonzero(other)
    a, b = np.append(cuts[alone], cuts[left]), np.append(cuts[alone], cuts[left + 1])
    a_past, b_past = np.append(past[alone], past[left]), np.append(past[alone], past[left + 1])
    return np.stack([a, a_past, b, b_past, np.zeros_like(a)])


def trie_join(
    codes: np.ndarray, group: np.ndarray, lead: int, errors: int, depth_past: int = 64, checks: np.ndarray | None = None, total: int = 0, side: np.ndarray | None = None
) -> Forest:
    """Links all pairs of one group whose codes differ in at most `errors` bits, and their checks in at most `total`.

    codes: sorted by group, side and code, their first depth_past bits count, and the group fixes the first `lead` of these.
    side: of a group with rows on both sides, 0 and 1, only pairs across are met; a group of side 0 is met with itself.
    """
    forest = Forest(len(codes))
    ones: dict[int, np.ndarray] = {}
    stack = [(lead, _nodes(group, np.zeros(len(codes), np.int8) if side is None else side))]
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > FRONT:
            stack += [(depth, x) for x in np.array_split(pairs, -(-pairs.shape[1] // FRONT), axis=1)]
            continue
        small = ((pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= LEAVES) | (depth == depth_past)
        for x, y in _leaf_pairs(*pairs[:4, small]):
            near = (x < y) & (np.bitwise_count(codes[x] ^ codes[y]) <= errors)
            x, y = x[near], y[near]
            if checks is not None and len(x):
                near = np.bitwise_count(checks[x] ^ checks[y]).sum(1) <= total
                x, y = x[near], y[near]
            forest.link(x, y)
        if small.all():
            continue
        a, a_past, b, b_past, errs = pairs[:, ~small]
        if depth not in ones:
            bit = (codes >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.append(0, np.cumsum(bit.astype(np.int64)))
        count = ones[depth]
        a_mid, b_mid = a_past - (count[a_past] - count[a]), b_past - (count[b_past] - count[b])
        apart = a != b
        children = [(a, a_mid, b, b_mid, errs), (a_mid, a_past, b_mid, b_past, errs), (a, a_mid, b_mid, b_past, errs + 1)]
        children.append(tuple(x[apart] for x in (a_mid, a_past, b, b_mid, errs + 1)))
        for child in children:
            child = np.stack(child)
            live = (child[0] < child[1]) & (child[2] < child[3]) & (child[4] <= errors)
            if live.any():
                stack.append((depth + 1, child[:, live]))
    return forest


def _in_chunks(rows: DataFrame, lead: int) -> DataFrame:
    """key, node, code, side, checks: rows of a block (turn, block) under one key, or under the keys of all pairs of chunks that a row's chunk is part of."""
    counts = rows.groupBy("turn", "block").count().where(F.col("count") > CHUNK)
    chunks = F.least(F.ceil(F.col("count") / CHUNK), F.lit((1 << CHUNK_BITS) - 1)).cast("int")
    hot = saved(counts.select("turn", "block", chunks.alias("chunks")))
    dealt = rows.join(hot, ["turn", "block"], "left")
    dealt = dealt.withColumn("chunk", F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), "chunks")).cast("int"))
    others = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = dealt.withColumn("other", F.explode(others))
    block = F.shiftleft(F.col("turn").cast("long"), lead).bitwiseOR(F.col("block"))
    low, high = F.least("chunk", "other").cast("long"), F.greatest("chunk", "other").cast("long")
    key = F.shiftleft(block, 2 * CHUNK_BITS).bitwiseOR(F.shiftleft(low, CHUNK_BITS)).bitwiseOR(high)
    return dealt.select(key.alias("key"), "node", "code", (F.col("chunk") > F.col("other")).cast("byte").alias("side"), "checks")


def links(prints: DataFrame, views: list[Column], bits: int = 64, errors: int = 4, total: int | None = None) -> DataFrame:
    """a, b: links that connect what is near in any view. prints: node, bits; views: longs of which the low `bits` bits are a code; total: most bits in which all of `bits` differ."""
    n = prints.count()
    for equal in (1, 2):
        edges = [bits * i // (errors + equal) for i in range(errors + equal + 1)]
        parts = list(pairwise(edges))
        leads = list(combinations(parts, equal))
        lead = min(sum(b - a for a, b in chosen) for chosen in leads)
        if n <= CROWD << lead:
            break

    def turn(code: Column, chosen: tuple[tuple[int, int], ...]) -> Column:
        """The code with the chosen parts first, in the high bits of a long."""
        out, at = F.lit(0).cast("long"), 0
        for a, b in (*chosen, *(x for x in parts if x not in chosen)):
            part = F.shiftrightunsigned(F.shiftleft(code, 64 - bits + a), 64 - (b - a))
            out, at = out.bitwiseOR(F.shiftleft(part, 64 - at - (b - a))), at + b - a
        return out

    turned = F.array(*[F.struct(F.lit(k * len(leads) + i).alias("turn"), turn(v, e).alias("code")) for k, v in enumerate(views) for i, e in enumerate(leads)])
    checks = F.col("bits") if total is not None else F.lit(None).cast("array<long>")
    rows = prints.select("node", checks.alias("checks"), F.explode(turned).alias("x")).select("node", "checks", "x.turn", "x.code", F.shiftrightunsigned("x.code", 64 - lead).alias("block"))
    rows = _in_chunks(rows, lead).repartition(partitions(prints.sparkSession), "key").sortWithinPartitions("key")

    def join(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, node, code, side, check = (np.concatenate(x) for x in held)
        order = np.lexsort((code, side, key))
        node = node[order]
        root = trie_join(code[order], key[order], lead, errors, bits, check[order] if total is not None else None, total or 0, side[order]).root
        met = np.flatnonzero(root != np.arange(len(root)))
        return pa.record_batch([pa.array(node[met]), pa.array(node[root[met]])], names=["a", "b"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups, about 100,000 rows at once."""
        held: list[list] = [[], [], [], [], []]
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, side = (batch.column(c).to_numpy() for c in ("key", "node", "side"))
            check = batch.column("checks").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1) if total is not None else node
            new = [key, node, batch.column("code").to_numpy().view(np.uint64), side, check]
            if sum(map(len, held[0])) > 100_000:
                other = key != held[0][-1][-1]
                more = int(np.argmax(other)) if other.any() else len(key)
                for h, x in zip(held, new, strict=True):
                    h.append(x[:more])
                if more == len(key):
                    continue
                yield join(held)
                held, new = [[], [], [], [], []], [x[more:] for x in new]
            for h, x in zip(held, new, strict=True):
                h.append(x)
        if held[0]:
            yield join(held)

    return rows.mapInArrow(T.releasing(go), "a long, b long")


def reached(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Smallest row that links lead to. near(x, left): which rows of left link with x; every row is asked once, for those not reached yet."""
    root, left = np.arange(n), np.arange(n)
    while len(left):
        first, left = left[0], left[1:]
        front = [first]
        while front and len(left):
            hit = near(front.pop(), left)
            new = left[hit]
            root[new] = first
            front += new.tolist()
            left = left[~hit]
    return root


def same_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Smallest row that pairs of sets of at least that Jaccard similarity lead to; empty sets are alike."""
    sizes = np.array([len(x) for x in sets], np.int64)
    names, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    ends = np.cumsum(sizes)
    mark = np.zeros(len(names) + 1, bool)

    def near(x: int, left: np.ndarray) -> np.ndarray:
        hit = np.minimum(sizes[x], sizes[left]) >= (similarity - 1e-9) * np.maximum(sizes[x], sizes[left])
        some = left[hit]
        own = flat[ends[x] - sizes[x] : ends[x]]
        mark[own] = True
        both = np.array([np.count_nonzero(mark[flat[ends[y] - sizes[y] : ends[y]]]) for y in some], np.int64)
        mark[own] = False
        union = sizes[x] + sizes[some] - both
        hit[hit] = (union == 0) | (both / np.maximum(union, 1) >= similarity)
        return hit

    return reached(len(sets), near)


def _groups(batches: Iterator[pa.RecordBatch], one: Callable[[pa.Table], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one `group`: each node and the smallest one it reaches through any of many groups, so that the shingles of a group of copies give the same few links."""

    def flat() -> pa.RecordBatch:
        names, code = np.unique(np.concatenate([*a, *b]), return_inverse=True)
        forest, n = Forest(len(names)), len(code) // 2
        forest.link(code[:n], code[n:])
        met = np.flatnonzero(forest.root != np.arange(len(names)))
        return pa.record_batch([pa.array(names[met]), pa.array(names[forest.root[met]])], names=["a", "b"])

    a, b, rows = [], [], 0
    for _, parts in T.grouped(batches, "group"):
        run = pa.Table.from_batches(parts).combine_chunks()
        run = run.take(np.argsort(run.column("node").to_numpy(), kind="stable"))
        node = run.column("node").to_numpy()
        root = one(run) if len(node) > 1 else np.zeros(1, np.int64)
        met = np.flatnonzero(root != np.arange(len(root)))
        a.append(node[met])
        b.append(node[root[met]])
        rows += len(met)
        if rows > 100_000 or len(a) > 10_000:
            yield flat()
            a, b, rows = [], [], 0
    if a:
        yield flat()


def connecting(rows: DataFrame, key: str, weight: Column, one: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """a, b: links that connect whatever `one` links within a key. rows: a saved table of key, node and what `one` reads of a table of rows; weight: a row's share of a chunk."""
    names = [c for c in rows.columns if c != key]
    schema = "a long, b long"

    def meet(groups: DataFrame) -> DataFrame:
        return dealt(groups, "group").mapInArrow(T.releasing(lambda batches: _groups(batches, one)), schema)

    sizes = saved(rows.groupBy(key).agg(F.ceil(F.sum(weight)).cast("int").alias("chunks"), F.min("node").alias("first")).where("chunks > 1"))
    hot = sizes.select(F.col(key).alias("key"), F.col("chunks").alias("salts"))
    sized = met(rows, sizes, key, "node", hot)
    chunk = F.pmod(F.xxhash64("node", F.lit(SEED)), "chunks").cast("int")
    # a group's first row goes to all of its chunks, every other row to its own
    at = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).when(F.col("node") == F.col("first"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk))
    inside = saved(meet(sized.withColumn("chunk", F.explode(at)).withColumn("group", F.xxhash64(key, "chunk")).select("group", *names)))
    if not sizes.limit(1).count():
        discard(sizes)
        return inside
    reached_ = saved(components(inside))
    reached_ = reached_.withColumnRenamed("component", "reached")
    side = sizes.select(key, "chunks", F.col("first").alias("node")).join(reached_, "node", "left").select(key, "chunks", F.coalesce("reached", "node").alias("main"))
    side = saved(side)
    large = met(rows, side, key, "node", hot).where("main is not null").join(reached_, "node", "left").withColumn("apart", F.coalesce("reached", "node") != F.col("main"))
    # rows that are not on the first one's side meet all chunks
    apart = saved(large.where("apart").groupBy(key).agg(F.ceil(F.sum(weight)).cast("int").alias("others")))
    if not apart.limit(1).count():
        discard(sizes, reached_, side, apart)
        return inside
    rest = met(large, apart, key, "node", hot).where("others is not null")
    all_rows = rest.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    own = F.pmod(F.xxhash64("node", F.lit(SEED + 1)), "others").cast("int")
    some = rest.where("apart").withColumn("other", own).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    both = all_rows.select(*rows.columns, "chunk", "other").union(some.select(*rows.columns, "chunk", "other"))
    across = meet(both.withColumn("group", F.xxhash64(key, "chunk", "other")).select("group", *names))
    return inside.union(saved(across))


def candidates(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """a, b: links that connect, together with what connects already, all pairs which share a shingle of their prefixes and differ in at most APART bits.

    nodes: node, bits, prefix. known: node, component of the nodes that other links (those of fingerprints) connect.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All pairs of a shingle of few rows; the rows, with a null b, of one of more."""
        for _, parts in _runs(batches):
            key, node = parts
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(cuts, len(key)))
            few = (sizes > 1) & (sizes <= LISTED)
            x, y = zip(*(p for p in _leaf_pairs(cuts[few], (cuts + sizes)[few], cuts[few], (cuts + sizes)[few])), strict=True)
            x, y = np.concatenate(x), np.concatenate(y)
            pairs = np.unique(np.stack([node[x], node[y]])[:, node[x] < node[y]], axis=1)
            many = np.repeat(sizes > LISTED, sizes)
            rows = int(many.sum())
            a, b = np.append(pairs[0], node[many]), pa.concat_arrays([pa.array(pairs[1]), pa.nulls(rows, pa.int64())])
            yield pa.record_batch([pa.concat_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(key[many])]), pa.array(a), b], names=["key", "a", "b"])

    def meet(run: pa.Table) -> np.ndarray:
        bits = run.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(run.num_rows, -1)
        return reached(len(bits), lambda x, left: np.bitwise_count(bits[left] ^ bits[x]).sum(1) <= APART)

    rows = dealt(nodes.select(F.explode("prefix").alias("key"), "node"), "key")
    found = saved(rows.mapInArrow(T.releasing(shared), "key long, a long, b long"))
    bits = nodes.select("node", "bits")
    rooted = saved(bits.join(known, "node", "left").select("node", "bits", F.coalesce("component", "node").alias("root")))
    pairs = found.where("b is not null").select("a", "b").distinct()
    both = pairs.join(rooted.toDF("a", "x", "p"), "a").join(rooted.toDF("b", "y", "q"), "b").where("p <> q")
    differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    many = found.where("b is null").select("key", F.col("a").alias("node")).join(bits, "node")
    close = saved(both.where(differ <= APART).select("a", "b").union(connecting(saved(many.select("key", "node", "bits")), "key", F.lit(1 / CHUNK), meet)))
    discard(found, rooted)
    return close


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Keys and nodes of rows sorted by key, cut between keys, about 100,000 at once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column("key").to_numpy(), batch.column("node").to_numpy()))
        if sum(len(k) for k, _ in held) > 100_000:
            key, node = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            held = [(key[cut:], node[cut:])]
            if cut:
                yield cut, (key[:cut], node[:cut])
    if held:
        key, node = (np.concatenate(x) for x in zip(*held, strict=True))
        yield len(key), (key, node)


def similar(docs: DataFrame, near: DataFrame, width: int, similarity: float) -> DataFrame:
    """a, b: links that connect all pairs of at least that similarity among what candidates (near: node, component) connect. docs: node, text."""
    some, _ = sifted(docs, "node", near.select("node"))  # texts that no candidate needs stay where they are
    rows = some.join(near, "node").dropDuplicates(["component", "node", "text"])

    def meet(run: pa.Table) -> np.ndarray:
        return same_sets([shingle_set((t or "").encode(), width) for t in run.column("text").to_pylist()], similarity)

    return connecting(saved(rows.select("component", "node", "text")), "component", F.lit(1 / CHUNK) + F.coalesce(F.octet_length("text"), F.lit(0)) / CHUNK_BYTES, meet)


def near_duplicates(docs: DataFrame, width: int = 4, errors: int = 4, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id (integer), fingerprint (long, 64 bits), component_id (smallest id reachable through links, itself included).

    Texts are lower-cased (A-Z), words are `[^\\x20\\x09-\\x0D]+`; fewer than `width` words are one shingle, none give fingerprint 0, which links like any other.
    Fingerprints link at `errors` or fewer differing bits. With `similarity` these links, and those of shared rare shingles, are candidates, and texts link if the Jaccard similarity
    of their sets of shingles is at least that; two texts without words are alike. Every distinct text is compared, not one of a group.
    Rows that repeat an id stay rows, and all texts of one id connect. A null id has a fingerprint, links with nothing and has a null component. Other columns are
    ignored.
    """
    by, words, more = ("same", WORDS, ["same", "prefix"]) if similarity is not None else ("fingerprint", 1, [])
    prints = fingerprints(docs, width, words, id_col, text_col, similarity, None if similarity is None else frequencies(docs, width, text_col))
    prints = saved(prints.select(F.col("id").cast("long"), F.col("bits")[0].alias("fingerprint"), "bits", *more))
    named = prints.where("id is not null")
    nodes = saved(named.groupBy(by).agg(*(F.min_by(c, "id").alias(c) for c in ("bits", *more[1:])), F.min("id").alias("node")))
    equal = named.select("id", by).join(nodes.select(by, "node"), by).select("id", "node")
    repeated = equal.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b")
    if similarity is None:
        groups = components(saved(links(nodes, [F.col("fingerprint")], 64, errors).union(repeated)))
    else:
        met_ = links(nodes, [F.col("bits")[0]], 64, errors, APART)
        known = saved(components(saved(met_)))
        near = saved(components(known.toDF("a", "b").union(candidates(nodes, known))))
        texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
        groups = components(saved(similar(texts, near, width, similarity).union(repeated)))
    names = nodes.join(groups, "node", "left").select(by, F.coalesce("component", "node").alias("component_id"))
    out = prints.join(names, by, "left").select("id", "fingerprint", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out.withColumnRenamed("id", id_col)
