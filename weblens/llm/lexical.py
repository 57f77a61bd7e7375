"""Ranked lexical search over classes of documents whose bags are alike.

Seen from a set of items, a document is the counts of the items' terms in it and its length measure m.  Documents are restricted to that vocabulary in one pass; those of equal hash and, compared in
full, equal counts and m form a class.  A class is scored once against all items.  Its members tie, so of each class only the k smallest ids can ever be returned; they are picked before and
after the shuffle, and a third of all documents being copies costs k rows a task.  Every task keeps the k best documents of each item; these few rows meet in the end.

Items are worked off in blocks of bounded size (POSTINGS terms, ITEMS items), a pass over the documents each; only a block's terms are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.llm import text as T
from weblens.llm.shared import saved

#: Pairs of item and term, and items, that a block has (on average; an item is never cut).
POSTINGS, ITEMS = 1 << 15, 1 << 8
#: Classes times terms that are scored at once.
CELLS = 1 << 22
#: A to Z become a to z, what parts terms becomes a space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[[x for x in range(128) if not chr(x).isalnum()]] = 32
FOLD[65:91] += 32


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of a string column, hash, first byte and end of each term in them, and the number of terms of each row."""
    data, at = T.buffer(column)
    data = FOLD[data]
    return data, *T.words(data, at)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, term (binary): the distinct terms of every item that has an id."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                data, _, a, b, n = terms(part.column("text"))
                raw = data.tobytes()
                ids = part.column("item").take(pa.array(np.repeat(np.arange(part.num_rows), n)))
                yield pa.record_batch([ids, pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())], names=["item", "term"])

    named = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item is not null")
    return named.mapInArrow(go, "item long, term binary").distinct()


class Block:
    """The items of one pass: their ids, the vocabulary in order of hash, and item and term of each posting."""

    def __init__(self, table: pa.Table):
        found, code = np.unique(np.array(table.column("term").to_pylist(), object), return_inverse=True)
        raw = np.frombuffer(b" ".join(found), np.uint8)
        hashes, *_ = T.words(raw, np.array([0, len(raw)], np.int64))
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], found[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms with one 64-bit hash")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.items, self.item = np.unique(table.column("item").to_numpy(), return_inverse=True)
        self.term = place[code]

    def find(self, data: np.ndarray, hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms are in the vocabulary, and where; a term counts if its bytes are the same too."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        at = at[hit]
        # of each term and length one occurrence is compared; only texts made to collide would differ beyond that
        key = at * (1 << 32) + (b - a)[hit]
        _, one, back = np.unique(key, return_index=True, return_inverse=True)
        raw = data.tobytes()
        same = np.array([raw[x:y] == self.words[w] for x, y, w in zip(a[hit][one].tolist(), b[hit][one].tolist(), at[one].tolist(), strict=True)], bool)
        good = same[back] if len(hit) else np.zeros(0, bool)
        return hit[good], at[good]


def bags(docs: DataFrame, block, id_col: str, text_col: str) -> DataFrame:
    """id, n (terms of the document), bag (pairs of 32-bit numbers, term and count, by term) of every document with a term of the vocabulary.

    Besides one row a task with a null bag: docs (that have a term), n (all their terms), df (documents by term).
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = 0, 0
        frequency = np.zeros(len(block.value.hashes), np.int64)
        size = len(frequency)
        for batch in batches:
            for part in T.slices(batch, "text"):
                data, hashes, a, b, n = terms(part.column("text"))
                found += int((n > 0).sum())
                total += len(hashes)
                hit, at = block.value.find(data, hashes, a, b)
                owner = np.repeat(np.arange(len(n)), n)[hit]
                pair, count = np.unique(owner * size + at, return_counts=True)
                owner, at = pair // size, pair % size
                frequency += np.bincount(at, minlength=size)
                cells = np.stack([at, count], axis=1).astype("<u4")
                rows = np.flatnonzero(np.bincount(owner, minlength=len(n)))
                ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(n))[rows]) * 8).astype(np.int32)
                bag = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(cells.tobytes())])
                none = pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.list_(pa.int64()))
                yield pa.record_batch([part.column("id").take(pa.array(rows)), pa.array(n[rows], pa.int64()), bag, *none], names=["id", "n", "bag", "docs", "df"])
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.array([total], pa.int64()), pa.nulls(1, pa.binary()), pa.array([found], pa.int64()), pa.array([frequency], pa.list_(pa.int64()))],
                              names=["id", "n", "bag", "docs", "df"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(go, "id long, n long, bag binary, docs long, df array<long>")


def statistics(found: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the documents of each term, summed up over the tasks' rows."""
    sums = found.where("docs is not null")
    row = sums.agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).first()
    frequency = np.zeros(size, np.int64)
    for term, count in sums.select(F.posexplode("df").alias("term", "df")).groupBy("term").agg(F.sum("df")).collect():  # the vocabulary of a block
        frequency[term] = count
    return row.docs or 0, row.n or 0, frequency


def classes(found: DataFrame, docs: int, total: int, k: int) -> DataFrame:
    """m, bag, members (the k smallest ids, ascending): documents whose bag and m are alike. Documents without an id are left out."""
    named = found.where("bag is not null and id is not null")
    m = F.expr(f"10L + (90L * n * {docs}L) div {max(total, 1)}L")
    named = named.select("id", m.alias("m"), "bag").withColumn("hash", F.xxhash64("m", "bag"))
    key = ["hash", "m", "bag"]
    first = named.withColumn("row", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("row") <= k)
    return first.groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("members")).drop("hash")


def best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each item the k entries of highest score, ties by ascending id."""
    order = np.lexsort((doc, -score, item))
    item, score, doc = item[order], score[order], doc[order]
    first = np.searchsorted(item, item)
    keep = np.arange(len(item)) - first < k
    return item[keep], score[keep], doc[keep]


def score(groups: DataFrame, block, weight: np.ndarray, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best documents of each item among a task's classes, of score above 0."""
    most = int(np.bincount(block.value.item, weight[block.value.term]).max(initial=0)) * 1_000_000

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        size, width = len(weight), len(own.items)
        kind = np.float64 if most < 1 << 53 else np.int64  # sums of whole numbers below 2**53 are exact in doubles
        table = np.zeros((size, width), kind)
        table[own.term, own.item] = 1
        item, points, doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at_once = max(1, CELLS // max(size, width, 1))
        for whole in batches:
            for low in range(0, whole.num_rows, at_once):
                part = whole.slice(low, at_once)
                data, at = T.buffer(part.column("bag"))
                cells = np.ascontiguousarray(data).view("<u4").reshape(-1, 2).astype(np.int64)
                owner = np.repeat(np.arange(part.num_rows), np.diff(at) // 8)
                m = part.column("m").to_numpy()[owner]
                value = weight[cells[:, 0]] * ((1_000_000_000 * cells[:, 1]) // (1000 * cells[:, 1] + 8 * m))
                dense = np.zeros((part.num_rows, size), kind)
                dense[owner, cells[:, 0]] = value
                sums = (dense @ table).astype(np.int64)
                bar = np.ones(width, np.int64)  # an item that has k documents needs no lower ones
                full = np.flatnonzero(np.bincount(item, minlength=width) >= k)
                bar[full] = np.maximum(1, points[np.searchsorted(item, full, "right") - 1])
                row, column = np.nonzero(sums >= bar)
                members = part.column("members")
                sizes = np.diff(members.offsets.to_numpy())
                ids = members.flatten().to_numpy()
                starts = np.cumsum(sizes) - sizes
                n = sizes[row]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[row], n)
                item, points, doc = best(np.append(item, np.repeat(column, n)), np.append(points, np.repeat(sums[row, column], n)), np.append(doc, ids[place]), k)
        yield pa.record_batch([pa.array(own.items[item]), pa.array(doc), pa.array(points)], names=["item_id", "doc_id", "score"])

    return groups.mapInArrow(go, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", postings: int = POSTINGS, at_once: int = ITEMS) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): the k documents of highest score above 0 of every item, ties by ascending id; fewer if there are fewer.

    Terms are runs of what is neither an ASCII mark, space nor control character, A to Z lower-cased; a null or empty text has none. Rows that repeat a document's id are documents of their own and may
    each be returned; a document without an id counts in all statistics and is never returned. Rows that repeat an item's id make one item with the terms of all of them; an item without an
    id is left out. Other columns are ignored. Empty tables give no rows.
    """
    spark = docs.sparkSession
    pairs = saved(item_terms(items, item_col, item_text_col))
    size = pairs.agg(F.count("*").alias("pairs"), F.countDistinct("item").alias("items")).first()
    blocks = max(math.ceil(size.pairs / postings), math.ceil(size["items"] / at_once))
    out = None
    for number in range(blocks):
        table = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).toArrow()  # a block: bounded above
        if not table.num_rows:
            continue
        block = spark.sparkContext.broadcast(Block(table))
        found = saved(bags(docs, block, id_col, text_col))
        n, total, frequency = statistics(found, len(block.value.hashes))
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in frequency.tolist()], np.int64)
        top = score(classes(found, n, total, k), block, weight, k)
        out = top if out is None else out.unionByName(top)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
