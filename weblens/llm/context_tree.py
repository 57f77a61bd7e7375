"""Language-model scores by context-tree weighting (Willems, Shtarkov and Tjalkens, 1995) over bytes.

A byte is eight binary choices, each in a node of a binary tree; the context of a choice is that node and the last 0 to `depth` bytes.  Every context has its
Krichevsky-Trofimov estimate from its counts in the training texts, and each depth's estimate is weighted against all deeper ones by how well it codes these texts.  The
trained weights stay fixed while texts are scored, so a text's log probability is a sum over its runs of depth + 1 bytes, and each distinct run is priced once:

1. a task cuts its documents into runs of some megabytes and writes, for each, the texts and the distinct byte strings and words with their training counts;
2. strings are dealt by the two bytes next to the predicted one, where all deeper contexts meet; counts of the 256 x 255 contexts above are summed and collected;
3. the prices (log10 probabilities) go back to the runs, which sum them up by document.

Nothing of the corpus's size is broadcast or collected; a frequent string is one entry a run.  The base model of words is counted on the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm import text as T
from weblens.llm.shared import dealt, partitions, saved

DEPTH, RUN_BYTES, SMOOTHING = 4, 6 << 20, 0.1
#: Bytes of text whose strings are held at once: they take some ten times eight bytes for each.
PART = 1 << 19
#: Never a byte of UTF-8: ends a text and is the context before one.
END = 0xFF
TEXTS, STRINGS, WORDS, PRICES, COUNTS = range(5)
EXCHANGE = "key long, kind int, run long, bucket int, payload binary, more binary, ids array<string>"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()))
    names = ["key", "kind", "run", "bucket", "payload", "more", "ids"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by Stirling's series eight places on."""
    low = np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov log probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def strings(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the texts and their ends, behind its `depth` bytes of context (nearest highest), and its text's number."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at) + 1)
    place = np.arange(len(data) + n) + owner * (depth - 1) + depth
    laid = np.full(len(data) + n * depth + depth, END, np.uint8)
    body = np.ones(len(owner), bool)
    body[at[1:] + np.arange(n)] = False
    laid[place[body]] = LOWER[data]
    keys = np.zeros(len(owner), np.uint64)
    for k in range(1, depth + 1):
        keys = (keys << np.uint64(8)) | laid[place - k]
    return (keys << np.uint64(8)) | laid[place], owner


def _distinct(values: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how many of the training ones are each."""
    u = np.sort(values)
    u = u[np.append(True, u[1:] != u[:-1])] if len(u) else u
    t = np.sort(values[training])
    return u, np.diff(np.append(np.searchsorted(t, u), len(t))) if len(u) else np.zeros(0, np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of several parts in order, and the sums of their counts."""
    u = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in parts)])
    order = np.argsort(u)
    u = u[order]
    new = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
    return u[new], np.add.reduceat(np.concatenate([p[1] for p in parts])[order], new) if len(u) else np.zeros(0, np.int64)


def _parts(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Texts in parts of PART bytes, or one text: their rows, bytes and bounds."""
    for low, high in T.spans(at, PART):
        yield slice(low, high), data[at[low] : at[high]], at[low : high + 1] - at[low]


def _strings(data: np.ndarray, at: np.ndarray, depth: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """By part: its texts, the strings of all its bytes, and the number of the text, in the part, of each."""
    for texts, own, bounds in _parts(data, at):
        yield texts, *strings(own, bounds, depth)


def _words(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The same of the words' hashes."""
    for texts, own, bounds in _parts(data, at):
        h, _, _, n = T.words(own, bounds)
        yield texts, h, np.repeat(np.arange(len(n)), n)


def string_bucket(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    return (T.mix(keys >> np.uint64(8 * (depth - 1))) % np.uint64(buckets)).astype(np.int64)


def word_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % np.uint64(buckets)).astype(np.int64)


def _runs(depth: int, buckets: int):
    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        data, at = T.buffer(table.column("text").chunk(0))
        ids, train = table.column("id").to_pylist(), table.column("train").to_numpy().astype(bool)
        raw = LOWER[data].tobytes()
        run = int(np.uint64(xxhash.xxh64_intdigest(raw + repr(ids).encode(), 5)).view(np.int64))
        packed = len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)
        rows = [(run, TEXTS, run, -1, packed, T.pack(np.diff(at), train), ids)]
        for kind, found, bucket in (
            (STRINGS, _strings(data, at, depth), lambda u: string_bucket(u, depth, buckets)),
            (WORDS, _words(LOWER[data], at), lambda u: word_bucket(u, buckets)),
        ):
            u, count = _summed([_distinct(values, train[texts][owner]) for texts, values, owner in found])
            where = bucket(u)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(buckets + 1))
            for b in range(buckets):
                own = order[cuts[b] : cuts[b + 1]]
                if len(own):
                    key = (b << 1) | (kind == WORDS)
                    rows.append((key, kind, run, b, T.pack(np.diff(u[own], prepend=np.uint64(0))), T.pack(count[own].astype(np.uint32)), None))
        return _rows(rows)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for batch in T.slices(whole, "text", RUN_BYTES // 2):
                text = pa.array(batch.column("text").to_pylist(), pa.string()).fill_null("")
                held.append(pa.record_batch([batch.column("id"), text, batch.column("train")], names=["id", "text", "train"]))
                size += int(T.buffer(text)[1][-1])
                if size >= RUN_BYTES // 2:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return T.releasing(go)


class Subtrees:
    """All contexts of `depth` to 2 bytes of a bucket's strings. keys: distinct, sorted; n: their training counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        self.keys, self.n, self.depth = keys, n, depth
        self.next = keys & np.uint64(255)
        self.near = (keys >> np.uint64(8 * depth)).astype(np.int64)

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple]]:
        """For each of the eight choices: each string's node, its bit, its probability at depth 2, and the nodes of depth 2 (nearest byte, node, zeros, ones, log weight)."""
        for t in range(8):
            prefix = self.next >> np.uint64(8 - t)
            bit = ((self.next >> np.uint64(7 - t)) & np.uint64(1)).astype(bool)
            deeper = None
            for d in range(self.depth, 1, -1):
                context = self.keys >> np.uint64(8 * (self.depth - d + 1))
                nodes, inverse = np.unique(context << np.uint64(8) | prefix, return_inverse=True)
                total, ones = np.bincount(inverse, self.n, len(nodes)), np.bincount(inverse, self.n * bit, len(nodes))
                kt = log_kt(total - ones, ones)
                estimate = (np.where(bit, ones[inverse], (total - ones)[inverse]) + 0.5) / (total[inverse] + 1)
                if deeper is None:
                    weight, p = kt, estimate
                else:
                    under, weights = deeper
                    parent = np.searchsorted(nodes, (under >> np.uint64(16)) << np.uint64(8) | under & np.uint64(255))
                    below = np.bincount(parent, weights, len(nodes))
                    weight = np.logaddexp(kt, below) - np.log(2)
                    share = np.exp(kt - np.log(2) - weight)[inverse]
                    p = share * estimate + (1 - share) * p
                deeper = nodes, weight
            node = (1 << t) | prefix.astype(np.int64)
            top = (nodes >> np.uint64(16)).astype(np.int64), (1 << t) | (nodes & np.uint64(255)).astype(np.int64), total - ones, ones, weight
            yield node, bit, p, top


def _merged(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Distinct values of a bucket with summed counts, and (run, bucket, own values) of each run."""
    parts, counts = [], []
    for batch in rows:
        for run, bucket, payload, more in zip(*(batch.column(c).to_pylist() for c in ("run", "bucket", "payload", "more")), strict=True):
            parts.append((run, bucket, np.cumsum(T.unpack(payload, np.uint64)[0], dtype=np.uint64)))
            counts.append(T.unpack(more, np.uint32)[0])
    u, inverse = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
    return u, np.bincount(inverse, np.concatenate(counts), len(u)), parts


def _top(depth: int):
    """Sums of the contexts of one byte, and of the base model's counts (near = -1: training words, distinct ones)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, 256, 256))
        words = [0.0, 0.0]
        for key, rows in T.grouped(batches, "key"):
            u, n, _ = _merged(rows)
            if key & 1:
                words[0] += n.sum()
                words[1] += (n > 0).sum()
            else:
                for *_, (near, node, *values) in Subtrees(u, n, depth).levels():
                    for k, v in enumerate(values):
                        np.add.at(sums[k], (near, node), v)
        near, node = np.nonzero(np.abs(sums).sum(0))
        columns = [np.append(near, -1), np.append(node, 0), *(np.append(s[near, node], x) for s, x in zip(sums, (*words, 0.0), strict=True))]
        yield pa.record_batch([pa.array(c) for c in columns], names=["near", "node", "zeros", "ones", "below"])

    return T.releasing(go)


def _prices(depth: int, table):
    """From a bucket's strings or words to each run's log10 probabilities or counts of its own."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (one1, share1), (one0, share0) = table.value
        for key, rows in T.grouped(batches, "key"):
            u, n, parts = _merged(rows)
            if key & 1:
                value = n.astype(np.float64)
            else:
                value, tree = np.zeros(len(u)), Subtrees(u, n, depth)
                for node, bit, p, _ in tree.levels():
                    for one, share in ((one1[tree.near, node], share1[tree.near, node]), (one0[node], share0[node])):
                        p = share * np.where(bit, one, 1 - one) + (1 - share) * p
                    value += np.log10(p)
            kind = COUNTS if key & 1 else PRICES
            for low in range(0, len(parts), 64):
                yield _rows([(run, kind, run, b, T.pack(value[np.searchsorted(u, own)]), None, None) for run, b, own in parts[low : low + 64]])

    return T.releasing(go)


def _score(depth: int, buckets: int, base: tuple[float, float, float]):
    """From a run's texts and prices to its documents' scores. base: training tokens, distinct ones, training documents."""
    tokens, distinct, ends = base
    unit = np.log10(tokens + SMOOTHING * (distinct + 1))

    def looked_up(pieces, known: dict[int, np.ndarray], bucket) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """By part: its texts, and each value's text and what is known of it, in the order of the values. pieces: makes the parts, twice."""
        u = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(values) for _, values, _ in pieces())]))
        where, value = bucket(u), np.zeros(len(u))
        by = np.argsort(where, kind="stable")
        if len(u):
            value[by] = np.concatenate([known[b] for b in np.unique(where)])
        for texts, values, owner in pieces():
            order = np.argsort(values)
            yield texts, owner[order], value[np.searchsorted(u, values[order])]

    def one(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, prices, counts = [], {}, {}
        for batch in rows:
            for kind, bucket, payload, more, ids in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "payload", "more", "ids")), strict=True):
                if kind == TEXTS:
                    texts.append((payload, more, ids))
                else:
                    (prices if kind == PRICES else counts)[bucket] = T.unpack(payload, np.float64)[0]
        for payload, more, ids in texts:
            size = int.from_bytes(payload[:8], "little")
            data = np.frombuffer(pa.Codec("zstd").decompress(payload[8:], size), np.uint8) if size else np.zeros(0, np.uint8)
            length, train = T.unpack(more, np.int64, np.bool_)
            at, n = np.append(0, np.cumsum(length)), len(length)
            score, known, total, words = np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
            for own, docs, price in looked_up(lambda: _strings(data, at, depth), prices, lambda u: string_bucket(u, depth, buckets)):  # noqa: B023
                score[own] = np.bincount(docs, price, own.stop - own.start)
            for own, docs, count in looked_up(lambda: _words(data, at), counts, lambda u: word_bucket(u, buckets)):  # noqa: B023
                size = own.stop - own.start
                words[own] = np.bincount(docs, minlength=size)
                known[own] = np.bincount(docs, count > 0, size).astype(np.int64)
                total[own] = np.bincount(docs, np.log10(count + SMOOTHING), size)
            known, total = known + (ends > 0), total + np.log10(ends + SMOOTHING)
            columns = [pa.array(ids, pa.string()), pa.array(~train), pa.array(words + 1), pa.array(known), pa.array(np.full(n, int(tokens))), pa.array(total - (words + 1) * unit), pa.array(score), pa.array(length + 1)]
            yield pa.record_batch(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in T.grouped(batches, "run"):
            yield from one(rows)

    return T.releasing(go)


def score(docs: DataFrame, train: str, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, held_out (not `train`), n_tokens, n_known, train_tokens, base_score (smoothed word counts), score (log10 probability by context-tree
    weighting), n_bytes, bits_per_byte (code length, the end included).

    train: SQL condition of training rows; null is false. A null text counts as empty: its end alone. Without training rows every choice has probability 1/2 and the base
    is log10(0.1 / 0.1). Repeated rows count and are scored each. A null id stays null; other columns are ignored.
    """
    spark = docs.sparkSession
    if depth < 2 or depth > 6:
        raise ValueError("depth is 2 to 6 bytes")
    buckets = 2 * partitions(spark)
    i = F.col(id_col)
    rows = docs.select(i.cast("string").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.expr(train), F.lit(False)).alias("train"))
    runs = saved(rows.mapInArrow(_runs(depth, buckets), EXCHANGE))
    counted = dealt(runs.where(F.col("kind") != TEXTS), "key")
    tops = counted.mapInArrow(_top(depth), "near long, node long, zeros double, ones double, below double")
    sums = np.zeros((3, 257, 256))
    for r in tops.groupBy("near", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).collect():  # at most 256 x 256 + 1 rows
        sums[:, r.near, r.node] = r.zeros, r.ones, r.below
    words, distinct = sums[0, -1, 0], sums[1, -1, 0]
    ends = float(rows.where("train").count())
    zeros, ones, below = sums[:, :256]
    tables = []
    for _ in range(2):
        kt = log_kt(zeros, ones)
        weight = np.logaddexp(kt, below) - np.log(2)
        tables.append(((ones + 0.5) / (zeros + ones + 1), np.exp(kt - np.log(2) - weight)))
        zeros, ones, below = zeros.sum(0), ones.sum(0), weight.sum(0)
    table = spark.sparkContext.broadcast(tables)  # 2 x 256 x 257 numbers
    priced = counted.mapInArrow(_prices(depth, table), EXCHANGE)
    schema = "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    base = (words + ends, distinct + (ends > 0), ends)
    scored = dealt(priced.unionByName(runs.where(F.col("kind") == TEXTS)), "run").mapInArrow(_score(depth, buckets, base), schema)
    bits = (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte")
    return scored.select(F.col("id").cast(dict(docs.dtypes)[id_col]).alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", bits)
