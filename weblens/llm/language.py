"""Language identification: multinomial naive Bayes over hashed character n-grams.

The n-grams of 1 to `orders` code points of the lower-cased text fall into `buckets` bins.  Training adds up one array of counts a language and task, over all labelled
texts, none held in memory; there are at most `max_languages` x `buckets` numbers.  The log probabilities (that size is checked before they are broadcast) score a
batch of texts by one gather and one segmented sum a language and order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm import text as T

ORDERS, BUCKETS, MAX_LANGUAGES, SMOOTHING = 3, 1 << 16, 512, 0.5
#: Code points that are hashed at once.
BLOCK = 1 << 20
UNDETERMINED = "und"


def code_points(texts: list[str | None], orders: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each with orders - 1 zeros behind it, and the texts' bounds."""
    lower = [(t or "").lower() for t in texts]
    at = np.append(0, np.cumsum([len(t) + orders - 1 for t in lower])).astype(np.int64)
    gap = "\0" * (orders - 1)
    return np.frombuffer((gap.join(lower) + gap).encode("utf-32-le"), np.uint32), at


def ngrams(points: np.ndarray, orders: int, buckets: int) -> Iterator[np.ndarray]:
    """For each order the bin of the n-gram that starts at each code point; those that would run into a gap hold its zeros."""
    h = np.zeros(len(points) - orders + 1, np.uint32)
    for n in range(orders):
        h = (h ^ points[n : n + len(h)]) * np.uint32(0x9E3779B1)
        h = h ^ (h >> np.uint32(15))
        yield h % np.uint32(buckets)


def blocks(batch: pa.RecordBatch, orders: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in T.slices(batch, "__text", BLOCK):
        points, at = code_points(part.column("__text").to_pylist(), orders)
        yield part, points, at


def has_letter(texts: list[str | None]) -> np.ndarray:
    """Whether a text has a letter of any script."""
    return np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text has a letter."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, text_col, BLOCK):
                yield part.filter(pa.array(has_letter(part.column(text_col).to_pylist()), pa.bool_()))

    return docs.mapInArrow(T.releasing(go), docs.schema)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", orders: int = ORDERS, buckets: int = BUCKETS, max_languages: int = MAX_LANGUAGES, smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order of name, log priors, log probabilities (language x order x bin) from every row with a text and a language.

    No such row: no languages. More than max_languages: ValueError (labels that are not languages).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for part, points, at in blocks(batch, orders):
                names, codes = np.unique(part.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
                for name, number in zip(names, np.bincount(codes), strict=True):
                    rows[name] = rows.get(name, 0) + int(number)
                    sums.setdefault(name, np.zeros((orders, buckets), np.int64))
                owner = np.repeat(codes, np.diff(at))[: len(points) - orders + 1]
                for n, bins in enumerate(ngrams(points, orders, buckets)):
                    added = np.bincount(owner * buckets + bins, minlength=len(names) * buckets).reshape(len(names), buckets)
                    for k, name in enumerate(names):
                        sums[name][n] += added[k]
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([rows[s] for s in sums], pa.int64()), pa.array([s.astype("<i8").tobytes() for s in sums.values()], pa.binary())], names=["lang", "rows", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, parts in T.grouped(batches, "lang"):
            rows, total = 0, np.zeros(orders * buckets, np.int64)
            for part in parts:
                rows += int(part.column("rows").to_numpy().sum())
                for x in part.column("counts"):
                    total += np.frombuffer(x.as_buffer(), "<i8")
            yield pa.record_batch([pa.array([name]), pa.array([rows], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["lang", "rows", "counts"])

    schema = "lang string, rows long, counts binary"
    known = docs.select(F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("lang")).where("__text is not null and lang is not null")
    partial = known.mapInArrow(T.releasing(count), schema)
    found = partial.repartition("lang").sortWithinPartitions("lang").mapInArrow(add, schema).limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    found.sort(key=lambda r: r.lang)
    counts = np.array([np.frombuffer(r.counts, "<i8").reshape(orders, buckets) for r in found], float).reshape(len(found), orders, buckets) + smoothing
    prior = np.log(np.array([r.rows for r in found], float)) - np.log(max(1, sum(r.rows for r in found)))
    return [r.lang for r in found], prior, np.log(counts / counts.sum(2, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: the id, the columns of `keep`, lang_pred, score (posterior probability of lang_pred, 0 to 1).

    A text that is null or has no letter gets `und` and score 0, and so does every text if no language was learned. Equal posteriors: the first name.
    Repeated rows are scored alike. A column of `keep` must not be called lang_pred or score.
    """
    spark = docs.sparkSession
    languages, prior, table = model
    shared = spark.sparkContext.broadcast((languages, prior, table))  # at most MAX_LANGUAGES x ORDERS x BUCKETS numbers

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prior, table = shared.value
        orders, buckets = table.shape[1:] if len(languages) else (ORDERS, BUCKETS)
        for batch in batches:
            for part, points, at in blocks(batch, orders):
                sums = np.tile(prior, (part.num_rows, 1))
                found = has_letter(part.column("__text").to_pylist())
                if len(languages):
                    for n, bins in enumerate(ngrams(points, orders, buckets)):
                        bins = np.append(bins, np.zeros(orders - 1, bins.dtype))
                        for k in range(len(languages)):
                            logs = table[k, n][bins]
                            for gap in range(orders - 1):  # the zeros behind a text are no part of it
                                logs[at[1:] - 1 - gap] = 0
                            sums[:, k] += np.add.reduceat(logs, at[:-1], dtype=np.float64)
                    best = sums.argmax(1)
                    top = sums[np.arange(len(best)), best]
                    score = np.where(found, 1 / np.exp(sums - top[:, None]).sum(1), 0.0)
                    names = np.where(found, np.array(languages, object)[best], UNDETERMINED)
                else:
                    score, names = np.zeros(part.num_rows), np.full(part.num_rows, UNDETERMINED, object)
                yield pa.record_batch([*(part.column(c) for c in ("__id", *keep)), pa.array(names, pa.string()), pa.array(score)], names=["__id", *keep, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"__id {kinds[id_col]}", *(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"])
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *keep).mapInArrow(T.releasing(go), schema).withColumnRenamed("__id", id_col)
