"""Quality verdicts by gradient-boosted trees over statistics of a document.

The statistics of whole texts are computed in tasks.  The trees are grown by Newton boosting on histograms of a bounded sample of labelled rows (`most_rows`, those of lowest hash: the same
rows on every run); a split on a constrained statistic must move the score in its direction only, in all trees, so more junk can never raise a verdict.  All trees lie in flat node arrays, and a
batch goes down a tree level by level in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm import text as T
from weblens.llm.shared import saved

WINDOW = 8
MOST_ROWS, TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 20_000, 60, 4, 64, 0.15, 1.0, 20
# Fixed values of the contract: symbols, and the least number of words and the largest percentage of repeated ones.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 20, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct", "n_digits", "n_upper", "n_points", "n_bytes")
#: Statistics that trees see, from the counts above, and the direction in which each may move the score (0: any).
STATISTICS = {
    "words": ("log(1 + n_words)", 0), "word_length": ("word_chars / greatest(n_words, 1)", 0), "symbols": ("n_symbols / greatest(n_words, 1)", -1),
    "repeated_lines": ("n_dup_lines / greatest(n_lines, 1)", -1), "repeated_words": ("n_repeat_words / greatest(n_words, 1)", -1), "lines": ("n_lines / greatest(n_words, 1)", 0),
    "distinct": ("n_distinct / greatest(n_words, 1)", 0), "digits": ("n_digits / greatest(word_chars, 1)", 0), "upper": ("n_upper / greatest(word_chars, 1)", 0),
    "points": ("n_points / greatest(n_words, 1)", 0), "wide": ("n_bytes / greatest(word_chars, 1)", 0),
}


def _class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


IS_SYMBOL, IS_DIGIT, IS_UPPER, IS_POINT = _class(SYMBOLS), _class(b"0123456789"), _class(bytes(range(65, 91))), _class(b".!?")


def counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every text."""
    n = len(at) - 1
    per = lambda mask: np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[at])
    h, _, _, words = T.words(data, at)
    owner = np.repeat(np.arange(n), words)
    out = {"n_words": words.astype(np.int64), "word_chars": per(~T.SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": per(IS_SYMBOL[data])}
    raw = data.tobytes()
    lines = [[x for x in raw[a:b].split(b"\n") if x.strip()] for a, b in zip(at, at[1:], strict=False)]
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    window = T.inside(words, WINDOW)
    keys = T.mix(T.rolling(h, WINDOW)[window] ^ T.mix(owner[window].astype(np.uint64) + np.uint64(1))) if len(window) else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    equal = keys[order][1:] == keys[order][:-1]
    twice = window[order[np.append(False, equal) | np.append(equal, False)]] if len(keys) else window
    covered = np.cumsum(np.bincount(twice, minlength=len(h) + 1) - np.bincount(twice + WINDOW, minlength=len(h) + 1))[: len(h)] > 0
    out["n_repeat_words"] = np.bincount(owner, covered, n).astype(np.int64)
    distinct = np.sort(T.mix(h ^ T.mix(owner.astype(np.uint64) + np.uint64(7))))
    first = np.argsort(T.mix(h ^ T.mix(owner.astype(np.uint64) + np.uint64(7))))
    new = np.append(True, np.diff(distinct) != 0) if len(distinct) else np.zeros(0, bool)
    out["n_distinct"] = np.bincount(owner[first[new]], minlength=n).astype(np.int64)
    out |= {"n_lines": np.array([len(x) for x in lines], np.int64), "n_digits": per(IS_DIGIT[data]), "n_upper": per(IS_UPPER[data]), "n_points": per(IS_POINT[data]), "n_bytes": np.diff(at)}
    return out


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the counts of every row. Null text: no words."""
    names = [*COUNTS, *MORE]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text", 4 << 20):
                found = counts(*T.buffer(batch.column("text")))
                yield pa.record_batch([batch.column("id"), *(pa.array(found[c]) for c in names)], names=["id", *names])

    schema = ", ".join([f"id {dict(docs.dtypes)[id_col]}", *(f"{c} long" for c in names)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(go, schema)


class Trees:
    """Trees in flat arrays: feature (-1: leaf), threshold, left, right, value; roots."""

    def __init__(self, width: int):
        self.width = width
        self.rows: list[tuple[int, float, int, int, float]] = []
        self.roots: list[int] = []
        self.prior = 0.0

    def flatten(self) -> Trees:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 5
        self.feature, self.left, self.right = (np.array(columns[k], np.int64) for k in (0, 2, 3))
        self.threshold, self.value = np.array(columns[1], float), np.array(columns[4], float)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality of every row of statistics."""
        total, rows = np.full(len(x), self.prior), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[at]
                at = np.where(f < 0, at, np.where(x[rows, f] <= self.threshold[at], self.left[at], self.right[at]))
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = TREES) -> Trees:
    """Boosts trees for labels 0 and 1."""
    model = Trees(x.shape[1])
    if not len(y) or y.min() == y.max():
        return model.flatten()
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    mean = y.mean()
    model.prior = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), model.prior)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + RIDGE), low, high))

    def build(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        g, h = gradient[rows], hessian[rows]
        place = len(model.rows)
        model.rows.append((-1, 0.0, 0, 0, RATE * leaf(g.sum(), h.sum(), low, high)))
        best = None
        for f in range(x.shape[1]) if depth < DEPTH and len(rows) >= 2 * LEAST else ():
            size = len(edges[f]) + 1
            sums = [np.cumsum(np.bincount(bins[rows, f], w, size))[:-1] for w in (g, h, None)]
            gl, hl, nl = sums
            gr, hr, nr = g.sum() - gl, h.sum() - hl, len(rows) - nl
            wl, wr = (np.clip(-a / (b + RIDGE), low, high) for a, b in ((gl, hl), (gr, hr)))
            gain = -(gl * wl + (hl + RIDGE) * wl**2 / 2) - (gr * wr + (hr + RIDGE) * wr**2 / 2)
            gain[(nl < LEAST) | (nr < LEAST) | (monotone[f] * (wr - wl) < 0)] = -np.inf
            if len(gain) and (best is None or gain.max() > best[0]):
                k = int(gain.argmax())
                best = gain[k], f, k, float(wl[k]), float(wr[k])
        w = leaf(g.sum(), h.sum(), low, high)
        if best and best[0] > -(g.sum() * w + (h.sum() + RIDGE) * w**2 / 2) + 1e-6:
            _, f, k, wl, wr = best
            middle = (wl + wr) / 2
            sides = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[f]]
            goes = bins[rows, f] <= k
            left, right = build(rows[goes], depth + 1, *sides[0]), build(rows[~goes], depth + 1, *sides[1])
            model.rows[place] = (f, float(edges[f][k]), left, right, 0.0)
        return place

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = p - y, p * (1 - p)
        model.roots.append(build(np.arange(len(y)), 0, -np.inf, np.inf))
        one = Trees(x.shape[1])
        one.rows, one.roots = model.rows, model.roots[-1:]
        q = np.clip(one.flatten().predict(x), 1e-12, 1 - 1e-12)
        score += np.log(q / (1 - q))
    return model.flatten()


def rate(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row of docs: the id, the counts of COUNTS and MORE, base_failed (rules of the contract), quality (probability; null if nothing could be learned), kept.

    labels: rows of id and a label 1 (good) or 0; null labels and ids say nothing. The trees are grown on at most most_rows labelled rows. With no labels, or of one kind only, kept is: not
    base_failed. A null text has no words and fails. Repeated rows are rated alike; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = saved(describe(docs, id_col, text_col))
    statistics = [F.expr(e).cast("double").alias(c) for c, (e, _) in STATISTICS.items()]
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null")
    # the lowest hashes: a share of all that leaves about as many as wanted, so no task sends more than its part of them
    sample = rows.join(known, "id").select((F.shiftrightunsigned(F.xxhash64("id"), 11) / 2.0**53).alias("h"), "id", "label", *statistics)
    share = min(1.0, most_rows / max(1, sample.count()))
    found = sample.where(F.col("h") <= share).orderBy("h", "id", "label").limit(most_rows).drop("h", "id").toPandas()
    x, y = found[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), found["label"].to_numpy(float)
    model = spark.sparkContext.broadcast(grow(x, y, [m for _, m in STATISTICS.values()]))  # at most TREES x 2**(DEPTH + 1) nodes
    names = [c for c, _ in rows.dtypes]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS], 1) if batch.num_rows else np.zeros((0, len(STATISTICS)))
            quality = pa.array(model.value.predict(x)) if model.value.roots else pa.nulls(batch.num_rows, pa.float64())
            yield pa.record_batch([*(batch.column(c) for c in names), quality], names=[*names, "quality"])

    schema = ", ".join([*(f"{c} {k}" for c, k in rows.dtypes), "quality double"])
    rated = rows.select("*", *statistics).mapInArrow(go, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rated.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(F.col("quality") >= threshold, F.lit(True))).withColumnRenamed("id", id_col)
