"""Removal of passages that occur more than once.

Every window of `width` consecutive words gets a Rabin-Karp hash.  A task counts the windows of a run of documents (about a million words), and sends every
distinct hash once, in packed rows dealt by the leading bits of the hash; there the runs' hashes meet and are counted, and each run is told which of its windows
occur elsewhere too.  A very common window is one entry per run, never one per occurrence.  Marked windows merge into maximal intervals of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm import text as T
from weblens.llm.shared import dealt, partitions, saved

RUN_WORDS = 1 << 20
#: Bytes of text that are taken into a run, or cut, at once: a run has hardly more than RUN_WORDS words.
SLICE_BYTES = 1 << 20
#: A run's windows are sorted in parts, by that many leading bits: beside 12 bytes a window, a task holds what an eighth of them takes.
PART_BITS = 3
DIRECTORY, WINDOWS, MARKS = 0, 1, 2
SPANS = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
EXCHANGE = "key long, kind int, run long, payload binary, more binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "kind", "run", "payload", "more"])


def _count_runs(width: int, bits: int):
    """From documents to one directory row and the packed window hashes of every run."""

    def flush(keys: list, counts: list, windows: list, places: list) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate([k[i] for k in keys]) for i in (0, 1))
        n = np.concatenate(counts)
        run = int(np.int64(np.uint64(xxhash.xxh64_intdigest(a.tobytes() + b.tobytes() + n.tobytes(), 3)).view(np.int64)))
        repeated = []
        for part in range(1 << PART_BITS):
            own = [np.flatnonzero(w >> np.uint64(64 - PART_BITS) == np.uint64(part)) for w in windows]
            window, at = (np.concatenate([x[i] for x, i in zip(pieces, own, strict=True)]) for pieces in (windows, places))
            order = np.argsort(window)
            window, at = window[order], at[order]
            new = np.ones(len(window), bool)
            new[1:] = window[1:] != window[:-1]
            size = np.diff(np.append(np.flatnonzero(new), len(window)))
            repeated.append(at[np.repeat(size > 1, size)])
            window, at, many = window[new], at[new], size > 1
            first = part << (bits - PART_BITS)
            past = first + (1 << (bits - PART_BITS))
            edges = np.searchsorted(window >> np.uint64(64 - bits), np.arange(first, past + 1, dtype=np.uint64))
            rows = []
            for bucket, (low, high) in enumerate(pairwise(edges), first):
                if high > low:
                    steps = np.diff(window[low:high], prepend=np.uint64(bucket << (64 - bits)))
                    rows.append((bucket, WINDOWS, run, T.pack(steps, at[low:high]), T.pack(many[low:high])))
            yield _rows(rows)
        yield _rows([(run, DIRECTORY, run, T.pack(a, b, n), T.pack(np.sort(np.concatenate(repeated))))])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, windows, places, held = [], [], [], [], 0
        for whole in batches:
            for batch in T.slices(whole, "__text", SLICE_BYTES):
                h, _, _, n = T.words(*T.buffer(batch.column("__text")))
                at = T.inside(n, width)
                keys.append([batch.column(k).to_numpy().copy() for k in ("__a", "__b")])  # a view would hold the whole batch
                counts.append(n)
                windows.append(T.rolling(h, width)[at])
                places.append((at + held).astype(np.uint32))
                held += len(h)
                if held >= RUN_WORDS:
                    yield from flush(keys, counts, windows, places)
                    keys, counts, windows, places, held = [], [], [], [], 0
        if keys:
            yield from flush(keys, counts, windows, places)

    return T.releasing(go)


def _meet(bits: int):
    """From all runs' hashes of a bucket to the places of windows that other runs hold too; directories pass through."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in T.grouped(batches, "key"):
            runs, windows, places, many = [], [], [], []
            for batch in rows:
                kinds = batch.column("kind").to_numpy()
                own = np.flatnonzero(kinds == DIRECTORY)
                if len(own):
                    yield batch.take(pa.array(own))
                for i in np.flatnonzero(kinds == WINDOWS):
                    steps, at = T.unpack(batch.column("payload")[i].as_py(), np.uint64, np.uint32)
                    steps[0] += np.uint64(int(bucket) << (64 - bits))
                    windows.append(np.cumsum(steps, dtype=np.uint64))
                    places.append(at)
                    many.append(T.unpack(batch.column("more")[i].as_py(), np.bool_)[0])
                    runs.append(batch.column("run")[i].as_py())
            if len(runs) < 2:
                continue
            owner = np.repeat(np.arange(len(runs)), [len(w) for w in windows])
            window, at, known = np.concatenate(windows), np.concatenate(places), np.concatenate(many)
            order = np.argsort(window)
            window = window[order]
            equal = window[1:] == window[:-1]
            met = np.zeros(len(window), bool)
            met[1:] |= equal
            met[:-1] |= equal
            met = order[met]
            met = met[~known[met]]
            met = met[np.argsort(owner[met], kind="stable")]
            cuts = np.searchsorted(owner[met], np.arange(len(runs) + 1))
            out = [(runs[k], MARKS, runs[k], T.pack(at[met[cuts[k] : cuts[k + 1]]]), None) for k in range(len(runs)) if cuts[k + 1] > cuts[k]]
            if out:
                yield _rows(out)

    return T.releasing(go)


def _merge(width: int):
    """From a run's directory and marks to intervals of words by document."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in T.grouped(batches, "run"):
            marks, documents = [], None
            for batch in rows:
                for kind, payload, more in zip(*(batch.column(c).to_pylist() for c in ("kind", "payload", "more")), strict=True):
                    if kind == DIRECTORY:
                        documents = T.unpack(payload, np.int64, np.int64, np.int64)
                        payload = more
                    marks.append(T.unpack(payload, np.uint32)[0])
            at = np.unique(np.concatenate(marks)).astype(np.int64)
            if documents is None or not len(at):
                continue
            a, b, n = documents
            ends = np.cumsum(n)
            owner = np.searchsorted(ends, at, "right")
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] > at[:-1] + width) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            doc, base = owner[first], (ends - n)[owner[first]]
            begin, end = (at[first] - base).astype(np.int32), (at[last] + width - base).astype(np.int32)
            docs, count = np.unique(doc, return_counts=True)
            cuts = np.append(0, np.cumsum(count)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (begin, end)]
            yield pa.record_batch([pa.array(a[docs]), pa.array(b[docs]), *lists], names=["__a", "__b", "__first", "__past"])

    return T.releasing(go)


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """__id, __text, two hashes of both that stand for the row (repeated rows have equal ones), and the columns of keep."""
    i, t = F.col(id_col), F.col(text_col)
    return docs.select(i.alias("__id"), t.alias("__text"), F.xxhash64(i, t, F.lit(1)).alias("__a"), F.xxhash64(F.lit(2), t, i).alias("__b"), *keep)


def repeated_spans(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Intervals [first, past) of words to remove: __a, __b (hashes of the row, see keyed), __first, __past (arrays). Documents without such words have no row.

    Null and empty texts have no window. Repeated rows are documents of their own, so their windows occur more than once.
    """
    spark = docs.sparkSession
    bits = max(8, (4 * partitions(spark) - 1).bit_length())
    runs = keyed(docs, id_col, text_col).select("__a", "__b", "__text").mapInArrow(_count_runs(width, bits), EXCHANGE)
    met = dealt(runs, "key").mapInArrow(_meet(bits), EXCHANGE)
    spans = dealt(met, "run").mapInArrow(_merge(width), "__a long, __b long, __first array<int>, __past array<int>")
    return saved(spans).dropDuplicates(["__a", "__b"])


def _cut_words(keep: tuple[str, ...], with_text: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "__text", SLICE_BYTES):
                texts, first, past = (batch.column(c).to_pylist() for c in ("__text", "__first", "__past"))
                kept, total, removed, spans = [], [], [], []
                for t, lows, highs in zip(texts, first, past, strict=True):
                    w = (t or "").encode().split()
                    total.append(len(w))
                    removed.append(sum(highs) - sum(lows) if lows else 0)
                    if lows:
                        w = [x for low, high in zip([0, *highs], [*lows, len(w)], strict=True) for x in w[low:high]]
                    kept.append(b" ".join(w).decode())
                    spans.append([{"first": a, "past": b} for a, b in zip(lows, highs, strict=True)] if lows else None)
                columns = [batch.column(c) for c in ("__id", *["__text"] * with_text, *keep)]
                columns += [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, SPANS)]
                yield pa.record_batch(columns, names=["__id", *["__text"] * with_text, *keep, "n_words", "n_removed", "kept_text", "spans"])

    return T.releasing(go)


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Per row of docs: the id, with_text: the text as it was, the columns of `keep`, n_words, n_removed, kept_text (kept words joined by one space), spans (array of first, past in words; null if none).

    Null text: no words, kept_text ''. All copies of a passage go, the first too. Rows repeated with id and text get one row each. A null id stays null. Other
    columns are ignored, whatever their names; those of `keep` must not have the names above.
    """
    kinds = dict(docs.dtypes)
    # spans grow with the texts, so they are never broadcast, and the plan is the same at any size
    spans = repeated_spans(docs, width, id_col, text_col)
    joined = keyed(docs, id_col, text_col, keep).join(spans.hint("merge"), ["__a", "__b"], "left").select("__id", "__text", *keep, "__first", "__past")
    own = [f"__id {kinds[id_col]}", *["__text string"] * with_text, *(f"`{c}` {kinds[c]}" for c in keep)]
    schema = ", ".join([*own, "n_words long, n_removed long, kept_text string, spans array<struct<first:int,past:int>>"])
    cut = joined.mapInArrow(_cut_words(tuple(keep), with_text), schema).withColumnRenamed("__id", id_col)
    return cut.withColumnRenamed("__text", text_col) if with_text else cut
