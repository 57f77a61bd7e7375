"""Packing of documents' tokens into as few sequences of a fixed length as possible, by linear grouping.

Documents are cut only if they are longer than a sequence.  What decides is how many pieces have each length: at most `capacity` numbers, whatever the input, so the
plan is made of them on the driver (fernandez de la Vega and Lueker, 1981):
1. large lengths are sorted, cut into groups of equal cardinality and rounded up to the largest of their group;
2. configurations of these few sizes are chosen one by one: the largest size left, completed by a subset-sum over the sizes left to the fullest sequence, is taken as
   often as its sizes last;
3. the actual pieces of a group take its places, which leaves gaps;
4. small pieces go, longest first, into the smallest gap that holds them (best fit), then into new sequences.
Spark numbers the pieces of one length (by counts of each task, without a sort), and looks up each number's place in the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.llm import text as T
from weblens.llm.shared import saved
from weblens.llm.tokens import word_tokens

VOCABULARY, CAPACITY, END_ID = "word_bpe_49k.json", 4096, 1
#: Bytes of text whose tokens are made at once.
SLICE_BYTES = 1 << 20
#: Number of groups of large pieces, and the share of a sequence from which a piece is large.
GROUPS, LARGE = 512, 1 / 16


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of at most `capacity` tokens: id, piece, start, length, ids_crc32, and with_ids: ids (array). Null and empty texts are the end id alone."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokens(vocabulary)
        for whole in batches:
            for batch in T.slices(whole, "text", SLICE_BYTES):
                ids, at = coder.encode(*T.buffer(batch.column("text")), end_id)
                n = np.diff(at)
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(capacity, n[row] - start)
                low = at[row] + start
                raw = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(raw[a : a + k]) for a, k in zip(low.tolist(), length.tolist(), strict=True)]
                columns = [batch.column("id").take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(low, at[-1]), pa.int32()), pa.array(ids.view(np.int32))))
                yield pa.record_batch(columns, names=["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    id_type = dict(docs.dtypes)[id_col]
    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(T.releasing(go), schema).withColumnRenamed("id", id_col)


Bins = list[tuple[int, list[tuple[int, int]]]]  # how many sequences, and the lengths in each with their numbers


def _groups(large: list[tuple[int, int]], groups: int) -> tuple[list[int], list[list[list[int]]]]:
    """Sizes of equal-cardinality groups, largest first, and each group's [length, count] runs."""
    total = sum(c for _, c in large)
    each = max(1, -(-total // groups))
    sizes, members, room = [], [], 0
    for length, count in large:
        while count:
            if not room:
                sizes.append(length)
                members.append([])
                room = each
            n = min(room, count)
            members[-1].append([length, n])
            room, count = room - n, count - n
    return sizes, members


def _fullest(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """Places of the fullest sequence that has the first size left: index -> number of it."""
    lead = next(i for i, c in enumerate(left) if c)
    room = capacity - sizes[lead]
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for i in range(lead, len(sizes)):
        most = min(left[i] - (i == lead), room // sizes[i])
        k = 1
        while most > 0:  # numbers of one size in binary, so few steps reach any number
            n = min(k, most)
            wider = reach | (reach << (n * sizes[i])) & mask
            if wider != reach:
                steps.append((i, n, reach))
                reach = wider
            most, k = most - n, 2 * k
        if reach >> room & 1:
            break
    at, config = reach.bit_length() - 1, Counter({lead: 1})
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            config[i] += n
            at -= n * sizes[i]
    return config


def _substitute(config: dict[int, int], times: int, members: list[list[list[int]]]) -> Bins:
    """Actual lengths in `times` sequences of one configuration, in runs of sequences with the same lengths."""
    places = []
    for i, n in config.items():
        for _ in range(n):
            runs, need = [], times
            while need:
                run = members[i][-1]
                k = min(need, run[1])
                runs.append((run[0], k))
                run[1] -= k
                need -= k
                if not run[1]:
                    members[i].pop()
            places.append(runs)
    cuts = sorted({c for runs in places for c in np.cumsum([k for _, k in runs]).tolist()})
    ends = [np.cumsum([k for _, k in runs]) for runs in places]
    found: Bins = []
    for low, high in zip([0, *cuts], cuts, strict=False):
        lengths = Counter(runs[int(np.searchsorted(e, low, "right"))][0] for runs, e in zip(places, ends, strict=True))
        found.append((high - low, list(lengths.items())))
    return found


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, large: float = LARGE) -> Bins:
    """Sequences for that many pieces of each length (1 to capacity)."""
    done: Bins = []
    gaps: dict[int, Bins] = defaultdict(list)

    def put(n: int, lengths: list[tuple[int, int]]) -> None:
        gap = capacity - sum(k * c for k, c in lengths)
        (gaps[gap] if gap else done).append((n, lengths))

    lengths = sorted(histogram.items(), reverse=True)
    sizes, members = _groups([(k, c) for k, c in lengths if c and k > large * capacity], groups)
    left = [sum(c for _, c in m) for m in members]
    while any(left):
        config = _fullest(sizes, left, capacity)
        times = min(left[i] // n for i, n in config.items())
        for i, n in config.items():
            left[i] -= n * times
        for n, inside in _substitute(config, times, members):
            put(n, inside)
    for length, count in ((k, c) for k, c in lengths if c and k <= large * capacity):
        for gap in sorted(g for g in gaps if g >= length):
            waiting, gaps[gap] = gaps[gap], []
            each = gap // length
            while waiting and count:
                n, inside = waiting.pop()
                full, more = divmod(min(count, n * each), each)
                count -= full * each + more
                for m, k in ((full, each), (1 if more else 0, more)):
                    if m:
                        put(m, [*inside, (length, k)])
                n -= full + (more > 0)
                if n:
                    waiting.append((n, inside))
            gaps[gap] += waiting
            if not count:
                break
        each = capacity // length
        if count >= each:
            put(count // each, [(length, each)])
        if count % each:
            put(1, [(length, count % each)])
    return done + [b for g in sorted(gaps) for b in gaps[g]]


def _lookup(bins: Bins) -> tuple[np.ndarray, np.ndarray]:
    """For the n-th piece of a length: keys (length, n) at which a row of (first n, first sequence, sequences, offset, length) begins."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for n, inside in bins:
        offset = 0
        for length, k in inside:
            rows.append(((length << 44) + used[length], used[length], sequence, n, offset, length))
            used[length] += n * k
            offset += length * k
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(len(rows), 6)
    return table[:, 0].copy(), table[:, 1:].copy()


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task and the piece's number among those of its length in the task."""
    task = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for batch in batches:
        length = batch.column("length").to_numpy()
        order = np.argsort(length, kind="stable")
        values, first, count = np.unique(length[order], return_index=True, return_counts=True)
        base = np.array([seen.get(v, 0) for v in values.tolist()], np.int64)
        number = np.empty(len(length), np.int64)
        number[order] = np.arange(len(length)) - np.repeat(first - base, count)
        seen.update(zip(values.tolist(), (base + count).tolist(), strict=True))
        yield pa.record_batch([*batch.columns, pa.array(np.full(len(length), task), pa.int32()), pa.array(number)], names=[*batch.schema.names, "task", "number"])


def pack(items: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> DataFrame:
    """items, which have a `length` from 1 to capacity, with sequence_id (from 0, without a break) and offset (place in it, without a gap from 0). No items: no rows.

    items must be read from files: they are read twice. Their columns must not be called task, number, base, sequence_id or offset.
    """
    spark = items.sparkSession
    schema = ", ".join(f"`{n}` {k}" for n, k in items.dtypes) + ", task int, number long"
    numbered = saved(items.mapInArrow(_number, schema))
    counts = numbered.groupBy("length", "task").count()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    if histogram and not 0 < min(histogram) <= max(histogram) <= capacity:
        raise ValueError("a length is not between 1 and the capacity")
    table = spark.sparkContext.broadcast(_lookup(plan(histogram, capacity, groups, large)))  # its size follows the capacity, not the input

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = table.value
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy() + batch.column("base").to_numpy()
            row = rows[np.searchsorted(keys, (length << 44) + number, "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            n = number - row[:, 0]
            sequence, offset = row[:, 1] + n % np.maximum(row[:, 2], 1), row[:, 3] + n // np.maximum(row[:, 2], 1) * row[:, 4]
            names = [c for c in batch.schema.names if c not in ("task", "number", "base")]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {k}" for n, k in items.dtypes) + ", sequence_id long, offset long"
    joined = numbered.join(bases, ["length", "task"]).select(*items.columns, "task", "number", "base")
    return joined.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, from pieces that hold their ids. A sequence gathers at most `capacity` ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of all rows of docs: id, piece, start, length, ids_crc32, with_ids: ids, sequence_id, offset. Repeated rows are packed each; a null id stays null."""
    return pack(saved(tokenize(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids)), capacity)
