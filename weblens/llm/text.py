"""Words and hashes of many texts at once, in numpy, straight from Arrow's buffers.

Words are `[^\\x20\\x09-\\x0D]+` over UTF-8 bytes.  Long texts are walked in slices that end between words, so memory beside the text itself is 24 bytes a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE = 1 << 18
#: Bytes that a task takes in before it gives freed memory back.
RELEASED = 16 << 20
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Words of more bytes are hashed by XXH64: a polynomial modulo 2**64 has known collisions between very long strings.
LONG_WORD = 512
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if base not in _tables or len(_tables[base][0]) < n:
        size = max(n, SLICE + 4096)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _tables[base] = both[0], both[1]
    return _tables[base]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's bounds in them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have together at most that many bytes, or one row."""
    _, at = buffer(batch.column(column))
    for row, end in spans(at, most):
        yield batch.slice(row, end - row)


def spans(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First and past row of runs of texts with these bounds that have together at most that many bytes, or of one text."""
    row = 0
    while row < len(at) - 1:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end
        row = end


def release() -> None:
    """Gives freed memory of Arrow and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def releasing(go: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """go, with release() at its end and whenever RELEASED bytes came in: a worker holds what the task uses now, and keeps none of it while it waits or runs another one."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            seen += batch.nbytes
            yield batch
            if seen >= RELEASED:
                seen = 0
                release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from go(counted(batches))
        release()

    return run


def _cut(data: np.ndarray, at: np.ndarray, low: int) -> int:
    """Where a slice that begins at low ends: between two words or texts."""
    high = low + SLICE
    if high >= len(data):
        return len(data)
    text = int(at[np.searchsorted(at, high, "right") - 1])
    spaces = np.flatnonzero(SPACE[data[low:high]])
    cut = max(text, low + int(spaces[-1]) + 1 if len(spaces) else low)
    if cut > low:
        return cut
    end = int(at[np.searchsorted(at, low, "right")])
    while high < end:
        spaces = np.flatnonzero(SPACE[data[high : min(end, high + SLICE)]])
        if len(spaces):
            return high + int(spaces[0])
        high += SLICE
    return end


def words(data: np.ndarray, at: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word, and the number of words of each text. breaks: bytes inside words at which a new word begins."""
    hashes, firsts, ends, low = [], [], [], 0
    while low < len(data):
        high = _cut(data, at, low)
        part = data[low:high]
        inside = ~SPACE[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = at[np.searchsorted(at, low, "right") : np.searchsorted(at, high)] - low
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        if breaks is not None:
            more = np.flatnonzero(breaks[low:high] & inside)
            first[more] = True
            last[more[more > 0] - 1] |= inside[more[more > 0] - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = powers(BYTE_BASE, len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        values = part.astype(np.uint64)
        values += np.uint64(1)
        values *= power[: len(part)]
        np.cumsum(values, out=sums[1:])
        h = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        for k in np.flatnonzero(b - a > LONG_WORD):
            h[k] = xxhash.xxh64_intdigest(part[a[k] : b[k]].tobytes(), 7)
        hashes.append(h)
        firsts.append(a + low)
        ends.append(b + low)
        low = high
    none = np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else none.astype(np.uint64)
    a = np.concatenate(firsts) if firsts else none
    b = np.concatenate(ends) if ends else none
    return h, a, b, np.diff(np.searchsorted(a, at))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of `width` values; entry i starts at value i."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(count, np.uint64)
    power, inverse = powers(WORD_BASE, min(count, SLICE) + width + 1)
    for low in range(0, count, SLICE):
        part = values[low : min(len(values), low + SLICE + width - 1)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        n = len(part) - width + 1
        out[low : low + n] = (sums[width:] - sums[:-width]) * inverse[:n]
    return mix(out)


def inside(counts: np.ndarray, width: int) -> np.ndarray:
    """Places at which a window of `width` words of one text starts, in the numbering of all words."""
    ends = np.repeat(np.cumsum(counts), counts)
    return np.flatnonzero(ends - np.arange(len(ends)) >= width)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as compressed planes of bytes."""
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in arrays]
    raw = b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True) if raw else b""


def unpack(data: bytes, *types: type) -> list[np.ndarray]:
    if not data:
        return [np.zeros(0, t) for t in types]
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little")), np.uint8)
    widths = [np.dtype(t).itemsize for t in types]
    n, low, out = len(raw) // sum(widths), 0, []
    for t, w in zip(types, widths, strict=True):
        out.append(np.ascontiguousarray(raw[low : low + n * w].reshape(w, n).T).view(t).reshape(n))
        low += n * w
    return out


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of rows with one key of a partition that is sorted by it."""
    run: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if run and keys[low] != now:
                yield now, run
                run = []
            now = keys[low]
            run.append(batch.slice(low, high - low))
    if run:
        yield now, run
