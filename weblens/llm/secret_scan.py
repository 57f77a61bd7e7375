"""Secrets in texts: three known forms, and random strings found by how badly a public vocabulary compresses them.

A byte-level BPE vocabulary needs few tokens for words and many for random characters.  Runs of `[A-Za-z0-9+/_=-]` at least `least` characters long are encoded,
letters of one case too; at most `ratio` characters a token make a span of kind `random`.  Digests of known lengths, UUIDs, numbers and names in snake, kebab or
camel case, whose parts compress like words, are excluded first.  Each part between separators `-_/+=` and each stretch of parts that are no names is tested as well, so
words joined to a secret do not hide it; the spans are the union.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm import text as T

VOCABULARY = "byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")
RATIO, LEAST = 2.0, 20
#: Bytes of text that are scanned at once.
SLICE_BYTES = 1 << 20
# The forms that the contract of this query names, and what its kinds need at least.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# End of the fixed values.
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: A part of a run; a UUID is one.
PART = re.compile(rf"(?<![0-9A-Za-z]){UUID.pattern}(?![0-9A-Za-z])|[0-9A-Za-z]+")
#: Hexadecimal digits of CRC-64, MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = {16, 32, 40, 56, 64, 96, 128}
NAME = re.compile(r"([A-Za-z]+)\d{0,4}")
#: Letters of a part that are too few to tell words from random ones.
SHORT = re.compile(r"[A-Z]?[a-z]{1,3}|[a-z]{4}|[A-Z]{2,4}")
_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(vocabulary: str) -> tiktoken.Encoding:
    if vocabulary not in _encodings:
        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary]


def wordlike(part: str, ratio: float, coder: tiktoken.Encoding) -> bool:
    """Whether a part of a run is a short number, or letters (and up to 4 digits behind them) that compress like words."""
    if part.isdigit():
        return len(part) <= 8
    name = NAME.fullmatch(part)
    return bool(name) and (bool(SHORT.fullmatch(name[1])) or len(name[1]) > ratio * len(coder.encode_ordinary(name[1])))


def excluded(run: str, ratio: float, coder: tiktoken.Encoding) -> bool:
    """Known digests, numbers and identifiers: no secrets, however they compress."""
    if UUID.fullmatch(run) or not re.search(r"[A-Za-z]", run):
        return True
    if len(run) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return True
    return all(wordlike(x, ratio, coder) for x in re.split(r"[-_/+=]+", run) if x)


def pieces(run: str, ratio: float, coder: tiktoken.Encoding) -> list[tuple[int, int]]:
    """The parts of a run, and the stretches from one part that is no name to another with none but short names and numbers between."""
    out, first, past = [], None, None
    for m in PART.finditer(run):
        a, b = m.span()
        known = bool(UUID.fullmatch(m[0])) or len(m[0]) in DIGESTS and bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", m[0])) and bool(re.search(r"[A-Fa-f]", m[0]))
        if known or wordlike(m[0], ratio, coder):
            if first is not None and (known or b - a > 4):
                out.append((first, past))
                first = None
        else:
            out.append((a, b))
            first, past = a if first is None else first, b
    return out if first is None else [*out, (first, past)]


def random_spans(text: str, ratio: float, least: int, coder: tiktoken.Encoding) -> list[tuple[int, int]]:
    def is_random(run: str) -> bool:
        return len(run) >= least and not excluded(run, ratio, coder) and len(run) <= ratio * len(coder.encode_ordinary(run))

    found: list[tuple[int, int]] = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % least, text):
        if is_random(m[0]):
            found.append(m.span())
            continue
        at = m.start()
        for a, b in sorted({x for x in pieces(m[0], ratio, coder) if x[1] - x[0] >= least}):
            if is_random(m[0][a:b]):
                if found and at + a < found[-1][1]:
                    found[-1] = found[-1][0], max(found[-1][1], at + b)
                else:
                    found.append((at + a, at + b))
    return found


def spans(text: str, ratio: float, least: int, coder: tiktoken.Encoding, runs: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in order; runs: whether the text has a run of characters long enough for hex, access and random."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if runs:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        base = sorted((a, b) for a, _, b in found)
        found += [(a, 3, b) for a, b in random_spans(text, ratio, least, coder) if not any(x < b and a < y for x, y in base)]
    return sorted(found)


RUN = np.zeros(256, bool)
RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True


def long_runs(data: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Whether a text has a run of at least `least` bytes of `[A-Za-z0-9+/_=-]` (a run that crosses two texts may count for both)."""
    edges = np.flatnonzero(np.diff(RUN[data].astype(np.int8), prepend=0, append=0))
    first, past = edges[::2], edges[1::2]
    long = past - first >= least
    hits = np.zeros(len(at) - 1, bool)
    for a, b in zip(first[long], past[long], strict=True):
        hits[np.searchsorted(at, a, "right") - 1 : np.searchsorted(at, b)] = True
    return hits


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, ratio: float = RATIO, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Per row of docs: the id, the columns of `keep`, spans (array of kind, start, past in code points), with_text: redacted_text, each span replaced by `[kind]`.

    Null text: no spans, redacted_text null. Spans of two kinds may overlap; in redacted_text they are one. A random span that overlaps a base one is left out.
    Repeated rows are scanned alike. A column of `keep` must not be called spans or redacted_text.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        shortest = min(least, ACCESS_LENGTH, 24)
        for batch in batches:
            for part in T.slices(batch, "__text", SLICE_BYTES):
                runs = long_runs(*T.buffer(part.column("__text")), shortest)
                texts = part.column("__text").to_pylist()
                found = [spans(t, ratio, least, coder, r) if t else [] for t, r in zip(texts, runs, strict=True)]
                rows = [[{"kind": KINDS[k], "start": a, "past": b} for a, k, b in f] for f in found]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("past", pa.int32())]))
                columns = [*(part.column(c) for c in ("__id", *keep)), pa.array(rows, kind)]
                if with_text:
                    columns.append(pa.array([redact(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string()))
                yield pa.record_batch(columns, names=["__id", *keep, "spans", *["redacted_text"] * with_text])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"__id {kinds[id_col]}", *(f"`{c}` {kinds[c]}" for c in keep), "spans array<struct<kind:string,start:int,past:int>>", *["redacted_text string"] * with_text])
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *keep).mapInArrow(T.releasing(go), schema).withColumnRenamed("__id", id_col)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    out, now = [], 0
    for a, k, b in found:
        if a >= now:
            out += [text[now:a], f"[{KINDS[k]}]"]
        now = max(now, b)
    return "".join([*out, text[now:]])


def digest(found: list[tuple[int, int, int]]) -> str:
    """The contract's digest of base spans."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found if k < 3).encode()).hexdigest()
