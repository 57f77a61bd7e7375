"""SentencePiece encoding and decoding, exact for models of byte-pair type with byte fallback, by a streaming Viterbi pass.

The pass goes over code points from left to right.  A state stands for a prefix; its backpointer is the last piece of the prefix's encoding.  For byte-pair merges that piece is unique: it is the one
that ends there and forms a stable pair with the last piece of the prefix before it (merging the two pieces' characters gives the two again).  States more than the longest piece back can start no
further piece; when the paths of all states that still can pass through one boundary, the ids before it are committed and forgotten.  So memory is bounded by the longest piece, not by the text.

No piece has a space mark behind another character or a line end, so all paths meet before a space that follows a non-space and around line ends: the stretches between are encoded once and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm import text as T

VOCABULARY, MARK = "piece_bpe_32k.model", "▁"
#: Parts of a text that no piece crosses, and how many a worker remembers twice (recent ones, and those before).
STRETCH = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")
REMEMBERED, LONGEST_REMEMBERED = 400_000, 64


class Model:
    """Pieces and their order of merging, read from a model file; encoding and decoding are our own."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
        size = file.get_piece_size()
        normal = [i for i in range(size) if not (file.is_control(i) or file.is_unknown(i) or file.is_byte(i) or file.is_unused(i))]
        self.piece = [file.id_to_piece(i) for i in range(size)]
        self.id = {self.piece[i]: i for i in normal}
        order = {x: k for k, x in enumerate(sorted({-file.get_score(i) for i in normal}))}
        self.rank = {self.piece[i]: order[-file.get_score(i)] for i in normal}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(size) if file.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        self.silent = {i for i in range(size) if file.is_control(i)}
        self.unknown = file.unk_id()
        self.prefix = MARK if file.encode_as_pieces("\u0001")[:1] == [MARK] else ""
        self.longest = max(map(len, self.id))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.id):
            raise ValueError("a piece crosses a space or a line")
        self.made: dict[str, tuple[int, str, str] | None] = {}
        self.suffixes: dict = {}
        for p in filter(self._made, self.id):
            node = self.suffixes
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        self.apart: dict[tuple[str, str], bool] = {}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _made(self, piece: str) -> tuple[int, str, str] | None:
        """When byte-pair merging of its characters makes the piece, and of which two; None if it never does. The best pair comes first, the leftmost of equals."""
        if piece not in self.made:
            symbols, found = list(piece), (-1, "", piece)
            while len(symbols) > 1:
                pairs = [(self.rank[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.rank]
                if not pairs:
                    break
                rank, k = min(pairs)
                found = max(found[0], rank), symbols[k], symbols[k + 1]
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            self.made[piece] = found if len(symbols) == 1 else None
        return self.made[piece]

    def fits(self, last: str, piece: str) -> bool:
        """Whether merging keeps the two apart."""
        pair = last, piece
        known = self.apart.get(pair)
        if known is None:
            if len(self.apart) >= REMEMBERED:
                self.apart.clear()
            known = self.apart[pair] = self._fits(last, piece)
        return known

    def _fits(self, last: str, piece: str) -> bool:
        """The inner parts are taken back merge by merge, and at no moment a merge across came first."""
        a, b = last, piece
        a_used = b_used = 1 << 60  # when the next merge takes a and b up
        while True:
            a_made, b_made = self._made(a), self._made(b)
            across = self.rank.get(a + b)
            if across is not None:
                when = max(across, a_made[0], b_made[0])
                if when < a_used and when <= b_used:
                    return False
            if len(a) == 1 and len(b) == 1:
                return True
            if len(b) == 1 or len(a) > 1 and a_made[0] > b_made[0]:
                a, a_used = a_made[2], a_made[0]
            else:
                b, b_used = b_made[1], b_made[0]

    def ids(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        return [self.byte[b] for b in piece.encode()] if self.byte else [self.unknown]

    def viterbi(self, chars: Iterator[str]) -> Iterator[str]:
        """Pieces of a stream of code points, each given out as soon as all paths agree on it."""
        window: list[str] = []  # characters behind the committed boundary
        last: list[str | None] = [None]  # of each prefix of the window, its last piece; at 0 the committed one
        suffixes, fits, most = self.suffixes, self.fits, 4 * self.longest
        for c in chars:
            window.append(c)
            k = end = len(window)
            node, found = suffixes, []
            while k and (node := node.get(window[k - 1])):
                k -= 1
                if "" in node:
                    found.append((k, node[""]))
            piece = c
            for k, candidate in reversed(found):
                before = last[k]
                if before is None or fits(before, candidate):
                    piece = candidate
                    break
            last.append(piece)
            if end >= most:
                cut, pieces = self._agreed(last)
                yield from pieces
                window, last = window[cut:], last[cut:]
        yield from self._path(last, len(window))

    def _path(self, last: list[str | None], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _agreed(self, last: list[str | None]) -> tuple[int, list[str]]:
        """The furthest boundary on the paths of all prefixes that can still be followed by a piece, and the pieces before it."""
        at = set(range(max(0, len(last) - self.longest), len(last)))
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(far - len(last[far]))
        cut = at.pop()
        return cut, self._path(last, cut)

    def _stretch(self, stretch: str) -> bytes:
        ids = self.recent.get(stretch) or self.older.get(stretch)
        if ids is None:
            ids = np.array([i for p in self.viterbi(iter(stretch)) for i in self.ids(p)], "<i4").tobytes()
        if len(stretch) <= LONGEST_REMEMBERED:
            if len(self.recent) >= REMEMBERED:
                self.older, self.recent = self.recent, {}
            self.recent[stretch] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        found, miss = self.recent.get, self._stretch
        return np.frombuffer(b"".join([found(x) or miss(x) for x in STRETCH.findall(self.prefix + text.replace(" ", MARK))]), "<i4")

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of the ids' pieces one after another, and where each ends."""
        if not hasattr(self, "texts"):
            texts = [bytes([self.value[i]]) if i in self.value else b"" if i in self.silent else (" ⁇ " if i == self.unknown else p.replace(MARK, " ")).encode() for i, p in enumerate(self.piece)]
            self.length = np.array([len(t) for t in texts])
            self.first, self.texts = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(texts), np.uint8)
        length = self.length[ids]
        ends = np.cumsum(length)
        return self.texts[np.repeat(self.first[ids] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)], ends

    def decoded(self, rows: pa.ListArray) -> list[str | None]:
        ids = rows.flatten().to_numpy()
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(self.piece):
            raise ValueError("an id is outside the vocabulary")
        data, ends = self.decode(ids)
        ends = np.append(0, ends)[np.append(0, np.cumsum(rows.value_lengths().fill_null(0).to_numpy()))]
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
        texts = [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]
        return [t if ok else None for t, ok in zip(texts, rows.is_valid().to_pylist(), strict=True)]


_models: dict[str, Model] = {}


def model(vocabulary: str) -> Model:
    if vocabulary not in _models:
        _models[vocabulary] = Model(vocabulary)
    return _models[vocabulary]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, ids (array of int). A null text has null ids, an empty one none. Repeated rows are encoded alike; other columns are ignored."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(vocabulary)
        for whole in batches:
            for batch in T.slices(whole, "text", 2 << 20):
                rows = [None if t is None else m.encode(t) for t in batch.column("text").to_pylist()]
                yield pa.record_batch([batch.column("id"), pa.array(rows, pa.list_(pa.int32()))], names=["id", "ids"])

    id_type = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(go, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the id, ids and the text that they stand for. Null ids: null text. An id outside the vocabulary fails."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(vocabulary)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                yield pa.record_batch([*part.columns, pa.array(m.decoded(part.column("ids")), pa.string())], names=["id", "ids", "text"])

    id_type = dict(encoded.dtypes)[id_col]
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(go, f"id {id_type}, ids array<int>, text string").withColumnRenamed("id", id_col)
