"""Token ids of texts whose tokenizer ignores case and never joins what white space parts, nor a letter or digit and punctuation behind it.

Each distinct part between such places is encoded once, the rest is gathering in numpy.
"""

from __future__ import annotations

import os
import re

import numpy as np
import public_tokenizers

from weblens.llm import text as T

#: Words whose ids a worker remembers; when they are more, it starts anew.
REMEMBERED = 1 << 19


IS_WORD, IS_MARK, IS_UPPER = (np.zeros(256, bool) for _ in range(3))
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
IS_MARK[[x for x in range(33, 127) if not IS_WORD[x]]] = True
IS_UPPER[65:91] = True


class WordTokens:
    """Ids of words, by their 64-bit hash."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.coder.encode_special_tokens = True
        # a text that holds the string of a special token is encoded as a whole, as the library does it
        self.whole = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.special = [t.content.lower().encode() for t in self.whole.get_added_tokens_decoder().values()]
        probes = ["a", "the", "straightforward", "zqxjkvb", "s", "aaaaaaaa"]
        self.plain = all(self.coder.encode(p, add_special_tokens=False).ids == self._plain(p) for p in probes)
        if self.coder.encode("It's, A.B", add_special_tokens=False).ids != [i for p in ("it", "'s", ",", "a", ".b") for i in self.coder.encode(p, add_special_tokens=False).ids]:
            raise ValueError("this tokenizer joins parts of words or heeds case")
        self.forget()

    def _plain(self, word: str) -> list[int]:
        """Ids of a word of a to z, which needs no normalising and no splitting."""
        return [t.id for t in self.coder.model.tokenize(word)]

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.first = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        simple = [w.isascii() and w.isalpha() and w.islower() and self.plain for w in words]
        other = iter(self.coder.encode_batch_fast([w.decode() for w, x in zip(words, simple, strict=True) if not x], add_special_tokens=False))
        tokenize = self.coder.model.tokenize
        return [[t.id for t in tokenize(w.decode())] if x else next(other).ids for w, x in zip(words, simple, strict=True)]

    def _learn(self, hashes: list[int], words: list[bytes]) -> None:
        for low in range(0, len(words), 4096):
            for h, ids in zip(hashes[low : low + 4096], self._ids(words[low : low + 4096]), strict=True):
                k = len(self.known)
                if k == len(self.first):
                    self.first, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length))
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                self.first[k], self.length[k] = self.used, len(ids)
                self.ids[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
                self.known[h] = k

    def encode(self, data: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each closed by `end`, and the texts' bounds in them."""
        ids, bounds = self._encode(data, at, end)
        raw = data.tobytes()
        low = raw.lower()
        found = [m.start() for x in self.special if x in low for m in re.finditer(re.escape(x), low)]
        rows = np.unique(np.searchsorted(at, found, "right") - 1).tolist()
        if not rows:
            return ids, bounds
        pieces, counts, low = [], np.diff(bounds), 0
        for row in rows:
            own = self.whole.encode(raw[at[row] : at[row + 1]].decode(), add_special_tokens=False).ids
            pieces += [ids[bounds[low] : bounds[row]], np.array([*own, end], np.uint32)]
            counts[row], low = len(own) + 1, row + 1
        return np.concatenate([*pieces, ids[bounds[low] :]]), np.append(0, np.cumsum(counts))

    def _encode(self, data: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        upper = IS_UPPER[data]
        upper[:-1] &= data[1:] < 128  # a combining mark may follow
        data = np.where(upper, data + np.uint8(32), data)
        breaks = IS_MARK[data]
        breaks[1:] &= IS_WORD[data[:-1]]
        h, a, b, n = T.words(data, at, breaks)
        order = np.argsort(h)
        new = np.append(True, np.diff(h[order]) != 0) if len(h) else np.zeros(0, bool)
        distinct, one = h[order[new]], order[new]
        inverse = np.empty(len(h), np.int64)
        inverse[order] = np.cumsum(new) - 1
        if len(self.known) + len(distinct) > REMEMBERED and self.known:
            self.forget()
        keys = distinct.tolist()
        missing = [i for i, k in enumerate(keys) if k not in self.known]
        raw = data.tobytes() if missing else b""
        self._learn([keys[i] for i in missing], [raw[x:y] for x, y in zip(a[one[missing]].tolist(), b[one[missing]].tolist(), strict=True)])
        place = np.array([self.known[k] for k in keys], np.int64)[inverse] if keys else np.zeros(0, np.int64)
        length = self.length[place]
        past = np.cumsum(length)
        total = int(past[-1]) if len(past) else 0
        owner = np.repeat(np.arange(len(n)), n)
        out = np.full(total + len(n), end, np.uint32)
        source = np.arange(total) + np.repeat(self.first[place] - (past - length), length)
        out[np.arange(total) + np.repeat(owner, length)] = self.ids[source]
        counts = np.bincount(owner, length, len(n)).astype(np.int64) + 1
        return out, np.append(0, np.cumsum(counts))


_coders: dict[str, WordTokens] = {}


def word_tokens(vocabulary: str) -> WordTokens:
    if vocabulary not in _coders:
        _coders[vocabulary] = WordTokens(vocabulary)
    return _coders[vocabulary]
