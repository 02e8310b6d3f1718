"""Distinct pieces of texts, so that a tokenizer sees each piece once.

The tokenizers served here drop white space, lower-case, and never let a token span a
letter and a following ASCII mark or digit.  A text can therefore be cut at ASCII white
space and between an ASCII letter and a following ASCII mark or digit, and the token
sequences of the pieces, joined, are those of the text.  Texts with ``<|`` may hold
special strings that span such a cut and are handled as one piece each.

Pieces are found and keyed by 64-bit hash in numpy for a whole batch; what a piece
yields is kept in a cache of at most ``CACHE`` pieces, which starts anew when full.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from .wordhash import BLANK_SEPARATED, Words

CACHE = 1 << 20
os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
_U = np.uint64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~_LETTER


class Pieces(Words):
    """Words cut again where an ASCII letter is followed by an ASCII mark or digit."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        marked = data[:-1][data[1:] == 0x7C] == 0x3C if len(data) > 1 else np.zeros(0, bool)
        whole = np.zeros(len(offsets) - 1, bool)
        if marked.any():
            bars = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
            doc = np.searchsorted(offsets, bars, "right") - 1
            whole[doc[bars + 1 < offsets[doc + 1]]] = True
        cuts = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1 if len(data) > 1 else np.zeros(0, np.int64)
        inner = np.unique(np.concatenate((offsets, cuts)))
        super().__init__(data, inner, BLANK_SEPARATED)
        self.bounds = np.searchsorted(self.start, offsets)
        self.whole = np.flatnonzero(whole)


class Cache:
    """What each piece yields: an array of integers.  ``make`` gets texts of new pieces and
    returns their values end to end and how many each has."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.make = make
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, _U)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.values = np.zeros(0, np.int32)

    def resolve(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """First value and number of values of each piece."""
        keys, sample, inverse = np.unique(pieces.hash, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = pieces.bytes.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(pieces.start[sample[new]].tolist(), pieces.stop[sample[new]].tolist(), strict=True)]
            values, count = self.make(texts)
            first = len(self.values) + np.concatenate(([0], np.cumsum(count)[:-1]))
            self.values = np.concatenate((self.values, values.astype(np.int32)))
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.first = np.insert(self.first, at[new], first)
            self.count = np.insert(self.count, at[new], count)
            at = np.searchsorted(self.keys, keys)
        return self.first[at][inverse], self.count[at][inverse]


def gathered(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``values[first[i]:first[i] + count[i]]`` of all i, end to end."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(first - (ends - count), count) + np.arange(total)]


class Encoder:
    """Token ids by the tokenizers library, a piece at a time."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.cache = Cache(self._ids)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum())), count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin."""
        pieces = Pieces(data, offsets)
        first, count = self.cache.resolve(pieces)
        sums = np.concatenate(([0], np.cumsum(count)))
        bounds = sums[pieces.bounds]
        ids = gathered(self.cache.values, first, count)
        if not len(pieces.whole):
            return ids, bounds
        own = {int(d): np.array(self.tokenizer.encode(data[offsets[d] : offsets[d + 1]].tobytes().decode(), add_special_tokens=False).ids, np.int32) for d in pieces.whole}
        parts = [own.get(d, ids[bounds[d] : bounds[d + 1]]) for d in range(len(offsets) - 1)]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker: tasks that follow each other share its cache."""
    return Encoder(path)


def default_tokenizer() -> str:
    """word_bpe_49k.json of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
