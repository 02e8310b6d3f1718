"""Words of whole texts as 64-bit hashes, many documents at a time, in numpy.

A batch of texts is one byte array.  The hash of the word at bytes [i, j) is the
polynomial sum over its bytes of value(byte) * P**position, divided by P**i (P is odd,
so it has an inverse modulo 2**64), then mixed.  The words of a block of bytes so come from one
cumulative sum.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is handled alone, whole.
SLICE_BYTES = 1 << 20
#: Bytes of which words are hashed at once (one word at least), so that little is held.
BLOCK_BYTES = 1 << 17

_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
_U = np.uint64
_P, _SEED = 0x9E3779B97F4A7C15 | 1, 0x243F6A8885A308D3
_powers: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _tables(n: int) -> list[np.ndarray]:
    """Byte values, P**i and P**-i for i <= n."""
    if not _powers or len(_powers[1]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        p, q = np.full(size, _P, _U), np.full(size, pow(_P, -1, 1 << 64), _U)
        p[0] = q[0] = 1
        _powers[:] = [mixed(np.arange(256, dtype=_U) + _U(_SEED)) | _U(1), np.multiply.accumulate(p), np.multiply.accumulate(q)]
    return _powers


def byte_class(allowed: bytes) -> np.ndarray:
    """Table of the bytes that belong to words; UTF-8 bytes from 0x80 on always do."""
    table = np.zeros(256, bool)
    table[128:] = True
    table[list(allowed)] = True
    return table


#: `[^\x20\x09-\x0D]+`, and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
BLANK_SEPARATED = byte_class(bytes(x for x in range(128) if x not in (0x20, *range(0x09, 0x0E))))
ALPHANUMERIC = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of some texts: ``hash``, ``start`` and ``stop`` byte of each, ``doc`` its
    text; ``bounds[i]:bounds[i + 1]`` are those of text i.  ``bytes`` are the texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True):
        data = _LOWER[data] if lower else data
        inside = table[data]
        edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
        starts, stops = edge[:-1] == 1, edge[1:] == -1
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        cut = cut[inside[cut] & inside[cut - 1]]
        starts[cut] = True
        stops[cut - 1] = True
        self.bytes, self.start, self.stop = data, np.flatnonzero(starts), np.flatnonzero(stops) + 1
        self.hash = np.empty(len(self.start), _U)
        i = 0
        while i < len(self.start):
            lo = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.stop, lo + BLOCK_BYTES, "right")))
            n = int(self.stop[j - 1] - lo)
            value, power, inverse = _tables(n)
            sums = np.zeros(n + 1, _U)
            np.cumsum(value[data[lo : lo + n]] * power[:n], out=sums[1:])
            at = self.start[i:j] - lo
            self.hash[i:j] = mixed((sums[self.stop[i:j] - lo] - sums[at]) * inverse[at])
            i = j
        self.bounds = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))


def hash_word(word: str, lower: bool = True) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Words(data, np.array([0, len(data)]), np.ones(256, bool), lower).hash[0])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column (null: empty) and where each text begins."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def trim() -> None:
    """Give freed memory back: Python workers outlive their tasks, several to an executor."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows of at most ``limit`` bytes of text (one row at least),
    with their bytes and offsets."""
    data, at = text_bytes(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    trim()


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, ascending: hashes and bounds.  A text of
    fewer words, but not none, has its whole sequence as its one shingle."""
    h, bounds = words.hash, words.bounds
    counts = np.diff(bounds)
    n_of = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), n_of)
    first = np.concatenate(([0], np.cumsum(n_of)))
    at = np.arange(first[-1]) - first[doc] + bounds[doc]
    s = np.zeros(len(at), _U)
    for i in range(k):
        here = np.where(i < counts[doc], at + i, 0)
        part = (h[here] + _U(i)) * _U(pow(_P, i + 1, 1 << 64)) if len(h) else s
        s += np.where(i < counts[doc], part, _U(0))
    s = mixed(s + np.minimum(counts[doc], k).astype(_U))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[fresh], doc[fresh]
    return s, np.searchsorted(doc, np.arange(len(counts) + 1))
