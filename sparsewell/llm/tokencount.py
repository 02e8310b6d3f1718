"""Token counts by rank-synchronous merging of arrays.

Pre-tokens of a batch are held as one ragged array of symbols.  In each round every
sequence finds its lowest-rank pair, and all sequences merge theirs at the same time
(within a sequence all places of that pair, left to right, not overlapping); sequences
without a pair in the merge table leave.  The symbols that remain are the tokens.

Vocabulary and merges come from the tokenizer's file; its normaliser (canonical
composition, white space, lower case) and pre-token pattern are applied here to the
distinct pieces of the texts (see :mod:`pretokens`), whose counts are kept in a cache.

Defined cases: a null or blank text has 0 tokens and, if null, 0 bytes; special strings
in a text count as one token; equal rows each give a row; an empty table gives an empty
result; further columns are ignored.  Nothing is shuffled.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .pretokens import Cache, Pieces, default_tokenizer
from .store import dealt
from .wordhash import pieces

LIMIT = 2048
#: Symbols merged at once.
CHUNK = 1 << 21
# The white space and the pre-token pattern of the tokenizer file.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Characters that every Unicode version since 5 classifies alike; pieces with others are
#: cut by the library itself, whose version may differ from that of this interpreter.
STABLE = regex.compile("[\x00-\u024f\u0400-\u045f\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes
    of visible Latin-1 characters stand for themselves, others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merger:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.size = max(vocab.values()) + 1
        left, right = zip(*(m if isinstance(m, list) else m.split(" ") for m in model["merges"]), strict=True)
        a, b = (np.array([vocab[x] for x in side], np.int64) for side in (left, right))
        made = np.array([vocab[x + y] for x, y in zip((x.removesuffix(suffix) for x in left), right, strict=True)], np.int64)
        keys = a * self.size + b
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made
        self.none = len(keys)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.library = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        self.cache = Cache(self._counts)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.rank[i], self.none)

    def pre_tokens(self, text: str) -> list[bytes]:
        if not STABLE.fullmatch(text):
            cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(self.byte_of[c] for c in word) for word, _ in cut]
        if not text.isascii():
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
        else:
            text = text.lower()
        return [m.encode() for m in self.pattern.findall(text)]

    def merged(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive of each pre-token (none of them empty)."""
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1
        for part in np.split(np.arange(len(words)), cuts):
            if len(part):
                out[part] = self._merge(b"".join(words[part[0] : part[-1] + 1]), sizes[part])
        return out

    def _merge(self, data: bytes, sizes: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(sizes)
        sym[ends - 1] = self.final[raw[ends - 1]]
        count = sizes.copy()
        seq = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(sym), self.none)
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inside] = self.ranks(sym[inside], sym[inside + 1])
        while True:
            # sequences without a pair leave
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1]))) if len(seq) else np.zeros(0, np.int64)
            if not len(first):
                return count
            length = np.diff(np.append(first, len(seq)))
            low = np.minimum.reduceat(rank, first)
            stays = low < self.none
            if not stays.all():
                count[seq[first[~stays]]] = length[~stays]
                keep = np.repeat(stays, length)
                seq, sym, rank = seq[keep], sym[keep], rank[keep]
                low, length = low[stays], length[stays]
                if not len(seq):
                    return count
            hit = rank == np.repeat(low, length)
            # of touching places (x x x) every other one, from the left, is merged
            start = hit & ~np.concatenate(([False], hit[:-1]))
            place = np.flatnonzero(hit)
            begin = np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))[place]
            place = place[(place - begin) % 2 == 0]
            sym[place] = self.made[rank[place]]
            keep = np.ones(len(seq), bool)
            keep[place + 1] = False
            at = np.cumsum(keep) - 1
            seq, sym, rank = seq[keep], sym[keep], rank[keep]
            now = at[place]
            touched = np.zeros(len(seq), bool)
            touched[now] = True
            touched[now[now > 0] - 1] = True
            stale = np.flatnonzero(touched)
            rank[stale] = self.none
            stale = stale[stale + 1 < len(seq)]
            stale = stale[seq[stale] == seq[stale + 1]]
            rank[stale] = self.ranks(sym[stale], sym[stale + 1])

    def _counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [self.pre_tokens(t) for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        of = np.repeat(np.arange(len(texts)), n)
        total = np.bincount(of, self.merged(flat), len(texts)) if flat else np.zeros(len(texts))
        return total.astype(np.int64), np.ones(len(texts), np.int64)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        p = Pieces(data, offsets)
        first, _ = self.cache.resolve(p)
        sums = np.concatenate(([0], np.cumsum(self.cache.values[first].astype(np.int64))))
        out = np.diff(sums[p.bounds])
        for d in p.whole:
            text = data[offsets[d] : offsets[d + 1]].tobytes().decode()
            parts = self.split_special.split(text) if self.split_special else [text]
            counts, _ = self._counts(parts)
            out[d] = counts.sum() + len(parts) - 1
        return out


@lru_cache(maxsize=1)
def merger(path: str) -> Merger:
    """The merger of this Python worker: tasks that follow each other share its cache."""
    return Merger(path)


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit."""
    path = tokenizer or default_tokenizer()

    def rows(batches):
        for batch in batches:
            for part, data, at in pieces(batch):
                n = merger(path).count(data, at)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(rows, SCHEMA)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")))
