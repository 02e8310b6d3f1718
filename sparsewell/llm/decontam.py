"""Benchmark decontamination with a distributed positional inverted index.

:func:`build_index` stores, for every few megabytes of documents (a shard), the word
positions of each term.  Only terms of the benchmark get postings, as others cannot
match; if the benchmark has more than ``MAX_TERMS`` of them, all terms do.  A window is
searched for by intersecting the offset-adjusted position lists of its terms, from the
rarest in the shard on; as all its words take part, what is left are exact phrases.

An item matches by proximity where, for some place of its first word, at least
``NEAR_PERCENT`` of its words stand within ``SLOP`` words of their places, all in one
document (a word that the item repeats is looked for at each of its places).  If m words
may be missing, one of any m + 1 is not, so the m + 1 words that are rarest in the shard
propose the places, and the others are looked up, rarest first, until too many are
missing.  Which words are rarest changes the cost, never the matches.

The benchmark is the stated query set: it is dealt into blocks of bounded size, and
every block is searched for in all shards.

Defined cases: a null or blank text has no words and is not contaminated; an item with
no words, or without an id, matches nothing, and one of fewer than three different words
nothing by proximity; items of equal id count once; a null doc_id is kept; equal
documents each give a row; empty tables give empty results (no benchmark: nothing is
contaminated); further columns are ignored, and kept by :func:`clean_documents`.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import packed, unpacked
from .store import dealt, saved
from .wordhash import ALPHANUMERIC, Words, pieces, text_bytes

WINDOW, SLOP, NEAR_PERCENT = 13, 8, 80
#: Bytes of document text in a shard.
SHARD_BYTES = 4 << 20
#: Bytes of benchmark text in a block, and terms of the whole benchmark sent to all tasks.
BLOCK_BYTES, MAX_TERMS = 4 << 20, 4 << 20
INDEX = "shard string, docs binary, keys binary, nulls binary, bounds binary, terms binary, counts binary, places binary"


#: More than the words of a text and of an item: (text, place) as one number.
_SPAN = 1 << 36


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def build_index(docs: DataFrame, terms: np.ndarray | None) -> DataFrame:
    """The stored index, a row a shard.  terms: those that get postings, ascending (None:
    all).  Position lists follow each other in the order of terms, as differences."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def rows(batches):
        wanted = shared.value
        for batch in batches:
            for part, data, at in pieces(batch, limit=SHARD_BYTES):
                words = Words(data, at, ALPHANUMERIC)
                if wanted is None:
                    place = np.arange(len(words.hash))
                elif len(wanted):
                    i = np.minimum(np.searchsorted(wanted, words.hash), len(wanted) - 1)
                    place = np.flatnonzero(wanted[i] == words.hash)
                else:
                    place = np.zeros(0, np.int64)
                h = words.hash[place]
                order = np.argsort(h, kind="stable")
                found, count = np.unique(h[order], return_counts=True)
                step = np.diff(place[order], prepend=0)
                doc_id = part.column("doc_id").cast(pa.int64())
                null = doc_id.is_null().to_numpy(zero_copy_only=False)
                row = [uuid.uuid4().hex, _bytes(doc_id.fill_null(0).to_numpy(), "<i8"), _bytes(part.column("key").to_numpy(), "<i8"), _bytes(null, "u1"), _bytes(words.bounds, "<i8"), _bytes(found, "<u8"), _bytes(count, "<i4"), zstandard.ZstdCompressor(level=1).compress(_bytes(step, "<i4").ljust(1, b"\0"))]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if k == 0 else pa.binary()) for k, x in enumerate(row)], names=[x.split()[0] for x in INDEX.split(", ")])

    return saved(docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(rows, INDEX), "positional-index")


class Shard:
    def __init__(self, row: dict):
        self.shard = row["shard"]
        self.docs, self.keys = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["keys"], "<i8")
        self.null = np.frombuffer(row["nulls"], np.uint8).astype(bool)
        self.bounds = np.frombuffer(row["bounds"], "<i8")
        self.terms, self.counts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["counts"], "<i4").astype(np.int64)
        raw = zstandard.ZstdDecompressor().decompress(row["places"])
        self.places = np.cumsum(np.frombuffer(raw[: len(raw) // 4 * 4], "<i4").astype(np.int64))
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.doc = np.repeat(np.arange(len(self.docs)), np.diff(self.bounds))

    def lookup(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First posting and number of postings of each term."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return self.first[i], np.where(self.terms[i] == terms, self.counts[i], 0)


class Block:
    """Items of the benchmark: words as numbers of ``terms``, and the distinct windows."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        data, at = text_bytes(pa.array([t for _, t in items], pa.string()))
        words = Words(data, at, ALPHANUMERIC)
        self.terms, number = np.unique(words.hash, return_inverse=True)
        self.ids = [i for i, _ in items]
        self.items = [number[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        self.windows: list[tuple[int, np.ndarray]] = []
        for k, own in enumerate(self.items):
            if len(own):
                n = min(window, len(own))
                self.windows += [(k, own[i : i + n]) for i in range(len(own) - n + 1)]

    def search(self, s: Shard, slop: int = SLOP) -> tuple[list[np.ndarray], list[set[int]], list[set[int]]]:
        """Per document of the shard: places of words that are hit, items with exact and
        items with proximity matches."""
        first, count = s.lookup(self.terms)
        lists = lambda t: s.places[first[t] : first[t] + count[t]]
        edge = np.zeros(len(s.doc) + 1, np.int64)
        exact: list[set[int]] = [set() for _ in s.docs]
        near: list[set[int]] = [set() for _ in s.docs]
        for k, terms in self.windows:
            n = count[terms]
            order = np.argsort(n, kind="stable")
            if not n[order[0]]:
                continue
            start = lists(terms[order[0]]) - order[0]
            start = start[(start >= 0) & (start + len(terms) <= len(s.doc))]
            for j in order[1:]:
                if not len(start):
                    break
                places = lists(terms[j])
                at = np.minimum(np.searchsorted(places, start + j), len(places) - 1)
                start = start[places[at] == start + j]
            start = start[s.doc[start] == s.doc[start + len(terms) - 1]]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + len(terms), -1)
            for d in np.unique(s.doc[start]):
                exact[d].add(k)
        for k in range(len(self.items)):
            for d in self.near(s, k, count, lists, slop):
                near[d].add(k)
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        cuts = np.searchsorted(hit, s.bounds)
        return [hit[a:b] - lo for a, b, lo in zip(cuts[:-1], cuts[1:], s.bounds[:-1], strict=True)], exact, near

    def near(self, s: Shard, k: int, count: np.ndarray, lists, slop: int) -> np.ndarray:
        """Documents of the shard in which item ``k`` matches by proximity."""
        own = self.items[k]
        may_miss = len(own) - -(-NEAR_PERCENT * len(own) // 100)
        order = np.argsort(count[own], kind="stable")
        if len(np.unique(own)) < 3 or not count[own[order[may_miss]]]:
            return np.zeros(0, np.int64)
        places = [(lists(own[j]), j) for j in order[: may_miss + 1]]
        at = np.concatenate([x for x, _ in places])
        start = np.concatenate([x - j for x, j in places])
        doc, start = np.divmod(np.unique(s.doc[at] * _SPAN + start - s.bounds[s.doc[at]] + _SPAN // 2), _SPAN)
        start += s.bounds[doc] - _SPAN // 2
        # first around a place that one word proposes, which may be off by the slop itself
        doc, start = self._present(s, own, order, lists, doc, start, 2 * slop, may_miss)
        shift = np.arange(-slop, slop + 1)
        doc, start = np.repeat(doc, len(shift)), (start[:, None] + shift).reshape(-1)
        return np.unique(self._present(s, own, order, lists, doc, start, slop, may_miss)[0])

    def _present(self, s: Shard, own: np.ndarray, order: np.ndarray, lists, doc: np.ndarray, start: np.ndarray, reach: int, may_miss: int) -> tuple[np.ndarray, np.ndarray]:
        """Those places of an item's first word around which at most ``may_miss`` words are
        farther than ``reach`` from their places."""
        missing = np.zeros(len(start), np.int64)
        for j in order:
            if not len(start):
                break
            x = lists(own[j])
            if len(x):
                lo = np.maximum(start + j - reach, s.bounds[doc])
                i = np.searchsorted(x, lo)
                missing += (i == len(x)) | (x[np.minimum(i, len(x) - 1)] > np.minimum(start + j + reach, s.bounds[doc + 1] - 1))
            else:
                missing += 1
            stay = missing <= may_miss
            doc, start, missing = doc[stay], start[stay], missing[stay]
        return doc, start


FOUND = "shard string, place int, doc_id long, key long, n_words long, hits array<int>, items array<string>, near array<string>"


def search(index: DataFrame, items: list[tuple[str, str | None]], window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Matches of one block of items: a row a document."""
    shared = index.sparkSession.sparkContext.broadcast(items)

    def rows(batches):
        block = Block(shared.value, window)
        for batch in batches:
            for i in range(batch.num_rows):
                s = Shard(batch.slice(i, 1).to_pylist()[0])
                hits, exact, near = block.search(s, slop)
                names = lambda found: [sorted({block.ids[k] for k in one}) for one in found]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.shard] * len(s.docs)), pa.array(np.arange(len(s.docs)), pa.int32()), pa.array(s.docs.astype(np.int64), mask=s.null), pa.array(s.keys.astype(np.int64)), pa.array(np.diff(s.bounds).astype(np.int64)), pa.array(hits, pa.list_(pa.int32())), pa.array(names(exact), pa.list_(pa.string())), pa.array(names(near), pa.list_(pa.string()))],
                    names=[x.split()[0] for x in FOUND.split(", ")],
                )

    return index.mapInArrow(rows, FOUND)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, key (hash of the text), n_words, hits (places of hit words), items (exact),
    near (proximity)."""
    own = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("id"), "text")
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)))
    blocks = lambda: ([tuple(r) for r in dealt.where(F.col("block") == b).select("id", "text").collect()] for b in range(n_blocks))
    terms: np.ndarray | None = np.zeros(0, np.uint64)
    for items in blocks():
        terms = np.union1d(terms, Block(items).terms)
        if len(terms) > MAX_TERMS:
            terms = None
            break
    index = build_index(docs, terms)
    found = [search(index, items, window, slop) for items in blocks()]
    if n_blocks == 1:
        return found[0].drop("shard", "place")
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return every.groupBy("shard", "place", "doc_id", "key", "n_words").agg(merged("hits"), merged("items"), merged("near")).drop("shard", "place")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated, n_near."""
    m = matches(docs, benchmark).withColumn("n_hit", F.size("hits").cast("long"))
    return m.select(
        "doc_id", "key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark passage, all columns: a single hit window is
    enough to go, however long the text around it is."""
    bad = contamination(docs, benchmark).where("n_hit > 0").select(F.col("doc_id").alias("of"), F.col("key").alias("of_key")).distinct()
    own = packed(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("key"))
    return unpacked(own.join(bad, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left_anti"))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(dealt(docs), items).drop("key")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win
       FROM b, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS u(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) AS u(i)),
m AS (SELECT doc_id, item, i, n FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id),
bt AS (SELECT item, i, w[i] AS word, len(w) AS n FROM b, unnest(range(1, len(w) + 1)) AS u(i) WHERE len(list_distinct(w)) >= 3),
dt AS (SELECT doc_id, i AS p, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
cand AS (SELECT doc_id, item FROM (SELECT DISTINCT doc_id, word FROM dt) JOIN bt USING (word) GROUP BY ALL HAVING 100 * count(*) >= {NEAR_PERCENT} * any_value(n)),
met AS (SELECT doc_id, item, i, n, p - i AS s0 FROM cand JOIN bt USING (item) JOIN dt USING (doc_id, word)),
spread AS (SELECT DISTINCT doc_id, item, i, n, s0 + v.o AS s FROM met, (SELECT unnest(range(-{SLOP}, {SLOP} + 1)) AS o) v),
nr AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM (SELECT doc_id, item FROM spread GROUP BY doc_id, item, s HAVING 100 * count(*) >= {NEAR_PERCENT} * any_value(n)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)
"""
