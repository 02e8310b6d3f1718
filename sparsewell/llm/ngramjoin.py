"""N-gram Jaccard join with token-combination prefixes.

A document is its set of 5-word shingles; two link when 100 * |A and B| >= 80 * |A or B|.
Documents of equal sets are one class from the start.

**Prefixes.**  All shingles have one order: by level, the logarithm of their document
frequency, then by hash.  A set of n shingles lacks at most t = n - ceil(0.8 n) of a
linked set's, so if both sets' prefixes hold more than t shingles in this order they
share one.  Rare shingles (level below ``FREQUENT``) are indexed alone.  Where a set has
too few rare ones, its prefix is extended into the frequent class, whose members are
dealt into G groups by hash and indexed as pairs within a group: of p shingles in a
group p - 1 count, since two linked sets that share fewer than two of them lack p - 1.
The prefix ends where the counts exceed t.  G depends on the size of the set; near the
sizes where it changes, both values are indexed, so linked sets always have one in
common.  A shingle of one document only takes its place in the prefix but no posting.

**Document frequencies** are counted exactly, over all documents, from sorted hash
lists, and end in two tables that all tasks get.  One has a bit for a hash, set if a
shingle of two documents has it; it grows with the corpus from 8 MB to 128 MB
(``SEEN_BITS``), so that most shingles of one document are known as such: texts without a
copy give no postings as long as less than four fifths of the bits are set.  The other,
32 MB, has levels from 2 on, 4 bits for ``TABLE_BITS`` bits of hash.  A slot has the
level of its most frequent shingle; two shingles in one slot only cost selectivity, as
any order gives the same links.  Where both tables are full, everything is still found,
but every set has postings, and disk grows to more than twice as much.

**Verification** does not take all pairs of a list.  First every member is compared
with the list's hub only, the set with the fewest shingles of its own (of near copies
that is their original), and the links found make components.  Lists that still span
several components are then joined by differences: if D(x) is the symmetric difference
of x and the hub, x and y differ in |D(x)| + |D(y)| - 2 |D(x) and D(y)| shingles, and
link if these are at most (n(x) + n(y)) / 9.  Of two sets in different components one, x,
is not linked to the hub, so |D(x)| > (n(x) + n(hub)) / 9; it follows that y must share
more than (|D(y)| + (n(hub) - n(y)) / 9) / 2 of its differences with x, and x at least
|D(x)| - n(x) / 4 of its own with y.  Both are prefix filters, and as near copies mostly
differ from the original in shingles of their own, few candidates remain.  All candidates
are compared.  Sets are compared by 48 bits of their shingles' hashes.

Where the differences are frequent themselves, as in texts put together from a stock of
passages, these filters keep most pairs.  The pairs are therefore counted first: a list
(hub) that would give more than ``PAIRS`` a member is crowded, and its members have a
second way.  Shingles whose members have the same least values of four hashes are one
class; a passage is mostly one class, although texts with edits lack some of it.  A text
has a class if it holds three quarters of it, has it not if it holds a quarter at most,
and may count either way between.  If one of two texts has a class and the other has it
not, they differ in half of it, so linked sets agree on all heavy classes (of about a
fourteenth of a set at least) but some of bounded weight.  A member is indexed under its
heavy classes less each set of them within that bound, and linked sets meet under those
that both have; one of the two leaves out no more than half of the bound, so entries that
leave out more are joined with such ones only.  Members whose heavy classes outweigh the
bound find all their links so, and go the way that gives them fewer candidates.  How well
classes fit passages changes the cost alone.  What remains quadratic are crowded lists
without heavy classes, as of texts of dozens of short passages.

Defined cases: a text without words is empty, links with nothing and is a component of
its own; a text of fewer than five words has one shingle, its whole sequence; equal rows
have the same component; a null doc_id is linked like others but never the least; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .rows import packed, unpacked
from .store import dealt, saved, scratch, shuffles_removed, small_batches
from .wordhash import BLANK_SEPARATED, Words, mixed, pieces, shingles, trim

K, PERCENT = 5, 80
#: Level (log2 of document frequency) from which shingles are indexed in pairs.
FREQUENT = 4
TABLE_BITS, TOP_LEVEL = 26, 15
#: Bits of hash of the table of shingles of two documents: one bit for four shingles of the
#: corpus, at least and at most.
SEEN_BITS = 26, 30
#: Tasks that share the rows of one key, and pairs of a key from which they do.
SALTS, SHARED = 16, 1 << 16
#: Candidate pairs a member from which on a list is crowded.
PAIRS = 16
#: Shingles counted in one task before they are sent on, and in one bucket of counts.
COUNT_RUN, BUCKET_SHINGLES = 2 << 20, 1 << 18
_U = np.uint64


def _sets(batches):
    """For each run of texts: the batch, all shingles, and their bounds."""
    for batch in batches:
        for part, data, at in pieces(batch):
            s, bounds = shingles(Words(data, at, BLANK_SEPARATED), K)
            yield part, s, bounds


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


DOCS = "doc_id long, key long, n int, sid long"


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), n (shingles), sid (a hash of the set)."""

    def rows(batches):
        for part, s, bounds in _sets(batches):
            sid = [set_id(s[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield _batch(DOCS, part.column("doc_id").cast(pa.int64()), part.column("key"), np.diff(bounds), sid)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(rows, DOCS)


COUNTS = "bucket long, hashes binary, counts binary"


Levels = tuple[np.ndarray, np.ndarray]


def seen_bits(total: int) -> int:
    """Of a corpus of so many shingles."""
    return min(max((total // 4).bit_length(), SEEN_BITS[0]), SEEN_BITS[1])


def frequency_table(docs: DataFrame, total: int) -> Levels:
    """The bits of shingles of two documents, and levels of all slots, two to a byte.
    total: shingles of all documents."""
    size = max(1, total).bit_length()
    bits = min(64, max(40, size + 13))  # of the hash: few of different shingles are equal
    seen_size = seen_bits(total)
    low = max(0, size - BUCKET_SHINGLES.bit_length() + 1)
    low = min(low, TABLE_BITS - 1, seen_size - 3)

    def count(batches):
        held, n = [], 0

        def runs():
            h, c = np.unique(np.concatenate(held) >> _U(64 - bits), return_counts=True)
            bucket = (h >> _U(bits - low)).astype(np.int64) if low else np.zeros(len(h), np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            packer = zstandard.ZstdCompressor(level=1)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)], strict=True):
                step = np.diff(h[a:b], prepend=_U(0)).astype("<u8")
                planes = step.view(np.uint8).reshape(-1, 8).T.tobytes()  # bytes of one rank together
                yield int(bucket[a]), packer.compress(planes), packer.compress(np.minimum(c[a:b], 65535).astype("<u2").tobytes())

        for _, s, _ in _sets(batches):
            held.append(s)
            n += len(s)
            if n >= COUNT_RUN:
                yield _batch(COUNTS, *zip(*runs(), strict=True))
                held, n = [], 0
        if n:
            yield _batch(COUNTS, *zip(*runs(), strict=True))

    def levels(table: pa.Table) -> pa.Table:
        packer = zstandard.ZstdDecompressor()
        hs, cs = [], []
        for raw, counts in zip(table.column("hashes").to_pylist(), table.column("counts").to_pylist(), strict=True):
            planes = np.frombuffer(packer.decompress(raw), np.uint8).reshape(8, -1)
            hs.append(np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=_U))
            cs.append(np.frombuffer(packer.decompress(counts), "<u2").astype(np.int64))
        h, c = np.concatenate(hs), np.concatenate(cs)
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        df = np.add.reduceat(c, first)
        h, df = h[first][df > 1], df[df > 1]
        slot = lambda h, of: (h >> _U(bits - of)).astype(np.int64) & ((1 << (of - low)) - 1)
        pack = zstandard.ZstdCompressor(level=1).compress
        seen = np.zeros(1 << (seen_size - low), bool)
        seen[slot(h, seen_size)] = True
        seen = pack(np.packbits(seen, bitorder="little").tobytes())
        h, df = h[df > 3], df[df > 3]
        out = np.zeros(1 << (TABLE_BITS - low), np.uint8)
        np.maximum.at(out, slot(h, TABLE_BITS), np.minimum(np.log2(df).astype(np.uint8), TOP_LEVEL))
        out = pack((out[::2] | (out[1::2] << 4)).tobytes())
        return pa.table({"bucket": table.column("bucket")[:1].cast(pa.int64()), "seen": pa.array([seen], pa.binary()), "levels": pa.array([out], pa.binary())})

    found = docs.select("doc_id", "text").mapInArrow(count, COUNTS).groupBy("bucket").applyInArrow(levels, "bucket long, seen binary, levels binary")
    tables = np.zeros(1 << (seen_size - 3), np.uint8), np.zeros(1 << (TABLE_BITS - 1), np.uint8)
    unpack = zstandard.ZstdDecompressor().decompress
    with scratch(docs.sparkSession, keep=()):
        for bucket, *packed in saved(found, "ngram-levels").toLocalIterator():  # so that the driver holds one partition
            for table, part in zip(tables, packed, strict=True):
                part = np.frombuffer(unpack(bytes(part)), np.uint8)
                table[bucket * len(part) : (bucket + 1) * len(part)] = part
    return tables


def look_up(tables: Levels, h: np.ndarray) -> np.ndarray:
    """The level of each hash: 0 of shingles of one document, but for those whose bit
    another has set."""
    seen, levels = tables
    slot = (h >> _U(62 - len(seen).bit_length())).astype(np.int64)
    at = np.flatnonzero((seen[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
    slot = (h[at] >> _U(64 - len(levels).bit_length())).astype(np.int64)
    out = np.zeros(len(h), np.uint8)
    out[at] = np.maximum((levels[slot >> 1] >> ((slot & 1) << 2).astype(np.uint8)) & 15, 1)
    return out


def allowed_missing(n: int) -> int:
    """Of n shingles, how many a linked set may lack."""
    return n - -(-PERCENT * n // 100)


def group_counts(n: int) -> set[int]:
    """Numbers of groups of the frequent class that sets of linked sizes can have."""
    step = lambda m: 4 ** (max(0, (m // 16).bit_length() - 1) // 2)
    return {step(PERCENT * n // 100), step(-(-100 * n // PERCENT))}


def signatures(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """What a set (of four shingles at least) is indexed under."""
    order = np.lexsort((h, level))
    h, level = h[order], level[order]
    need = allowed_missing(len(h)) + 1
    rare = int((level < FREQUENT).sum())
    singles = slice(0, min(rare, need))
    out = [mixed(h[singles][level[singles] > 0])]
    if rare < need:
        h = h[rare:]
        for groups in group_counts(len(order)):
            g = ((h >> _U(8)) & _U(groups - 1)).astype(np.int64)
            _, first = np.unique(g, return_index=True)
            counts = np.ones(len(g), np.int64)
            counts[first] = 0
            end = int(np.searchsorted(np.cumsum(counts), need - rare)) + 1
            by = np.argsort(g[:end], kind="stable")
            for own in np.split(h[:end][by], np.flatnonzero(np.diff(g[:end][by])) + 1):
                if len(own) > 1:
                    a, b = np.triu_indices(len(own), 1)
                    out.append(mixed(mixed(own[a] + _U(groups)) + own[b]))
    return np.concatenate(out)


POSTINGS = "sig long, sid long, n int, alone int"


def postings(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """The postings of all sets; shared: the table of levels, sent to all tasks once."""

    def rows(batches):
        levels = shared.value
        for _, s, bounds in _sets(batches):
            level = look_up(levels, s)
            n = np.diff(bounds)
            alone = np.concatenate(([0], np.cumsum(level == 0)))
            alone = alone[bounds[1:]] - alone[bounds[:-1]]
            out: list[tuple[np.ndarray, int, int, int]] = []
            for d in np.flatnonzero((n > 3) & (alone <= n - -(-PERCENT * n // 100))).tolist():
                a, b = bounds[d], bounds[d + 1]
                sig = signatures(s[a:b], level[a:b])
                if len(sig):
                    out.append((sig, set_id(s[a:b]), b - a, alone[d]))
            if out:
                sig, *rest = zip(*out, strict=True)
                yield _batch(POSTINGS, np.concatenate(sig).view(np.int64), *(np.repeat(x, [len(y) for y in sig]) for x in rest))

    return docs.select("doc_id", "text").mapInArrow(rows, POSTINGS)


SETS = "sid long, hashes binary"


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid and the set, 6 bytes a shingle, of the documents ``wanted`` (_id, _key)."""

    def rows(batches):
        for _, s, bounds in _sets(batches):
            six = np.ascontiguousarray((s >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield _batch(SETS, [set_id(s[a:b])], [six[a:b].tobytes()])

    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    return docs.select("doc_id", "text").join(wanted, own, "left_semi").mapInArrow(rows, SETS)


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that link."""

    def rows(batches):
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                p, q = sorted((_wide(x), _wide(y)), key=len)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                same = int((q[at] == p).sum())
                if 100 * same >= PERCENT * (len(p) + len(q) - same):
                    out.append((a, b))
            if out:
                yield _batch("a long, b long", *zip(*out, strict=True))
            trim()

    side = lambda k, v: sets.select(F.col("sid").alias(k), F.col("hashes").alias(v))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(rows, "a long, b long")


DIFFERENCES = "hub long, token long, sid long, n int, root long, as_x boolean, as_y boolean"


def differences(members: DataFrame, sets: DataFrame, shared: Broadcast) -> DataFrame:
    """For members (hub, sid, n, root) of lists, the prefixes of their differences from the
    hub, rarest first: the part that counts for a set not linked to the hub (as_x), and for
    any partner of such a set (as_y).  Shingles of this document only take their places but
    give no row; those of the hub only come last, as all its members lack them."""

    def rows(batches):
        levels = shared.value
        for batch in batches:
            for hub, sid, n, root, x, y in zip(*(batch.column(c).to_pylist() for c in ("hub", "sid", "n", "root", "x", "y")), strict=True):
                h, own = _wide(x), _wide(y)
                d = np.setxor1d(h, own, assume_unique=True)
                level = look_up(levels, d << _U(16))
                level[(level == 0) & np.isin(d, h, assume_unique=True)] = TOP_LEVEL + 1
                order = np.lexsort((d, level))
                d, level, size = d[order], level[order], len(d)
                apart = 9 * size > n + len(h)
                end_x = min(size, size - max(1, size - n // 4) + 1) if apart else 0
                end_y = max(0, size - (9 * size + len(h) - n) // 18)
                at = np.flatnonzero(level[: max(end_x, end_y)] > 0)
                if len(at):
                    same = lambda v: np.full(len(at), v)  # noqa: B023, E731
                    yield _batch(DIFFERENCES, same(hub), d[at].view(np.int64), same(sid), same(n), same(root), at < end_x, at < end_y)

    side = lambda k, v: sets.select(F.col("sid").alias(k), F.col("hashes").alias(v))
    m = members.join(side("hub", "x"), "hub").join(side("sid", "y"), "sid")
    return m.select("hub", "sid", "n", "root", "x", "y").mapInArrow(rows, DIFFERENCES)


def _sizes_fit(n, m):
    return PERCENT * F.greatest(n, m) <= 100 * F.least(n, m)


def _salt(of: str = "sid"):
    return F.pmod(of, F.lit(SALTS)).cast("int").alias("salt")


def _salts():
    """The salts that rows of a group have, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("salt"))).alias("salts")


def _each_salt():
    """A row for each salt that the group has: a join on (key, salt) then repeats a group's
    row no more often than it has rows, and no task takes a whole frequent key."""
    has = lambda k: F.col("salts").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) != 0
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), has)).alias("salt")


def _met(x: DataFrame, y: DataFrame, key: list[str]) -> DataFrame:
    """Pairs (a, b) of x and y with equal keys, of different components and fitting sizes.
    Both have sid, n, root, lost (twice the shingles that the other set lacks for sure) and
    pairs (of the key); keys of many pairs are dealt over tasks."""
    deal = F.when(F.col("pairs") > SHARED, SALTS).otherwise(1)
    x = x.select(*key, F.col("sid").alias("p"), F.col("n").alias("np"), F.col("root").alias("rp"), F.col("lost").alias("lp"), F.explode(F.sequence(F.lit(0), deal - 1)).alias("salt"))
    y = y.select(*key, F.col("sid").alias("q"), F.col("n").alias("nq"), F.col("root").alias("rq"), F.col("lost").alias("lq"), F.pmod(F.col("sid"), deal).cast("int").alias("salt"))
    met = x.join(y, [*key, "salt"]).where((F.col("rp") != F.col("rq")) & _sizes_fit(F.col("np"), F.col("nq")))
    met = met.where(9 * (F.col("lp") + F.col("lq")) <= 2 * (F.col("np") + F.col("nq")))
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


TOKENS = "sid long, token long"


def heavy_classes(members: DataFrame, sets: DataFrame, shared: Broadcast) -> DataFrame:
    """For members (sid, n, root): sid, n, root and classes (class, weight, has) of the heavy
    classes, those of about a fourteenth of a set (so few), that it has or may have."""

    def rows(batches):
        for batch in batches:
            for sid, raw in zip(batch.column("sid").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                h = _wide(raw)
                h = h[look_up(shared.value, h << _U(16)) > 0]
                yield _batch(TOKENS, np.full(len(h), sid), h.view(np.int64))

    tokens = saved(members.select("sid").join(sets, "sid").select("sid", "hashes").mapInArrow(rows, TOKENS).withColumn("salt", _salt()), "ngram-tokens")
    least = [F.min(F.xxhash64(F.lit(k), "sid")) for k in range(4)]
    kinds = tokens.groupBy("token").agg(F.xxhash64(*least).alias("class"), F.count("*").alias("c"), _salts()).where("c > 1")
    kinds = saved(kinds.select("token", "class", "salts"), "ngram-kinds")
    weights = kinds.groupBy("class").agg(F.count("*").cast("int").alias("weight"))
    own = tokens.join(kinds.select("token", "class", _each_salt()), ["token", "salt"]).groupBy("sid", "class").agg(F.count("*").alias("held"))
    own = own.join(members, "sid").where(F.col("held") * 8 * HEAVY >= F.col("n")).join(weights, "class")
    own = own.where((F.col("weight") * 2 * HEAVY >= F.col("n")) & (4 * F.col("held") > F.col("weight")))
    has = (4 * F.col("held") >= 3 * F.col("weight")).alias("has")
    return own.groupBy("sid", "n", "root").agg(F.array_sort(F.collect_list(F.struct("class", "weight", has))).alias("classes"))


#: A class is heavy if it has a tenth of the smaller of two linked sets, less up to a factor
#: of sqrt(2): the bounds are powers of it, so that both sets know them.
HEAVY = 10
#: Entries of a set from which it is left to the first way.
ENTRIES = 2000
CLASS_SIGNATURES = "sig long, sid long, n int, root long, lost int, small boolean, able boolean, listed boolean"


def heavy_bounds(n: int) -> list[float]:
    """The bounds of heavy classes that a set of n shingles may have in common with a linked
    one: of the smaller sets' sizes from 0.8 n on to n."""
    power = lambda m: int(np.floor(2 * np.log2(m / HEAVY) + 1e-9))
    return [2 ** (k / 2) for k in range(power(PERCENT * n / 100), power(n) + 1)]


def class_signatures(classes: list[tuple[int, int, bool]], n: int) -> tuple[dict[tuple[float, int], int], bool] | None:
    """What a set is indexed under, from (class, weight, has): the least weight left out for
    each, and whether that finds all its links; None: more than ``ENTRIES``."""
    out: dict[tuple[float, int], int] = {}
    able, spare = True, 2 * allowed_missing(n)
    for bound in heavy_bounds(n):
        heavy = sorted(((w, c, has) for c, w, has in classes if w >= bound), reverse=True)
        able = able and sum(w for w, _, has in heavy if has) > spare
        kept = [(0, 0, sum(c for _, c, _ in heavy), len(heavy))]  # place, weight left out, sum of classes, their number
        while kept:
            at, lost, total, size = kept.pop()
            if size:
                key = bound, total % (1 << 64)
                out[key] = min(lost, out.get(key, lost))
                if len(out) > ENTRIES:
                    return None
            for k in range(at, len(heavy)):
                w, c, has = heavy[k]
                if lost + w * has <= spare:
                    kept.append((k + 1, lost + w * has, total - c, size - 1))
    return out, able


def by_classes(heavy: DataFrame) -> DataFrame:
    """sig, sid, n, root, lost, small (lost is no more than half of what two sets may), able,
    listed (false: too many entries, and no sig) of members with heavy classes."""

    def rows(batches):
        for batch in batches:
            for sid, n, root, classes in zip(*(batch.column(c).to_pylist() for c in ("sid", "n", "root", "classes")), strict=True):
                found = class_signatures([(c["class"], c["weight"], c["has"]) for c in classes], n)
                if found is None:
                    yield _batch(CLASS_SIGNATURES, [None], [sid], [n], [root], [0], [False], [False], [False])
                elif found[0]:
                    sig = mixed(np.array([(total + int(bound * 1024)) % (1 << 64) for bound, total in found[0]], _U)).view(np.int64)
                    lost = np.array(list(found[0].values()))
                    yield _batch(CLASS_SIGNATURES, sig, *([v] * len(sig) for v in (sid, n, root)), lost, 4 * lost <= n, [found[1]] * len(sig), [True] * len(sig))

    return heavy.mapInArrow(rows, CLASS_SIGNATURES)


def _shared_differences(diff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those of the differences (see ``differences``) that two sets of a list may share, and
    their counts by hub and token."""
    diff = saved(diff, "ngram-prefixes")
    counts = diff.groupBy("hub", "token").agg(F.count_if("as_x").alias("cx"), F.count_if("as_y").alias("cy"), F.bit_or(F.call_function("shiftleft", F.lit(1), _salt())).alias("salts"))
    counts = saved(counts.where("cx > 0 and cy > 0").withColumn("pairs", F.col("cx") * F.col("cy")), "ngram-counts")
    each = counts.select("hub", "token", "cy", "pairs", F.lit(0).alias("lost"), _each_salt())
    return saved(diff.withColumn("salt", _salt()).join(each, ["hub", "token", "salt"]).drop("salt"), "ngram-differences"), counts


def candidates(members: DataFrame, sets: DataFrame, shared: Broadcast) -> DataFrame:
    """Pairs (a, b) of members (hub, sid, n, root) of lists among which are all links between
    different components (roots)."""
    with scratch(members.sparkSession, keep=("ngram-differences", "ngram-counts")):
        diff, counts = _shared_differences(differences(members, sets, shared))
    crowded = counts.groupBy("hub").agg(F.sum("pairs").alias("pairs")).join(members.groupBy("hub").agg(F.count("*").alias("size")), "hub")
    crowded = saved(crowded.where(F.col("pairs") > PAIRS * F.col("size")).select("hub"), "ngram-crowded")
    key, x, y = ["hub", "token"], diff.where("as_x"), diff.where("as_y")
    if crowded.isEmpty():
        return _met(x, y, key)
    some = members.join(crowded, "hub", "left_semi").select("sid", "n", "root").distinct()
    sigs = saved(by_classes(heavy_classes(saved(some, "ngram-members"), sets, shared)).withColumn("salt", _salt()), "ngram-classes")
    lists = sigs.where("listed").groupBy("sig").agg(F.count("*").alias("size"), F.count_if("small").alias("few"), _salts()).where("size > 1 and few > 0")
    lists = lists.select("sig", "size", "few", (F.col("size") * F.col("few")).alias("pairs"), _each_salt())
    listed = saved(sigs.join(lists, ["sig", "salt"]).drop("salt"), "ngram-class-lists")
    able = sigs.where("able").select("sid").distinct()
    one = listed.groupBy("sid").agg(F.sum(F.when(F.col("small"), F.col("size")).otherwise(F.col("few"))).alias("one"))
    other = x.join(crowded, "hub", "left_semi").groupBy("sid").agg(F.sum("cy").alias("other"))
    chosen = able.join(other, "sid").join(one, "sid", "left").where(F.coalesce("one", F.lit(0)) <= F.col("other")).select("sid")
    chosen = saved(chosen, "ngram-chosen")
    x = x.join(crowded.withColumn("full", F.lit(True)), "hub", "left").join(chosen.withColumn("other_way", F.lit(True)), "sid", "left")
    second = F.col("full").isNotNull() & F.col("other_way").isNotNull()
    met = _met(x.where(~second), y, key)
    unlisted = saved(sigs.where("not listed").select("sid"), "ngram-unlisted")
    if not unlisted.isEmpty():
        met = met.unionByName(_met(x.where(second), y.join(unlisted, "sid", "left_semi"), key))
    mine = listed.join(chosen, "sid", "left_semi")
    met = met.unionByName(_met(mine.where("small"), listed, ["sig"])).unionByName(_met(mine.where("not small"), listed.where("small"), ["sig"]))
    return met.distinct()


def _lists(post: DataFrame) -> DataFrame:
    """The postings of lists of two members at least, with their hubs."""
    hubs = post.groupBy("sig").agg(F.min(F.struct("alone", "sid", "n")).alias("hub"), F.count("*").alias("members"), _salts()).where("members > 1")
    hubs = hubs.select("sig", "hub", "members", "salts", _each_salt())
    return saved(post.join(hubs, ["sig", "salt"]).select("sig", "sid", "n", F.col("hub.sid").alias("hub"), F.col("hub.n").alias("hub_n"), "members", "salt"), "ngram-lists")


def linked_components(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, component_id (least doc_id reachable by
    links), component (a number of its own; null: an empty set, alone)."""
    spark = docs.sparkSession
    with shuffles_removed(spark), small_batches(spark), scratch(spark, keep=("ngram-sets", "ngram-links", "roots")):
        return _linked_components(docs)  # small batches, as a pair to compare brings two sets with it


def _linked_components(docs: DataFrame) -> DataFrame:
    own = saved(document_sets(docs), "ngram-sets").withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int"))
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    reps = own.where("n > 0").groupBy("sid").agg(least.alias("r"), F.count("*").alias("copies"), _salts())
    reps = reps.select("sid", F.col("r.doc_id").alias("rep"), F.col("r.key").alias("rep_key"), "copies", "salts")
    shared = docs.sparkSession.sparkContext.broadcast(frequency_table(docs, total))
    with scratch(docs.sparkSession, keep=("ngram-lists",)):
        post = _lists(saved(postings(docs, shared).distinct().withColumn("salt", _salt()), "ngram-postings"))

    stars = post.where((F.col("sid") != F.col("hub")) & _sizes_fit(F.col("n"), F.col("hub_n")))
    stars = saved(stars.select(F.least("hub", "sid").alias("a"), F.greatest("hub", "sid").alias("b")).distinct(), "ngram-stars")
    wanted = post.select("sid").distinct().join(reps, "sid").select(F.col("rep").alias("_id"), F.col("rep_key").alias("_key")).distinct()
    sets = saved(sets_of(docs, wanted), "ngram-compared")
    links = saved(verified(stars, sets), "ngram-links")
    roots = components(links)

    # lists that still span components
    named = post.where("members > 2").join(roots.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    split = named.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), _salts()).where("lo <> hi").select("sig", _each_salt())
    members = saved(named.join(split, ["sig", "salt"], "left_semi").where("sid <> hub").select("hub", "sid", "n", "root").distinct(), "ngram-members")
    met = candidates(members, sets, shared)
    more = saved(verified(met.join(stars, ["a", "b"], "left_anti"), sets), "ngram-links")
    shared.unpersist()  # whatever needs it is saved
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    named = reps.join(roots.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("size")).where("size > 1")
    of = named.join(least, "root").select(F.col("sid").alias("_sid"), "component_id", "root", _each_salt().alias("_salt"))
    out = own.join(of, (F.col("sid") == F.col("_sid")) & (F.col("salt") == F.col("_salt")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.coalesce("root", "sid"))
    return out.select("doc_id", "key", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), component.alias("component"))


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns: that of the least doc_id (null last;
    of equal ones the least text hash).  Empty documents stay; of equal rows one stays."""
    c = linked_components(docs)
    best = c.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"))
    stay = best.select(F.col("best.doc_id").alias("of"), F.col("best.key").alias("of_key"))
    stay = stay.unionByName(c.where(F.col("component").isNull()).select(F.col("doc_id").alias("of"), F.col("key").alias("of_key")))
    own = packed(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("key"))
    out = own.join(stay.distinct(), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left_semi")
    return unpacked(out.dropDuplicates(["doc_id", "key"]))


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return linked_components(dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s FROM d, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.b, reach.root FROM reach JOIN link ON reach.doc_id = link.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""
