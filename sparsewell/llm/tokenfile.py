"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of many documents end to end in blocks of 256.  Of each block the
minimum is subtracted and the differences are packed with a width chosen at a
percentile of their lengths in bits; the few that do not fit are outliers, kept whole
in the block's exception list.  At the end stand the documents (id, number of tokens)
and the start of every block, so that any document is read without what is before it.

    magic "PFOR1\\0\\0\\0"
    block: minimum u32, width u8, exceptions u16, packed differences 32 * width bytes,
           then place u8 and difference u32 of each exception
    tail:  block starts u64, document ids i64, null flags u8, token counts u64
    end:   n_blocks u64, n_documents u64, n_tokens u64, tail start u64, magic

Defined cases: a null or blank text has the end id alone; a null doc_id comes first;
rows of equal doc_id are ordered by the hash of their text; an empty table makes no
files; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .files import open_new, open_old
from .pretokens import default_tokenizer, encoder
from .store import new_path, saved
from .wordhash import pieces

MAGIC, BLOCK, PERCENTILE, END_ID = b"PFOR1\0\0\0", 256, 95, 2
#: Bytes of text in a file: tables below these times the tasks are dealt over all tasks,
#: larger ones make as many files as they need.
LEAST_BYTES, MOST_BYTES = 4 << 20, 256 << 20
#: Tokens of a segment, the unit of reading (whole documents, one at least).
SEGMENT = 1 << 20
HEAD, END = struct.Struct("<IBH"), struct.Struct("<QQQQ8s")


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)  # exact below 2**53


def pack_bits(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of 256 numbers as 32 * width bytes each, lowest bits first."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(x.astype(f"<u{width // 8}")).view(np.uint8).reshape(len(x), -1)
    bits = (x.astype(np.uint32)[:, :, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(bits.reshape(len(x), -1), axis=1, bitorder="little")


def unpack_bits(raw: np.ndarray, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.ascontiguousarray(raw).view(f"<u{width // 8}").astype(np.uint32)
    if not width:
        return np.zeros((len(raw), BLOCK), np.uint32)
    bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(raw), BLOCK, width)
    full = np.zeros((len(raw), BLOCK, 32), np.uint8)
    full[:, :, :width] = bits
    return np.packbits(full.reshape(len(raw), -1), axis=1, bitorder="little").view("<u4")


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of a multiple of 256 ids."""
    x = ids.astype(np.uint32).reshape(-1, BLOCK)
    low = x.min(axis=1)
    x = x - low[:, None]
    lengths = bit_lengths(x)
    width = np.sort(lengths, axis=1)[:, BLOCK * PERCENTILE // 100]
    over = lengths > width[:, None]
    n_over = over.sum(axis=1)
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width):
        for part in np.array_split(rows := np.flatnonzero(width == w), -(-len(rows) // 512)):
            packed = pack_bits(np.where(over[part], 0, x[part]), int(w))
            for i, raw in zip(part.tolist(), packed, strict=True):
                out[i] = HEAD.pack(int(low[i]), int(w), int(n_over[i])) + raw.tobytes()
    for i in np.flatnonzero(n_over).tolist():
        at = np.flatnonzero(over[i])
        out[i] += at.astype(np.uint8).tobytes() + x[i, at].astype("<u4").tobytes()
    return out


def decode_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at ``starts`` in ``raw``."""
    heads = [HEAD.unpack_from(raw, s) for s in starts.tolist()]
    width = np.array([h[1] for h in heads])
    out = np.empty((len(heads), BLOCK), np.uint32)
    data = np.frombuffer(raw, np.uint8)
    for w in np.unique(width):
        for part in np.array_split(rows := np.flatnonzero(width == w), -(-len(rows) // 512)):
            where = starts[part][:, None] + HEAD.size + np.arange(32 * w)
            out[part] = unpack_bits(data[where], int(w))
    for i, (low, w, n) in enumerate(heads):
        if n:
            a = int(starts[i]) + HEAD.size + 32 * w
            out[i, data[a : a + n]] = np.frombuffer(raw, "<u4", n, a + n)
        out[i] += np.uint32(low)
    return out.reshape(-1)


class Writer:
    """A file of documents; :meth:`add` takes their ids end to end."""

    def __init__(self, folder: str):
        self.out, self.uri = open_new(folder, ".pfor")
        self.out.write(MAGIC)
        self.at, self.starts, self.docs, self.nulls, self.counts = len(MAGIC), [], [], [], []
        self.rest, self.n_docs, self.n_tokens = np.zeros(0, np.int32), 0, 0

    def _write(self, ids: np.ndarray) -> None:
        blocks = encode_blocks(ids)
        self.starts.append(self.at + np.concatenate(([0], np.cumsum([len(b) for b in blocks])[:-1])).astype(np.int64))
        self.out.write(b"".join(blocks))
        self.at += sum(map(len, blocks))

    def add(self, doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        ids = np.concatenate((self.rest, ids))
        full = len(ids) // BLOCK * BLOCK
        if full:
            self._write(ids[:full])
        self.rest = ids[full:]
        self.docs.append(doc_ids)
        self.nulls.append(null)
        self.counts.append(counts)
        self.n_docs += len(counts)
        self.n_tokens += int(counts.sum())

    def close(self) -> None:
        if len(self.rest):
            self._write(np.concatenate((self.rest, np.full(-len(self.rest) % BLOCK, self.rest.min(), np.int32))))
        starts, docs, nulls, counts = (np.concatenate(x) if x else np.zeros(0) for x in (self.starts, self.docs, self.nulls, self.counts))
        self.out.write(starts.astype("<u8").tobytes() + docs.astype("<i8").tobytes() + nulls.astype(np.uint8).tobytes() + counts.astype("<u8").tobytes())
        self.out.write(END.pack(len(starts), self.n_docs, self.n_tokens, self.at, MAGIC))
        self.out.close()


class Reader:
    def __init__(self, uri: str):
        self.file = open_old(uri)
        self.file.seek(self.file.size() - END.size)
        n_blocks, self.n_docs, self.n_tokens, tail, magic = END.unpack(self.file.read(END.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} does not end as a token file")
        self.file.seek(tail)
        raw, n = self.file.read(8 * n_blocks + 17 * self.n_docs), self.n_docs
        self.starts = np.append(np.frombuffer(raw, "<u8", n_blocks), tail).astype(np.int64)
        self.docs = np.frombuffer(raw, "<i8", n, 8 * n_blocks)
        self.null = np.frombuffer(raw, np.uint8, n, 8 * (n_blocks + n)).astype(bool)
        self.tokens = np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<u8", n, 8 * n_blocks + 9 * n)))).astype(np.int64)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids of documents lo to hi - 1, end to end; reads the blocks that hold them."""
        a, b = self.tokens[lo], self.tokens[hi]
        if a == b:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK, -(-b // BLOCK)
        self.file.seek(int(self.starts[first]))
        raw = self.file.read(int(self.starts[last] - self.starts[first]))
        return decode_blocks(raw, self.starts[first:last] - self.starts[first])[a - first * BLOCK : b - first * BLOCK]

    def close(self) -> None:
        self.file.close()


SEGMENTS = "file string, part int, doc_lo long, doc_hi long, token_lo long, token_hi long"


def n_files(docs: DataFrame) -> int:
    """Files for a table: by its bytes of text, which are summed."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(tasks, -(-size // LEAST_BYTES)), -(-size // MOST_BYTES))


def write(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents in ascending doc_id order, a file per range of ids, and return
    the segments: the place of each run of documents, in tokens, over all files."""
    spark = docs.sparkSession
    folder, path = folder or new_path(spark, "tokens"), tokenizer or default_tokenizer()
    n = n_files(docs)
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie)

    def rows(batches):
        writer = None
        for batch in batches:
            for part, data, at in pieces(batch):
                writer = writer or Writer(folder)
                ids, bounds = encoder(path).encode(data, at)
                bounds = bounds + np.arange(len(bounds))
                ended = np.full(bounds[-1], end_id, np.int32)
                ended[np.delete(np.arange(bounds[-1]), bounds[1:] - 1)] = ids
                doc_id = part.column("doc_id").cast(pa.int64())
                null = doc_id.is_null().to_numpy(zero_copy_only=False)
                writer.add(doc_id.fill_null(0).to_numpy(), null, ended, np.diff(bounds))
        if not writer:
            return
        counts = np.concatenate(writer.counts)
        writer.close()
        ends = np.cumsum(counts)
        cut = np.flatnonzero(np.diff(ends // SEGMENT)) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(counts)]))
        tokens = np.concatenate(([0], ends))
        k, number = len(lo), TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([writer.uri] * k), pa.array([number] * k, pa.int32()), *(pa.array(x.astype(np.int64)) for x in (lo, hi, tokens[lo], tokens[hi]))],
            names=[x.split()[0] for x in SEGMENTS.split(", ")],
        )

    written = saved(ordered.mapInArrow(rows, SEGMENTS), "token-segments")
    files = written.groupBy("file", "part").agg(F.max("token_hi").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # one row a file
    files = files.select("file", F.coalesce(before, F.lit(0)).alias("base"))
    return written.join(files, "file")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(segments: DataFrame) -> DataFrame:
    """Per document, as read from the files: start (tokens of all before it), n_tokens and
    ids_crc32 over the ids as little-endian unsigned 32-bit integers."""
    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(batches):
        reader, uri = None, None
        for batch in batches:
            for file, lo, hi, base in zip(*(batch.column(c).to_pylist() for c in ("file", "doc_lo", "doc_hi", "base")), strict=True):
                if file != uri:  # segments come in order of their files
                    if reader:
                        reader.close()
                    reader, uri = Reader(file), file
                raw = reader.ids(lo, hi).astype("<u4").tobytes()
                tokens, a = reader.tokens[lo : hi + 1], int(reader.tokens[lo])
                crc = [zlib.crc32(raw[4 * (x - a) : 4 * (y - a)]) for x, y in zip(tokens[:-1].tolist(), tokens[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.docs[lo:hi].astype(np.int64), mask=reader.null[lo:hi]), pa.array(base + tokens[:-1]), pa.array(np.diff(tokens)), pa.array(crc, pa.int64())],
                    names=[x.split()[0] for x in READ.split(", ")],
                )
        if reader:
            reader.close()

    laid = segments.select("file", "doc_lo", "doc_hi", "base").repartitionByRange(tasks, "file", "doc_lo").sortWithinPartitions("file", "doc_lo")
    return laid.mapInArrow(rows, READ)


def op3_token_file(spark, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet")))
