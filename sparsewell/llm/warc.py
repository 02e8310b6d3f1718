"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are compressed independently; the file ends with
the seek table of the Zstandard seekable format (a skippable frame), so any zstd tool
can read the file and one frame can be read alone.  The index, a table, maps each record
identifier to its file, frame and offset within the frame; :func:`lookup` reads records by
their identifiers.  Identifiers are unique, also of equal rows.  A payload stored before is
not stored again: its record is a revisit that names the page and target that hold it.

Defined cases: a null html has an empty payload; payloads below ``MIN_DEDUP`` bytes are
always responses; rows of the smallest page_id of a group are responses, also if that
page_id is repeated; a null page_id ranks last; a null url leaves out the target; an
empty table makes no files and an empty index; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import open_new, open_old
from .store import new_path, saved

MIN_DEDUP, FRAME_BYTES, LEVEL, SALTS = 100, 256 << 10, 3, 32

# Fixed values of the Zstandard seekable format and of WARC 1.1.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX_SCHEMA = "record_id string, page_id long, file string, frame long, offset long, length long"
READ_SCHEMA = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def record_id(file: str, number: int) -> str:
    """The identifier of a file's record: file names are unique, so it is."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file} {number}')}"


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """The bytes of one record.  A revisit has the HTTP head of the response, whose length
    is the full payload's, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Date: {DATE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_uri(refers_url)}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record's bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class Writer:
    """A bundle: frames of about ``FRAME_BYTES``, then the seek table."""

    def __init__(self, folder: str):
        self.out, self.uri = open_new(folder, ".warc.zst")
        self.packer, self.frames, self.held, self.size = zstandard.ZstdCompressor(level=LEVEL), [], [], 0
        self.n_records = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset within it of the record now added."""
        self.n_records += 1
        if self.held and self.size + len(data) > FRAME_BYTES:
            self.flush()
        at = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC))
        self.out.close()


class Reader:
    """Random access to the frames of a bundle."""

    def __init__(self, uri: str):
        self.file = open_old(uri)
        end = self.file.size()
        self.file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        entry = 12 if flags & 0x80 else 8
        self.file.seek(end - 9 - n * entry)
        table = self.file.read(n * entry)
        self.sizes = [struct.unpack_from("<II", table, i * entry) for i in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.at, self.frame_data = -1, b""

    def frame(self, i: int) -> bytes:
        if i != self.at:
            self.file.seek(self.starts[i])
            packed, size = self.sizes[i]
            self.frame_data = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)
            self.at = i
        return self.frame_data

    def close(self) -> None:
        self.file.close()


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to (null: the record is a response), refers_url.  Groups are
    found from digests alone; equal payloads are dealt over ``SALTS`` tasks."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("n", F.octet_length("html"))
    groups = p.where(F.col("n") >= MIN_DEDUP).groupBy(F.col("digest").alias("of")).agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("head"), F.count("*").alias("rows"))
    groups = groups.where("rows > 1").select("of", F.col("head.page_id").alias("head"), F.col("head.url").alias("head_url"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("in"))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    p = p.join(groups, (F.col("digest") == F.col("of")) & (F.col("salt") == F.col("in")) & (F.col("n") >= MIN_DEDUP), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("head")), F.col("head"))
    return p.select("page_id", "url", "html", "digest", refers.alias("refers_to"), F.when(refers.isNotNull(), F.col("head_url")).alias("refers_url"))


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives, one per task, and return the index."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def rows(batches):
        writer = None
        for batch in batches:
            out: list[tuple] = []
            for page_id, url, html, digest, refers_to, refers_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "refers_url")), strict=True):
                writer = writer or Writer(folder)
                name = record_id(writer.uri.rsplit("/", 1)[1], writer.n_records)
                data = record(name, page_id, url, html.encode(), digest, refers_to, refers_url)
                out.append((name, page_id, writer.uri, *writer.add(data), len(data)))
            if out:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX_SCHEMA.split(", ")])
        if writer:
            writer.close()

    return saved(revisits(pages).mapInArrow(rows, INDEX_SCHEMA), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """The records of the index, each read from its frame at its offset.  A response's
    payload is measured and hashed again; a revisit's are those its fields state."""

    def rows(batches):
        reader, uri = None, None
        for batch in batches:
            out: list[tuple] = []
            for file, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "offset", "length")), strict=True):
                if file != uri:
                    if reader:
                        reader.close()
                    reader, uri = Reader(file), file
                fields, http, payload = parse(reader.frame(frame)[offset : offset + length])
                response = fields["WARC-Type"] == "response"
                digest = hashlib.sha256(payload).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha256:")
                size = len(payload) if response else int(http["Content-Length"])
                number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                out.append((fields["WARC-Record-ID"].strip("<>"), number("WARC-Page-ID"), size, digest, fields["WARC-Type"], number("WARC-Refers-To-Page-ID"), fields.get("WARC-Target-URI")))
            if out:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ_SCHEMA.split(", ")])
        if reader:
            reader.close()

    return index.mapInArrow(rows, READ_SCHEMA)


def lookup(index: DataFrame, record_ids: list[str]) -> DataFrame:
    """The records of the given identifiers: only their frames are read."""
    return read(index.where(F.col("record_id").isin(record_ids)))


def op1_warc(spark, sf_dir: str) -> DataFrame:
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS head FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN head IS NOT NULL AND head IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head IS NOT NULL AND head IS DISTINCT FROM page_id THEN head END AS refers_to
FROM g
"""
