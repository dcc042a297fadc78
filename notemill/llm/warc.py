"""Operator 9: WARC records in seekable Zstandard bundles.

A bundle is a file of independent zstd frames, each with whole records of about
``FRAME_BYTES``. A frame with the record index and a skippable frame with the seek
table (compressed and plain size of every frame, and the usual seekable-format
footer) end the file, so any zstd tool can unpack it and a reader can reach one
record by its id with two reads: the footer, then one frame.

Payloads that repeat are stored once. Of rows with one payload of at least
``least`` bytes the smallest id becomes a response, the others are revisit
records that name it. Only digests and ids are grouped; the digest with the most
copies is joined on a salt, so no task holds one digest's rows. Null payloads are
empty; ids should be different, and rows that share the smallest id of a payload
are all responses. A null id sorts last and is written as an empty id.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import stash

FRAME_BYTES = 256 << 10
#: Fixed values of the public seekable format.
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
SEEK_FOOTER, SEEK_ENTRY = struct.Struct("<IBI"), struct.Struct("<II")
#: Marks the frame that maps record ids to (frame, offset in frame).
INDEX_MAGIC = b"NMWI"
#: Groups of equal payloads are joined on this many salts.
SALTS = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: str, url: str, payload: bytes, size: int, digest: str, kind: str, refers_to: str | None) -> bytes:
    """One record; a revisit has no payload but the digest and size of the one it stands for."""
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    body = b"" if kind == "revisit" else payload
    return "\r\n".join([*head, "Content-Type: text/html", f"Content-Length: {len(body)}\r\n\r\n"]).encode() + body + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the end of the record that starts at ``at``."""
    stop = raw.index(b"\r\n\r\n", at)
    lines = raw[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(head["Content-Length"])
    return head, raw[stop + 4 : stop + 4 + size], stop + 8 + size


class BundleWriter:
    def __init__(self, out):
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=3)
        self.seek: list[bytes] = []
        self.index: list[str] = []
        self.frame: list[bytes] = []
        self.held = 0

    def add(self, page_id: str, raw: bytes) -> None:
        self.index.append(f"{page_id}\t{len(self.seek)}\t{self.held}")
        self.frame.append(raw)
        self.held += len(raw)
        if self.held >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        raw = b"".join(self.frame)
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.seek.append(SEEK_ENTRY.pack(len(packed), len(raw)))
        self.frame, self.held = [], 0

    def close(self) -> None:
        if self.frame:
            self.flush()
        packed = zstandard.ZstdCompressor(level=3).compress(INDEX_MAGIC + "\n".join(self.index).encode())
        self.out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.seek.append(SEEK_ENTRY.pack(len(packed) + 8, 0))  # skippable: unpacks to nothing
        table = b"".join(self.seek) + SEEK_FOOTER.pack(len(self.seek), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Bundle:
    """A bundle open for reading: frames by number, records by id."""

    def __init__(self, path: str):
        where, name = fs.FileSystem.from_uri(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        n, _, magic = SEEK_FOOTER.unpack(self.read(size - SEEK_FOOTER.size, SEEK_FOOTER.size))
        if magic != SEEK_MAGIC:
            raise ValueError(f"no seek table: {path}")
        table = self.read(size - SEEK_FOOTER.size - n * SEEK_ENTRY.size, n * SEEK_ENTRY.size)
        self.frames, at = [], 0
        for packed, plain in SEEK_ENTRY.iter_unpack(table):
            self.frames.append((at, packed, plain))
            at += packed

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self.read(at, packed), max_output_size=plain)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for i in range(len(self.frames) - 1):
            raw, at = self.frame(i), 0
            while at < len(raw):
                head, payload, at = parse(raw, at)
                yield head, payload

    def find(self, page_id: int | str) -> tuple[dict[str, str], bytes] | None:
        """The record with this id."""
        at, packed, _ = self.frames[-1]
        index = zstandard.ZstdDecompressor().decompress(self.read(at + 8, packed - 8))[len(INDEX_MAGIC) :].decode()
        for line in index.split("\n"):
            name, frame, offset = line.split("\t")
            if name == str(page_id):
                return parse(self.frame(int(frame)), int(offset))[:2]
        return None


def mark_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, record_type, refers_to`` for each row."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha2("html", 256).alias("payload_digest"))
    again = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    again = stash(again, "payloads").select(F.col("payload_digest").alias("d"), "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    both = salted.join(again, (F.col("payload_digest") == F.col("d")) & (salted["salt"] == again["salt"]), "left")
    repeats = F.col("first_id").isNotNull() & (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return both.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(repeats, "revisit").otherwise("response").alias("record_type"), F.when(repeats, F.col("first_id")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Writes bundles into ``folder``, a URI that all workers reach; returns ``path, n_records`` per bundle.

    Each task writes one bundle under a name of its own attempt; the manifest that
    Spark writes names those that count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, uri = None, 0, f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    where, name = fs.FileSystem.from_uri(uri)
                    where.create_dir(name.rpartition("/")[0], recursive=True)
                    out = BundleWriter(where.open_output_stream(name, compression=None))
                page_id = "" if row["page_id"] is None else str(row["page_id"])
                out.add(page_id, record(page_id, row["url"] or "", row["html"].encode(), row["payload_bytes"], row["payload_digest"], row["record_type"], None if row["refers_to"] is None else str(row["refers_to"])))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], names=["path", "n_records"])

    mark_revisits(pages, least).mapInArrow(write, "path string, n_records long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """Records of the bundles: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``.

    A response's digest is taken from the payload read; one that differs from its header is an error.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def number(name: str) -> int | None:
        digits = name.removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def rows(path: str) -> Iterator[dict]:
        for head, payload in Bundle(path).records():
            kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
            if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                raise ValueError(f"damaged record {head['WARC-Record-ID']} in {path}")
            yield {"page_id": number(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None, "payload": payload}

    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[dict] = []
                for row in rows(path):
                    held.append(row)
                    if len(held) == 500:
                        yield pa.RecordBatch.from_pylist(held, types)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, types)

    tasks = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("path").repartition(4 * tasks).mapInArrow(read, schema)
