"""Operator 8: token ids in sorted-string-table shards.

A shard is one file of documents in ascending key order:

* data blocks: entries of up to ``BLOCK_IDS`` ids in all. An entry holds how many leading
  bytes its key shares with the key before it in the block, the rest of the key
  (big-endian, so that bytes sort as numbers), the number of ids and the ids as
  little-endian unsigned 32-bit integers. The whole block is one zstd frame. A block's
  first key is never shortened, so a block can be read alone.
* Bloom filter over the keys, 10 bits a key, 7 probes.
* sparse index: first key, offset, size and number of entries of each block.
* footer: offsets and sizes of filter and index, number of entries and ids, magic.

``read_document`` looks one key up by footer, filter, binary search in the index and one block.

Documents are dealt to shards by range of the key, so that shard order is key order and
no task holds more than its range. A task writes under a name of its own attempt and
the manifest, written by Spark, names the files that count; files of lost attempts are
never read. Keys are non-negative 64-bit integers; several rows may share one key and
stay apart, in the order of their texts; a null key sorts first and is stored as null.
Null and empty texts have no ids but the end mark. An empty table gives no shards and reads back as no rows;
other columns are not looked at; a negative key fails, since its bytes would not sort as the number does.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notemill.llm.bpe import REMEMBERED, lay_out, library_of, weave
from notemill.llm.common import Texts, distinct, scratch, steps
from notemill.llm.pretoken import byte_pieces, classes, unusual

MAGIC = b"NMTT0001"
FOOTER = struct.Struct("<QQQQQQ8s")
ENTRY, INDEX = struct.Struct("<BBI"), struct.Struct("<9sQII")
#: Ids in a block before the next begins.
BLOCK_IDS = 1 << 16
BLOOM_BITS, BLOOM_PROBES = 10, 7
MANIFEST = "shard long, path string, n_docs long, n_ids long"


class ByteBpe:
    """The byte-level vocabulary: the library encodes each different piece once per batch."""

    def __init__(self, path: str):
        self.library = library_of(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.unsafe = ~classes()[1]
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        whole = unusual(texts, self.unsafe, self.special)
        usual, odd = np.flatnonzero(~whole), np.flatnonzero(whole)
        plain = texts.pick(usual) if len(odd) else texts
        pieces, bounds = byte_pieces(plain)
        kinds, index = distinct(pieces)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = list(map(self.known.get, kinds))
        if new := [i for i, ids in enumerate(found) if ids is None]:
            made = [e.ids for e in self.library.encode_batch_fast([kinds[i].decode() for i in new], add_special_tokens=False)]
            ends = np.cumsum(np.fromiter(map(len, made), np.int64, len(made))).tolist()
            raw = np.fromiter(chain.from_iterable(made), "<u4", ends[-1]).tobytes()
            start = 0
            for i, end in zip(new, ends, strict=True):
                found[i] = self.known[kinds[i]] = raw[4 * start : 4 * end]
                start = end
        ids, at = lay_out(found, index, bounds)
        if not len(odd):
            return ids, at
        return weave(ids, at, usual, {int(i): np.array(self.library.encode(texts.row(i).decode(), add_special_tokens=False).ids, np.int64) for i in odd}, len(texts))


@cache
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def key_bytes(key: int | None) -> bytes:
    """Sorts as the key does; a null key is the empty string."""
    return b"" if key is None else struct.pack(">Q", key)


def probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key + b"\x01") | 1
    return [(a + i * b * 0x9E3779B1) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    def __init__(self, out):
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=1)
        self.keys: set[bytes] = set()
        self.index: list[bytes] = []
        self.n_docs = self.n_ids = self.at = 0
        self.block: list[bytes] = []
        self.held = 0
        self.first = self.last = b""

    def add(self, key: bytes, ids: bytes) -> None:
        if self.held >= BLOCK_IDS:
            self.flush()
        if not self.block:
            self.first, self.last = key, b""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.block += [ENTRY.pack(shared, len(key) - shared, len(ids) // 4), key[shared:], ids]
        self.last = key
        self.held += len(ids) // 4
        self.keys.add(key)
        self.n_docs += 1
        self.n_ids += len(ids) // 4

    def flush(self) -> None:
        raw = self.zstd.compress(b"".join(self.block))
        self.index.append(INDEX.pack(bytes([len(self.first)]) + self.first.ljust(8, b"\0"), self.at, len(raw), len(self.block) // 3))
        self.out.write(raw)
        self.at += len(raw)
        self.block, self.held = [], 0

    def close(self) -> None:
        if self.block:
            self.flush()
        bits = max(64, (BLOOM_BITS * len(self.keys) + 7) // 8 * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.out.write(bytes(bloom))
        self.out.write(index)
        self.out.write(FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(index), self.n_docs, self.n_ids, MAGIC))
        self.out.close()


class Shard:
    """A shard open for reading."""

    def __init__(self, path: str):
        where, name = fs.FileSystem.from_uri(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        self.bloom_at, self.bloom_size, index_at, index_size, self.n_docs, self.n_ids, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        self.index = [(first[1 : 1 + first[0]], at, n) for first, at, n, _ in INDEX.iter_unpack(self.read(index_at, index_size))]

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        """Keys and ids of one block."""
        raw, at, last = zstandard.ZstdDecompressor().decompress(self.read(*self.index[i][1:])), 0, b""
        while at < len(raw):
            shared, rest, n = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            last = last[:shared] + raw[at : at + rest]
            at += rest
            yield last, raw[at : at + 4 * n]
            at += 4 * n

    def find(self, key: int | None) -> list[bytes]:
        """Ids of every row with this key."""
        wanted = key_bytes(key)
        bloom = self.read(self.bloom_at, self.bloom_size)
        if not all(bloom[p >> 3] >> (p & 7) & 1 for p in probes(wanted, 8 * len(bloom))):
            return []
        firsts = [first for first, _, _ in self.index]
        i = max(0, bisect.bisect_left(firsts, wanted) - 1)
        out = []
        while i < len(self.index) and firsts[i] <= wanted:
            out += [ids for k, ids in self.block(i) if k == wanted]
            i += 1
        return out


def read_document(manifest: DataFrame, key: int) -> list[list[int]]:
    """Ids of the rows with this key, read from the shards that can hold it. For looking at single documents."""
    return [np.frombuffer(x, "<u4").tolist() for row in manifest.where((F.coalesce("first_key", F.lit(key)) <= key) & (F.col("last_key") >= key)).collect() for x in Shard(row.path).find(key)]


def write_token_table(docs: DataFrame, path: str, folder: str, end_id: int = 0, n_shards: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes every text, adds ``end_id`` and writes shards into ``folder``, a URI that all workers reach.

    Returns the manifest, one row per shard: ``shard, path, n_docs, n_ids, start`` where
    ``start`` is the number of ids in all shards before, and the shard's first and last key.
    ``n_shards`` is the session's number of shuffle partitions unless given.
    """
    spark = docs.sparkSession
    rows = docs.selectExpr(f"CAST(`{key}` AS long) AS k", f"`{text}` AS t")
    order = F.col("k").asc_nulls_first()
    ranged = (rows.repartitionByRange(n_shards, order) if n_shards else rows.repartitionByRange(order)).sortWithinPartitions(order, "t")
    ranged = ranged.withColumn("shard", F.spark_partition_id().cast("long"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, out, shard, first, last = vocabulary(path), None, 0, None, None
        end = np.array([end_id], "<u4").tobytes()
        for part, texts in steps(batches, "t"):
            keys = part.column(0).to_pylist()
            if out is None:
                shard = part.column(2)[0].as_py()
                where, name = fs.FileSystem.from_uri(f"{folder}/shard-{shard:08d}-{uuid.uuid4().hex}.tokens")
                where.create_dir(name.rpartition("/")[0], recursive=True)
                uri = f"{folder}/{name.rpartition('/')[2]}"
                out, first = ShardWriter(where.open_output_stream(name, compression=None)), keys[0]
            ids, at = bpe.encode(texts)
            raw = ids.astype("<u4").tobytes()
            for i, k in enumerate(keys):
                out.add(key_bytes(k), raw[4 * at[i] : 4 * at[i + 1]] + end)
            last = keys[-1]
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int64()), (uri, pa.string()), (out.n_docs, pa.int64()), (out.n_ids, pa.int64()), (first, pa.int64()), (last, pa.int64()))], names=["shard", "path", "n_docs", "n_ids", "first_key", "last_key"])

    ranged.mapInArrow(write, f"{MANIFEST}, first_key long, last_key long").write.parquet(f"{folder}/manifest")
    shards = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file, not per document
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_table(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every document of the shards: ``key, start, n_tokens, ids binary`` (little-endian unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                for i in range(len(shard.index)):
                    keys, ids = zip(*shard.block(i), strict=True)
                    sizes = np.array([len(x) // 4 for x in ids], np.int64)
                    starts = start + np.cumsum(sizes) - sizes
                    start += int(sizes.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(k, "big") if k else None for k in keys], pa.int64()), pa.array(starts), pa.array(sizes), pa.array(ids, pa.binary())], names=["k", "start", "n_tokens", "ids"])

    files = manifest.select("path", "start")
    tasks = manifest.sparkSession.sparkContext.defaultParallelism
    return files.repartition(4 * tasks).mapInArrow(read, "k long, start long, n_tokens long, ids binary").withColumnRenamed("k", key)


def token_table_folder(spark: SparkSession) -> str:
    return scratch(spark, "tokens")
