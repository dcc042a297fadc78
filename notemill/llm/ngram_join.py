"""Operator 1: n-gram Jaccard join by MinHash banding.

A document is the set of its runs of ``NGRAM`` words (words have no ASCII white space). Two documents
are linked when the Jaccard similarity of their sets is at least ``SIMILARITY``.

1. Signatures: bands of minimum hashes. At similarity s a pair meets in one of b bands of r rows with chance
   1 - (1 - s^r)^b; ``bands_for`` chooses both numbers for the similarity and ``RECALL``: 20 bands of 5 at 0.8, which meet with chance 0.9996.
2. Equal sets become one vertex that counts its copies; copies never meet each other again.
3. Vertices are shuffled by band hash. Buckets with the same members (a pair of near copies
   meets in most bands) are kept once, found by count and checksums of the members.
4. Verification on full sets. A bucket is cut into blocks of at most ``BLOCK`` members and
   ``BLOCK_GRAMS`` n-grams by a hash of the vertex, and each pair of blocks is one group of an
   Arrow task; a bucket of n different sets sends each of them once for each of its blocks, n / ``BLOCK`` or so. A pair of vertices is looked at in the first band where it meets only. A
   group returns one row per member: its number of links and the root of its linked
   members. So pairs never become rows, whatever a bucket's size, and none is skipped.
5. Connected components over (member, root) give classes.

Defined results: a text of fewer than ``NGRAM`` words has one n-gram, all its words; null, empty
and blank texts have none and link to nothing; rows with a null key have a null class and no
links; rows that share a key are judged by their own texts; the class is the smallest key in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import Texts, distinct, small, stash, steps
from notemill.llm.components import components

NGRAM, SIMILARITY, RECALL = 5, 0.8, 0.9995
BLOCK, BLOCK_GRAMS = 250, 500_000
BROADCAST_BYTES = 24 << 20
#: Columns of the 0/1 matrix whose product counts shared n-grams.
WIDTH = 4096
ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """Bands and rows that reach ``recall`` at ``similarity`` with the most rows, hence the fewest false meetings."""
    fitting = [(r, b) for r in range(1, most_hashes + 1) for b in range(1, most_hashes // r + 1) if 1 - (1 - similarity**r) ** b >= recall]
    rows = max(r for r, _ in fitting)
    return min(b for r, b in fitting if r == rows), rows


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def words_of(texts: Texts) -> tuple[Texts, np.ndarray]:
    """Words of all texts in a row, and where each text's words start (one more entry at the end)."""
    b = texts.data
    blank = (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))
    first = np.zeros(len(b), bool)
    first[texts.at[:-1][texts.at[:-1] < len(b)]] = True
    starts = ~blank & (np.concatenate([[True], blank[:-1]]) | first) if len(b) else np.zeros(0, bool)
    begin = np.flatnonzero(starts)
    kept = np.concatenate([[0], np.cumsum(~blank)])
    return Texts(b[~blank], np.append(kept[begin], kept[-1]).astype(np.int64)), np.searchsorted(begin, texts.at)


def gram_sets(texts: Texts, n: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams."""
    words, at = words_of(texts)
    kinds, index = distinct(words)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in kinds], np.uint64)[index] if kinds else np.zeros(0, np.uint64)
    runs = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    odds = ODD * (2 * np.arange(n, dtype=np.uint64) + np.uint64(1))
    for j in range(n):
        runs += hashes[j : j + len(runs)] * odds[j]
    runs = mix(runs)
    out = []
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            few = np.uint64(b - a) + np.add.reduce(hashes[a:b] * (ODD * (2 * np.arange(b - a, dtype=np.uint64) + np.uint64(1))))
            out.append(mix(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash_bands(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band for each set that isn't empty."""
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * ODD)
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), np.uint64(band + 1))
        for seed in seeds[band * rows : (band + 1) * rows]:
            key = mix(key * ODD + np.minimum.reduceat((flat ^ seed) * (seed | np.uint64(1)), starts))
        out[:, band] = key
    return out


def signatures(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """``k, v, grams, bands``: key, hash of the n-gram set (null if empty), its size, band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "t"):
            sets = gram_sets(texts, n)
            full = [i for i, s in enumerate(sets) if len(s)]
            v: list = [None] * len(sets)
            marks: list = [None] * len(sets)
            if full:
                found = minhash_bands([sets[i] for i in full], bands, rows).view(np.int64)
                for i, m in zip(full, found, strict=True):
                    v[i], marks[i] = vertex(sets[i]), m
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(v, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(marks, pa.list_(pa.int64()))], names=["k", "v", "grams", "bands"])

    kind = docs.schema["k"].dataType.simpleString()
    return docs.select("k", "t").mapInArrow(run, f"k {kind}, v long, grams int, bands array<long>")


def vertex(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def shared_counts(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Number of n-grams that each set of ``a`` shares with each of ``b`` (of ``a`` if None)."""
    sets = a + (b or [])
    kinds, index, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.cumsum(times > 1) - 1  # an n-gram of one set is shared by none
    use = times[index] > 1
    row, col = row[use], often[index[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(a), len(sets) - len(a) if b is not None else len(a)), np.float32)
    for first in range(0, int(often[-1]) + 1 if len(often) else 0, WIDTH):
        lo, hi = np.searchsorted(col, [first, first + WIDTH])
        m = np.zeros((len(sets), WIDTH), np.float32)
        m[row[lo:hi], col[lo:hi] - first] = 1
        left = m[: len(a)]
        out += left @ (m[len(a) :] if b is not None else left).T
    return out


def verify(band: int, side: np.ndarray, v: np.ndarray, copies: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member of one group, and its root: the smallest vertex it is joined to."""
    one = not side.any()
    x = np.flatnonzero(side == 0)
    y = x if one else np.flatnonzero(side == 1)
    links, root = np.zeros(len(v), np.int64), v.copy()
    if not len(x) or not len(y):
        return links, root
    may = np.triu(np.ones((len(x), len(x)), bool), 1) if one else np.ones((len(x), len(y)), bool)
    for e in range(band):  # met before, looked at there
        may &= marks[x, e][:, None] != marks[y, e][None, :]
    size = np.array([len(s) for s in sets], np.float64)
    total = size[x][:, None] + size[y][None, :]
    may &= np.minimum(size[x][:, None], size[y][None, :]) * (1 + least) >= least * total - 1e-9
    if may.any():
        shared = shared_counts([sets[i] for i in x], None if one else [sets[i] for i in y]).astype(np.float64)  # counts; compared to the last bit
        linked = may & (shared * (1 + least) >= least * total - 1e-6)
        np.add.at(links, x, linked @ copies[y])
        np.add.at(links, y, linked.T @ copies[x])
        while True:
            before = root.copy()
            big = np.iinfo(np.int64).max
            root[x] = np.minimum(root[x], np.where(linked, root[y][None, :], big).min(1))
            root[y] = np.minimum(root[y], np.where(linked, root[x][:, None], big).min(0))
            if (before == root).all():
                break
    return links, root


def ngram_join(docs: DataFrame, least: float = SIMILARITY, n: int = NGRAM, recall: float = RECALL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, class_id, n_links``, one row per row of ``docs``; a pair at ``least`` is met with a chance of ``recall`` or more."""
    bands, rows = bands_for(least, recall)
    plain = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    marked = stash(signatures(plain, bands, rows, n), "signatures")
    sets = stash(marked.where("k IS NOT NULL AND v IS NOT NULL").groupBy("v", "grams", "bands").agg(F.min("k").alias("rep"), F.count("*").alias("copies")), "sets")

    members = sets.select("v", "grams", F.posexplode("bands").alias("band", "hash"))
    buckets = members.groupBy("band", "hash").agg(F.count("*").alias("n"), F.sum(F.col("grams").cast("long")).alias("total"), F.min("v").alias("low"), F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y")).where("n > 1")
    buckets = stash(buckets.groupBy("n", "total", "low", "x", "y").agg(F.min(F.struct("band", "hash")).alias("b")).select("b.*", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_GRAMS)).cast("int").alias("blocks")), "buckets")
    found = members.join(buckets, ["band", "hash"]).groupBy("v").agg(F.collect_list(F.struct("band", "hash", "blocks")).alias("buckets"))  # at most one entry per band
    wanted = stash(sets.join(found, "v").select("v", "rep", "copies", "bands", "buckets"), "wanted")
    if small(wanted, 16 * bands + 200, BROADCAST_BYTES):
        wanted = F.broadcast(wanted)
    texts = plain.join(wanted, plain["k"] == wanted["rep"]).select("v", "copies", "bands", "buckets", "t")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, view in steps(batches, "t"):
            sets_here = gram_sets(view, n)
            out: dict[str, list] = {c: [] for c in ("band", "hash", "i", "j", "side", "v", "copies", "bands", "grams")}
            for grams, row in zip(sets_here, part.drop_columns(["t"]).to_pylist(), strict=True):
                if not len(grams) or vertex(grams) != row["v"]:  # another text under the same key
                    continue
                raw = grams.tobytes()
                for b in row["buckets"]:
                    at = int(mix(np.array([row["v"] & (2**64 - 1)], np.uint64))[0] % np.uint64(b["blocks"]))
                    for other in range(b["blocks"]):
                        i, j = min(at, other), max(at, other)
                        for c, x in zip(out, (b["band"], b["hash"], i, j, int(at != i), row["v"], row["copies"], row["bands"], raw), strict=True):
                            out[c].append(x)
                if len(out["v"]) >= 2000:
                    yield pa.RecordBatch.from_pydict(out, schema=dealt)
                    out = {c: [] for c in out}
            if out["v"]:
                yield pa.RecordBatch.from_pydict(out, schema=dealt)

    dealt = pa.schema([("band", pa.int32()), ("hash", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("v", pa.int64()), ("copies", pa.int64()), ("bands", pa.list_(pa.int64())), ("grams", pa.binary())])

    def check(group: pa.Table) -> pa.Table:
        v = group.column("v").to_numpy()
        _, keep = np.unique(v, return_index=True)  # repeated rows of one document
        group = group.take(keep)
        marks = np.array(group.column("bands").to_pylist(), np.int64)
        sets_here = [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()]
        v = group.column("v").to_numpy()
        links, root = verify(group.column("band")[0].as_py(), group.column("side").to_numpy(), v, group.column("copies").to_numpy(), marks, sets_here, least)
        return pa.table({"v": v, "links": links, "root": root})

    verified = texts.mapInArrow(deal, "band int, hash long, i int, j int, side int, v long, copies long, bands array<long>, grams binary").groupBy("band", "hash", "i", "j").applyInArrow(check, "v long, links long, root long")
    verified = stash(verified.where("links > 0 OR root <> v"), "verified")
    labels = components(verified.where("root <> v").select(F.col("v").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("v").agg(F.sum("links").alias("links"))
    found = stash(sets.select("v", "rep", "copies").join(labels, "v", "left").select("v", "rep", "copies", F.coalesce("label", "v").alias("label")).join(links, "v", "left"), "labelled")
    names = stash(found.groupBy("label").agg(F.min("rep").alias("class_id")), "classes")
    classes = stash(found.join(names, "label").select("v", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    out = marked.select("k", "v").join(classes, "v", "left")
    linked = F.col("k").isNotNull() & F.col("class_id").isNotNull()
    return out.select(F.col("k").alias(key), F.when(linked, F.col("class_id")).otherwise(F.col("k")).alias("class_id"), F.when(linked, F.col("n_links")).otherwise(F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the documents whose class has a smaller key."""
    classes = ngram_join(docs, key=key, **how)
    gone = stash(classes.where(F.col(key) != F.col("class_id")).select(F.col(key).alias("_gone")).distinct(), "gone")
    gone = F.broadcast(gone) if small(gone, 16, BROADCAST_BYTES) else gone
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
