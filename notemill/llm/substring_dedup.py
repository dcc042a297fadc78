"""Operator 7: repeated byte strings found by external induced suffix sorting.

A byte is removed when it lies in a string of ``LEAST`` bytes that also starts in a document with
a smaller key. Strings are judged on the input, whole texts are read, matches never
cross documents.

1. Equal texts. A document whose whole text has a smaller key elsewhere goes entirely (from ``LEAST``
   bytes on) and is left out below: whatever it holds starts in the smaller document too.
2. Anchors. In every string of ``LEAST`` bytes the k-gram with the least hash is its anchor. Equal
   strings have equal anchors, so only anchors in two documents or more matter. A Bloom filter over
   them, of bounded size, goes to the tasks; it only spares work: anchors that pass it without need match nothing.
3. Shards. An anchor's context is all strings it can be the anchor of, ``2 * LEAST - KGRAM`` bytes. Contexts are
   shuffled by anchor and sorted by it. Tasks take them in pieces of about ``PIECE_BYTES``, so a
   shard may be much larger than memory; those different contexts of a piece that share an anchor are joined into one
   text and their suffixes sorted by induction (``induced``), with run queues on disk
   and the common prefix of each suffix with the one before. Neighbours with ``LEAST``
   symbols in common are one string; the least key among its documents decides.
4. Very frequent anchors (in over ``HOT`` documents) are dealt over salts, ``MORE`` times as many for each ``MORE`` times
   as many documents. There a context that a smaller key has too is removed at once, and only the least key's
   contexts live on. What is left is cut into strings, which are grouped by 128-bit hash with partial aggregation.
5. Spans of all strings are joined per document and cut out.

Null text is empty; documents with a null key keep everything and count for nobody; rows that share
a key don't count as each other's smaller document. A text of any length is one row of one task; texts below ``LEAST``
bytes keep everything. Other columns are not read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import Texts, distinct, small, spread, stash, steps, text_view
from notemill.llm.induced import suffix_order

LEAST, KGRAM = 50, 24
#: K-grams of one string.
REACH = LEAST - KGRAM + 1
#: Documents beyond which an anchor is salted, and how many times more of them make the next level.
HOT, MORE = 5000, 16
PIECE_BYTES = 3 << 20
BROADCAST_BYTES = 24 << 20
#: Bits of the filter over repeated anchors: ten for each, between these bounds.
FILTER_BITS = (1 << 16, 1 << 28)
#: Strings that one vectorised step looks at, and low bits of a hash that give way to the place, which breaks ties to the left.
BLOCK, PLACE_BITS = 1 << 16, 17


def kgram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the k-gram at each byte but the last few."""
    n = len(data) - KGRAM + 1
    word = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,)).copy()  # the eight bytes at each place
    x = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(8, KGRAM, 8):
        x ^= (word[j : n + j] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def anchors(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place in the joined bytes and hash of each anchor, in order of place."""
    data, n = texts.data, len(texts.data)
    inside = np.ones(n, bool)  # strings that end in their text
    short = np.minimum(np.diff(texts.at), LEAST - 1)
    inside[spread(texts.at[1:] - short, short)] = False
    mask, index = np.uint64((1 << PLACE_BITS) - 1), np.arange(BLOCK + REACH, dtype=np.uint64)
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for begin in range(0, n - LEAST + 1, BLOCK):
        end = min(begin + BLOCK, n - LEAST + 1)
        h = kgram_hashes(data[begin : end + LEAST - 1])
        least = h & ~mask | index[: len(h)]
        width = 1  # least of the next `width` places, by doubling
        while width < REACH:
            step = min(width, REACH - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        p = (least[inside[begin:end]] & mask).astype(np.int64)
        if len(p):  # places never go back
            p = p[np.concatenate([[True], p[1:] != p[:-1]])]
            places.append(p + begin)
            hashes.append(h[p])
    place, h = np.concatenate(places), np.concatenate(hashes)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    place, h = place[new], h[new]
    return np.searchsorted(texts.at, place, side="right") - 1, place, h


def anchor_marks(docs: DataFrame) -> DataFrame:
    """``m``: the different anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in steps(batches, "t"):
            of, _, h = anchors(texts)
            order = np.argsort(h, kind="stable")  # equal anchors of a text stay together
            of, h = of[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64))], names=["m"])

    return docs.select("k", "t").mapInArrow(run, "m long")


def filter_of(repeated: DataFrame) -> np.ndarray:
    """Bloom filter over ``rm``, two bits an anchor, as 64-bit words; its size has a fixed bound."""
    wanted = 10 * repeated.count()
    bits = FILTER_BITS[0]
    while bits < min(wanted, FILTER_BITS[1]):
        bits *= 2
    place = F.explode(F.array(F.col("rm").bitwiseAND(bits - 1), F.shiftrightunsigned("rm", 32).bitwiseAND(bits - 1)))
    words = repeated.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS int))")).alias("x"))
    out = np.zeros(bits // 64, np.int64)
    for part in words.toArrow().to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return out.view(np.uint64)


def within(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each anchor."""
    last = np.uint64(len(words) * 64 - 1)
    hit = lambda p: words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)
    return (hit(h & last) & hit((h >> np.uint64(32)) & last)).astype(bool)


def same_contexts(of: np.ndarray, h: np.ndarray, found: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal contexts of one text and anchor as one: the first row of each, how many there are, and all rows in that order."""
    by_hash = np.argsort(h, kind="stable")
    twin = (h[by_hash][1:] == h[by_hash][:-1]) & (of[by_hash][1:] == of[by_hash][:-1])
    again = np.zeros(len(h), bool)
    again[by_hash[1:][twin]] = again[by_hash[:-1][twin]] = True
    group = np.arange(len(h))
    rows = np.flatnonzero(again)
    if len(rows):
        _, kind = distinct(found.pick(rows))
        order = np.lexsort([rows, kind, h[rows], of[rows]])
        new = np.ones(len(rows), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (kind, h[rows], of[rows])], axis=0)
        group[rows[order]] = rows[order][new][np.cumsum(new) - 1]
    order = np.argsort(group, kind="stable")
    first, per = np.unique(group, return_counts=True)
    return first, per, order


def contexts(docs: DataFrame, filters: list[np.ndarray]) -> DataFrame:
    """``m, s, k, lo, ctx``: context of each anchor that may be repeated, all places where it starts in the document, and its salt.

    The first filter holds all repeated anchors, each further one those that are frequent enough for the
    next level of salts; a salt is 0 for anchors of no level.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "t"):
            of, place, h = anchors(texts)
            use = within(shared.value[0], h)
            of, place, h = of[use], place[use], h[use]
            if len(of):
                lo = np.maximum(place - (REACH - 1), texts.at[of])
                hi = np.minimum(place + LEAST, texts.at[of + 1])
                found = Texts(texts.data[spread(lo, hi - lo)], np.concatenate([[0], np.cumsum(hi - lo)]))
                first, per, order = same_contexts(of, h, found)
                places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array((lo - texts.at[of])[order]))
                ctx = found.pick(first).arrow().cast(pa.binary())
                of, h = of[first], h[first]
                keys = part.column(0).to_numpy()[of]
                mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)
                salt = np.zeros(len(of), np.int64)
                for level, words in enumerate(shared.value[1:], 1):
                    hot = within(words, h)
                    salt[hot] = 1 + (mixed[hot] % np.uint64(MORE**level)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(salt), pa.array(keys), places, ctx], names=["m", "s", "k", "lo", "ctx"])

    return docs.select("k", "t").mapInArrow(run, "m long, s long, k long, lo array<long>, ctx binary")


def repeated_spans(marks: np.ndarray, keys: np.ndarray, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, and start and end in its context, of each run of strings that a smaller key has too.

    A context without a different one of the same anchor needs no sorting: its strings occur where it does.
    """
    never = np.iinfo(np.int64).max
    kinds, index = distinct(texts)
    sizes = np.fromiter(map(len, kinds), np.int64, len(kinds))
    least = np.full(len(kinds), never)
    np.minimum.at(least, index, keys)
    mark, kind = np.divmod(np.unique(np.unique(marks, return_inverse=True)[1] * len(kinds) + index), len(kinds))
    several = np.zeros(len(kinds), bool)
    several[kind[np.bincount(mark)[mark] > 1]] = True
    base = np.cumsum(sizes + 1) - (sizes + 1)
    first_key = np.repeat(least, sizes + 1)
    if several.any():
        some, size = np.flatnonzero(several), sizes[several]
        start = np.cumsum(size + 1) - (size + 1)
        text = np.zeros(int((size + 1).sum()), np.uint16)
        text[spread(start, size)] = np.frombuffer(b"".join(kinds[i] for i in some), np.uint8).astype(np.uint16) + 1
        order, lcp = suffix_order(text, LEAST)
        of = np.repeat(np.arange(len(some)), size + 1)
        group = np.cumsum(lcp < LEAST) - 1
        found = np.full(int(group[-1]) + 1, never)
        use = (np.arange(len(text)) - start[of] + LEAST <= size[of])[order]
        group, order = group[use], order[use]
        np.minimum.at(found, group, least[some[of[order]]])
        first_key[base[some[of[order]]] + order - start[of[order]]] = found[group]
    # each row has the strings of its context
    strings = np.maximum(sizes[index] - LEAST + 1, 0)
    offset = spread(np.zeros(len(index), np.int64), strings)
    row = np.repeat(np.arange(len(index)), strings)
    dup = first_key[base[index[row]] + offset] < keys[row]
    row, start = row[dup], offset[dup]
    head = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]) if len(row) else np.zeros(0, bool)
    heads = np.flatnonzero(head)
    last = np.append(heads[1:], len(row)) - 1
    return row[heads], start[heads], start[last] + LEAST if len(heads) else start[heads]


def least_contexts(marks: np.ndarray, keys: np.ndarray, texts: Texts) -> np.ndarray:
    """Which rows have the least key of their anchor and context here."""
    kinds, index = distinct(texts)
    _, pair = np.unique(np.unique(marks, return_inverse=True)[1] * len(kinds) + index, return_inverse=True)
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, pair, keys)
    return keys == least[pair]


def judged_contexts(ordered: DataFrame) -> DataFrame:
    """``k, a, b, ctx`` from contexts that are partitioned and sorted by anchor and salt.

    Rows without ``ctx`` are spans to remove; rows with it are salted contexts that start at ``a``, on which no
    smaller key was found.
    """

    def piece(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        m, s, k = (rows.column(i).to_numpy() for i in range(3))
        places, texts, ctx = rows.column("lo").combine_chunks(), text_view(rows.column("ctx")), rows.column("ctx").combine_chunks()
        lo, per = places.flatten().to_numpy(), places.value_lengths().to_numpy()
        at = np.cumsum(per) - per

        def spans(row: np.ndarray, a: np.ndarray, b: np.ndarray, held: pa.Array) -> pa.RecordBatch:
            """One output row for each place of each row."""
            n = per[row]
            base = lo[spread(at[row], n)]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(k[row], n)), pa.array(base + np.repeat(a, n)), pa.array(base + np.repeat(b, n)), held.take(pa.array(np.repeat(np.arange(len(row)), n)))], names=["k", "a", "b", "ctx"])

        cold, hot = np.flatnonzero(s == 0), np.flatnonzero(s > 0)
        if len(cold):
            row, a, b = repeated_spans(m[cold], k[cold], texts.pick(cold) if len(hot) else texts)
            yield spans(cold[row], a, b, pa.nulls(len(row), pa.binary()))
        if len(hot):
            lives = least_contexts(m[hot], k[hot], texts.pick(hot))
            yield spans(hot, np.zeros(len(hot), np.int64), np.diff(texts.at)[hot], pc.if_else(pa.array(lives), ctx.take(pa.array(hot)), pa.scalar(None, pa.binary())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size >= PIECE_BYTES:  # end the piece where the anchor changes; salted contexts may be cut anywhere
                m, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                ends = np.flatnonzero((m != held[-1].column(0)[held[-1].num_rows - 1].as_py()) | (s > 0))
                if len(ends):
                    yield from piece([*held, batch.slice(0, int(ends[0]))])
                    held, batch, size = [], batch.slice(int(ends[0])), 0
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(4))).as_py()
        if held:
            yield from piece(held)

    return ordered.select("m", "s", "k", "lo", "ctx").mapInArrow(run, "k long, a long, b long, ctx binary")


def string_spans(lives: DataFrame) -> DataFrame:
    """``k, a, b`` of each string in contexts ``k, a, ctx`` that a smaller key has too, by hash of the string."""
    strings = F.transform(F.sequence(F.lit(1), F.octet_length("ctx") - LEAST + 1), lambda i: F.md5(F.substring("ctx", i, F.lit(LEAST))))
    cut = stash(lives.select("k", "a", F.posexplode(strings).alias("i", "s")), "strings")
    first = stash(cut.groupBy("s").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").drop("last"), "first")
    start = F.col("a") + F.col("i")
    return cut.join(first, "s").where("first < k").select("k", start.alias("a"), (start + LEAST).alias("b"))


def fitting(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if small(df, row_bytes, BROADCAST_BYTES) else df


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept binary``, one row per row of ``docs``."""
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    heads = plain.where("k IS NOT NULL").select("k", F.md5("t").alias("h"))
    equal = stash(heads.groupBy("h").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").drop("last"), "equal")
    copies = stash(heads.join(equal, "h").where("k > first").select(F.col("k").alias("ck"), F.col("h").alias("ch")).distinct(), "copies")
    marked = plain.withColumn("h", F.md5("t"))
    firsts = marked.where("k IS NOT NULL").join(fitting(copies, 100), (F.col("k") == F.col("ck")) & (F.col("h") == F.col("ch")), "left_anti").select("k", "t")

    level = sum(((F.col("n") > HOT * MORE**i).cast("int") for i in range(1, 9)), (F.col("n") > HOT).cast("int"))
    repeated = stash(anchor_marks(firsts).groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select(F.col("m").alias("rm"), level.alias("level")), "anchors")
    levels = repeated.agg(F.max("level")).first()[0] or 0
    filters = [filter_of(repeated.where(F.col("level") >= i)) for i in range(levels + 1)]
    judged = stash(judged_contexts(contexts(firsts, filters).repartition("m", "s").sortWithinPartitions("m", "s")), "judged")
    spans = judged.where("ctx IS NULL").select("k", "a", "b")
    if levels:
        spans = spans.unionByName(string_spans(judged.where("ctx IS NOT NULL").select("k", "a", "ctx")))
    packed = F.shiftleft(F.col("a"), 32).bitwiseOR(F.col("b"))
    gone = spans.select("k", packed.alias("span"), F.lit(None).cast("string").alias("ch")).unionByName(copies.select(F.col("ck").alias("k"), F.lit(None).cast("long").alias("span"), "ch"))
    gone = stash(gone.groupBy(F.col("k").alias("sk")).agg(F.collect_list("span").alias("spans"), F.collect_list("ch").alias("copies")), "gone")
    # documents meet their spans by key at every size; those without a key have none
    met = marked.where("k IS NOT NULL").join(gone.hint("merge"), F.col("k") == F.col("sk"), "left").select("k", F.coalesce(F.array_contains("copies", F.col("h")), F.lit(False)).alias("copy"), "spans", "t")
    rows = met.unionByName(plain.where("k IS NULL").select("k", F.lit(False).alias("copy"), F.lit(None).cast("array<long>").alias("spans"), "t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "t"):
            n = len(texts.data)
            change = np.zeros(n + 1, np.int32)  # +1 where a span starts, -1 where it ends
            lists = part.column(2)
            packed = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            per = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
            base = np.repeat(texts.at[:-1], per)
            np.add.at(change, base + (packed >> 32), 1)
            np.add.at(change, base + (packed & 0xFFFFFFFF), -1)
            gone = np.cumsum(change[:n]) > 0
            size = np.diff(texts.at)
            whole = part.column(1).to_numpy(zero_copy_only=False).astype(bool) & (size >= LEAST)
            gone |= np.repeat(whole, size)
            kept_at = np.concatenate([[0], np.cumsum(~gone)])[texts.at]
            starts = gone & ~np.concatenate([[False], gone[:-1]])
            inner = texts.at[:-1][size > 0]
            starts[inner] = gone[inner]
            runs = np.diff(np.concatenate([[0], np.cumsum(starts)])[texts.at])
            kept = Texts(texts.data[~gone], kept_at).arrow().cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(size - np.diff(kept_at)), pa.array(runs), kept], names=["k", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(cut, "k long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("k", key)
