"""Operator 13: mixing sources to target weights by Sainte-Laguë apportionment.

Every source has a target number of words: its share by weight, but never more than ``REPEATS`` times what it has; what it
can't take goes to the others by weight. The targets are the votes in a Sainte-Laguë election of blocks of ``block`` words:
the seats go to the highest quotients target / (2 k + 1). A source's words are one stream, its documents in seeded order,
cut into blocks and these into shards. The shards of a source are equally long, so its blocks go to them evenly, the ones
left over by a seeded turn. A shard takes as many whole passes as its quota allows and then single blocks: those that come
first in a seeded permutation.

Nothing is gathered by source. Positions in a source's stream are sums within sorted range partitions plus the totals of the
partitions before; blocks, shards and permutations are arithmetic on positions. Totals by source stay tables, so there may be
millions of sources and one of them may hold most rows. Equal input gives equal output, however it is partitioned.

Defined cases: null and blank texts have size 0 and take 0; a null source is a source of its own and comes last; repeated
rows are documents of their own; an empty table gives an empty one; a document of any length is looked at in bounded steps;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.llm.common import fits, ranked, spread, stash

BLOCK_WORDS = 8
#: Blocks of a shard; with more than MOST_SHARDS of these the shards of a source grow instead.
SHARD_BLOCKS, MOST_SHARDS = 4096, 4096
#: A word is taken so often at most.
REPEATS = 3
#: Weights of the sources in their order, over and over.
WEIGHTS = (1, 2, 3)
#: Blocks that one vectorised step looks at.
STEP_BLOCKS = 1 << 20
#: Multiplies block numbers in a shard; a prime over any number of blocks of one, so that no two blocks meet.
PRIME = 2_654_435_761
SOURCE_BYTES, BROADCAST_BYTES = 200, 16 << 20


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def fill(sources: DataFrame, total: int) -> float:
    """Words for a weight of 1, where no source takes more than ``REPEATS`` times its size and all take ``total`` together.

    Each round shares among the sources below their limit what those at the limit leave; the level only rises.
    """
    full, w = F.col("source_size") * REPEATS, F.col("weight")
    level = total / (sources.agg(F.sum("weight")).first()[0] or 1)
    while True:
        held, free = sources.agg(F.coalesce(F.sum(F.when(full <= w * level, full)), F.lit(0)), F.sum(F.when(full > w * level, w))).first()
        if not free or not (raised := (total - held) / free) > level:
            return level
        level = raised


def apportion(parties: DataFrame, seats: int, votes: str = "target", order: str = "rank") -> DataFrame:
    """``parties`` with ``quota``, their seats by Sainte-Laguë: the highest quotients votes / (2 k + 1), ties by ``order``.

    A divisor d gives round(votes / d) seats. Each pass tries 32 divisors in one aggregation and keeps the gap that ``seats``
    falls into; at a tie no divisor fits, and the seats left go to the highest next quotients.
    """
    v = F.col(votes)
    at = lambda d: F.floor(v / F.lit(float(d)) + 0.5)
    n, all_votes, most = parties.agg(F.count("*"), F.sum(votes), F.max(votes)).first()
    if not seats or not all_votes:
        return parties.withColumn("quota", F.lit(0).cast("long"))
    low, high = all_votes / (seats + n), 2.0 * most + 1  # too many seats or enough; none
    if 2 * seats > n:
        high = min(high, all_votes / (seats - n / 2) * (1 + 1e-9))
    while True:
        tried = np.unique(np.linspace(low, high, 34)[1:-1])
        given = parties.agg(*[F.sum(at(d)) for d in tried]).first()
        enough = [float(d) for d, s in zip(tried, given, strict=True) if s <= seats]
        more = [float(d) for d, s in zip(tried, given, strict=True) if s > seats]
        was = (low, high)
        low, high = max([low, *more]), min([high, *enough])
        if high in tried and given[int(np.searchsorted(tried, high))] == seats:
            return parties.withColumn("quota", at(high).cast("long"))
        if (low, high) == was or high - low <= 1e-14 * high:
            break
    base = parties.withColumn("base", at(high).cast("long"))
    left = seats - (base.agg(F.sum("base")).first()[0] or 0)
    return ranked(base, F.desc(F.col(votes) / (2 * F.col("base") + 1)), F.asc(order), name="turn").withColumn("quota", F.col("base") + (F.col("turn") < left).cast("long")).drop("base", "turn")


def quotas(sizes: DataFrame, weights: tuple[int, ...], block: int) -> DataFrame:
    """``source, source_size, rank, weight, target, quota`` for each source of ``source, size`` rows."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = ranked(sources, F.asc_nulls_last("source"), name="rank")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int"))
    sources = stash(sources.withColumn("weight", weight), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = fill(sources, total)
    sources = sources.withColumn("target", F.least(F.col("source_size") * float(REPEATS), F.col("weight") * level))
    return stash(apportion(sources, round(total / block)), "quotas")


def placed(sizes: DataFrame, seed: int) -> DataFrame:
    """``doc_id, source, size, start``: where each document starts in its source's stream.

    ``uid`` only parts rows that are equal in all that counts, so that many of them need not meet in one range.
    """
    order = ["source", "h", "doc_id", "size", "uid"]
    rows = sizes.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("part", F.spark_partition_id())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, total = None, 0
        for batch in batches:
            of, sizes = batch.column("source").to_pylist(), batch.column("size").to_pylist()
            before = []
            for s, n in zip(of, sizes, strict=True):
                source, total = s, total if s == source else 0
                before.append(total)
                total += n
            yield batch.append_column("before", pa.array(before, pa.int64()))

    kind, name = sizes.schema["doc_id"].dataType.simpleString(), sizes.schema["source"].dataType.simpleString()
    laid = stash(rows.select("doc_id", "source", "size", "part").mapInArrow(sums, f"doc_id {kind}, source {name}, size long, part int, before long"), "placed")
    parts = laid.groupBy("source", "part").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = stash(parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead")), "ahead")
    both = laid.join(fits(parts, SOURCE_BYTES, BROADCAST_BYTES), laid["source"].eqNullSafe(parts["s"]) & (laid["part"] == parts["p"]))
    return both.select("doc_id", "source", "size", (F.col("before") + F.col("ahead")).alias("start"))


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """Numbers of 63 bits that follow from ``x`` but don't show it."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def copies_of(g: np.ndarray, size: np.ndarray, quota: np.ndarray, rank: np.ndarray, block: int, seed: int) -> np.ndarray:
    """How often block ``g`` of a source of ``size`` words with ``quota`` blocks is taken."""
    blocks = -(-size // block)
    shards = np.clip(blocks // SHARD_BLOCKS, 1, MOST_SHARDS)
    j = ((g + 1) * shards - 1) // blocks
    first, after = blocks * j // shards, blocks * (j + 1) // shards
    n, own = after - first, np.minimum(after * block, size) - first * block
    salt = mixed_bits(rank * 1_000_003 + seed)
    turn = (j + salt % shards) % shards
    wanted = np.minimum((quota // shards + (turn < quota % shards)) * block, REPEATS * own)
    passes = wanted // own
    singles = np.minimum(n, (2 * (wanted - passes * own) + block) // (2 * block))
    place = ((g - first) * PRIME + mixed_bits(salt + j)) % n
    return passes + (place < singles)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS, seed: int = 13, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """What the mix takes of each document: ``key, source, size, source_size, target, quota, taken, runs``.

    ``runs`` lists (first word, end, copies) for the runs of words that are taken equally often, those left out as well.
    ``target`` and ``quota`` (in blocks) are those of the source.
    """
    sizes = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), words_in(F.col(f"`{text}`")).alias("size"))
    sizes = stash(sizes.withColumn("uid", F.monotonically_increasing_id()), "sizes")
    found = quotas(sizes, weights, block)
    rows = placed(sizes, seed)
    found = fits(found.withColumnRenamed("source", "s"), SOURCE_BYTES, BROADCAST_BYTES)
    rows = rows.join(found, rows["source"].eqNullSafe(found["s"])).select("doc_id", "source", "size", "source_size", "target", "quota", "start", "rank")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, whole, quota, start, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "source_size", "quota", "start", "rank"))
            some = np.flatnonzero(size)
            head = start[some] // block
            n = (start[some] + size[some] - 1) // block + 1 - head
            at = np.concatenate([[0], np.cumsum(n)])
            taken, runs = np.zeros(len(size), np.int64), []
            low = 0
            while low < at[-1]:
                high = min(int(at[-1]), low + STEP_BLOCKS)
                i, k = np.searchsorted(at, [low, high - 1], side="right") - 1  # rows of the first and the last block
                sizes_here = np.minimum(at[i + 1 : k + 2], high) - np.maximum(at[i : k + 1], low)
                row = np.repeat(some[i : k + 1], sizes_here)
                g = spread(head[i : k + 1] + np.maximum(low - at[i : k + 1], 0), sizes_here)
                times = copies_of(g, whole[row], quota[row], rank[row], block, seed)
                a = np.maximum(g * block, start[row]) - start[row]
                b = np.minimum((g + 1) * block, start[row] + size[row]) - start[row]
                np.add.at(taken, row, times * (b - a))
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (times[1:] != times[:-1])]))
                end = np.concatenate([new[1:], [len(row)]]) - 1
                runs.append(np.stack([row[new], a[new], b[end], times[new]]))
                low = high
            all_runs = np.concatenate(runs, axis=1) if runs else np.zeros((4, 0), np.int64)
            bounds = np.searchsorted(all_runs[0], np.arange(len(size) + 1))
            kinds = pa.StructArray.from_arrays([pa.array(x) for x in all_runs[1:]], names=["start", "end", "copies"])
            out = batch.select(["doc_id", "source", "size", "source_size", "target", "quota"])
            yield out.append_column("taken", pa.array(taken)).append_column("runs", pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), kinds))

    kind, name = sizes.schema["doc_id"].dataType.simpleString(), sizes.schema["source"].dataType.simpleString()
    out = rows.mapInArrow(take, f"doc_id {kind}, source {name}, size long, source_size long, target double, quota long, taken long, runs array<struct<start: long, end: long, copies: long>>")
    return out.withColumnsRenamed({"doc_id": key, "source": source})


def mixed_texts(docs: DataFrame, mixed: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The words that ``mix`` takes: ``key, start, copy, words``, a row for each run and copy. Ids have to be different."""
    runs = mixed.select(key, F.explode("runs").alias("run")).where("run.copies > 0")
    words = docs.select(key, F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]++"), F.lit(0)).alias("words"))
    cut = F.concat_ws(" ", F.slice("words", (F.col("run.start") + 1).cast("int"), (F.col("run.end") - F.col("run.start")).cast("int")))
    return runs.join(words, key).select(key, "run.start", F.explode(F.sequence(F.lit(1), F.col("run.copies"))).alias("copy"), cut.alias("words"))
