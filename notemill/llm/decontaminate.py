"""Operator 6: benchmark passages found in documents by SimHash windows.

Steps, all column expressions and joins:

1. Windows. A window has the size of a benchmark item, in words. A window can only be
   similar to an item if they share a shingle (``SHINGLE`` words), so windows are laid where a
   document's shingle occurs in an item, at the offset it has there and up to one
   ``SHIFT``-th of the item's size to either side; a window further off has lost too many shingles.
2. Fingerprints. SimHash of ``BITS`` bits over the weighted words of window and item.
3. Candidates. ``BLOCKS`` blocks of the fingerprint are join keys, together with the
   window's size. Fingerprints that differ in at most ``RADIUS = BLOCKS - 1`` bits agree on a
   whole block, so the join finds every pair within the radius.
4. Verification. Weighted Jaccard similarity of the shingles, a shingle weighing the
   number of letters in it: the sum of smaller over the sum of larger weights, counts included.

The benchmark side of the joins is broadcast when it is counted to fit in
``BROADCAST_BYTES``; beyond that they shuffle keys, places and fingerprints, never words. Words are read again
for documents that share a shingle, and join by key; the index join has no words either.

Words are runs of letters and digits, lower-cased. Items and texts with fewer than
``SHINGLE`` words have one shingle, all their words; longer texts are searched for such items by shingles of
their size. Null and empty texts match nothing. Repeated item rows match alike; repeated document ids are taken as one
document's text rows and reported once; of equally similar windows the first counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import let, small, stash

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS = 64, 16
RADIUS = BLOCKS - 1
SHIFT = 9
BROADCAST_BYTES = 16 << 20


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column) -> Column:
    """Hash of the shingle at each position; one of all words if they are too few."""

    def each(w: Column) -> Column:
        whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<long>"))
        runs = F.slice(F.transform(w, lambda x, i: F.xxhash64(F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, SHINGLE)]))), 1, F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0)))
        return F.when(F.size(w) >= SHINGLE, runs).otherwise(whole)

    return let(words, each)


def runs_of(words: Column, n: int) -> Column:
    """Hash of the run of n words at each position, for texts of n words or more."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i + 1, n))))


def simhash(words: Column) -> Column:
    """Bit b is set if the words whose hash has bit b outweigh the others; a word weighs its length."""
    hashed = F.transform(words, lambda w: F.struct(F.xxhash64(w, F.lit("fingerprint")).alias("h"), F.length(w).alias("n")))
    bit = lambda hs, b: F.aggregate(hs, F.lit(0), lambda s, x: s + F.when(F.getbit(x["h"], b) == 1, x["n"]).otherwise(-x["n"])) > 0
    return let(hashed, lambda hs: F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(F.when(bit(hs, b), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))))


def blocks(fingerprint: Column) -> Column:
    """Number and value of each block."""
    width = BITS // BLOCKS
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda i: F.struct(i.alias("block"), F.call_function("shiftright", fingerprint, i * width).bitwiseAND(F.lit((1 << width) - 1)).alias("value")))


def weights(words: Column) -> Column:
    """``array<struct<g, w>>``: each different shingle and its weight, letters times occurrences."""

    def each(w: Column) -> Column:
        n = F.when(F.size(w) >= SHINGLE, SHINGLE).otherwise(F.size(w))
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", F.slice(w, i + 1, n)))
        return let(grams, lambda gs: F.transform(F.array_distinct(gs), lambda g: F.struct(g.alias("g"), (F.length(F.replace(g, F.lit(" "), F.lit(""))) * F.size(F.filter(gs, lambda x: x == g))).alias("w"))))

    return let(words, lambda w: F.when(F.size(w) > 0, each(w)).otherwise(F.array().cast("array<struct<g:string,w:int>>")))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of ``weights``."""

    def of(b: Column) -> Column:
        known = F.map_from_entries(b)
        shared = let(known, lambda m: F.aggregate(a, F.lit(0), lambda s, x: s + F.least(x["w"], F.coalesce(F.try_element_at(m, x["g"]), F.lit(0)))))
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x["w"])
        return let(shared, lambda s: F.try_divide(s, total(a) + total(b) - s))

    return let(b, of)


def fitting(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if it is counted to fit."""
    return F.broadcast(df) if small(df, row_bytes, BROADCAST_BYTES) else df


def find_contamination(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Best window of each document and item of ``least`` similarity: ``key, item_id, similarity, distance, start_word, n_words``."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = stash(items.select("item_id", "words", F.size("words").alias("n"), simhash(F.col("words")).alias("print")), "items")
    short = sorted(r.n for r in items.where(F.col("n") < SHINGLE).select("n").distinct().collect())  # SHINGLE - 1 values at most
    places = items.select("n", F.posexplode(shingles(F.col("words"))).alias("offset", "shingle")).groupBy("shingle").agg(F.collect_set(F.struct("n", "offset")).alias("places"))

    # keys and places only, until a document is known to share a shingle
    plain = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    split = plain.select("k", words_of(F.col("t")).alias("words"))
    seen = split.select("k", F.size("words").alias("size"), F.posexplode(shingles(F.col("words"))).alias("pos", "shingle"))
    for n in short:  # texts hold items of fewer words too
        seen = seen.unionByName(split.where(F.size("words") >= SHINGLE).select("k", F.size("words").alias("size"), F.posexplode(runs_of(F.col("words"), n)).alias("pos", "shingle")))
    hits = seen.join(fitting(places, 100), "shingle").select("k", "size", "pos", F.explode("places").alias("p"))
    at, d = F.col("pos") - F.col("p.offset"), (1 + F.floor(F.col("p.n") / SHIFT)).cast("int")
    last = F.greatest(F.col("size") - F.col("p.n"), F.lit(0))
    low, high = F.least(F.greatest(at - d, F.lit(0)), last), F.least(F.greatest(at + d, F.lit(0)), last)
    spots = hits.select("k", F.struct(F.col("p.n").alias("n"), low.alias("low"), high.alias("high")).alias("spot")).groupBy(F.col("k").alias("sk")).agg(F.collect_set("spot").alias("spots"))
    spots = stash(spots, "spots")
    found = plain.join(fitting(spots, 400), F.col("k").eqNullSafe(F.col("sk"))).select("k", words_of(F.col("t")).alias("words"), "spots")
    starts = F.array_distinct(F.flatten(F.transform("spots", lambda x: F.transform(F.sequence(x["low"], x["high"]), lambda i: F.struct(x["n"].alias("n"), F.least(i, F.greatest(F.size("words") - x["n"], F.lit(0))).alias("start"))))))
    windows = found.select("k", "words", F.explode(starts).alias("w")).select("k", "w.n", "w.start", F.slice("words", F.col("w.start") + 1, F.col("w.n")).alias("window")).where(F.size("window") > 0)
    windows = windows.withColumn("wprint", simhash(F.col("window"))).withColumn("id", F.xxhash64("window"))
    windows = stash(windows, "windows")

    prints = windows.select("k", "n", "start", "id", "wprint", F.explode(blocks(F.col("wprint"))).alias("b"))
    index = items.withColumn("b", F.explode(blocks(F.col("print")))).select("item_id", F.col("n").alias("m"), "print", F.col("b").alias("c"))
    pairs = prints.join(fitting(index, 100), (F.col("n") == F.col("m")) & (F.col("b.block") == F.col("c.block")) & (F.col("b.value") == F.col("c.value")))
    near = pairs.withColumn("distance", F.bit_count(F.col("wprint").bitwiseXOR(F.col("print")))).where(F.col("distance") <= RADIUS)
    near = stash(near.select("k", "n", "start", "id", "item_id", "distance").distinct(), "near")
    same = ["n", "start", "id"]
    both = near.withColumnRenamed("k", "nk").join(windows.select("k", *same, "window"), [F.col("nk").eqNullSafe(F.col("k")), *[near[c] == windows[c] for c in same]]).select("k", near["n"], near["start"], "item_id", "distance", "window")
    both = both.join(fitting(items.select(F.col("item_id").alias("i"), F.col("words").alias("item"), F.col("n").alias("m")), 1000), (F.col("item_id") == F.col("i")) & (F.col("n") == F.col("m")))
    scored = both.withColumn("similarity", similarity(weights(F.col("window")), weights(F.col("item")))).where(F.col("similarity") >= least)
    best = scored.groupBy("k", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n", "distance")).alias("x"))
    return best.select(F.col("k").alias(key), "item_id", "x.similarity", "x.distance", (-F.col("x.back")).alias("start_word"), F.col("x.n").alias("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without those that hold a benchmark passage. Documents without key stay."""
    bad = find_contamination(docs, benchmark, key=key).select(F.col(key).alias("_bad")).distinct()
    return docs.join(bad, docs[key] == bad["_bad"], "left_anti")
