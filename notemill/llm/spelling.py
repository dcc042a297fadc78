"""Operator 12: spelling variants by dynamic programming over a sorted vocabulary.

Two words are near if one inserted, deleted or replaced letter (code point) turns one into the other. With S the length of the
shorter, a pair either shares its first S // 2 letters or its last S - S // 2: a list of the words sorted forwards serves the
first kind, one of the words reversed the second, so that a word meets only a short stretch of each.

Both lists are one table, sorted by range and cut into shards. A word is sent to the shards that its stretch touches; of those
that begin and end with a longer shared prefix, only to those whose prefix is within one edit. In a shard the longest common prefixes
of neighbours cut the list into ranges that share their first letters. A range has one row of the edit matrix, three cells wide,
for each word that searches it; the ranges that it splits into at the next letter go on from that row, and where no cell is at most one
edit, the whole range is skipped. That is done letter by letter for thousands of searching words at once.

Bounds: a shard has about ``SHARD_WORDS`` words, more beyond ``MOST_SHARDS`` shards; a task holds one shard, the words that search it
stream by. The first and last word of each shard, at most twice ``MOST_SHARDS`` rows, are all that the driver sees. Results are
linear: each word gets its number of near words and the best of them.

Defined cases: null texts have no words; a null doc_id is written as nothing before the colon; repeated rows count again; an empty
table gives an empty one; words of any length are compared; ties go to the word that comes first by code points; other columns
are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import spread, stash

LETTERS = "[A-Za-zÀ-ÿ]++"
#: A word of this residue loses a letter, as the contract says.
DAMAGED = 97
SHORTEST, FEWEST = 5, 3
SHARD_WORDS, MOST_SHARDS = 20_000, 10_000
#: Words that search a shard together.
ASKED = 4096
#: Letters after an asked word, like no letter.
PAD = 3
#: Sorts after every word that a prefix begins.
AFTER = "\U0010ffff"


def word_counts(docs: DataFrame, damaged: int | None = DAMAGED, shortest: int = SHORTEST, fewest: int = FEWEST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``word, n``: the runs of letters of all texts, A to Z lower-cased, those by rule with a letter less."""
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("k"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(LETTERS), F.lit(0))).alias("w"))
    rows = rows.select("k", F.translate("w", ascii_uppercase, ascii_lowercase).alias("w"))
    if damaged:
        rows = rows.select("w", F.crc32(F.concat(F.coalesce("k", F.lit("")), F.lit(":"), "w")).alias("h"))
        at = (F.col("h") % F.length("w")).cast("int")
        shorter = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
        rows = rows.select(F.when(F.col("h") % damaged == 0, shorter).otherwise(F.col("w")).alias("w"))
    return rows.where(F.length("w") >= shortest).groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


# ---- edit matrix, three cells wide ----


def row_after(row: tuple, depth: int, letter: str, q: str) -> tuple:
    """Cells (depth - 1, depth, depth + 1) of row ``depth``, the word's letter there being ``letter``; ``q`` is padded by two."""
    a, b, c = row
    left = min(a + (letter != q[depth - 2]), b + 1)
    mid = min(b + (letter != q[depth - 1]), c + 1, left + 1)
    return left, mid, min(c + (letter != q[depth]), mid + 1)


def within_one(prefix: str, q: str, base: int) -> bool:
    """Whether some beginning of ``q`` is within one edit of ``prefix``; they share the first ``base`` letters."""
    row, q = (1, 0, 1), q + "\0\0"
    for depth in range(base + 1, len(prefix) + 1):
        if depth > len(q) - 1:
            return False
        row = row_after(row, depth, prefix[depth - 1], q)
        if min(row) > 1:
            return False
    return True


def steps_of_rows() -> tuple[np.ndarray, np.ndarray]:
    """All rows as numbers: three cells of 0, 1 or more make 27, and the row after each for the eight outcomes of comparing a letter with three."""
    after = np.zeros(27 * 8, np.uint8)
    for row in range(27):
        for same in range(8):
            q = ["=" if same & bit else "!" for bit in (4, 2, 1)]
            cells = row_after((row // 9, row // 3 % 3, row % 3), 2, "=", q)
            after[8 * row + same] = sum(min(x, 2) * f for x, f in zip(cells, (9, 3, 1), strict=True))
    return after, np.array([[r // 9, r // 3 % 3, r % 3] for r in range(27)], np.int8)


AFTER_ROW, CELLS = steps_of_rows()
FIRST_ROW, DEAD_ROW = 1 * 9 + 0 * 3 + 1, 26
TWO, FOUR, EIGHT = np.uint8(2), np.uint8(4), np.uint8(8)


class Vocabulary:
    """Sorted words as letters, and the length of each one's common prefix with the one before."""

    def __init__(self, words: list[str]):
        self.words = words
        self.shared = np.array([0, *map(common, words, words[1:])] if words else [], np.int64)
        self.letters, self.at = flat(words)
        self.sizes = np.diff(self.at)


def flat(words: list[str], pad: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words in a row, each followed by ``pad``, and where each begins."""
    at = np.concatenate([[0], np.cumsum(np.fromiter((len(w) + len(pad) for w in words), np.int64, len(words)))])
    return np.frombuffer("".join(w + pad for w in words).encode("utf-32-le"), np.uint32), at


def scan(list_: Vocabulary, asked: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words and numbers of the asked words at one edit from them, where both share the first ``bases`` letters.

    All ranges of words that share ``depth`` letters are looked at together, each with the asked words that reach it: the next letter splits
    a range where the common prefixes of neighbours end, and its row goes on from the row of the range. Rows without a cell of at
    most one edit are dropped, and with them all words of their range.
    """
    letters, at = flat(asked, "\0" * PAD)
    sizes = np.diff(at) - PAD
    base = np.fromiter(map(bases, asked), np.int64, len(asked))
    prefixes = [x[:b] for x, b in zip(asked, base.tolist(), strict=True)]
    stretch = {p: (bisect_left(list_.words, p), bisect_right(list_.words, p + AFTER)) for p in set(prefixes)}
    begin, end = (np.array([stretch[p][k] for p in prefixes], np.int64) for k in (0, 1))
    some = np.flatnonzero(end > begin)
    some = some[np.argsort(base[some], kind="stable")]
    starts = base[some]
    none = np.zeros(0, np.int64)
    who, low, high, row = none, none, none, np.zeros(0, np.uint8)
    depth, used, hits = 0, 0, [(none, none)]
    while len(who) or used < len(some):
        depth = depth if len(who) else int(starts[used])
        more = int(np.searchsorted(starts, depth, side="right"))
        new, used = some[used:more], more
        who, low, high = np.concatenate([who, new]), np.concatenate([low, begin[new]]), np.concatenate([high, end[new]])
        row = np.concatenate([row, np.full(len(new), FIRST_ROW, np.uint8)])
        cuts = np.append(np.flatnonzero(list_.shared <= depth), len(list_.words))  # where words differ in the next letter or before
        first = np.searchsorted(cuts, low) + (list_.sizes[low] == depth)  # a word that ends here goes no further
        n = np.searchsorted(cuts, high) - first
        of, cut = np.repeat(np.arange(len(who)), n), spread(first, n)
        low, high, who = cuts[cut], cuts[cut + 1], who[of]
        letter, q = list_.letters[list_.at[low] + depth], at[who] + depth
        same = (letters[q - 1] == letter) * FOUR + (letters[q] == letter) * TWO + (letters[q + 1] == letter)
        row = AFTER_ROW[row[of] * EIGHT + same]
        depth += 1
        alive = np.flatnonzero(row != DEAD_ROW)
        who, low, high, row = who[alive], low[alive], high[alive], row[alive]
        cell = sizes[who] - depth + 1  # of the row, where the asked word ends
        done = np.flatnonzero((list_.sizes[low] == depth) & (cell >= 0) & (cell <= 2))
        done = done[CELLS[row[done], cell[done]] == 1]
        hits.append((low[done], who[done]))
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def bases(q: str) -> int:
    """Letters of a list entry, its direction included, that all of its partners in this direction share."""
    shorter = len(q) - 2  # a partner may have a letter less
    return 1 + (shorter // 2 if q[0] == "f" else shorter - shorter // 2)


# ---- tables ----


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, near, near_n`` for words with near ones, from ``word, n``: how many, and which has the largest n."""
    n_shards = max(1, min(MOST_SHARDS, -(-2 * words.count() // SHARD_WORDS)))
    both = F.explode(F.array(F.concat(F.lit("f"), "word"), F.concat(F.lit("r"), F.reverse("word")))).alias("x")
    entries = words.select(both, "n").repartitionByRange(n_shards, "x").sortWithinPartitions("x")
    entries = stash(entries.withColumn("shard", F.spark_partition_id()), "vocabulary")
    bounds = entries.groupBy("shard").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("low").collect()
    shards, lows, highs = [b.shard for b in bounds], [b.low for b in bounds], [b.high for b in bounds]
    prefixes = [a[: common(a, b)] for a, b in zip(lows, highs, strict=True)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, who, row = [], [], []
            for i, q in enumerate(batch.column("x").to_pylist()):
                base = bases(q)
                first, last = bisect_left(highs, q[:base]), bisect_right(lows, q[:base] + AFTER)
                for s in range(first, last):
                    if len(prefixes[s]) <= base or within_one(prefixes[s], q, base):
                        to.append(shards[s])
                        who.append(1)
                        row.append(i)
            n = batch.num_rows
            picked = batch.select(["x", "n"]).take(pa.array([*range(n), *row], pa.int64()))
            yield picked.append_column("shard", pa.array(batch.column("shard").to_pylist() + to, pa.int32())).append_column("asks", pa.array([0] * n + who, pa.int32()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, words_, counts, asked, list_ = None, [], [], [], None
        for batch in batches:
            found = []
            for x, n, s, asks in zip(*(batch.column(c).to_pylist() for c in ("x", "n", "shard", "asks")), strict=True):
                if s != shard:
                    found += answers(list_, counts, asked)
                    shard, words_, counts, asked, list_ = s, [], [], [], None
                if asks:
                    list_ = list_ or Vocabulary(words_)
                    asked.append(x)
                    if len(asked) == ASKED:
                        found += answers(list_, counts, asked)
                        asked = []
                else:
                    words_.append(x)
                    counts.append(n)
            found += answers(list_, counts, asked)
            asked = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "hits", "near", "near_n"])

    def answers(list_, counts, asked):
        if not asked:
            return []
        best: dict[str, tuple] = {}
        for i, j in zip(*(x.tolist() for x in scan(list_, asked)), strict=True):
            x, w = asked[j], list_.words[i]
            forwards = x[0] == "f"
            word, near = (x[1:], w[1:]) if forwards else (x[:0:-1], w[:0:-1])
            if forwards == (common(word, near) >= min(len(word), len(near)) // 2):  # else the other list has the pair
                hits, most = best.get(word, (0, (0, "")))
                best[word] = hits + 1, min(most, (-counts[i], near))
        return [(word, hits, most[1], -most[0]) for word, (hits, most) in best.items()]

    sent = entries.mapInArrow(send, "x string, n long, shard int, asks int")
    hits = sent.repartition(n_shards, "shard").sortWithinPartitions("shard", "asks", "x").mapInArrow(search, "word string, hits long, near string, near_n long")
    best = hits.groupBy("word").agg(F.sum("hits").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    return best.select("word", "n_near", "best.near", (-F.col("best.minus")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form``: where following the forms ends. Each round doubles the steps taken."""
    now = stash(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("w"), F.col("root").alias("further"))
        now = stash(now.join(ahead, now["root"] == ahead["w"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(words: DataFrame, lead: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``word, n``.

    ``form`` is the near word of largest n where that is at least ``lead`` times the word's own, ``root`` what following the forms leads to.
    """
    words = stash(words.select("word", "n"), "words")
    near = near_words(words).withColumnRenamed("word", "w")
    whole = words.join(near, words["word"] == near["w"], "left")
    formed = F.col("near_n") >= lead * F.col("n")
    whole = stash(whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "variants")
    found = roots(whole.where("form IS NOT NULL")).withColumnRenamed("word", "w")
    return whole.join(found, whole["word"] == found["w"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
