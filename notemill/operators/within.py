"""Figures of a note that come from its own sentences and words, made where the text lies: no row for a word or a pair, no shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions import text
from notemill.operators import tokens as tk

#: Words that one step looks at (one note at least), and pairs of words that it counts at once.
STEP_WORDS, STEP_PAIRS = 1 << 18, 1 << 21


def said(body: Column) -> Column:
    """Words of each sentence."""
    return F.transform(F.coalesce(text.sentences(body), F.array().cast("array<string>")), lambda s: tk.token_list(s))


class Said:
    """Word counts of all sentences of some notes: cells ``(sentence, word, count)`` in order, sentences numbered through."""

    def __init__(self, column: pa.Array):
        sentences = column.flatten()
        self.of_note = np.diff(column.offsets.to_numpy())
        self.note = np.repeat(np.arange(len(column)), self.of_note)
        self.n = len(self.note)
        words = sentences.flatten().dictionary_encode()
        self.kinds = max(len(words.dictionary), 1)
        key = np.repeat(np.arange(self.n), np.diff(sentences.offsets.to_numpy())) * self.kinds + words.indices.to_numpy()
        self.key, self.count = np.unique(key, return_counts=True)
        self.sentence, self.word = self.key // self.kinds, self.key % self.kinds
        self.norm = np.sqrt(np.bincount(self.sentence, self.count * self.count, self.n))


def coherences(s: Said) -> np.ndarray:
    """Mean cosine of each note's neighbouring sentences; 1 for one sentence, 0 for none."""
    if len(s.key):
        at = np.minimum(np.searchsorted(s.key, s.key + s.kinds), len(s.key) - 1)
        met = (s.key[at] == s.key + s.kinds) & (s.note[s.sentence] == s.note[s.sentence[at]])
        dot = np.bincount(s.sentence[met], s.count[met] * s.count[at[met]], s.n)
        a = np.flatnonzero(dot)
        total = np.bincount(s.note[a], dot[a] / (s.norm[a] * s.norm[a + 1]), len(s.of_note))
    else:
        total = np.zeros(len(s.of_note))
    return np.where(s.of_note > 1, total / np.maximum(s.of_note - 1, 1), s.of_note)


def likeness(s: Said) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a note's sentences that share a word, each direction counted, and the largest cosine of one."""
    pairs, most = np.zeros(len(s.of_note), np.int64), np.zeros(len(s.of_note))
    order = np.lexsort((s.sentence, s.word, s.note[s.sentence]))  # cells of a note and word lie together
    sentence, count = s.sentence[order], s.count[order]
    group = s.note[sentence] * s.kinds + s.word[order]
    later = np.searchsorted(group, group, "right") - np.arange(len(group)) - 1
    by = np.argsort(sentence, kind="stable")
    by = by[later[by] > 0]
    ends = np.cumsum(later[by])
    last_of = np.searchsorted(sentence[by], sentence[by], "right")  # a sentence's cells stay together
    first = 0
    while first < len(by):
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + STEP_PAIRS, "right"))
        last = int(last_of[first]) if last < last_of[first] else last if last == len(by) else int(np.searchsorted(sentence[by], sentence[by[last]], "left"))
        cells = by[first:last]
        times = later[cells]
        other = np.arange(times.sum()) + np.repeat(cells + 1 - (np.cumsum(times) - times), times)
        a = np.repeat(sentence[cells], times)
        met, where = np.unique(a * s.n + sentence[other], return_inverse=True)
        dot = np.bincount(where, np.repeat(count[cells], times) * count[other])
        a, b = met // s.n, met % s.n
        pairs += 2 * np.bincount(s.note[a], minlength=len(pairs))
        np.maximum.at(most, s.note[a], np.minimum(dot / (s.norm[a] * s.norm[b]), 1.0))
        first = last
    return pairs, most


def evenness(weights: np.ndarray) -> float:
    """Shannon entropy of weights over its largest value; 0 for one outcome."""
    weights = weights[weights > 0]
    if len(weights) < 2:
        return 0.0
    p = weights / weights.sum()
    return float(-(p * np.log2(p)).sum() / np.log2(len(p)))


def entropy_of(words: list[str], size: int) -> float | None:
    """Of the weights of a note's themes if it has several, else of its words; None without words. ``size`` counts white-space words."""
    if not words:
        return None
    themes = tk.joined_terms(tk.note_terms(words).items(), tk.most_of(size, 9))
    return evenness(np.array([w for _, w, _ in themes] if len(themes) > 1 else list(Counter(words).values()), float))


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column``, lists of lists of words, has about ``STEP_WORDS`` words in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(column)
        ends = lists.flatten().offsets.to_numpy()[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        row = 0
        while row < batch.num_rows:
            upto = max(row + 1, int(np.searchsorted(ends, ends[row] + STEP_WORDS, "right")) - 1)
            yield batch.slice(row, upto - row)
            row = upto


def mapped(rows: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``run`` over slices of ``rows``, which have ``said``."""
    return rows.mapInArrow(lambda batches: map(run, slices(batches, "said")), schema)


def kinds(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "said")


def with_coherence(rows: DataFrame) -> DataFrame:
    """``rows`` with ``coherence`` in place of ``said``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.drop_columns(["said"]).append_column("coherence", pa.array(coherences(Said(batch.column("said")))))

    return mapped(rows, run, kinds(rows) + ", coherence double")


def with_scores(rows: DataFrame) -> DataFrame:
    """``rows``, which have ``size``, with ``coherence`` and ``entropy`` in place of ``said``; no ``entropy`` without words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("said")
        spread = [entropy_of([w for s in note for w in s], n) for note, n in zip(column.to_pylist(), batch.column("size").to_pylist(), strict=True)]
        return batch.drop_columns(["said"]).append_column("coherence", pa.array(coherences(Said(column)))).append_column("entropy", pa.array(spread, pa.float64()))

    return mapped(rows, run, kinds(rows) + ", coherence double, entropy double")


def sentence_pairs(notes: DataFrame, body: str = "raw_transcript") -> DataFrame:
    """``note_id, pairs, most``: pairs of sentences that share a word, both directions, and the largest cosine; notes without one have no row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs, most = likeness(Said(batch.column("said")))
        rows = np.flatnonzero(pairs)
        return pa.RecordBatch.from_arrays([batch.column("note_id").take(pa.array(rows)), pa.array(pairs[rows]), pa.array(most[rows])], names=["note_id", "pairs", "most"])

    rows = notes.select("note_id", said(F.col(body)).alias("said"))
    return mapped(rows, run, kinds(rows) + ", pairs long, most double")
