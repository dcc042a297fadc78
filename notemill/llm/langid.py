"""Operator 4: language by compression with raw-content zstandard dictionaries.

Each language has one dictionary of sample text. A text is cut into pieces of
``PIECE_BYTES``, every piece is compressed with every dictionary, and the language
whose pieces are smallest in all is chosen. Pieces are short so that a long text
cannot replace the dictionary by its own history. Text is lower-cased first.

The sample is bounded: ``BINS`` documents per language at most, spread by a hash of
the key. Each gives an equal share of its language's dictionary, in ``SLICES`` slices spread evenly over
its whole text, so that all of the sample is used. Every language that was learned has a dictionary, of ``DICT_BYTES``
or of its share of ``MODEL_BYTES`` when there are many. Everything else
reads whole texts where they lie; nothing is shuffled but the sample's keys.

Defined results: null text or text without a letter has language ``und``, score 0 and
is rejected. On equal sizes the language with more training documents wins, then the
first by name. A text is rejected when the runner-up is less than ``margin`` larger, whatever its length;
for a text of a few bytes that means an equal size.
Without any training row all texts are ``und``. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, SLICES, DICT_BYTES = 64, 8, 64 << 10
#: All dictionaries together; what a task holds and a broadcast sends.
MODEL_BYTES = 32 << 20
PIECE_BYTES, LEVEL = 1024, 6
MARGIN = 0.002
#: How fast the score rises with the runner-up's relative size.
SHARPNESS = 40.0
#: Letters, and a few numerals that the second test leaves out.
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, the language with most training rows first."""

    dictionaries: tuple[tuple[str, bytes], ...]


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Dictionaries from labelled rows; rows without label or letter teach nothing."""
    rows = train.selectExpr(f"`{key}` AS k", f"`{text}` AS t", f"`{lang}` AS l").where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    order = F.xxhash64("k")
    bins = rows.groupBy("l", F.pmod(F.xxhash64("k", F.lit("bin")), F.lit(BINS)).alias("b")).agg(F.min_by("k", order).alias("k"), F.count("*").alias("n"))
    chosen = bins.collect()  # at most BINS rows per language
    counts: dict[str, int] = {}
    for r in chosen:
        counts[r.l] = counts.get(r.l, 0) + r.n
    langs = sorted(counts, key=lambda x: (-counts[x], x))
    if not langs:
        return LanguageModel(())
    held = {x: sum(r.l == x for r in chosen) for x in langs}
    share = {x: min(DICT_BYTES, MODEL_BYTES // len(langs)) // held[x] for x in langs}
    wanted = train.sparkSession.createDataFrame([(r.k, r.l, share[r.l]) for r in chosen], f"k {train.schema[key].dataType.simpleString()}, l string, take int")
    joined = rows.join(F.broadcast(wanted), ["k", "l"]).select("l", order.alias("o"), sampled(F.col("t"), F.col("take")).alias("t"))
    texts: dict[str, dict[int, str]] = {}
    for r in joined.groupBy("l", "o").agg(F.min("t").alias("t")).collect():
        texts.setdefault(r.l, {})[r.o] = r.t
    dictionary = lambda x: b"\n".join(t.lower().encode()[: share[x]] for _, t in sorted(texts[x].items()))
    return LanguageModel(tuple((x, dictionary(x)) for x in langs))


def sampled(text: Column, take: Column) -> Column:
    """``take`` characters of a text in slices with even gaps between them; all of a shorter one."""
    size = F.floor(take / SLICES).cast("int")
    room = F.length(text) - size
    slices = F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.substring(text, F.floor(room * i / (SLICES - 1)).cast("int") + 1, size))
    return F.when(F.length(text) <= take, text).otherwise(F.array_join(slices, ""))


@lru_cache(maxsize=4)
def compressors(model: LanguageModel) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, raw in model.dictionaries:
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=PIECE_BYTES, dict_size=len(raw), write_content_size=False, write_dict_id=False, write_checksum=False)
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(dict_data=known, compression_params=how))
    return out


def decide(text: str | None, model: LanguageModel, margin: float = MARGIN) -> tuple[str, float, bool]:
    """Language, score and whether it is rejected."""
    if text is None or not model.dictionaries or not any(m[0].isalpha() for m in LETTER.finditer(text)):
        return "und", 0.0, True
    raw = text.lower().encode()
    pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
    sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in compressors(model)], float)
    best = int(sizes.argmin())
    over = sizes / sizes[best] - 1
    score = float(1 / np.exp(-SHARPNESS * over).sum())
    narrow = len(sizes) > 1 and float(np.delete(over, best).min()) < margin
    return model.dictionaries[best][0], score, narrow


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred string, lang_score double, lang_rejected boolean``; the inputs are the texts alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_BYTES

    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")  # columns of these names are replaced
    text_at = docs.columns.index(text)
    names, kinds = [f"c{i}" for i in range(len(docs.columns))], [f.dataType.simpleString() for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decide(t, shared.value, margin) for t in batch.column(text_at).to_pylist()]
            new = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "p", "s", "r"])

    schema = ", ".join(f"{n} {k}" for n, k in zip([*names, "p", "s", "r"], [*kinds, "string", "double", "boolean"], strict=True))
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns, "lang_pred", "lang_score", "lang_rejected")
