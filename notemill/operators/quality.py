"""Quality of notes: readability, cohesion, coherence, entropy and their mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions import fixed, text
from notemill.functions.text import let
from notemill.operators import tokens as tk
from notemill.operators import within

BANDS = [(0.75, "high quality: readable, clear and thematically consistent"), (0.55, "good quality"), (0.35, "mixed quality: some of this may be unclear or wandering")]
LOWEST = "low quality: random or hard to follow, with little information"


def syllables(word: Column) -> Column:
    """Vowel groups without a silent final e; one at least."""

    def of(w: Column) -> Column:
        n = F.size(F.regexp_extract_all(w, F.lit("[aeiouy]+"), F.lit(0)))
        silent = w.endswith("e") & ~w.endswith("le") & ~w.endswith("ee") & ~w.endswith("ye") & (n > 1)
        return F.when(w == "", 0).otherwise(F.greatest(n - silent.cast("int"), F.lit(1)))

    return let(F.regexp_replace(F.lower(word), "[^a-z]", ""), of)


def flesch(body: Column) -> Column:
    def of(w: Column) -> Column:
        n, s = F.size(w), F.size(text.sentences(body))
        said = F.aggregate(w, F.lit(0), lambda a, x: a + syllables(x))
        return F.when((n > 0) & (s > 0), 206.835 - 1.015 * (n / s) - 84.6 * (said / n)).otherwise(0.0)

    return let(text.words(body), of)


def min_max(value: Column, low: float, high: float, new_low: float = 0.0, new_high: float = 1.0) -> Column:
    """Linear rescaling with clamping."""
    if high == low:
        return F.lit(new_low)
    return F.least(F.greatest(new_low + (value - low) / (high - low) * (new_high - new_low), F.lit(new_low)), F.lit(new_high))


def cohesion(body: Column) -> Column:
    """Mean of pronouns, signposts, repeated keywords and words that point back, each capped at 1."""

    def of(w: Column) -> Column:
        n = F.size(w)
        among = lambda words: F.size(F.filter(w, lambda x: x.isin(words)))
        content = F.filter(w, lambda x: (F.length(x) > 2) & ~x.isin(fixed.QUALITY_STOPWORDS))

        def repeated(c: Column) -> Column:
            """Words that occur again, by sorting: a word is repeated if a neighbour is equal."""
            s = F.array_sort(c)
            again = let(s, lambda a: F.size(F.filter(F.transform(a, lambda x, i: (x == F.get(a, i + 1)) | (x == F.get(a, i - 1))), lambda e: F.coalesce(e, F.lit(False)))))
            return F.when(F.size(c) > 0, again / F.size(c)).otherwise(0.0)

        marks = F.size(text.sentences(body))
        parts = [
            F.least(among(fixed.PRONOUNS) / n / 0.15, F.lit(1.0)),
            F.when(marks > 0, F.least(among(fixed.SIGNPOSTS) / marks, F.lit(1.0))).otherwise(0.0),
            let(content, repeated),
            F.least(among(fixed.ANAPHORIC) / n / 0.08, F.lit(1.0)),
        ]
        return F.when(n > 0, (parts[0] + parts[1] + parts[2] + parts[3]) / 4).otherwise(0.0)

    return let(F.transform(text.words(body), F.lower), of)


def coherence(notes: DataFrame, body: str = "raw_transcript") -> DataFrame:
    """Mean cosine of neighbouring sentences by their words; 1 for one sentence, 0 for none."""
    return within.with_coherence(notes.select("note_id", within.said(F.col(body)).alias("said")))


def quality(readability: Column, cohesion_: Column, coherence_: Column, entropy: Column) -> Column:
    """Equal parts of the four metrics, entropy turned round."""
    return F.least(F.greatest(0.25 * (readability + cohesion_ + coherence_ + (1 - entropy)), F.lit(0.0)), F.lit(1.0))


def rounded(value: Column, places: int = 4) -> Column:
    """Half up on the stored number, the same in every engine."""
    return F.floor(value * 10**places + 0.5) / 10**places


def describe(score: Column) -> Column:
    out = F.when(score >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise(LOWEST)


def score_notes(notes: DataFrame, body: str = "raw_transcript", confidence: str | None = None) -> DataFrame:
    """All metrics of each note, rounded to four places."""
    column = F.col(body)
    own = notes.select("note_id", min_max(flesch(column), 0, 100).alias("readability"), cohesion(column).alias("cohesion"), F.size(text.words(column)).cast("long").alias("word_count"), F.size(text.sentences(column)).cast("long").alias("sentence_count"), F.least(F.greatest(F.col(confidence) if confidence else F.lit(1.0), F.lit(0.0)), F.lit(1.0)).alias("transcription_confidence"), tk.word_number(column).alias("size"), within.said(column).alias("said"))
    all_ = within.with_scores(own).withColumn("entropy", F.coalesce(F.bround("entropy", 4), F.lit(0.0)))
    four = [rounded(F.col(c)).alias(c) for c in ("readability", "cohesion", "coherence", "entropy", "transcription_confidence")]
    score = F.bround(quality(F.col("readability"), F.col("cohesion"), F.col("coherence"), F.col("entropy")), 4)
    return all_.select("note_id", *four, "word_count", "sentence_count", score.alias("quality_score"))
