"""Transcript segments and signal levels: confidence, unclear passages, sessions by gaps, level repair."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions import fixed
from notemill.operators.vectors import fitting


def confidence(segments: DataFrame, by: str = "recording_id") -> DataFrame:
    """Span-weighted log probability, mean silence chance and confidence of each recording."""
    span = F.greatest(F.col("end") - F.col("start"), F.lit(1e-6))
    known = F.col("avg_logprob").isNotNull()
    weighted = F.try_divide(F.sum(F.when(known, F.col("avg_logprob") * span)), F.sum(F.when(known, span)))
    out = segments.groupBy(by).agg(weighted.alias("logprob"), F.avg("no_speech_prob").alias("no_speech"))
    return out.withColumn("confidence", F.coalesce(F.least(F.greatest(F.exp("logprob"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))


def unclear_passages(segments: DataFrame, least: float = -0.5, most: int = 6, by: str = "recording_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy("start", "segment_id")
    return segments.where(F.col("avg_logprob") < least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(by, "place", "segment_id", "text")


def drop_no_speech(segments: DataFrame, most: float = 0.6) -> DataFrame:
    return segments.where(F.col("no_speech_prob").isNull() | (F.col("no_speech_prob") <= most))


def assemble(segments: DataFrame, by: str = "recording_id") -> DataFrame:
    """Text of each recording in order, a period after each piece."""
    pieces = segments.where(F.trim("text") != "")
    text = F.transform(F.array_sort(F.collect_list(F.struct("start", "segment_id", F.trim("text").alias("t")))), lambda x: F.when(x["t"].rlike(r"[.!?]$"), x["t"]).otherwise(F.concat(x["t"], F.lit("."))))
    return pieces.groupBy(by).agg(F.array_join(text, " ").alias("transcript"), F.count("*").alias("pieces"))


def sessions(segments: DataFrame, gap: float, shortest: float = 0.0, by: str = "recording_id") -> DataFrame:
    """Runs of segments with pauses under ``gap`` seconds; runs shorter than ``shortest`` drop out."""
    order = Window.partitionBy(by).orderBy("start", "segment_id")
    opens = (F.col("start") - F.lag("start").over(order) > gap).cast("int")
    numbered = segments.withColumn("session", F.sum(F.coalesce(opens, F.lit(0))).over(order))
    out = numbered.groupBy(by, "session").agg(F.min("start").alias("first"), F.max("start").alias("last"), F.count("*").alias("segments"))
    return out.where(F.col("last") - F.col("first") >= shortest)


def cap_sessions(segments: DataFrame, gap: float, cap: float, by: str = "recording_id") -> DataFrame:
    """Sessions cut into parts of at most ``cap`` seconds, with the quietest segment of each part's second half."""
    order = Window.partitionBy(by).orderBy("start", "segment_id")
    opens = (F.col("start") - F.lag("start").over(order) > gap).cast("int")
    numbered = segments.withColumn("session", F.sum(F.coalesce(opens, F.lit(0))).over(order))
    begin = F.min("start").over(Window.partitionBy(by, "session"))
    parts = numbered.withColumn("elapsed", F.col("start") - begin).withColumn("part", F.floor(F.col("elapsed") / cap))
    late = F.col("elapsed") - F.col("part") * cap >= cap / 2
    quiet = F.min(F.when(late, F.struct("level", "segment_id")))
    return parts.groupBy(by, "session", "part").agg(F.count("*").alias("segments"), quiet.alias("q")).select(by, "session", "part", "segments", F.col("q.segment_id").alias("cut_at"))


def quiet_cuts(segments: DataFrame, gap: float, cap: float, tolerance: float = 0.5, by: str = "recording_id") -> DataFrame:
    """Pieces of sessions, none longer than ``cap`` seconds: ``by, session, piece, first, last, segments, first_id``.

    A session that is longer is cut at the quietest segment of the second half of what is allowed, of those within ``tolerance`` of
    it the nearest to the middle of that half, and starts again there; without a segment in that half it is cut after it. Segments of
    unknown level are as loud as can be. Recordings are sorted by Spark and read one segment at a time; a task holds the
    segments of one piece.
    """
    kind, name = segments.schema[by].dataType.simpleString(), segments.schema["segment_id"].dataType.simpleString()

    def cut_of(held: list[tuple]) -> float:
        begin = held[0][0]
        half = [(x[2] if x[2] is not None else float("inf"), abs(x[0] - begin - 0.75 * cap), x[0], x[1]) for x in held if cap / 2 <= x[0] - begin <= cap]
        if not half:
            return next(x[0] for x in held if x[0] - begin > cap)
        quietest = min(x[0] for x in half)
        return min(x[1:] for x in half if x[0] <= quietest + tolerance)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, session, piece, held, out = None, 0, 0, [], []

        def close(rows):
            out.append((of, session, piece, rows[0][0], rows[-1][0], len(rows), rows[0][1]))

        def made(type_):
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (type_[0], pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), type_[1]), strict=True)], names=[by, "session", "piece", "first", "last", "segments", "first_id"])

        types = None
        for batch in batches:
            types = batch.schema.field(by).type, batch.schema.field("segment_id").type
            for key, start, id_, level in zip(*(batch.column(c).to_pylist() for c in (by, "start", "segment_id", "level")), strict=True):
                if held and (key != of or start - held[-1][0] > gap):
                    close(held)
                    session, piece, held = session + 1 if key == of else 0, 0, []
                elif not held:
                    session, piece = 0, 0
                of = key
                held.append((start, id_, level))
                while start - held[0][0] > cap:
                    cut = cut_of(held)
                    at = next(i for i, x in enumerate(held) if x[0] >= cut)
                    close(held[:at])
                    piece, held = piece + 1, held[at:]
            if out:
                yield made(types)
        if held:
            close(held)
            yield made(types)

    rows = segments.where("start IS NOT NULL").select(by, F.col("start").cast("double").alias("start"), "segment_id", F.col("level").cast("double").alias("level"))
    return rows.repartition(by).sortWithinPartitions(by, "start", "segment_id").mapInArrow(run, f"{by} {kind}, session long, piece long, first double, last double, segments long, first_id {name}")


def damp_outliers(segments: DataFrame, tolerance: float = 12.0, reduction: float = 10.0, by: str = "recording_id") -> DataFrame:
    """Levels over the median by more than the tolerance are lowered."""
    known = segments.where("level IS NOT NULL").select(by, "level")
    sizes = known.groupBy(by).agg(F.count("*").alias("n"))
    ranked = known.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("level"))).join(sizes, by)  # sorted, never gathered
    middle = ranked.where("place IN ((n + 1) DIV 2, n DIV 2 + 1)").groupBy(by).agg(F.avg("level").alias("median"))
    both = segments.join(middle, by)
    return both.withColumn("level", F.when(F.col("level") > F.col("median") + tolerance, F.col("level") - reduction).otherwise(F.col("level"))).drop("median")


def shift_to_target(segments: DataFrame, target: float, by: str = "recording_id") -> DataFrame:
    """Levels moved so that a recording's mean meets the target."""
    mean = segments.groupBy(by).agg(F.avg("level").alias("mean"))
    return segments.join(mean, by).withColumn("level", F.col("level") + F.lit(target) - F.col("mean")).drop("mean")


def language_report(notes: DataFrame, code: str = "language") -> DataFrame:
    short = F.lower(F.substring_index(F.col(code), "-", 1))
    names = F.create_map(*[F.lit(x) for kv in fixed.LANGUAGES.items() for x in kv])
    blank = F.coalesce(F.col(code), F.lit("")) == ""
    return notes.withColumn("language_name", F.when(blank, "unknown").otherwise(F.coalesce(F.try_element_at(names, short), F.col(code)))).withColumn("is_english", ~blank & (short == "en")).withColumn("needs_translation", ~blank & (short != "en"))


def learn_languages(rows: DataFrame) -> DataFrame:
    """Smoothed log chances of words by language: ``word, lang, weight`` from ``lang, word``."""
    counts = rows.groupBy("lang", "word").agg(F.count("*").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return counts.join(fitting(totals, 10_000), "lang").select("lang", "word", (F.log((F.col("n") + 1) / (F.col("total") + F.col("kinds"))) - F.log(1 / (F.col("total") + F.col("kinds")))).alias("weight"))


def detect_languages(words: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Best language of each key from its distinct words ``key, word``."""
    scores = words.join(weights, "word").groupBy(key, "lang").agg(F.sum("weight").alias("score"))
    return scores.groupBy(key).agg(F.max(F.struct("score", "lang")).alias("x")).select(key, F.col("x.lang").alias("language"))
