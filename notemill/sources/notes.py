"""Canonical tables derived from the parquet tables: notes, topics, links, utterances, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds between notes, and the first one's time (2024-01-01 UTC).
STEP_SECONDS, EPOCH = 37 * 60, 1704067200
SEED_TYPES = ["academic", "brainstorm", "todo"]
#: Openings that notes made of documents get, so that rules for English notes have something to find.
OPENINGS = [
    "I need to return the library books to Doctor Mensah by next Tuesday. Also, email Priya about the poster session on May 9th.",
    "I must send Professor Okafor the draft before Thursday.",
    "A semaphore needs an atomic counter and a wait queue.",
    "What if we mapped the bus routes by sound? Maybe a small prototype would help.",
    "A queue is a list served in order. For example, print jobs wait in one.",
    "Paging splits memory into frames. File this under operating systems.",
    "Call Lena on 555 010 2233 or write to lena@example.org.",
    "um so  the the kernel ,, kernel swaps pages  and i think it works",
    "I have a meeting at 3:30 pm tomorrow. Remind me to print the agenda.",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_of(doc_id: Column) -> Column:
    return (F.lit(EPOCH) + doc_id * STEP_SECONDS).cast("long")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note per document."""
    docs = read(spark, sf_dir, "documents")
    kind = F.get(F.array(*[F.lit(x) for x in SEED_TYPES]), F.pmod(F.col("doc_id"), F.lit(3)).cast("int"))
    return docs.select(
        F.col("doc_id").alias("note_id"),
        F.coalesce("text", F.lit("")).alias("raw_transcript"),
        "source",
        F.col("lang").alias("language"),
        epoch_of(F.col("doc_id")).alias("created_epoch"),
        kind.alias("note_type"),
        F.concat("source", F.lit("-"), "lang").alias("topic_name"),
    )


def spoken_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that start with one of ``OPENINGS``, by turns."""
    opening = F.get(F.array(*[F.lit(x) for x in OPENINGS]), F.pmod(F.col("note_id"), F.lit(len(OPENINGS))).cast("int"))
    return notes(spark, sf_dir).withColumn("raw_transcript", F.concat(opening, F.lit(" "), "raw_transcript"))


def note_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of notes to topics: the own topic first, the language second."""
    both = F.array(F.struct(F.lit(0).alias("rank"), F.col("topic_name").alias("topic")), F.struct(F.lit(1).alias("rank"), F.col("language").alias("topic")))
    return notes(spark, sf_dir).select("note_id", "source", F.explode(both).alias("x")).select("note_id", F.col("source").alias("subject"), "x.topic", "x.rank")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations."""
    return read(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("utterance_id"), "conv_id", "turn", F.col("text").alias("utterance"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transcript segments of a recording per user."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("segment_id"),
        F.col("user_id").alias("recording_id"),
        start.alias("start"),
        (start + 1 + F.abs("value")).alias("end"),
        (-F.col("value") / 20).alias("avg_logprob"),
        (F.pmod(F.col("event_id"), F.lit(100)) / 100.0).alias("no_speech_prob"),
        F.col("event_type").alias("text"),
        F.col("value").alias("level"),
    )


# ---- the same tables in SQL ----

NOTES_SQL = f"""notes AS (SELECT doc_id AS note_id, coalesce(text, '') AS raw_transcript, source, lang AS language,
  {EPOCH} + doc_id * {STEP_SECONDS} AS created_epoch,
  CASE doc_id % 3 WHEN 0 THEN 'academic' WHEN 1 THEN 'brainstorm' ELSE 'todo' END AS note_type,
  source || '-' || lang AS topic_name FROM documents)"""

_CASES = " ".join(f"WHEN {i} THEN '{x.replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(OPENINGS))
SPOKEN_SQL = NOTES_SQL + f""", spoken AS (SELECT * REPLACE (CASE note_id % {len(OPENINGS)} {_CASES} END || ' ' || raw_transcript AS raw_transcript) FROM notes)"""
NOTE_TOPICS_SQL = NOTES_SQL + """, note_topics AS (SELECT note_id, source AS subject, topic_name AS topic, 0 AS rank FROM notes
  UNION ALL SELECT note_id, source, language, 1 FROM notes)"""
UTTERANCES_SQL = "utterances AS (SELECT conv_id * 1000 + turn AS utterance_id, conv_id, turn, text AS utterance FROM conversations WHERE role = 'user')"
SEGMENTS_SQL = """segments AS (SELECT event_id AS segment_id, user_id AS recording_id, epoch(ts) AS "start", epoch(ts) + 1 + abs(value) AS "end",
  -value / 20 AS avg_logprob, (event_id % 100) / 100.0::DOUBLE AS no_speech_prob, event_type AS text, value AS level FROM events)"""
