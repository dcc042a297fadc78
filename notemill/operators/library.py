"""The library as a whole: overview, outline, summaries of topics and subjects, scopes, retakes, rewrite guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from notemill.functions.text import let
from notemill.operators import vectors as vec

FEW_WORDS, KEPT_SHARE, LEAST_CHANGED = 8, 0.25, 2
#: Groups whose mean vectors may be broadcast, 2 KB each.
MOST_GROUPS = 5000


def overview(notes: DataFrame) -> DataFrame:
    """One row: numbers of subjects, topics and notes, and notes of each type as a sorted array."""
    kinds = notes.groupBy("note_type").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "note_type"))).alias("k"))
    totals = notes.agg(F.countDistinct("source").alias("subjects"), F.countDistinct("topic_name").alias("topics"), F.count("*").alias("notes"))
    return totals.crossJoin(kinds).select("subjects", "topics", "notes", F.transform("k", lambda x: F.concat(x["note_type"], F.lit(": "), (-x["m"]).cast("string"))).alias("types"))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def narrate(found: DataFrame) -> DataFrame:
    return found.select(F.concat(F.lit("You have "), plural(F.col("subjects"), "subject", "subjects"), F.lit(", "), plural(F.col("topics"), "topic", "topics"), F.lit(" and "), plural(F.col("notes"), "note", "notes"), F.lit(".")).alias("spoken"))


def topic_lines(notes: DataFrame, most: int = 5) -> DataFrame:
    """Per topic its number of notes and its newest ones, up to ``most``."""
    order = Window.partitionBy("source", "topic_name").orderBy(F.desc("created_epoch"), F.desc("note_id"))
    newest = notes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).groupBy("source", "topic_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "note_id"))), lambda x: x["note_id"]).alias("newest"))
    return notes.groupBy("source", "topic_name").agg(F.count("*").alias("notes")).join(newest, ["source", "topic_name"])


def outline(notes: DataFrame) -> DataFrame:
    """Per subject its topics by lower-case name, each with its number of notes."""
    topics = notes.groupBy("source", "topic_name").agg(F.count("*").alias("n"))
    return topics.groupBy("source").agg(F.sum("n").alias("notes"), F.transform(F.array_sort(F.collect_list(F.struct(F.lower("topic_name").alias("l"), "topic_name", "n"))), lambda x: F.struct(x["topic_name"].alias("topic"), x["n"].alias("notes"))).alias("topics"))


def outline_markdown(found: DataFrame) -> DataFrame:
    lines = F.transform("topics", lambda x: F.concat(F.lit("- "), x["topic"], F.lit(" ("), x["notes"].cast("string"), F.lit(")")))
    return found.select("source", F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.array_join(lines, "\n")).alias("markdown"))


def cut_words(body: Column, most: int) -> Column:
    words = F.filter(F.split(F.trim(body), r"\s+"), lambda w: w != "")
    return let(words, lambda w: F.when(F.size(w) <= most, F.trim(body)).otherwise(F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("..."))))


def group_summaries(notes: DataFrame, by: str, body: str = "raw_transcript", most: int = 12, members: DataFrame | None = None) -> DataFrame:
    """The note nearest to its group's mean hashed vector, cut to a number of words.

    ``members`` (``by, note_id``) says which notes are in which groups, if a column of the notes doesn't. A note keeps its
    words' buckets as one row and meets its group's mean as an array, so a large group is no hot key of a large join.
    """
    members = notes.select(by, "note_id") if members is None else members.select(by, "note_id")
    sparse = vec.embed_sparse(notes.where(F.trim(body) != ""), "note_id", body)
    held = sparse.groupBy("note_id").agg(F.collect_list(F.struct("bucket", "weight")).alias("v")).join(members, "note_id")
    mean = held.select(by, F.explode("v").alias("x")).groupBy(by, F.col("x.bucket").alias("bucket")).agg(F.sum("x.weight").alias("m"))
    sums = mean.groupBy(by).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"), F.map_from_entries(F.collect_list(F.struct("bucket", "m"))).alias("held"))
    means = sums.select(by, "norm", F.transform(F.sequence(F.lit(0), F.lit(vec.DIM - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0.0))).alias("mean"))
    dot = F.aggregate("v", F.lit(0.0), lambda s, x: s + x["weight"] * F.get("mean", x["bucket"]))
    near = held.join(vec.fitting(means, MOST_GROUPS), by).select(by, "note_id", (F.floor(dot / F.col("norm") * 1e6 + 0.5) / 1e6).alias("score"))
    best = near.groupBy(by).agg(F.max(F.struct("score", (-F.col("note_id")).alias("k"))).alias("x")).select(by, (-F.col("x.k")).alias("note_id"))
    return best.join(notes.select("note_id", body), "note_id").select(by, "note_id", cut_words(F.col(body), most).alias("summary"))


def resolve_scope(names: DataFrame, subjects: DataFrame, topics: DataFrame) -> DataFrame:
    """What a spoken name means: a subject, else a topic, else nothing; compared in lower case."""
    key = F.lower(F.trim("name"))
    s = subjects.select(F.lower("source").alias("k"), F.col("source").alias("subject")).distinct()
    t = topics.select(F.lower("topic_name").alias("k2"), F.col("topic_name").alias("topic")).distinct()
    both = names.withColumn("q", key).join(s, F.col("q") == F.col("k"), "left").join(t, F.col("q") == F.col("k2"), "left")
    return both.select("name", "subject", F.when(F.col("subject").isNull(), F.col("topic")).alias("topic"))


@F.pandas_udf(IntegerType())
def kept_words(a, b):
    """Words of a in matching blocks with b, in order."""
    import pandas as pd
    from difflib import SequenceMatcher

    return pd.Series([sum(m.size for m in SequenceMatcher(None, x.split(), y.split(), autojunk=False).get_matching_blocks()) for x, y in zip(a, b, strict=True)], dtype="int32")


def rewrite_guard(pairs: DataFrame, original: str = "original", corrected: str = "corrected") -> DataFrame:
    """Accepts a correction when at most two words or a quarter are not kept, and the length changes no more."""
    size = lambda c: F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    limit = F.greatest(F.lit(LEAST_CHANGED), F.floor(KEPT_SHARE * F.col("n")))
    rows = pairs.withColumn("n", size(original)).withColumn("m", size(corrected)).withColumn("lost", F.col("n") - kept_words(original, corrected))
    return rows.withColumn("accepted", (F.col("m") > 0) & (F.col("lost") <= limit) & (F.abs(F.col("m") - F.col("n")) <= limit)).drop("n", "m")


def correction_policy(notes: DataFrame, body: str = "raw_transcript") -> DataFrame:
    """Why a note is not corrected: blank or too short; empty means it may be."""
    n = F.size(F.filter(F.split(F.trim(body), r"\s+"), lambda w: w != ""))
    return notes.select("note_id", F.when(n == 0, "blank").when(n < FEW_WORDS, "short").otherwise("").alias("skipped"))
