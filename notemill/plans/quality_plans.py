"""Queries Q01 to Q11."""

from __future__ import annotations

from notemill.functions import fixed, text
from notemill.operators import quality as q
from notemill.operators import tokens as tk
from notemill.plans.base import query, quoted
from notemill.plans.text_plans import SENTENCES_SQL, WORDS_SQL
from notemill.plans.token_plans import LIST_SQL, TOKENS_SQL
from notemill.sources.notes import notes
from pyspark.sql import functions as F

SYLLABLES = """list_transform([regexp_replace(lower({w}), '[^a-z]', '', 'g')], lambda z: CASE WHEN z = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(z, '[aeiouy]+'))
  - CASE WHEN ends_with(z, 'e') AND NOT ends_with(z, 'le') AND NOT ends_with(z, 'ee') AND NOT ends_with(z, 'ye') AND len(regexp_extract_all(z, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END)[1]"""
BASE_SQL = TOKENS_SQL + f""", said AS (SELECT note_id, {SENTENCES_SQL.format('raw_transcript')} AS s, {WORDS_SQL.format('raw_transcript')} AS ws, {WORDS_SQL.format('lower(raw_transcript)')} AS lw FROM notes),
flesch AS (SELECT note_id, CASE WHEN len(ws) > 0 AND len(s) > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * (len(ws) / len(s)) - 84.6::DOUBLE * (list_sum(list_transform(ws, lambda w: {SYLLABLES.format(w='w')})) / len(ws)) ELSE 0 END AS flesch, len(ws) AS word_count, len(s) AS sentence_count FROM said),
words AS (SELECT note_id, unnest(lw) AS word FROM said),
content AS (SELECT note_id, sum(n) FILTER (WHERE n > 1) AS again, sum(n) AS n FROM (SELECT note_id, word, count(*) AS n FROM words WHERE length(word) > 2 AND word NOT IN ({quoted(fixed.QUALITY_STOPWORDS)}) GROUP BY ALL) GROUP BY ALL),
devices AS (SELECT note_id, count(*) AS n, count(*) FILTER (WHERE word IN ({quoted(fixed.PRONOUNS)})) AS pro, count(*) FILTER (WHERE word IN ({quoted(fixed.SIGNPOSTS)})) AS sign, count(*) FILTER (WHERE word IN ({quoted(fixed.ANAPHORIC)})) AS ana FROM words GROUP BY ALL),
cohesion AS (SELECT s.note_id, CASE WHEN coalesce(d.n, 0) = 0 THEN 0 ELSE (least(pro / d.n / 0.15::DOUBLE, 1) + CASE WHEN len(s) > 0 THEN least(sign / len(s), 1) ELSE 0 END + coalesce(coalesce(again, 0) / c.n, 0) + least(ana / d.n / 0.08::DOUBLE, 1)) / 4 END AS cohesion
  FROM said s LEFT JOIN devices d USING (note_id) LEFT JOIN content c USING (note_id)),
sents AS (SELECT note_id, unnest(s) AS raw_transcript, generate_subscripts(s, 1) AS sent FROM said),
sc AS (SELECT note_id, sent, word, count(*) AS n FROM (SELECT note_id, sent, unnest({LIST_SQL}) AS word FROM sents) GROUP BY ALL),
norms AS (SELECT note_id, sent, sqrt(sum(n * n)) AS norm FROM sc GROUP BY ALL),
dots AS (SELECT a.note_id, a.sent, sum(a.n * b.n) AS dot FROM sc a JOIN sc b ON a.note_id = b.note_id AND b.sent = a.sent + 1 AND a.word = b.word GROUP BY ALL),
cos AS (SELECT d.note_id, sum(dot / (a.norm * b.norm)) AS total FROM dots d JOIN norms a USING (note_id, sent) JOIN norms b ON b.note_id = d.note_id AND b.sent = d.sent + 1 GROUP BY ALL),
coherence AS (SELECT s.note_id, CASE len(s) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE coalesce(total, 0) / (len(s) - 1) END AS coherence FROM said s LEFT JOIN cos USING (note_id))"""


@query("q01_count_syllables", f"WITH {TOKENS_SQL}, w AS (SELECT DISTINCT unnest({WORDS_SQL.format('raw_transcript')}) AS word FROM notes) SELECT word, {SYLLABLES.format(w='word')} AS syllables FROM w")
def q01(spark, sf_dir):
    return notes(spark, sf_dir).select(F.explode(text.words(F.col("raw_transcript"))).alias("word")).distinct().withColumn("syllables", q.syllables(F.col("word")))


@query("q02_flesch_reading_ease", f"WITH {BASE_SQL} SELECT note_id, round_even(flesch, 4) AS flesch FROM flesch")
def q02(spark, sf_dir):
    return notes(spark, sf_dir).select("note_id", F.bround(q.flesch(F.col("raw_transcript")), 4).alias("flesch"))


@query("q03_cohesion", f"WITH {BASE_SQL} SELECT note_id, round_even(cohesion, 4) AS cohesion FROM cohesion")
def q03(spark, sf_dir):
    return notes(spark, sf_dir).select("note_id", F.bround(q.cohesion(F.col("raw_transcript")), 4).alias("cohesion"))


@query("q04_coherence", f"WITH {BASE_SQL} SELECT note_id, round_even(coherence, 4) AS coherence FROM coherence")
def q04(spark, sf_dir):
    return q.coherence(notes(spark, sf_dir)).withColumn("coherence", F.bround("coherence", 4))


@query("q05_shannon_entropy", f"WITH {BASE_SQL}, t AS (SELECT source, word, count(*) AS n FROM tokens JOIN notes USING (note_id) GROUP BY ALL), sp AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM t) SELECT source, CASE WHEN count(*) > 1 THEN round_even(-sum(p * log2(p)) / log2(count(*)), 4) ELSE 0 END AS entropy FROM sp GROUP BY ALL")
def q05(spark, sf_dir):
    """Of the words of each source."""
    base = notes(spark, sf_dir)
    words = base.select("source", F.explode(tk.token_list(F.col("raw_transcript"))).alias("word"))
    return tk.entropy(words.groupBy("source", "word").agg(F.count("*").alias("n")), "source", "n")


# Entropy is taken over a note's themes, which SQL cannot fold: Q06 and Q08 to Q11 are held against plain versions in the tests.


@query("q06_entropy")
def q06(spark, sf_dir):
    return tk.note_entropy(notes(spark, sf_dir))


@query("q07_normalize_metrics", f"WITH {BASE_SQL} SELECT note_id, floor(least(greatest(flesch / 100, 0), 1) * 10000 + 0.5) / 10000 AS readability FROM flesch")
def q07(spark, sf_dir):
    return notes(spark, sf_dir).select("note_id", q.rounded(q.min_max(q.flesch(F.col("raw_transcript")), 0, 100)).alias("readability"))


@query("q08_quality_score")
def q08(spark, sf_dir):
    """Mean score of documents labelled good and bad."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("note_id"), "quality")
    return q.score_notes(notes(spark, sf_dir)).join(labels, "note_id").groupBy("quality").agg(F.count("*").alias("n"), F.bround(F.avg("quality_score"), 3).alias("mean_score"))


@query("q09_score_notes")
def q09(spark, sf_dir):
    return q.score_notes(notes(spark, sf_dir))


@query("q10_describe_quality")
def q10(spark, sf_dir):
    return q.score_notes(notes(spark, sf_dir)).select("note_id", q.describe(F.col("quality_score")).alias("band"))


@query("q11_subject_quality")
def q11(spark, sf_dir):
    base = notes(spark, sf_dir)
    return q.score_notes(base).join(base.select("note_id", "source"), "note_id").groupBy("source").agg(F.bround(F.avg("quality_score"), 3).alias("mean_score"))
