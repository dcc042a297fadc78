"""Queries N01 to N14: tokens and word statistics over notes."""

from __future__ import annotations

from notemill.functions import fixed
from notemill.operators import tokens as tk
from notemill.plans.base import query, quoted
from notemill.sources.notes import NOTES_SQL, notes
from pyspark.sql import functions as F

EDGE = fixed.STRIPPED_PUNCTUATION.replace("'", "''")
LIST_SQL = f"""list_filter(list_transform(string_split(regexp_replace(raw_transcript, '\\s+', ' ', 'g'), ' '), lambda w: lower(trim(w, '{EDGE}'))),
  lambda w: length(w) > 1 AND w NOT IN ({quoted(fixed.NOISE_WORDS + fixed.TOKEN_STOPWORDS)}))"""
TOKENS_SQL = NOTES_SQL + f""", lists AS (SELECT note_id, {LIST_SQL} AS w FROM notes),
tokens AS (SELECT note_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM lists),
counts AS (SELECT note_id, word, count(*) AS frequency FROM tokens GROUP BY ALL)"""
PAIRS_SQL = TOKENS_SQL + """, nexts AS (SELECT note_id, word AS "first", lead(word) OVER (PARTITION BY note_id ORDER BY pos) AS "second" FROM tokens),
pairs AS (SELECT note_id, "first", "second", count(*) AS frequency FROM nexts WHERE "second" IS NOT NULL GROUP BY ALL),
totals AS (SELECT note_id, count(*) AS total FROM tokens GROUP BY ALL)"""
CELL = "CASE WHEN {0} > 0 AND ({1})::DOUBLE * ({2}) > 0 THEN {0} * ln({0} * total::DOUBLE / (({1})::DOUBLE * ({2}))) ELSE 0 END"
RATIO = "2 * (" + " + ".join(CELL.format(*c) for c in (("frequency", "n1", "n2"), ("(n2 - frequency)", "total - n1", "n2"), ("(n1 - frequency)", "n1", "total - n2"), ("(total - n1 - n2 + frequency)", "total - n1", "total - n2"))) + ")"
COLLOCATIONS_SQL = PAIRS_SQL + f""", joined AS (SELECT p.*, total, a.frequency AS n1, b.frequency AS n2 FROM pairs p JOIN totals USING (note_id)
  JOIN counts a ON a.note_id = p.note_id AND a.word = p."first" JOIN counts b ON b.note_id = p.note_id AND b.word = p."second"
  WHERE p.frequency >= CASE WHEN total > 200 THEN 2 ELSE 1 END),
scored AS (SELECT note_id, "first", "second", frequency, round_even({RATIO}, 4) AS score FROM joined),
collocations AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY score DESC, "first", "second") AS rank FROM scored QUALIFY rank <= 10)"""


def note_tokens(spark, sf_dir):
    return tk.tokens(notes(spark, sf_dir))


@query("n01_tokenize", f"WITH {TOKENS_SQL} SELECT note_id, w AS words FROM lists")
def n01(spark, sf_dir):
    return notes(spark, sf_dir).select("note_id", tk.token_list(F.col("raw_transcript")).alias("words"))


@query("n02_word_dictionary", f"WITH {TOKENS_SQL} SELECT *, length(word) AS length FROM counts")
def n02(spark, sf_dir):
    return tk.word_counts(note_tokens(spark, sf_dir)).withColumn("length", F.length("word").cast("long"))


@query("n03_lemmatize", f"WITH {TOKENS_SQL}, d AS (SELECT word, CASE WHEN ends_with(word, 'es') THEN left(word, -2) ELSE word END AS lemma FROM counts WHERE ends_with(word, 'es') GROUP BY ALL) SELECT coalesce(lemma, word) AS lemma, count(*) AS n FROM tokens LEFT JOIN d USING (word) GROUP BY ALL")
def n03(spark, sf_dir):
    """With a dictionary made of the corpus' own words that end in -es."""
    words = note_tokens(spark, sf_dir)
    dictionary = words.where(F.col("word").endswith("es")).select("word", F.expr("left(word, length(word) - 2)").alias("lemma")).distinct()
    return tk.lemmas(words, dictionary).groupBy(F.col("word").alias("lemma")).agg(F.count("*").alias("n"))


@query("n04_frequency_table", f"WITH {TOKENS_SQL} SELECT word, count(*) AS frequency FROM tokens GROUP BY ALL")
def n04(spark, sf_dir):
    return tk.corpus_counts(note_tokens(spark, sf_dir))


@query("n05_normalized_frequency", f"WITH {TOKENS_SQL} SELECT *, frequency / max(frequency) OVER (PARTITION BY note_id) AS score FROM counts")
def n05(spark, sf_dir):
    return tk.normalized_counts(note_tokens(spark, sf_dir))


@query("n06_word_cloud", f"WITH {TOKENS_SQL} SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY frequency DESC, word) AS rank FROM counts QUALIFY rank <= 20")
def n06(spark, sf_dir):
    return tk.top_words(note_tokens(spark, sf_dir), 20)


@query("n07_zipf_fit", f"""WITH {TOKENS_SQL}, pts AS (SELECT note_id, ln(frequency) AS y, ln(row_number() OVER (PARTITION BY note_id ORDER BY frequency DESC, word)) AS x FROM counts),
fit AS (SELECT note_id, regr_slope(y, x) AS slope, CASE WHEN var_pop(y) = 0 THEN 1 ELSE regr_r2(y, x) END AS r2, count(*) AS vocabulary FROM pts GROUP BY ALL)
SELECT note_id, CASE WHEN vocabulary >= 3 THEN round_even(coalesce(slope, 0), 4) ELSE 0.0 END AS slope, CASE WHEN vocabulary >= 3 THEN round_even(coalesce(r2, 0), 4) ELSE 0.0 END AS r2, vocabulary FROM fit""")
def n07(spark, sf_dir):
    return tk.zipf_fit(note_tokens(spark, sf_dir))


@query("n08_hapaxes", f"WITH {TOKENS_SQL} SELECT note_id, word FROM counts WHERE frequency = 1")
def n08(spark, sf_dir):
    return tk.hapaxes(note_tokens(spark, sf_dir))


@query("n09_bigrams", f"WITH {PAIRS_SQL} SELECT * FROM pairs")
def n09(spark, sf_dir):
    return tk.bigrams(note_tokens(spark, sf_dir))


@query("n10_collocations", f"WITH {COLLOCATIONS_SQL} SELECT * FROM collocations")
def n10(spark, sf_dir):
    return tk.collocations(note_tokens(spark, sf_dir))


@query("n11_candidate_terms", f"""WITH {COLLOCATIONS_SQL}, kept AS (SELECT p.note_id, p."first" || ' ' || p."second" AS term, p.frequency * 1.5 AS score FROM pairs p
  JOIN counts a ON a.note_id = p.note_id AND a.word = p."first" JOIN counts b ON b.note_id = p.note_id AND b.word = p."second" WHERE NOT (p.frequency = 1 AND a.frequency = 1 AND b.frequency = 1)
  UNION ALL SELECT note_id, "first" || ' ' || "second", 1.0 FROM collocations
  UNION ALL SELECT note_id, word, CASE WHEN frequency = 1 THEN 0.3 ELSE frequency END FROM counts WHERE length(word) > 3)
SELECT note_id, term, sum(score::DOUBLE) AS score FROM kept GROUP BY ALL""")
def n11(spark, sf_dir):
    return tk.terms_of_notes(notes(spark, sf_dir))


@query("n13_extract_themes")
def n13(spark, sf_dir):
    """N12 over the terms of N11, with themes and topics by the length of the note."""
    return tk.extract_themes(notes(spark, sf_dir))


@query("n14_theme_density")
def n14(spark, sf_dir):
    base = notes(spark, sf_dir)
    return tk.theme_density(tk.extract_themes(base), tk.text_sizes(base))
