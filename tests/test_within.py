"""Figures of notes made where the text lies, against the tables of words and pairs that they replace."""

import random

from pyspark.sql import functions as F

from notemill.operators import graphs, models, quality, within
from notemill.operators import tokens as tk


def some_notes(spark):
    r = random.Random(5)
    word = lambda: r.choice("kernel pages swap disk thread lock queue buffer stack heap cache fault driver".split()) + str(r.randint(0, 2))
    rows = [(i, " ".join(f"{' '.join(word() for _ in range(r.randint(1, 9)))}." for _ in range(r.randint(1, 40)))) for i in range(20)]
    return spark.createDataFrame([*rows, (50, "Same words here. Same words here! The is. Other"), (51, ""), (52, None), (53, "One sentence only.")], "note_id long, raw_transcript string")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_pairs_equal_those_of_the_link_table(spark, monkeypatch):
    notes = some_notes(spark)
    links = models.sentence_similarity(graphs.cut_lineage(models.sentence_table(notes)))
    want = {r.note_id: (r.pairs, r.most) for r in links.groupBy("note_id").agg(F.count("*").alias("pairs"), F.max("w").alias("most")).collect()}
    got = within.sentence_pairs(notes)
    assert shuffles(got) == 0
    got = {r.note_id: (r.pairs, r.most) for r in got.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    column = notes.select(within.said(F.col("raw_transcript")).alias("said")).toArrow().column("said").combine_chunks()
    whole = within.likeness(within.Said(column))
    monkeypatch.setattr(within, "STEP_PAIRS", 7)  # many steps
    cut = within.likeness(within.Said(column))
    assert whole[0].tolist() == cut[0].tolist() and abs(whole[1] - cut[1]).max() < 1e-12


def test_coherence_equals_that_of_the_word_table(spark):
    notes = some_notes(spark)
    counts = models.sentence_table(notes).select("note_id", "sent", F.explode(tk.token_list(F.col("sentence"))).alias("word")).groupBy("note_id", "sent", "word").agg(F.count("*").alias("n"))
    total = {r.note_id: r.t for r in tk.adjacent_similarity(counts).groupBy("note_id").agg(F.sum("cosine").alias("t")).collect()}
    n = {r.note_id: r.n for r in models.sentence_table(notes).groupBy("note_id").agg(F.count("*").alias("n")).collect()}
    out = quality.coherence(notes)
    assert shuffles(out) == 0
    for r in out.collect():
        k = n.get(r.note_id, 0)
        assert abs(r.coherence - (k if k < 2 else total.get(r.note_id, 0.0) / (k - 1))) < 1e-9


def test_terms_need_no_shuffle(spark):
    notes = some_notes(spark)
    want = {(r.note_id, r.term): r.score for r in tk.candidate_terms(tk.tokens(notes)).collect()}
    got = tk.terms_of_notes(notes)
    assert shuffles(got) == 0 and {(r.note_id, r.term): r.score for r in got.collect()} == want


def test_scores_need_no_shuffle(spark):
    assert shuffles(quality.score_notes(some_notes(spark))) == 0


def test_sentence_figures_need_no_shuffle(spark):
    notes = some_notes(spark)
    got = models.sentence_features(notes)
    assert shuffles(got) == 0
    said = models.sentence_table(notes).select("note_id", "sent", F.explode(tk.token_list(F.col("sentence"))).alias("word"))
    mean = {(r.note_id, r.sent): (r.m, r.n) for r in said.join(tk.normalized_counts(said), ["note_id", "word"]).groupBy("note_id", "sent").agg(F.avg("score").alias("m"), F.count("*").alias("n")).collect()}
    near = {(r.note_id, r.sent): (r.rank, r.near) for r in models.sentence_ranks(notes).collect()}
    rows = got.collect()
    assert {(r.note_id, r.sent) for r in rows} == near.keys()
    for r in rows:
        (m, content), words = mean.get((r.note_id, r.sent), (0.0, 0)), len(r.sentence.split())
        want = m + 1 - r.sent / r.n + min(2 * near[r.note_id, r.sent][1] / r.n, 1) + words / 20 + content / words
        assert abs(r.rank - near[r.note_id, r.sent][0]) < 1e-12 and abs(7 * r.feature - want) < 1e-9
