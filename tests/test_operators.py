"""Hand-made rows: cleaning, entities, times, names, chunks, tables, dialogue."""

import datetime

import pytest
from pyspark.sql import functions as F

from notemill.functions import text
from notemill.operators import entities, graphs, quality, reminders, retrieval, segments, tables, tokens, utterances
from notemill.streaming import jobs


def value(spark, column, *inputs):
    """The value of a column function on literals."""
    return spark.range(1).select(column(*[F.lit(x) for x in inputs]).alias("x")).first().x


def note(spark, body, i=0):
    return spark.createDataFrame([(i, body, 1704285000)], "note_id long, raw_transcript string, created_epoch long")


def test_cleaning(spark):
    assert value(spark, text.clean_note, "um so  the the kernel ,, kernel swaps pages … i think") == "So the kernel, kernel swaps pages. I think."
    assert value(spark, text.clean_note, "   ") == "" == value(spark, text.clean_note, None)
    assert value(spark, text.collapse_abbreviations, "The U.S.A. and i.e. Dr. Who") == "The USA and ie Dr. Who"
    assert value(spark, text.normalize_unicode, "“ﬁne”–ok x") == '"fine"-ok x'
    assert value(spark, text.collapse_repetitions, "the the the topic topic is is") == "the topic is"
    assert value(spark, text.analysis_text, "Policies, boxes and classes of the U.S.A.!") == "policy box and class of the usa"
    assert value(spark, text.title_case, "red-black tree's") == "Red-Black Tree'S"


@pytest.mark.parametrize(("word", "n"), [("the", 1), ("cat", 1), ("recovery", 4), ("deadlock", 2)])
def test_syllables(spark, word, n):
    assert value(spark, quality.syllables, word) == n


def test_published_scores(spark):
    score = lambda *x: spark.range(1).select(quality.quality(*[F.lit(v) for v in x]).alias("q")).first().q
    assert abs(score(0.8, 0.625, 0.592, 0.12) - 0.724) < 0.001 and abs(score(0.81, 0.625, 0.592, 0.12) - 0.727) < 0.001
    scale = lambda v, *r: spark.range(1).select(quality.min_max(F.lit(v), *r).alias("q")).first().q
    assert [scale(80.0, 0, 100), scale(130.0, 0, 100), scale(-20.0, 0, 100), scale(5.0, 3, 3)] == [0.8, 1.0, 0.0, 0.0]


def test_entropy(spark):
    rows = [("four", 1)] * 4 + [("one", 9)] + [("skewed", 100), ("skewed", 1), ("skewed", 1)]
    got = {r.g: r.entropy for r in tokens.entropy(spark.createDataFrame(rows, "g string, w long"), "g", "w").collect()}
    assert got["four"] == 1.0 and got["one"] == 0.0 and got["skewed"] < 0.3


def test_entities(spark):
    df = note(spark, "I need to return the library books to Doctor Mensah by next Tuesday. Also, email Priya about the poster session on May 9th.")
    got = {(r.kind, r.normalized or r.value) for r in entities.extract_all(df).collect() if r.kind != "key_phrase"}
    assert {("person", "Mensah"), ("person", "Priya"), ("deadline", "2024-01-09"), ("date", "2024-05-09"), ("task", "Return the library books to Doctor Mensah by next Tuesday")} <= got
    pairs = reminders.pair_tasks(entities.tasks(df), entities.dates(df)).collect()
    assert len({r.task for r in pairs}) == len({r.date for r in pairs}) == len(pairs) == 2
    assert entities.extract_all(note(spark, "  ")).count() == 0


@pytest.mark.parametrize(("said", "clock", "unclear"), [("3:30 pm", "15:30:00", False), ("15:30", "15:30:00", False), ("10am", "10:00:00", False), ("3 o'clock", "03:00:00", True), ("4.10 p.m.", "16:10:00", False), ("12 am", "00:00:00", False), ("99:99", None, False)])
def test_times(spark, said, clock, unclear):
    assert value(spark, entities.clock, said) == clock and value(spark, entities.time_is_ambiguous, said) == unclear


def test_intents(spark):
    said = {"what did I write about deadlocks": "search", "how many notes are under my physics?": "count_notes", "summarize my notes": "summarize", "when did I mention rent": "when", "move this note to Physics": "organize", "what's due": "reminders", "open calculus": "navigate", "read my notes on queues": "read_aloud", "list my subjects": "list_subjects", "": "unknown", "why is the sky blue": "ask"}
    assert {k: value(spark, utterances.classify, k) for k in said} == said
    assert value(spark, utterances.clean_query, "about deadlocks this week?") == "deadlocks"
    assert value(spark, utterances.note_types, "ideation and ideas, tasks") == ["brainstorm", "todo"]
    now = int(datetime.datetime(2024, 1, 10, 14, 30, tzinfo=datetime.UTC).timestamp())
    monday = int(datetime.datetime(2024, 1, 8, tzinfo=datetime.UTC).timestamp())
    row = spark.range(1).select(*utterances.time_range(F.lit("ideas this week"), F.lit(now))).first()
    assert tuple(row) == (monday, now)


def test_chunks(spark):
    long = " ".join(f"Sentence number {i} ends here." for i in range(80))
    parts = value(spark, lambda c: retrieval.chunks(c, 300, 50), long)
    assert len(parts) > 5 and parts[1].startswith(parts[0][-50:].strip()) and value(spark, lambda c: retrieval.chunks(c, 300, 50), "short") == ["short"]
    assert value(spark, lambda c: retrieval.chunks(c, 300, 50), " \n") == [] and max(map(len, value(spark, lambda c: retrieval.chunks(c, 400, 40), "word " * 2000))) <= 500


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = tables.upsert(old, new, "id")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")] == sorted(map(tuple, tables.upsert(once, new, "id").collect()))
    rows = spark.createDataFrame([(1, '[{"start":0,"end":1,"text":" x "},{"start":1,"end":2,"text":" "}]', "b", 5.0, None), (2, "broken", "whole", 7.0, "todo")], "note_id long, s string, body string, duration double, kind string")
    got = [tuple(r) for r in tables.explode_segments(rows, "s", "body", "kind").orderBy("note_id").collect()]
    assert got == [(1, 0, 0.0, 1.0, "x", "unclassified"), (2, 0, 0.0, 7.0, "whole", "todo")]


def test_names(spark):
    known = spark.createDataFrame([("lena fischer",), ("marco rossi",)], "name string")
    heard = spark.createDataFrame([("lena fisher",), ("someone else",), ("marco rossi",)], "name string")
    assert {r.name: r.match for r in reminders.match_names(heard, known, 0.82).collect()} == {"lena fisher": "lena fischer", "marco rossi": "marco rossi"}
    assert value(spark, reminders.normalize_name, " Prof. Lena  Fischer!") == "lena fischer"
    mentions = spark.createDataFrame([("Dr Lena Fischer",), ("lena fisher",), ("Marco",), (" ",)], "name string")
    found = {r.name: r.contact for r in reminders.resolve_contacts(mentions, 0.82, graphs.components).collect()}
    assert found == {"lena fischer": "lena fischer", "lena fisher": "lena fischer", "marco": "marco"}


def test_spoken_forms(spark):
    now = 1704844800  # a Wednesday
    said = [value(spark, reminders.speak, now + x, now) for x in (0, 86400 + 16 * 3600, -86400, 3 * 86400, 40 * 86400 + 1800)]
    assert said == ["today", "tomorrow at 4 pm", "yesterday", "on Saturday", "on 19 February at 12:30 am"]
    assert [value(spark, reminders.describe_window, h) for h in (1, 5, 24, 48, 72, 168, 744, 8760, 504)] == ["the next hour", "the next 5 hours", "the next 24 hours", "the next two days", "the next 3 days", "the next week", "the next month", "the next year", "the next 3 weeks"]


def test_sessions(spark):
    rows = spark.createDataFrame([(i, 1, float(t), float(t) + 1, 0.0, "x") for i, t in enumerate([0, 5, 8, 100, 104])], "segment_id long, recording_id long, start double, end double, level double, text string")
    assert [(r["first"], r["last"], r.segments) for r in segments.sessions(rows, 20).orderBy("session").collect()] == [(0.0, 8.0, 3), (100.0, 104.0, 2)]


#: User, second, note, said, day, clock, ambiguous, event, task.
DIALOGUE = [
    (1, 0, 10, "I have a meeting", None, None, False, "Meeting", None), (1, 60, 11, "on the fifth", "2024-01-05", None, False, None, None), (1, 120, 12, "at three", None, "03:00:00", True, None, None), (1, 150, 13, "hm", None, None, False, None, None), (1, 180, 14, "in the afternoon", None, None, False, None, None),
    (2, 0, 20, "an exam", None, None, False, "Exam", None), (2, 4000, 21, "on the fifth", "2024-01-05", None, False, None, None),
    (3, 0, 30, "a call at 3", None, "03:00:00", True, "Call", None), (3, 10, 31, "what", None, None, False, None, None), (3, 20, 32, "the sixth", "2024-01-06", None, False, None, None), (3, 30, 33, "AM", None, None, False, None, None),
    (4, 0, 40, "a plain note", None, None, False, None, None), (4, 9, 41, "submit it by Friday", "2024-01-05", None, False, None, "Submit it"),
    (5, 0, 50, "submit my Essay", None, None, False, None, "Submit my Essay"), (5, 5, 51, "the eighth", "2024-01-08", None, False, None, None), (5, 9, 52, "12:00", None, "12:00:00", True, None, None), (5, 12, 53, "p.m.", None, None, False, None, None),
    (6, 0, 60, "interview", "2024-01-02", "15:30:00", False, "Interview", None),
]


def dialogue(spark):
    rows = [(u, n, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), *x) for u, s, n, *x in DIALOGUE]
    return spark.createDataFrame(rows, "user_id long, note_id long, ts timestamp, said string, day string, clock string, ambiguous boolean, event string, task string")


def test_dialogue_replay(spark):
    out = {r.note_id: r for r in jobs.spoken_replies(jobs.replay_dialogue(dialogue(spark))).collect()}
    assert {n: r.due for n, r in out.items() if r.due} == {14: "2024-01-05 15:00:00", 33: "2024-01-06 03:00:00", 53: "2024-01-08 12:00:00", 60: "2024-01-02 15:30:00"}
    assert [out[n].reply for n in (10, 11, 12, 13, 14)] == ["Which date do you have the meeting?", "When is your meeting?", "Is it AM or PM?", "Sorry, I didn't catch that. Is it AM or PM?", "Reminder set. You have a meeting on Friday at 3 pm."]
    assert [out[n].reply for n in (20, 21, 40, 41)] == ["Which date do you have the meeting?", None, None, None]
    assert [out[n].reply for n in (30, 31, 32)] == ["Which date do you have the meeting?", "Sorry, I didn't catch a date. Which date do you have the meeting?", "Is it AM or PM?"]
    assert [out[n].reply for n in (50, 51)] == ["What date do you need to submit my essay?", "What time do you need to submit my essay?"] and out[60].reply == "Reminder set. You have an interview tomorrow at 3:30 pm."
    notes = dialogue(spark).select("note_id")
    assert {r.note_id for r in jobs.suppress_notes(notes, jobs.replay_dialogue(dialogue(spark))).collect()} == {21, 40, 41}


def test_streams_equal_batches(spark, tmp_path):
    dialogue(spark).coalesce(1).write.parquet(f"{tmp_path}/in")
    held = []
    stream = spark.readStream.schema(dialogue(spark).schema).parquet(f"{tmp_path}/in")
    jobs.run_once(jobs.reminder_dialogue(stream), lambda df, i: held.extend(df.collect()), f"{tmp_path}/c1")
    assert sorted(map(str, held)) == sorted(str(r) for r in jobs.replay_dialogue(dialogue(spark)).collect())
    seen = []
    alerts = stream.select(F.col("user_id").alias("reminder_id"), "ts")
    jobs.run_once(jobs.alert_once(alerts), lambda df, i: seen.extend(df.collect()), f"{tmp_path}/c2")
    assert sorted(r.reminder_id for r in seen) == [1, 2, 3, 4, 5, 6]
    write = jobs.note_writer(f"{tmp_path}/notes", lambda df: df.select("user_id"))
    jobs.run_once(stream, write, f"{tmp_path}/c3")
    jobs.run_once(stream, write, f"{tmp_path}/c3")
    assert spark.read.parquet(f"{tmp_path}/notes").count() == len(DIALOGUE)
