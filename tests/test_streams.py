"""The capture chain, alerts and the dialogue's state over several micro-batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from notemill.operators import entities as en
from notemill.sources.scratch import scratch
from notemill.streaming import capture, jobs

NOTES = "note_id long, raw_transcript string, created_epoch long"
FIRST = [
    (1, "um I need to return the library books to Doctor Mensah by next Tuesday. Also, email Priya about the poster session on May 9th.", 1704067200),
    (2, "A semaphore needs an atomic counter and a wait queue.", 1704067300),
    (3, None, 1704067400),
    (4, "   ", 1704067500),
    (2, "An older form of the second note.", 1704067000),
]
SECOND = [(5, "Paging splits memory into frames. File this under operating systems.", 1704070000), (2, "A semaphore counts the free places of a buffer. I must send Professor Okafor the draft before Thursday.", 1704071000)]


def arrive(spark, rows, schema, path, state, write):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(path)
    jobs.run_once(stream, write, state)


def table(spark, out, name):
    return sorted((str(r) for r in capture.captured(spark, out, name).collect()))


@pytest.fixture(scope="module")
def streamed(spark):
    path, out, state = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "state")
    write = capture.capture_writer(out)
    arrive(spark, FIRST, NOTES, path, state, write)
    arrive(spark, SECOND, NOTES, path, state, write)
    return out, write


def test_chain_writes_what_the_batch_jobs_make(spark, streamed):
    out, _ = streamed
    last = {k: (t, e) for k, t, e in sorted(FIRST + SECOND, key=lambda x: x[2])}
    notes = {r.note_id: r for r in capture.captured(spark, out, "notes").collect()}
    assert notes.keys() == last.keys() and all(notes[k].raw_transcript == t for k, (t, _) in last.items())
    assert notes[3].cleaned == notes[4].cleaned == "" and notes[3].note_type is None
    said = spark.createDataFrame([(k, notes[k].cleaned, e) for k, (_, e) in last.items() if notes[k].cleaned], "note_id long, cleaned string, created_epoch long")
    columns = ["note_id", "kind", "value", "normalized", "start"]
    want = {tuple(r) for r in en.extract_all(said, "cleaned").select(columns).collect()}
    assert {tuple(r) for r in capture.captured(spark, out, "entities").select(columns).collect()} == want and want
    kinds = {r.note_id: r.note_type for r in capture.understand(said)[1].collect()}
    assert {k: n.note_type for k, n in notes.items() if n.cleaned} == kinds
    chunks = capture.captured(spark, out, "chunks").collect()
    assert {c.note_id for c in chunks} == {1, 2, 5} and all(c.subject for c in chunks)
    assert {r.note_id: r.subject for r in capture.captured(spark, out, "links").where("rank = 0").collect()}[5] == "Operating Systems"
    assert {r.note_id for r in capture.captured(spark, out, "reminders").collect()} >= {1, 2}


def test_a_batch_that_runs_again_changes_nothing(spark, streamed):
    out, write = streamed
    before = {name: table(spark, out, name) for name in capture.TABLES}
    write(spark.createDataFrame(SECOND, NOTES), 1)
    write(spark.createDataFrame(FIRST, NOTES), 0)
    assert {name: table(spark, out, name) for name in capture.TABLES} == before


def test_alerts_come_once_however_late(spark):
    path, out, state = scratch(spark, "due"), scratch(spark, "alerts"), scratch(spark, "alerts-state")
    at = lambda day, hour=0: datetime.datetime(2024, 1, day, hour)
    write, schema = capture.alert_writer(out), "reminder_id long, ts timestamp"
    first, second = [(1, at(1)), (1, at(2)), (2, at(3))], [(1, at(20)), (3, at(20)), (3, at(19)), (2, at(4))]
    arrive(spark, first, schema, path, state, write)
    arrive(spark, second, schema, path, state, write)
    want = {(1, at(1)), (2, at(3)), (3, at(19))}
    read = lambda: [tuple(r) for r in spark.read.parquet(f"{out}/alerts").select("reminder_id", "ts").collect()]
    assert sorted(read()) == sorted(want)
    write(spark.createDataFrame(second, schema), 1)
    assert sorted(read()) == sorted(want)


def test_open_questions_end_by_event_time(spark):
    schema = "user_id long, note_id long, ts timestamp, said string, day string, clock string, ambiguous boolean, event string, task string"
    at = lambda minute: datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(minutes=minute)
    path, out, state = scratch(spark, "said"), scratch(spark, "replies"), scratch(spark, "said-state")
    kept = []

    def arrive_and_count(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.reminder_dialogue(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(path))
        query = stream.writeStream.outputMode("append").option("checkpointLocation", state).foreachBatch(jobs.note_writer(out, lambda df: df)).trigger(availableNow=True).start()
        query.awaitTermination()
        kept.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])

    arrive_and_count([(1, 1, at(0), "I have a meeting", None, None, False, "meeting", None), (2, 2, at(1), "I have a party", None, None, False, "party", None)])
    arrive_and_count([(2, 3, at(9), "tomorrow", "2024-01-02", None, False, None, None), (9, 4, at(60), "nothing", None, None, False, None, None)])
    arrive_and_count([(9, 5, at(61), "nothing", None, None, False, None, None), (1, 6, at(2), "far too late", "2024-01-02", "10:00:00", False, None, None)])
    assert kept[0] == 2 and kept[-1] == 0  # both users' questions are gone, though neither said a word
    got = {r.note_id: (r.question, r.due) for r in spark.read.parquet(out).collect()}
    assert got[1][0].startswith("Which date") and got[3][0] == "When is your meeting?" and 6 not in got
    assert spark.read.parquet(out).where(F.col("due").isNotNull()).count() == 0


def test_arrivals_are_dealt_to_all_cores(spark):
    """A batch that lies in one file, in one row group, would be worked on by one task."""
    from notemill.plans.filing_plans import arrivals

    seen = []
    arrivals(spark, spark.range(1000).repartition(1), ["id % 2 = 0"])(lambda stream: jobs.run_once(stream, lambda df, i: seen.append(len(df.inputFiles()) if df.inputFiles() else df.rdd.getNumPartitions()), scratch(spark, "state")))
    assert seen and min(seen) >= spark.sparkContext.defaultParallelism


def test_texts_are_searched_once(spark):
    """The kind of a note counts the entities that are stored; it doesn't find them again."""
    plans = {}

    def store(name, rows):
        plans[name] = rows._jdf.queryExecution().optimizedPlan().toString()
        path = scratch(spark, name)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    capture.capture(spark.createDataFrame(FIRST, NOTES), spark.createDataFrame([], capture.TOPICS), store)
    assert "Generate" in plans["entities"] and "Generate" not in plans["notes"]
