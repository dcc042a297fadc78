"""Patterns that are asked for their first letters before anything else match what they matched without."""

import re

from notemill.operators import entities as en
from notemill.operators.questions import by_note
from pyspark.sql import functions as F

SAID = "I need to pay on MAY 9th or 12th of june, remind Me to call Lena next friday at 3:30 pm; xnext friday, 5 o'clock, 12.30 P.M. x3:30 (10:45) in two weeks, end of the day 3/4/2024 2024-05-06 the 3rd, about the long river bank. The topic is deep queues! todo write it don't forget to pack"


def test_led_patterns_match_the_same(spark):
    rows = spark.createDataFrame([(SAID,), (SAID.upper(),), (SAID.title(),), ("",), ("é" + SAID.replace(" ", "\n"),)], "t string")
    found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    pairs = [(en.DATE, en.DATE_AT), (en.TIME, en.TIME_AT), (en.TASK_CUE, en.led(en.TASK_CUES, en.TASK_CUE)), (en.KEY_CUES, en.led(en.KEY_HEADS, en.KEY_CUES))]
    for row in rows.select(*[F.struct(found(a).alias("a"), found(b).alias("b")).alias(str(i)) for i, (a, b) in enumerate(pairs)]).collect():
        for pair in row:
            assert pair.a == pair.b
    counts = rows.limit(1).select(*[F.size(found(b)) for _, b in pairs]).first()
    assert all(n > 0 for n in counts)


def test_phrases_of_a_note_are_ranked_where_its_text_was_dealt(spark):
    notes = by_note(spark.createDataFrame([(i, SAID) for i in range(9)], "note_id long, raw_transcript string"))
    plan = en.key_phrases(notes)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(note_id#\d+L?, \d+\)", plan)
    assert dealt and plan.count("hashpartitioning(") == len(dealt)  # nothing is dealt by note and phrase again
    assert en.key_phrases(notes).groupBy("note_id").count().count() == 9
