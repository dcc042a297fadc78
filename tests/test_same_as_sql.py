"""Characters on which Java's and DuckDB's functions differ, in queries that are held against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from notemill.functions import text
from notemill.operators import utterances as ut
from notemill.plans import note_plans, text_plans


def sql(expression: str, texts: list[str]) -> list:
    values = ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(texts))
    return [r[1] for r in duckdb.connect().execute(f"SELECT i, {expression} FROM (VALUES {values}) v(i, u) ORDER BY i").fetchall()]


def spark_values(spark, f, texts: list[str]) -> list:
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, u string").select("i", f(F.col("u")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_capital_is_one_character(spark):
    texts = ["one. ßein. ﬁne. ŉa. ᾳb. éa. i"] + [c + "x" for c in text.MANY_CAPITALS]
    got = spark_values(spark, text.restore_sentence_case, texts)
    assert got == sql(text_plans.sentence_case("u"), texts)
    assert got[0].startswith("One. ẞein.")


#: Letters beyond ASCII beside "on", a vertical tab, line ends of other kinds, and letters that fold to ASCII ones.
ODD = ["open ton èon une", "open éabout la", "open notes on x", "open\x0bmy desk", "go to a b", "open a\rb.", "ſhow me deſk", "move it ünder x", "put this to åo", "remind éany due", "how many notes in my día?", "read my notes on éon"]


@pytest.mark.parametrize("kind", list(ut.PATTERNS))
def test_intents_as_in_sql(spark, kind):
    assert spark_values(spark, lambda u: ut.is_kind(kind, u), ODD) == sql(note_plans.rule_sql(kind), ODD)


def test_time_phrase_takes_bounds_of_ascii(spark):
    texts = ["étoday", "today", "in the last 3 daysé", "recentlyé"]
    assert spark_values(spark, ut.time_phrase, texts) == ["today", "today", "in the last 3 days", "recently"]
