"""Registered queries against DuckDB on small tables, and the contract of the entry module."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or two of each group; all are compared when the driver runs them.
SAMPLE = ["s05_notes_by_subject", "s09_upsert_keep_user_edit", "s12_prune_orphans", "s18_explode_segments", "t02_normalize_whitespace", "t03_normalize_punctuation", "t13_normalize_tokens", "n07_zipf_fit", "n10_collocations", "q02_flesch_reading_ease", "q03_cohesion", "e02_classify_notes", "g18_note_content", "g15_topic_clusters", "h06_dbscan", "r11_hybrid_search", "a04_extractive_answer", "u01_classify_intent", "u03_detect_time_range", "m07_update_status", "c05_absorb_details", "p07_cap_session_length", "x2_conversation_sessions"]


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df, want = __spark_entry__.queries()[name](spark, SF), duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == sorted(tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall())


def test_contract():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 130


def test_nothing_else_imports_the_subpackage():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{top}/notemill/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "notemill.llm" not in open(path).read() and "corpus_pipeline" not in open(path).read(), path
