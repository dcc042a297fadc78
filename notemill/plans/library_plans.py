"""Queries over the whole library: H16 to H23, S24, R13, P12, P13, C03, M03, N12, N19."""

from __future__ import annotations

from notemill.operators import entities as en
from notemill.operators import graphs, library as lb
from notemill.operators import models as md
from notemill.operators import reminders as rm
from notemill.operators import tokens as tk
from notemill.operators.questions import dealt
from notemill.plans.base import query
from notemill.plans.retrieval_plans import r6, sparse_sql
from notemill.sources.notes import NOTES_SQL, SPOKEN_SQL, notes, read, spoken_notes
from pyspark.sql import functions as F

KINDS_SQL = NOTES_SQL + ", k AS (SELECT note_type, count(*) AS n FROM notes GROUP BY ALL), t AS (SELECT count(DISTINCT source) AS subjects, count(DISTINCT topic_name) AS topics, count(*) AS notes FROM notes)"


@query("h16_library_overview", f"WITH {KINDS_SQL} SELECT t.*, (SELECT list(note_type || ': ' || n ORDER BY n DESC, note_type) FROM k) AS types FROM t")
def h16(spark, sf_dir):
    return lb.overview(notes(spark, sf_dir))


@query("h17_outline", f"WITH {NOTES_SQL}, t AS (SELECT source, topic_name, count(*) AS n FROM notes GROUP BY ALL) SELECT source, sum(n)::BIGINT AS notes, list(topic_name || ' ' || n ORDER BY lower(topic_name)) AS topics FROM t GROUP BY ALL")
def h17(spark, sf_dir):
    return lb.outline(notes(spark, sf_dir)).withColumn("topics", F.transform("topics", lambda x: F.concat(x["topic"], F.lit(" "), x["notes"].cast("string"))))


@query("h18_narration", f"WITH {KINDS_SQL} SELECT 'You have ' || subjects || ' subjects, ' || topics || ' topics and ' || notes || ' notes.' AS spoken FROM t")
def h18(spark, sf_dir):
    return lb.narrate(lb.overview(notes(spark, sf_dir)))


@query("h20_notes_under", f"WITH {NOTES_SQL}, n AS (SELECT source, topic_name, count(*) AS notes, list(note_id ORDER BY created_epoch DESC, note_id DESC)[1:5] AS newest FROM notes GROUP BY ALL) SELECT * FROM n")
def h20(spark, sf_dir):
    return lb.topic_lines(notes(spark, sf_dir))


def summary_sql(by: str, most: int) -> str:
    return f"""WITH {NOTES_SQL}, {sparse_sql('nv', 'notes', 'note_id', 'lower(raw_transcript)')}, s AS (SELECT v.*, {by} AS g FROM nv v JOIN notes USING (note_id)), m AS (SELECT g, bucket, sum(weight) AS m FROM s GROUP BY ALL),
nm AS (SELECT g, sqrt(sum(m * m)) AS norm FROM m GROUP BY ALL), near AS (SELECT g, note_id, {r6('sum(weight * m) / any_value(norm)')} AS score FROM s JOIN m USING (g, bucket) JOIN nm USING (g) GROUP BY ALL),
b AS (SELECT g, note_id FROM near QUALIFY row_number() OVER (PARTITION BY g ORDER BY score DESC, note_id) = 1), w AS (SELECT g, note_id, raw_transcript, list_filter(regexp_split_to_array(trim(raw_transcript), '\\s+'), lambda x: x <> '') AS w FROM b JOIN notes USING (note_id))
SELECT g AS {by}, note_id, CASE WHEN len(w) <= {most} THEN trim(raw_transcript) ELSE array_to_string(w[1:{most}], ' ') || '...' END AS summary FROM w"""


@query("h21_topic_summary", summary_sql("topic_name", 12))
def h21(spark, sf_dir):
    return lb.group_summaries(notes(spark, sf_dir), "topic_name")


@query("h22_subject_rollup", summary_sql("source", 60))
def h22(spark, sf_dir):
    return lb.group_summaries(notes(spark, sf_dir), "source", most=60)


@query("s24_export_outline_markdown", f"WITH {NOTES_SQL}, t AS (SELECT source, topic_name, count(*) AS n FROM notes GROUP BY ALL) SELECT source, '# ' || source || chr(10) || string_agg('- ' || topic_name || ' (' || n || ')', chr(10) ORDER BY lower(topic_name)) AS markdown FROM t GROUP BY source")
def s24(spark, sf_dir):
    return lb.outline_markdown(lb.outline(notes(spark, sf_dir)))


@query("r13_resolve_scope", f"WITH {NOTES_SQL}, n AS (SELECT upper(source) || ' ' AS name FROM notes UNION SELECT topic_name FROM notes UNION SELECT 'x' || language FROM notes), s AS (SELECT DISTINCT source FROM notes), t AS (SELECT DISTINCT topic_name FROM notes) SELECT name, source AS subject, CASE WHEN source IS NULL THEN topic_name END AS topic FROM n LEFT JOIN s ON lower(source) = lower(trim(name)) LEFT JOIN t ON lower(topic_name) = lower(trim(name))")
def r13(spark, sf_dir):
    base = notes(spark, sf_dir)
    names = base.select(F.concat(F.upper("source"), F.lit(" ")).alias("name")).unionByName(base.select(F.col("topic_name").alias("name"))).unionByName(base.select(F.concat(F.lit("x"), "language").alias("name"))).distinct()
    return lb.resolve_scope(names, base, base)


@query("p12_rewrite_guard")
def p12(spark, sf_dir):
    """Each conversation turn against the one after it."""
    turns = read(spark, sf_dir, "conversations")
    other = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("corrected"))
    return lb.rewrite_guard(turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("original")).join(other, ["conv_id", "turn"])).select("conv_id", "turn", "lost", "accepted")


@query("p13_correction_policy", f"WITH {NOTES_SQL}, w AS (SELECT note_id, len(list_filter(regexp_split_to_array(trim(raw_transcript), '\\s+'), lambda x: x <> '')) AS n FROM notes) SELECT note_id, CASE WHEN n = 0 THEN 'blank' WHEN n < 8 THEN 'short' ELSE '' END AS skipped FROM w")
def p13(spark, sf_dir):
    return lb.correction_policy(notes(spark, sf_dir))


@query("c03_resolve_contacts")
def c03(spark, sf_dir):
    """Names of people in spoken notes."""
    people = en.people(spoken_notes(spark, sf_dir)).select(F.col("value").alias("name")).distinct()
    return rm.resolve_contacts(people, 0.82, graphs.components)


@query("c06_notes_for_contact", f"WITH {SPOKEN_SQL}, n AS (SELECT note_id, regexp_extract(raw_transcript, '\\b(?:Doctor|Professor|Call)\\s+(Mensah|Okafor|Lena)\\b', 1) AS name FROM spoken) SELECT name, count(DISTINCT note_id) AS notes FROM n WHERE name <> '' GROUP BY ALL")
def c06(spark, sf_dir):
    people = en.people(spoken_notes(spark, sf_dir)).where("value IN ('Mensah', 'Okafor', 'Lena')")
    return people.groupBy(F.col("value").alias("name")).agg(F.countDistinct("note_id").alias("notes"))


@query("c02_match_people")
def c02_people(spark, sf_dir):
    """People of odd notes against those of even ones."""
    people = en.people(spoken_notes(spark, sf_dir)).select((F.col("note_id") % 2 == 0).alias("even"), rm.normalize_name(F.col("value")).alias("name")).where("name <> ''").distinct()
    return rm.match_names(people.where("NOT even").select("name"), people.where("even").select("name"), 0.82)


@query("c06_notes_for_all_contacts")
def c06_all(spark, sf_dir):
    """C06 for every name, not only three."""
    return en.people(spoken_notes(spark, sf_dir)).groupBy(F.col("value").alias("name")).agg(F.countDistinct("note_id").alias("notes"))


@query("g09_list_sources", f"WITH {NOTES_SQL} SELECT s.source AS subject, count(t.topic_name) AS topics FROM (SELECT DISTINCT source FROM notes) s LEFT JOIN (SELECT DISTINCT source, topic_name FROM notes WHERE language <> 'en') t ON t.source = s.source GROUP BY ALL")
def g09_sources(spark, sf_dir):
    """Sources of documents with their number of topics that aren't English."""
    base = notes(spark, sf_dir)
    topics = base.where("language <> 'en'").select("source", "topic_name").distinct()
    return base.select("source").distinct().join(topics, "source", "left").groupBy(F.col("source").alias("subject")).agg(F.count("topic_name").alias("topics"))


@query("m03_create_reminders")
def m03(spark, sf_dir):
    """Detected reminders that odd notes don't have yet."""
    base = dealt(spoken_notes(spark, sf_dir))
    found = graphs.cut_lineage(rm.detect(en.tasks(base), en.dates(base)))  # read twice
    return rm.create(found, found.where("accepted AND note_id % 2 = 0")).select("note_id", "title", "due_date")


@query("n12_group_themes")
def n12(spark, sf_dir):
    """Shares of the themes of each note add up to one."""
    themes = tk.extract_themes(notes(spark, sf_dir), by_length=False)
    return themes.groupBy("note_id").agg(F.count("*").alias("themes"), F.bround(F.sum("weight"), 6).alias("total"))


@query("n19_sentence_features")
def n19(spark, sf_dir):
    return md.sentence_features(notes(spark, sf_dir)).select("note_id", "sent", F.bround("feature", 6).alias("feature"))
