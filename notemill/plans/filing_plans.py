"""Queries G01 to G08, H07 to H23, A09 to A11, M09, M10, S20, E11, N21, X1 and X4."""

from __future__ import annotations

from notemill.functions import fixed
from notemill.operators import entities as en
from notemill.operators import filing as fl
from notemill.operators import graphs, metric
from notemill.operators import models as md
from notemill.operators import organize as og
from notemill.operators import readback as rb
from notemill.operators import vectors as vec
from notemill.plans.base import query
from notemill.plans.note_plans import CONTENT_SQL
from notemill.plans.retrieval_plans import COS, EPS, VEC_SQL, r6, sparse_sql
from notemill.sources.notes import EPOCH, NOTES_SQL, SPOKEN_SQL, notes, read, spoken_notes
from notemill.sources.scratch import scratch
from notemill.streaming import capture, jobs
from pyspark.sql import functions as F


def lit(text: str) -> str:
    return text.replace("'", "''")


# ---- topics ----


def term_sql(term: str, forms: list[str]) -> str:
    body = "|".join(f.replace("+", "\\+") for f in sorted(forms, key=len, reverse=True))
    pattern = lit(rf"(?i)\b(?:{body})\b")
    return f"SELECT note_id, '{lit(term)}' AS term, len(regexp_extract_all(t, '{pattern}')) AS n, length(regexp_split_to_array(t, '{pattern}')[1]) AS first FROM plain WHERE regexp_matches(t, '{pattern}')"


#: Letters with marks become plain ones first, because \b knows no others there.
TERMS_SQL = SPOKEN_SQL + ", plain AS (SELECT note_id, regexp_replace(raw_transcript, '[À-ɏ]', 'x', 'g') AS t FROM spoken), terms AS (" + " UNION ALL ".join(term_sql(t, f) for t, f in fixed.TOPICS.items()) + ")"
TITLE = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query("g01_tag_vocabulary", f"WITH {TERMS_SQL} SELECT * FROM terms")
def g01(spark, sf_dir):
    return fl.tag_vocabulary(spoken_notes(spark, sf_dir)).groupBy("note_id", "term").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first"))


@query("g02_extract_topics")
def g02(spark, sf_dir):
    return fl.extract_topics(spoken_notes(spark, sf_dir))


#: Spoken forms of a note's topic: as it is, in capitals, without its last letter, and one that is new.
NAMED_SQL = NOTES_SQL + """, named AS (SELECT note_id, source AS subject, r AS rank, CASE r WHEN 0 THEN CASE note_id % 4 WHEN 0 THEN upper(topic_name) WHEN 1 THEN left(topic_name, -1) WHEN 2 THEN 'Brand New Place ' || chr((65 + note_id % 2)::INT) ELSE topic_name END
  WHEN 1 THEN topic_name ELSE 'brand new place ' || chr((65 + note_id % 3)::INT) END AS name, 0.7 - 0.1 * r AS confidence FROM notes, (SELECT unnest([0, 1, 2]) AS r)),
tops AS (SELECT DISTINCT source AS subject, topic_name AS topic FROM notes), keys AS (SELECT DISTINCT subject, name FROM named),
resolved AS (SELECT k.subject, k.name, coalesce(e.topic, p.topic, n.made) AS topic, e.topic IS NULL AND p.topic IS NULL AS created FROM keys k LEFT JOIN tops e ON e.subject = k.subject AND lower(e.topic) = lower(k.name)
  LEFT JOIN (SELECT k.subject, k.name, max(t.topic) AS topic FROM keys k JOIN tops t ON t.subject = k.subject AND starts_with(t.topic, k.name) AND length(t.topic) = length(k.name) + 1 GROUP BY ALL) p ON p.subject = k.subject AND p.name = k.name
  LEFT JOIN (SELECT subject, lower(name) AS low, min(name) AS made FROM keys GROUP BY ALL) n ON n.subject = k.subject AND n.low = lower(k.name))"""


def named(spark, sf_dir):
    name = F.col("topic_name")
    letter = lambda k: F.char((65 + F.col("note_id") % k).cast("int"))
    first = F.when(F.col("note_id") % 4 == 0, F.upper(name)).when(F.col("note_id") % 4 == 1, F.expr("left(topic_name, length(topic_name) - 1)")).when(F.col("note_id") % 4 == 2, F.concat(F.lit("Brand New Place "), letter(2))).otherwise(name)
    said = F.when(F.col("rank") == 0, first).when(F.col("rank") == 1, name).otherwise(F.concat(F.lit("brand new place "), letter(3)))
    rows = notes(spark, sf_dir).withColumn("rank", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return rows.select("note_id", F.col("source").alias("subject"), "rank", said.alias("name"), F.round(0.7 - 0.1 * F.col("rank"), 1).alias("confidence"))


def known_topics(spark, sf_dir):
    return notes(spark, sf_dir).select(F.col("source").alias("subject"), F.col("topic_name").alias("topic")).distinct()


@query("g03_resolve_topic_fuzzy", f"WITH {NAMED_SQL} SELECT * FROM resolved")
def g03(spark, sf_dir):
    return fl.resolve_topics(named(spark, sf_dir), known_topics(spark, sf_dir))


@query("g04_link_note_topics", f"""WITH {NAMED_SQL}, l AS (SELECT note_id, n.subject, topic, rank, round(confidence, 1)::DOUBLE AS confidence, created FROM named n JOIN resolved r ON r.subject = n.subject AND r.name = n.name QUALIFY row_number() OVER (PARTITION BY note_id, topic ORDER BY rank) = 1),
m AS (SELECT * REPLACE (row_number() OVER (PARTITION BY note_id ORDER BY rank) - 1 AS rank), count(*) OVER (PARTITION BY note_id) AS k FROM l)
SELECT note_id, subject, topic, rank, confidence, CASE WHEN confidence >= 0.55 THEN 'llm' ELSE 'heuristic' END AS method, created, CASE WHEN rank = 0 THEN 'extracted from note text as topic 1 of ' || k END AS reason FROM m""")
def g04(spark, sf_dir):
    rows = named(spark, sf_dir)
    return fl.link_topics(rows, fl.resolve_topics(rows, known_topics(spark, sf_dir)))


@query("g05_resolve_subject", f"WITH {SPOKEN_SQL}, p AS (SELECT note_id, trim(regexp_extract(raw_transcript, '{lit(fixed.PLACEMENT)}', 1)) AS name FROM spoken) SELECT note_id, CASE WHEN name <> '' THEN {TITLE.format('name')} ELSE 'General' END AS subject FROM p")
def g05(spark, sf_dir):
    return spoken_notes(spark, sf_dir).select("note_id", fl.subject_of(F.col("raw_transcript")).alias("subject"))


@query("g08_file_notes")
def g08(spark, sf_dir):
    """Notes with odd ids are filed against the known terms of the others; links with the edges and content of each note counted beside them."""
    base = spoken_notes(spark, sf_dir)
    terms = fl.tag_vocabulary(base.where("note_id % 2 = 0")).join(base.select("note_id", fl.subject_of(F.col("raw_transcript")).alias("subject")), "note_id")
    links, edges, content = fl.file_notes(base.where("note_id % 2 = 1"), terms.select("subject", F.col("term").alias("topic")).distinct())
    degree = edges.select("subject", F.explode(F.array("topic_a", "topic_b")).alias("topic")).groupBy("subject", "topic").agg(F.count("*").alias("edges"))
    return links.join(degree, ["subject", "topic"], "left").join(content.select("note_id", F.length("summary").alias("summary_chars")), "note_id").select("note_id", "subject", "topic", "rank", "confidence", "method", F.coalesce("edges", F.lit(0)).alias("edges"), "summary_chars")


# ---- placement ----

CLUSTER_SQL = VEC_SQL + f""", pairs AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id < y.vec_id WHERE 1 - ({COS.format('x.v', 'y.v')}) <= 0.7), sides AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
cores AS (SELECT a AS core FROM sides GROUP BY a HAVING count(*) >= 2), links AS (SELECT a, b FROM sides WHERE a IN (FROM cores) AND b IN (FROM cores)),
reach AS (SELECT core AS v, core AS r FROM cores UNION SELECT l.b, r.r FROM reach r JOIN links l ON l.a = r.v), lab AS (SELECT v, min(r) AS label FROM reach GROUP BY v), num AS (SELECT v, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM lab),
border AS (SELECT b.a AS v, min(n.cluster) AS reached FROM sides b JOIN num n ON n.v = b.b GROUP BY b.a), db AS (SELECT vec_id, label, coalesce(n.cluster, reached, -1) AS cluster FROM e LEFT JOIN num n ON n.v = vec_id LEFT JOIN border d ON d.v = vec_id)"""


@query("h07_recluster_subject", f"""WITH RECURSIVE {CLUSTER_SQL}, g AS (SELECT label AS subject, vec_id, CASE WHEN cluster = -1 THEN 'noise-' || vec_id ELSE cluster::VARCHAR END AS grp, CASE WHEN vec_id % 3 > 0 THEN 'topic ' || (vec_id % 3) END AS topic FROM db),
votes AS (SELECT subject, grp, topic, count(*) AS n FROM g WHERE topic IS NOT NULL GROUP BY ALL), kept AS (SELECT subject, grp, topic FROM votes QUALIFY row_number() OVER (PARTITION BY subject, grp ORDER BY n DESC, topic) = 1)
SELECT g.subject, vec_id, coalesce(k.topic, 'group ' || g.grp) AS topic, k.topic IS NULL AS created FROM g LEFT JOIN kept k ON k.subject = g.subject AND k.grp = g.grp""")
def h07(spark, sf_dir):
    """Rows of a label are a subject, two of three with a topic; clusters without one are named after their group."""
    points = read(spark, sf_dir, "embeddings").select(F.col("label").alias("subject"), "vec_id", F.when(F.col("vec_id") % 3 > 0, F.concat(F.lit("topic "), (F.col("vec_id") % 3).cast("string"))).alias("topic"))
    labels = graphs.cut_lineage(metric.dbscan(read(spark, sf_dir, "embeddings"), "vec_id", "label", EPS, 3, graphs.components))
    group = F.when(F.col("cluster") == -1, F.concat(F.lit("noise-"), F.col("vec_id").cast("string"))).otherwise(F.col("cluster").cast("string"))
    names = points.join(labels, "vec_id").select("subject", group.alias("group")).distinct().withColumn("name", F.concat(F.lit("group "), F.col("group")))
    return og.recluster(points, labels, "subject", "vec_id", "topic", names)


PROFILE_SQL = """newest AS (SELECT source, topic_name, raw_transcript AS t, row_number() OVER (PARTITION BY source, topic_name ORDER BY created_epoch DESC, note_id DESC) AS place FROM notes WHERE trim(raw_transcript) <> '' QUALIFY place <= 30),
profiles AS (SELECT source, topic_name, any_value(topic_name) || '. ' || string_agg(t, '. ' ORDER BY place) AS profile FROM newest GROUP BY source, topic_name)"""


@query("h09_topic_profile", f"WITH {NOTES_SQL}, {PROFILE_SQL} SELECT source, topic_name, length(profile) AS chars, md5(profile) AS digest FROM profiles")
def h09(spark, sf_dir):
    base = notes(spark, sf_dir)
    return og.topic_profiles(base.select("source", "topic_name").distinct(), base).select("source", "topic_name", F.length("profile").cast("long").alias("chars"), F.md5("profile").alias("digest"))


WORDS = "list_filter(regexp_split_to_array(trim({}), '\\s+'), lambda w: w <> '')"
PHRASES_SQL = f"""p0 AS (SELECT conv_id AS note_id, turn, {WORDS.format('lower(text)')}[1:(turn % 5 + 1)::INT] AS w FROM conversations), phrases AS (SELECT note_id, array_to_string(w, ' ') AS value, w, 0.45 + 0.1 * (turn % 3) AS confidence, turn * 10 AS start FROM p0 WHERE len(w) > 0),
points AS (SELECT *, round(confidence - CASE WHEN len(list_filter(w, lambda x: x IN ({', '.join(repr(w) for w in fixed.ACTION_WORDS)}))) > 0 THEN 0.15 ELSE 0 END + CASE WHEN len(w) = 2 THEN 0.05 ELSE 0 END, 6) AS points FROM phrases WHERE len(w) <= 4),
best AS (SELECT note_id, value, w FROM points QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY points DESC, start, value DESC) = 1),
tail AS (SELECT *, greatest(coalesce(list_max(list_transform(w, lambda x, i: CASE WHEN x IN ({', '.join(repr(w) for w in fixed.CONTAINER_WORDS)}) THEN 0 ELSE i END)), 1), 1) AS upto FROM best),
headings AS (SELECT note_id, array_to_string(list_transform(regexp_extract_all(array_to_string(w[1:upto], ' '), '[\\pL]+|[^\\pL]+'), lambda x: replace(upper(x[1]), 'ẞ', 'Ss') || x[2:]), '') AS name FROM tail)"""


def phrases(spark, sf_dir):
    """The first one to five words of each turn stand for key phrases."""
    words = F.filter(F.split(F.trim(F.lower("text")), r"\s+"), lambda w: w != "")
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("note_id"), "turn", words.alias("w")).where(F.size("w") > 0)
    return rows.select("note_id", F.array_join(F.slice("w", F.lit(1), (F.col("turn") % 5 + 1).cast("int")), " ").alias("value"), (0.45 + 0.1 * (F.col("turn") % 3)).alias("confidence"), (F.col("turn") * 10).cast("int").alias("start"))


@query("h12_name_from_key_phrases", f"WITH {PHRASES_SQL} SELECT * FROM headings")
def h12(spark, sf_dir):
    return og.name_from_key_phrases(phrases(spark, sf_dir))


@query("h13_propose_topic_name", f"""WITH {NOTES_SQL}, {PHRASES_SQL}, f AS (SELECT note_id, {WORDS.format('raw_transcript')}[1:4] AS w FROM notes),
n AS (SELECT f.note_id, CASE WHEN f.note_id % 11 = 0 THEN 'theme ' || source END AS theme, CASE WHEN f.note_id % 7 = 0 THEN 'label ' || language END AS label, h.name AS phrase, coalesce(nullif(rtrim(array_to_string(w, ' '), '.'), ''), 'New Topic') AS first FROM f JOIN notes USING (note_id) LEFT JOIN headings h USING (note_id))
SELECT note_id, coalesce(theme, label, phrase, array_to_string(list_transform(regexp_extract_all(lower(first), '[\\pL]+|[^\\pL]+'), lambda x: replace(upper(x[1]), 'ẞ', 'Ss') || x[2:]), '')) AS name,
  CASE WHEN theme IS NOT NULL THEN 'lnt-theme' WHEN label IS NOT NULL THEN 'lnt-lda' WHEN phrase IS NOT NULL THEN 'key-phrase' ELSE 'heuristic' END AS method FROM n""")
def h13(spark, sf_dir):
    base = notes(spark, sf_dir)
    themes = base.where("note_id % 11 = 0").select("note_id", F.concat(F.lit("theme "), "source").alias("theme"), F.lit(1.0).alias("weight"))
    labels = base.where("note_id % 7 = 0").select("note_id", F.concat(F.lit("label "), "language").alias("label"))
    return og.propose_names(base, phrases(spark, sf_dir), themes, labels)


@query("h14_organize_notes")
def h14(spark, sf_dir):
    """Notes with ids divisible by 5, spoken, against a library of the others."""
    base = notes(spark, sf_dir)
    asked = F.when(F.col("note_id") % 15 == 0, F.concat("raw_transcript", F.lit(" File this under "), "topic_name")).when(F.col("note_id") % 35 == 0, "").otherwise(F.col("raw_transcript"))
    return og.organize_notes(base.where("note_id % 5 = 0").withColumn("raw_transcript", asked), base.where("note_id % 5 <> 0"))


MOVES_SQL = NOTES_SQL + """, moves AS (SELECT note_id, CASE note_id % 4 WHEN 0 THEN upper(topic_name) || ' ' WHEN 1 THEN upper(source) WHEN 2 THEN 'zanzibar yard ' || language ELSE '' END AS target FROM notes WHERE note_id % 3 = 0),
tops AS (SELECT topic_name, min(source) AS source FROM notes GROUP BY ALL), subs AS (SELECT DISTINCT source FROM notes),
placed AS (SELECT note_id, coalesce(t.source, s.source, t2) AS source, coalesce(t.topic_name, CASE WHEN s.source IS NOT NULL THEN 'General' END, t2) AS topic_name FROM (SELECT *, array_to_string(list_transform(string_split(lower(trim(target)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS t2 FROM moves WHERE trim(target) <> '') m
  LEFT JOIN tops t ON lower(t.topic_name) = lower(trim(target)) LEFT JOIN subs s ON lower(s.source) = lower(trim(target)))"""


@query("h15_move_notes", f"WITH {MOVES_SQL} SELECT n.note_id, coalesce(p.source, n.source) AS source, coalesce(p.topic_name, n.topic_name) AS topic_name, p.note_id IS NOT NULL AS moved FROM notes n LEFT JOIN placed p USING (note_id)")
def h15(spark, sf_dir):
    base = notes(spark, sf_dir)
    k = F.col("note_id") % 4
    target = F.when(k == 0, F.concat(F.upper("topic_name"), F.lit(" "))).when(k == 1, F.upper("source")).when(k == 2, F.concat(F.lit("zanzibar yard "), "language")).otherwise("")
    return og.move_notes(base, base.where("note_id % 3 = 0").select("note_id", target.alias("target"))).select("note_id", "source", "topic_name", "moved")


@query("h19_fuzzy_name_lookup", f"""WITH {NOTES_SQL}, t AS (SELECT DISTINCT topic_name FROM notes), n AS (SELECT upper(topic_name) || ' ' AS name, topic_name AS found FROM t UNION ALL SELECT left(topic_name, -1), max(topic_name) FROM t GROUP BY ALL UNION ALL SELECT DISTINCT 'harbour ' || language, NULL FROM notes) SELECT * FROM n""")
def h19(spark, sf_dir):
    base = notes(spark, sf_dir)
    names = base.select(F.explode(F.array(F.concat(F.upper("topic_name"), F.lit(" ")), F.expr("left(topic_name, length(topic_name) - 1)"), F.concat(F.lit("harbour "), "language"))).alias("name"))
    return fl.lookup_names(names, base.select(F.col("topic_name").alias("name")))


RANGES = [(1, EPOCH + 86400, EPOCH + 5 * 86400, None), (2, EPOCH + 3 * 86400 + 1000, None, "src1"), (3, None, EPOCH + 90000, None), (4, None, None, "src2"), (5, 5, 100, None)]


@query("h23_range_rollup", f"""WITH {NOTES_SQL}, ranges(range_id, lo, hi, scope) AS (VALUES {', '.join('(' + ', '.join('NULL' if x is None else repr(x) for x in r) + ')' for r in RANGES)}), held AS (SELECT range_id, note_id FROM notes JOIN ranges ON (lo IS NULL OR created_epoch >= lo) AND (hi IS NULL OR created_epoch < hi) AND (scope IS NULL OR scope = source)),
{sparse_sql('nv', 'notes', 'note_id', 'lower(raw_transcript)')}, s AS (SELECT * FROM nv JOIN held USING (note_id)), m AS (SELECT range_id, bucket, sum(weight) AS m FROM s GROUP BY ALL), nm AS (SELECT range_id, sqrt(sum(m * m)) AS norm FROM m GROUP BY ALL),
near AS (SELECT range_id, note_id, {r6('sum(weight * m) / any_value(norm)')} AS score FROM s JOIN m USING (range_id, bucket) JOIN nm USING (range_id) GROUP BY ALL), b AS (SELECT range_id, note_id FROM near QUALIFY row_number() OVER (PARTITION BY range_id ORDER BY score DESC, note_id) = 1),
w AS (SELECT range_id, raw_transcript, {WORDS.format('raw_transcript')} AS w FROM b JOIN notes USING (note_id)), c AS (SELECT range_id, count(*) AS n FROM held GROUP BY ALL),
o AS (SELECT r.*, coalesce(n, 0) AS notes, CASE WHEN coalesce(n, 0) = 0 THEN 'No notes in that time range.' WHEN len(w) <= 80 THEN trim(raw_transcript) ELSE array_to_string(w[1:80], ' ') || '...' END AS summary FROM ranges r LEFT JOIN c USING (range_id) LEFT JOIN w USING (range_id))
SELECT range_id, notes, summary, CASE WHEN scope IS NULL THEN '' ELSE scope || ', ' END || CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN 'from ' || strftime(make_timestamp(lo::BIGINT * 1000000), '%Y-%m-%d') || ' to ' || strftime(make_timestamp(hi::BIGINT * 1000000), '%Y-%m-%d') WHEN lo IS NOT NULL THEN 'since ' || strftime(make_timestamp(lo::BIGINT * 1000000), '%Y-%m-%d') WHEN hi IS NOT NULL THEN 'up to ' || strftime(make_timestamp(hi::BIGINT * 1000000), '%Y-%m-%d') ELSE 'across all time' END
  || '. ' || notes || CASE WHEN notes = 1 THEN ' note. ' ELSE ' notes. ' END || summary AS spoken FROM o""")
def h23(spark, sf_dir):
    ranges = spark.createDataFrame(RANGES, "range_id int, start long, end long, scope string")
    return og.range_rollup(notes(spark, sf_dir), ranges)


# ---- reading back ----


@query("a09_collapse_retakes")
def a09(spark, sf_dir):
    """The newest notes of each topic without those said again."""
    return rb.collapse_retakes(rb.newest_of_topics(notes(spark, sf_dir)), "topic_name").select("topic_name", "position", "note_id", "skipped")


@query("a10_read_aloud")
def a10(spark, sf_dir):
    """Topics by name, and benchmark passages, which only a search can find."""
    base = notes(spark, sf_dir)
    topics = base.select(F.upper("topic_name").alias("query")).distinct().select(F.xxhash64("query").alias("query_id"), "query")
    return rb.read_aloud(topics.unionByName(read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query"))), base)


PLACES_SQL = NOTES_SQL + """, c AS (SELECT source, topic_name, count(*) AS n FROM notes GROUP BY ALL), tops AS (SELECT topic_name AS topic, min(source) AS topic_source, arg_min(n, source) AS n FROM c GROUP BY ALL),
subs AS (SELECT source AS subject, count(*) AS topics, string_agg(topic_name, ', ' ORDER BY lower(topic_name)) AS names FROM c GROUP BY ALL), kinds AS (SELECT unnest(['navigate', 'notes_under', 'topics_under', 'count_notes']) AS intent),
said AS (SELECT DISTINCT upper(topic_name) AS name FROM notes UNION SELECT DISTINCT upper(source) FROM notes UNION SELECT DISTINCT 'harbour lights ' || language FROM notes UNION SELECT ' '), q AS (SELECT intent, name, topic, topic_source, n, subject, topics, names, intent IN ('navigate', 'notes_under', 'count_notes') AS topic_first FROM kinds, said LEFT JOIN tops ON lower(topic) = lower(name) LEFT JOIN subs ON lower(subject) = lower(name)),
a AS (SELECT intent || ':' || name AS query_id, trim(name) <> '' AND (topic IS NOT NULL OR subject IS NOT NULL) AS ok, CASE WHEN trim(name) = '' THEN CASE intent WHEN 'navigate' THEN 'Where would you like to go?' ELSE 'Which subject or topic do you mean?' END
  WHEN intent = 'navigate' AND topic IS NOT NULL THEN topic || ', under ' || topic_source || '. ' || n || ' note' || CASE WHEN n = 1 THEN '.' ELSE 's.' END
  WHEN intent = 'navigate' AND subject IS NOT NULL THEN subject || '. ' || topics || ' topic' || CASE WHEN topics = 1 THEN '.' ELSE 's.' END
  WHEN intent = 'navigate' THEN 'I couldn''t find anything called ' || name || '.'
  WHEN topic IS NOT NULL THEN 'Under ' || topic || ', there are ' || least(n, 50) || ' note' || CASE WHEN n = 1 THEN '.' ELSE 's.' END
  WHEN subject IS NOT NULL AND intent = 'count_notes' THEN subject || ' has ' || topics || ' topic' || CASE WHEN topics = 1 THEN '.' ELSE 's.' END
  WHEN subject IS NOT NULL THEN 'Under ' || subject || CASE WHEN topics = 1 THEN ', there is 1 topic: ' ELSE ', there are ' || topics || ' topics: ' END || names || '.'
  ELSE 'I don''t have a subject or topic called ' || name || '.' END AS spoken, CASE WHEN topic IS NOT NULL THEN 'topic-' || topic WHEN subject IS NOT NULL THEN 'subject-' || subject END AS navigate_to FROM q)"""


@query("a11_navigate_answers", f"""WITH {PLACES_SQL} SELECT * FROM a UNION ALL SELECT 'list_subjects:', true, 'You have ' || count(*) || ' subject' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ': ' || string_agg(subject, ', ' ORDER BY lower(subject)) || '.', NULL FROM subs""")
def a11(spark, sf_dir):
    base = notes(spark, sf_dir)
    names = base.select(F.explode(F.array(F.upper("topic_name"), F.upper("source"), F.concat(F.lit("harbour lights "), "language"), F.lit(" "))).alias("name")).distinct()
    asked = names.withColumn("intent", F.explode(F.array(*[F.lit(x) for x in ("navigate", "notes_under", "topics_under", "count_notes")])))
    asked = asked.unionByName(spark.createDataFrame([("", "list_subjects")], "name string, intent string")).withColumn("query_id", F.concat_ws(":", "intent", "name"))
    return rb.answer_places(asked, base)


# ---- reminders ----


def said_notes(spark, sf_dir):
    """Spoken notes of 97 users, ten minutes apart for each."""
    rows = spoken_notes(spark, sf_dir)
    return rows.withColumn("user", F.col("note_id") % 97).withColumn("created_epoch", F.lit(EPOCH) + F.floor(F.col("note_id") / 97) * 600)


@query("m09_clarify_reminders")
def m09(spark, sf_dir):
    rows = jobs.dialogue_notes(said_notes(spark, sf_dir), "user")
    return jobs.spoken_replies(jobs.replay_dialogue(rows)).select("user_id", "note_id", "reply", "title", "due")


@query("m10_suppress_clarification_notes")
def m10(spark, sf_dir):
    base = said_notes(spark, sf_dir)
    return jobs.suppress_notes(base, jobs.replay_dialogue(jobs.dialogue_notes(base, "user"))).select("note_id", "user")


# ---- content, overlaps, models, streams ----


@query("s20_regenerate_content", f"WITH {CONTENT_SQL} SELECT note_id, CASE WHEN note_id % 3 = 0 THEN 'kept' ELSE summary END AS summary, CASE WHEN note_id % 3 = 0 THEN 'llm' ELSE 'extractive' END AS method FROM content")
def s20(spark, sf_dir):
    """Every third note has content by a model already, which stays."""
    base = spoken_notes(spark, sf_dir)
    old = base.select("note_id", F.lit("").alias("definition"), F.lit("").alias("example"), F.lit("kept").alias("summary"), F.when(F.col("note_id") % 3 == 0, "llm").otherwise("extractive").alias("method")).where("note_id % 3 <> 1")
    return en.regenerate_content(base, old).select("note_id", "summary", "method")


SPANS_SQL = "s AS (SELECT conv_id AS note_id, turn, turn * 7 AS start, turn * 7 + 3 + length(text) % 20 AS \"end\" FROM conversations)"


@query("e11_drop_overlaps", f"WITH {SPANS_SQL} SELECT note_id, turn FROM s p WHERE turn % 2 = 0 AND NOT EXISTS (SELECT 1 FROM s c WHERE c.turn % 2 = 1 AND c.turn % 3 > 0 AND c.note_id = p.note_id AND p.start < c.\"end\" AND p.\"end\" > c.start)")
def e11(spark, sf_dir):
    """Even turns as phrases, odd ones as places already claimed."""
    spans = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("note_id"), "turn", (F.col("turn") * 7).alias("start"), (F.col("turn") * 7 + 3 + F.length("text") % 20).alias("end"))
    return en.drop_overlaps(spans.where("turn % 2 = 0"), spans.where("turn % 2 = 1 AND turn % 3 > 0")).select("note_id", "turn")


@query("n21_fit_lda")
def n21(spark, sf_dir):
    """Topic shares of every note under a model of all notes."""
    base = notes(spark, sf_dir)
    return md.topic_shares(md.fit_topics(base, 8), base)


@query("x1_note_stream", f"WITH {NOTES_SQL} SELECT source, count(*) AS notes, sum(length(raw_transcript))::BIGINT AS chars FROM notes GROUP BY ALL")
def x1(spark, sf_dir):
    """Documents that arrive as a stream, written batch by batch, then read. A pattern may name a file or a folder of them."""
    stream = spark.readStream.schema(read(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parque[t]")
    out = scratch(spark, "note-stream")
    jobs.run_once(stream, jobs.note_writer(out, lambda df: df.select(F.col("doc_id").alias("note_id"), "source", F.length(F.coalesce("text", F.lit(""))).alias("chars"))), scratch(spark, "note-stream-state"))
    return spark.read.parquet(out).groupBy("source").agg(F.count("*").alias("notes"), F.sum("chars").alias("chars"))


def arrivals(spark, rows, parts):
    """A stream of rows that arrive in as many batches as there are conditions, and what to do after each arrival."""
    path = scratch(spark, "arrivals")

    def run(start):
        for part in parts:
            rows.where(part).repartition(spark.sparkContext.defaultParallelism).write.mode("append").parquet(path)
            start(spark.readStream.schema(rows.schema).parquet(path))

    return run


@query("x1_capture_stream")
def x1_capture(spark, sf_dir):
    """Spoken notes that arrive in two batches go through the whole chain; what is written for each of them, counted."""
    rows = spoken_notes(spark, sf_dir).select("note_id", "raw_transcript", "created_epoch")
    out, state = scratch(spark, "captured"), scratch(spark, "captured-state")
    arrivals(spark, rows, ["note_id % 3 > 0", "note_id % 3 = 0"])(lambda stream: jobs.run_once(stream, capture.capture_writer(out), state))
    of = lambda name: capture.captured(spark, out, name)
    tags = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda x: x["topic"]), "; ")
    counts = [of("links").groupBy("note_id").agg(tags.alias("topics")), of("entities").groupBy("note_id").agg(F.count("*").alias("entities"))]
    counts += [of("reminders").groupBy("note_id").agg(F.count("*").alias("reminders")), of("chunks").groupBy("note_id").agg(F.count("*").alias("chunks"))]
    done = of("notes").select("note_id", "note_type", F.md5("cleaned").alias("cleaned"))
    for table in counts:
        done = done.join(table, "note_id", "left")
    return done.fillna(0, ["entities", "reminders", "chunks"])


@query("x5_alert_stream", "SELECT user_id AS reminder_id, floor(epoch(min(ts)))::BIGINT AS announced FROM events GROUP BY ALL")
def x5_alerts(spark, sf_dir):
    """Events as sightings of due reminders, the second half of January after the first: each is announced once."""
    due = read(spark, sf_dir, "events").select(F.col("user_id").alias("reminder_id"), F.col("ts").cast("timestamp").alias("ts"))
    out, state = scratch(spark, "alerts"), scratch(spark, "alerts-state")
    arrivals(spark, due, ["day(ts) <= 15", "day(ts) > 15"])(lambda stream: jobs.run_once(stream, capture.alert_writer(out), state))
    return spark.read.parquet(f"{out}/alerts").select("reminder_id", F.unix_seconds("ts").alias("announced"))


@query("x4_reminder_dialogue")
def x4(spark, sf_dir):
    """M09 as a stream with a state per user."""
    path, out = scratch(spark, "dialogue"), scratch(spark, "dialogue-out")
    rows = jobs.dialogue_notes(said_notes(spark, sf_dir), "user")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    jobs.run_once(jobs.reminder_dialogue(stream), jobs.note_writer(out, lambda df: df), scratch(spark, "dialogue-state"))
    return jobs.spoken_replies(spark.read.parquet(out)).select("user_id", "note_id", "reply", "title", "due")
