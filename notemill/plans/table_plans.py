"""Queries S01 to S24 and P01 to P14."""

from __future__ import annotations

from notemill.functions import fixed
from notemill.operators import retrieval as rt
from notemill.operators import segments as sg
from notemill.operators import tables as tb
from notemill.plans.base import query
from notemill.plans.retrieval_plans import r6
from notemill.sources.notes import NOTE_TOPICS_SQL, NOTES_SQL, SEGMENTS_SQL, note_topics, notes, read, segments
from pyspark.sql import functions as F

COLS = "note_id, source, language, created_epoch, note_type, topic_name"
COLUMNS = COLS.split(", ")


def slim(spark, sf_dir):
    return notes(spark, sf_dir).select(*COLUMNS)


@query("s01_load_notes", f"WITH {NOTES_SQL} SELECT * FROM notes")
def s01(spark, sf_dir):
    return notes(spark, sf_dir)


@query("s02_list_notes", f"WITH {NOTES_SQL} SELECT {COLS} FROM notes ORDER BY created_epoch DESC, note_id DESC LIMIT 50 OFFSET 10")
def s02(spark, sf_dir):
    return tb.page(slim(spark, sf_dir), 50, 10)


@query("s03_note_detail", f"WITH {NOTE_TOPICS_SQL} SELECT n.note_id, n.source, list(topic ORDER BY rank) AS topics, any_value(l.quality) AS quality FROM notes n JOIN note_topics t USING (note_id) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY ALL) l ON l.doc_id = n.note_id GROUP BY ALL")
def s03(spark, sf_dir):
    links = note_topics(spark, sf_dir).groupBy("note_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda x: x["topic"]).alias("topics"))
    labels = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("note_id")).agg(F.max("quality").alias("quality"))
    return slim(spark, sf_dir).select("note_id", "source").join(links, "note_id").join(labels, "note_id", "left")


@query("s04_notes_by_topic", f"WITH {NOTES_SQL} SELECT {COLS}, row_number() OVER (PARTITION BY topic_name ORDER BY created_epoch DESC, note_id DESC) AS place FROM notes QUALIFY place <= 200")
def s04(spark, sf_dir):
    return tb.newest_per(slim(spark, sf_dir), "topic_name", 200)


@query("s05_notes_by_subject", "SELECT c_custkey, n_name, row_number() OVER (PARTITION BY r_name ORDER BY c_custkey DESC) AS place, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey QUALIFY place <= 1000")
def s05(spark, sf_dir):
    """Customers stand for notes, nations for topics, regions for subjects."""
    topics = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = read(spark, sf_dir, "customer").join(topics, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name", F.col("c_custkey").alias("created_epoch"), F.col("c_custkey").alias("note_id"))
    return tb.newest_per(joined, "r_name", 1000).select("c_custkey", "n_name", "place", "r_name")


@query("s06_notes_between", f"WITH {NOTES_SQL} SELECT {COLS} FROM notes WHERE created_epoch >= 1704500000 AND created_epoch < 1706000000 AND source = 'src0'")
def s06(spark, sf_dir):
    return tb.between(slim(spark, sf_dir), 1704500000, 1706000000, source="src0")


@query("s07_upsert_by_key", f"WITH {NOTES_SQL} SELECT {COLS} FROM (SELECT * REPLACE (CASE WHEN language = 'fr' THEN 'moved' ELSE source END AS source) FROM notes)")
def s07(spark, sf_dir):
    base = slim(spark, sf_dir)
    return tb.upsert(base, base.where("language = 'fr'").withColumn("source", F.lit("moved")), "note_id")


@query("s08_replace_children", f"WITH {NOTE_TOPICS_SQL} SELECT t.note_id, t.subject, CASE WHEN n.language = 'de' THEN 'new' ELSE t.topic END AS topic, t.rank FROM note_topics t JOIN notes n USING (note_id) WHERE n.language <> 'de' OR t.rank = 0")
def s08(spark, sf_dir):
    links, parents = note_topics(spark, sf_dir), slim(spark, sf_dir).where("language = 'de'")
    fresh = parents.select("note_id", F.col("source").alias("subject"), F.lit("new").alias("topic"), F.lit(0).alias("rank"))
    return tb.replace_children(links, fresh, "note_id", parents)


@query("s09_upsert_keep_user_edit", "SELECT doc_id AS note_id, 'generated' AS summary, CASE WHEN lang = 'en' THEN 'mine' ELSE 'fresh' END AS edit_markdown, lang = 'en' AS edited_by_user FROM documents")
def s09(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    old = docs.where("lang <> 'fr'").select(F.col("doc_id").alias("note_id"), F.lit("old").alias("summary"), F.lit("mine").alias("edit_markdown"), (F.col("lang") == "en").alias("edited_by_user"))
    new = docs.select(F.col("doc_id").alias("note_id"), F.lit("generated").alias("summary"), F.lit("fresh").alias("edit_markdown"), F.lit(False).alias("edited_by_user"))
    return tb.upsert_keep_edits(old, new, "note_id")


@query("s10_get_or_create", f"WITH {NOTES_SQL} SELECT DISTINCT topic_name AS name FROM notes WHERE language <> 'en'")
def s10(spark, sf_dir):
    base = slim(spark, sf_dir)
    return tb.get_or_create(base.where("language = 'en'").select(F.upper("topic_name").alias("name")), base.select(F.col("topic_name").alias("name")))


@query("s11_cascade_delete", f"WITH {NOTE_TOPICS_SQL} SELECT 'links' AS kind, count(*) AS n FROM note_topics JOIN notes USING (note_id) WHERE language <> 'es' UNION ALL SELECT 'notes', count(*) FROM notes WHERE language <> 'es'")
def s11(spark, sf_dir):
    base = slim(spark, sf_dir)
    left = tb.cascade_delete({"notes": base, "links": note_topics(spark, sf_dir)}, base.where("language = 'es'"))
    return left["links"].select(F.lit("links").alias("kind")).unionByName(left["notes"].select(F.lit("notes").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("s12_prune_orphans", "SELECT 'topics' AS kind, count(*) AS n FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) UNION ALL SELECT 'subjects', count(*) FROM region WHERE r_regionkey = 0 OR r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)) UNION ALL SELECT 'contacts', count(*) FROM supplier WHERE s_nationkey % 2 = 0 OR s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)")
def s12(spark, sf_dir):
    topics = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("topic_id"), F.col("n_regionkey").alias("subject_id"))
    subjects = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("subject_id"), (F.col("r_regionkey") == 0).alias("is_unfiled"))
    own = read(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("topic_id"))
    links = read(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("topic_id"))
    contacts = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("contact_id"), F.when(F.col("s_nationkey") % 2 == 0, "x@example.org").otherwise(" ").alias("email"), F.lit(None).cast("string").alias("phone"))
    mentions = read(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_suppkey").alias("contact_id"))
    kept = tb.prune_orphans(own, links, topics, subjects, contacts, mentions)
    rows = [t.select(F.lit(n).alias("kind")) for n, t in zip(("topics", "subjects", "contacts"), kept, strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("kind").agg(F.count("*").alias("n"))


@query("s13_bulk_copy_backfill", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang <> 'en'")
def s13(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = docs.join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")
    return tb.backfill(rows, docs.where("lang = 'en'").select("doc_id"), "doc_id", ["quality", "toxic"])


@query("s14_reconcile_schema", "SELECT item_id, text, NULL::VARCHAR AS lang, NULL::BIGINT AS n_chars FROM benchmark")
def s14(spark, sf_dir):
    want = read(spark, sf_dir, "documents").select("lang", "n_chars").schema
    return tb.reconcile(read(spark, sf_dir, "benchmark"), want)


@query("s15_build_chunk_index")
def s15(spark, sf_dir):
    return rt.chunk_index(notes(spark, sf_dir)).groupBy("source").agg(F.countDistinct("note_id").alias("notes"), F.count("*").alias("chunks"))


@query("s16_index_replace", f"WITH {NOTES_SQL} SELECT source, count(*) AS n FROM notes WHERE source <> 'src3' GROUP BY ALL")
def s16(spark, sf_dir):
    """Chunks of one subject dropped; notes that remain indexed are counted."""
    index, gone = rt.chunk_index(notes(spark, sf_dir)), slim(spark, sf_dir).where("source = 'src3'")
    empty = index.limit(0)
    return tb.replace_children(index, empty, "note_id", gone).groupBy("source").agg(F.countDistinct("note_id").alias("n"))


@query("s17_index_integrity", f"WITH {NOTES_SQL} SELECT count(*) FILTER (WHERE trim(raw_transcript) <> '') AS indexed, 0 AS missing, 0 AS orphans FROM notes")
def s17(spark, sf_dir):
    base = notes(spark, sf_dir)
    index = rt.chunk_index(base).select("note_id").distinct()
    full = base.where(F.trim("raw_transcript") != "").select("note_id")
    flags = full.withColumn("f", F.lit(1)).join(index.withColumn("i", F.lit(1)), "note_id", "full")
    return flags.agg(F.count("i").alias("indexed"), F.count_if(F.col("i").isNull()).cast("int").alias("missing"), F.count_if(F.col("f").isNull()).cast("int").alias("orphans"))


@query("s18_explode_segments", "SELECT event_id AS note_id, 0 AS pos, 0.0::DOUBLE AS start, CASE WHEN event_id % 2 = 0 THEN 1.5 ELSE value END::DOUBLE AS \"end\", event_type AS text, CASE WHEN event_id % 3 = 0 THEN 'todo' ELSE 'unclassified' END AS label FROM events UNION ALL SELECT event_id, 1, 2.0, 3.0, event_type, CASE WHEN event_id % 3 = 0 THEN 'todo' ELSE 'unclassified' END FROM events WHERE event_id % 2 = 0")
def s18(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    json = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('[{"start":0,"end":1.5,"text":" '), F.col("event_type"), F.lit('"},{"start":1.5,"end":2,"text":"  "},{"start":2,"end":3,"text":"'), F.col("event_type"), F.lit('"}]')))
    rows = ev.select(F.col("event_id").alias("note_id"), json.alias("segments"), F.col("event_type").alias("body"), F.col("value").alias("duration"), F.when(F.col("event_id") % 3 == 0, "todo").alias("kind"))
    return tb.explode_segments(rows, "segments", "body", "kind")


@query("s19_backfill_unfiled", f"WITH {NOTES_SQL} SELECT topic_name, count(*) FILTER (WHERE note_type <> 'todo') AS before, count(*) AS after FROM notes GROUP BY ALL")
def s19(spark, sf_dir):
    """Notes without a topic get their own one; topic counts before and after."""
    base = notes(spark, sf_dir)
    filed = base.withColumn("topic_id", F.when(F.col("note_type") != "todo", F.col("topic_name")))
    fixed_ = filed.where("topic_id IS NULL AND trim(raw_transcript) <> ''").withColumn("topic_id", F.col("topic_name"))
    after = tb.upsert(filed, fixed_, "note_id").groupBy("topic_id").agg(F.count("*").alias("after"))
    return after.join(filed.groupBy("topic_id").agg(F.count("*").alias("before")), "topic_id", "left").where("topic_id IS NOT NULL").select(F.col("topic_id").alias("topic_name"), F.coalesce("before", F.lit(0)).alias("before"), "after")


@query("s21_reset_graph", f"WITH {NOTES_SQL} SELECT note_id, NULL::VARCHAR AS topic_name FROM notes")
def s21(spark, sf_dir):
    return slim(spark, sf_dir).select("note_id", F.lit(None).cast("string").alias("topic_name"))


@query("s22_scalar_metadata", "SELECT doc_id, CASE WHEN lang = 'fr' THEN 1 ELSE 2 END AS n FROM documents")
def s22(spark, sf_dir):
    held = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.when(F.col("lang") != "fr", F.col("lang")))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(tb.scalar_metadata(held)).alias("n"))


@query("s23_map_source_label", "SELECT event_type, count(*) AS n, CASE event_type WHEN 'click' THEN 'voice' WHEN 'view' THEN 'ocr' ELSE 'manual' END AS label FROM events GROUP BY ALL")
def s23(spark, sf_dir):
    stored = F.create_map(F.lit("click"), F.lit("microphone"), F.lit("view"), F.lit("upload"))
    ev = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return ev.withColumn("label", tb.source_label(F.coalesce(F.try_element_at(stored, F.col("event_type")), F.col("event_type"))))


# ---- segments ----

P_SQL = f"WITH {SEGMENTS_SQL}"
CONF_SQL = P_SQL + """, c AS (SELECT recording_id, sum(avg_logprob * greatest("end" - "start", 1e-6)) / sum(greatest("end" - "start", 1e-6)) AS logprob, avg(no_speech_prob) AS no_speech FROM segments GROUP BY ALL)"""


def conf(spark, sf_dir):
    return sg.confidence(segments(spark, sf_dir))


@query("p01_weighted_logprob", f"{CONF_SQL} SELECT recording_id, {r6('logprob')} AS logprob FROM c")
def p01(spark, sf_dir):
    return conf(spark, sf_dir).select("recording_id", rt.rounded(F.col("logprob")).alias("logprob"))


@query("p02_mean_no_speech", f"{CONF_SQL} SELECT recording_id, {r6('no_speech')} AS no_speech FROM c")
def p02(spark, sf_dir):
    return conf(spark, sf_dir).select("recording_id", rt.rounded(F.col("no_speech")).alias("no_speech"))


@query("p03_confidence", f"{CONF_SQL} SELECT recording_id, {r6('coalesce(least(greatest(exp(logprob), 0), 1), 0)')} AS confidence FROM c")
def p03(spark, sf_dir):
    return conf(spark, sf_dir).select("recording_id", rt.rounded(F.col("confidence")).alias("confidence"))


@query("p04_unclear_passages", P_SQL + """ SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY "start", segment_id) AS place, segment_id, text FROM segments WHERE avg_logprob < -0.5 QUALIFY place <= 6""")
def p04(spark, sf_dir):
    return sg.unclear_passages(segments(spark, sf_dir))


@query("p05_assemble_transcript", P_SQL + """ SELECT recording_id, string_agg(text || '.', ' ' ORDER BY "start", segment_id) AS transcript, count(*) AS pieces FROM segments GROUP BY ALL""")
def p05(spark, sf_dir):
    return sg.assemble(segments(spark, sf_dir))


SESSIONS_SQL = P_SQL + """, o AS (SELECT *, CASE WHEN "start" - lag("start") OVER w > 36000 THEN 1 ELSE 0 END AS opens FROM segments WINDOW w AS (PARTITION BY recording_id ORDER BY "start", segment_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY recording_id ORDER BY "start", segment_id) AS session FROM o)"""


@query("p06_sessionize_by_gap", SESSIONS_SQL + """ SELECT recording_id, session, min("start") AS "first", max("start") AS "last", count(*) AS segments FROM s GROUP BY ALL HAVING max("start") - min("start") >= 60""")
def p06(spark, sf_dir):
    return sg.sessions(segments(spark, sf_dir), 36000, 60)


@query("p07_cap_session_length", SESSIONS_SQL + """, e AS (SELECT *, "start" - min("start") OVER (PARTITION BY recording_id, session) AS elapsed FROM s), p AS (SELECT *, floor(elapsed / 20000) AS part FROM e)
SELECT recording_id, session, part, count(*) AS segments, arg_min(segment_id, {'l': level, 's': segment_id}) FILTER (WHERE elapsed - part * 20000 >= 10000) AS cut_at FROM p GROUP BY ALL""")
def p07(spark, sf_dir):
    return sg.cap_sessions(segments(spark, sf_dir), 36000, 20000)


#: Each step finds the next cut of every session that is still too long.
CUTS_SQL = SESSIONS_SQL.replace("WITH ", "WITH RECURSIVE ", 1).replace("36000", "200000") + """, cuts AS (SELECT recording_id, session, 0 AS piece, min("start") AS b, max("start") AS e FROM s GROUP BY ALL UNION ALL
SELECT recording_id, session, piece + 1, coalesce(arg_min(st, {'d': abs(st - b - 300000), 's': st, 'i': segment_id}) FILTER (WHERE st - b BETWEEN 200000 AND 400000 AND level <= quietest + 0.5::DOUBLE), min(st) FILTER (WHERE st - b > 400000)), e
FROM (SELECT c.*, s."start" AS st, segment_id, level, min(level) FILTER (WHERE s."start" - b BETWEEN 200000 AND 400000) OVER (PARTITION BY c.recording_id, c.session) AS quietest FROM cuts c JOIN s ON s.recording_id = c.recording_id AND s.session = c.session AND s."start" >= b WHERE e - b > 400000)
GROUP BY recording_id, session, piece, b, e), placed AS (SELECT s.recording_id, s.session, segment_id, "start", max(piece) AS piece FROM s JOIN cuts c ON s.recording_id = c.recording_id AND s.session = c.session AND s."start" >= b GROUP BY ALL)"""


@query("p07_quiet_cuts", CUTS_SQL + """ SELECT recording_id, session::BIGINT AS session, piece::BIGINT AS piece, min("start") AS "first", max("start") AS "last", count(*) AS segments, arg_min(segment_id, {'s': "start", 'i': segment_id}) AS first_id FROM placed GROUP BY ALL""")
def p07_quiet(spark, sf_dir):
    return sg.quiet_cuts(segments(spark, sf_dir), 200000, 400000)


@query("p08_damp_outliers", P_SQL + f", m AS (SELECT recording_id, quantile_cont(level, 0.5) AS median FROM segments GROUP BY ALL) SELECT segment_id, {r6('CASE WHEN level > median + 12 THEN level - 10 ELSE level END')} AS level FROM segments JOIN m USING (recording_id)")
def p08(spark, sf_dir):
    return sg.damp_outliers(segments(spark, sf_dir)).select("segment_id", rt.rounded(F.col("level")).alias("level"))


@query("p09_shift_to_target", P_SQL + f" SELECT segment_id, {r6('level + (-20.0::DOUBLE) - avg(level) OVER (PARTITION BY recording_id)', 4)} AS level FROM segments")
def p09(spark, sf_dir):
    return sg.shift_to_target(segments(spark, sf_dir), -20.0).select("segment_id", rt.rounded(F.col("level"), 4).alias("level"))


NAMES_SQL = "CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.LANGUAGES.items()) + " ELSE language END"


@query("p10_language_report", f"WITH {NOTES_SQL} SELECT {NAMES_SQL} AS language_name, language = 'en' AS is_english, language <> 'en' AS needs_translation, count(*) AS n FROM notes GROUP BY ALL")
def p10(spark, sf_dir):
    return sg.language_report(slim(spark, sf_dir)).groupBy("language_name", "is_english", "needs_translation").agg(F.count("*").alias("n"))


@query("p11_detect_language")
def p11(spark, sf_dir):
    """Confusion counts of languages found from words; words are learnt from all notes."""
    words = notes(spark, sf_dir).select("note_id", F.col("language").alias("lang"), F.explode(F.array_distinct(F.filter(F.split(F.lower("raw_transcript"), r"[^\p{L}]+"), lambda w: w != ""))).alias("word"))
    found = sg.detect_languages(words.select("note_id", "word"), sg.learn_languages(words), "note_id")
    known = notes(spark, sf_dir).select("note_id", F.col("language").alias("known"))
    return known.join(found, "note_id", "left").groupBy("known", "language").agg(F.count("*").alias("n"))


@query("p14_drop_no_speech", P_SQL + " SELECT count(*) AS n FROM segments WHERE no_speech_prob <= 0.6")
def p14(spark, sf_dir):
    return sg.drop_no_speech(segments(spark, sf_dir)).agg(F.count("*").alias("n"))
