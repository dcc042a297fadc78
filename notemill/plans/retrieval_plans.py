"""Queries H01 to H06, R01 to R16 and A01 to A12; benchmark passages are the questions."""

from __future__ import annotations

from notemill.functions import fixed, text
from notemill.operators import graphs, metric, retrieval as rt
from notemill.operators import vectors as vec
from notemill.plans.base import query, quoted
from notemill.plans.text_plans import SENTENCES_SQL, match_tokens
from notemill.sources.notes import NOTES_SQL, notes, read
from pyspark.sql import functions as F


def r6(x: str, k: int = 6) -> str:
    return f"floor(({x}) * 1e{k} + 0.5) / 1e{k}"


EMBED = f"list_filter(regexp_extract_all({{}}, '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({quoted(fixed.EMBED_STOPWORDS)}))"
BUCKET = "(('0x' || left(md5(t), 8))::BIGINT % 256)::INT"
KEYWORDS = f"list_distinct(list_filter({{}}, lambda t: length(t) > 2 AND t NOT IN ({quoted(fixed.QUERY_STOPWORDS)})))"


def sparse_sql(name: str, table: str, key: str, said: str) -> str:
    return f"""{name}_t AS (SELECT {key}, unnest({EMBED.format(said)}) AS t FROM {table}),
{name}_c AS (SELECT {key}, {BUCKET} AS bucket, count(*) AS n FROM {name}_t GROUP BY ALL),
{name} AS (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM {name}_c)"""


QUERIES_SQL = NOTES_SQL + ", queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
SEARCH_SQL = QUERIES_SQL + f""", said AS (SELECT note_id, array_to_string({match_tokens('raw_transcript')}, ' ') AS said FROM notes),
terms AS (SELECT query_id, array_to_string({match_tokens('query')}, ' ') AS said, {KEYWORDS.format(match_tokens('query'))} AS terms FROM queries),
{sparse_sql('qv', 'terms', 'query_id', 'said')}, {sparse_sql('nv', 'said', 'note_id', 'said')},
lexical AS (SELECT query_id, note_id, len(list_filter(terms, lambda t: contains(s.said, t))) / len(terms) AS lexical FROM said s, terms q WHERE len(terms) > 0 AND len(list_filter(terms, lambda t: contains(s.said, t))) > 0),
vector AS (SELECT query_id, note_id, {r6('least(sum(q.weight * n.weight), 1)')} AS vector FROM qv q JOIN nv n USING (bucket) GROUP BY ALL),
guarded AS (SELECT v.* FROM vector v SEMI JOIN lexical USING (query_id, note_id)),
fused AS (SELECT query_id, note_id, coalesce(vector, 0) AS vector, coalesce(lexical, 0) AS lexical, {r6('0.65::DOUBLE * coalesce(vector, 0) + (1 - 0.65::DOUBLE) * coalesce(lexical, 0)')} AS score,
  list_filter([CASE WHEN vector IS NOT NULL THEN 'vector' END, CASE WHEN lexical IS NOT NULL THEN 'keyword' END], lambda x: x IS NOT NULL) AS matched_by FROM guarded FULL JOIN lexical USING (query_id, note_id)),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id) AS rank FROM fused WHERE score >= 0.08 QUALIFY rank <= 5)"""
COS = "CASE WHEN list_dot_product({0}, {0}) * list_dot_product({1}, {1}) = 0 THEN 0 ELSE list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1})) END"
VEC_SQL = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def questions(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def found(spark, sf_dir):
    return rt.hybrid_search(questions(spark, sf_dir), notes(spark, sf_dir))


@query("h01_embed_hashed", f"WITH {NOTES_SQL}, {sparse_sql('nv', 'notes', 'note_id', 'lower(raw_transcript)')} SELECT note_id, bucket, {r6('weight')} AS weight FROM nv")
def h01(spark, sf_dir):
    out = vec.embed_sparse(notes(spark, sf_dir), "note_id", "raw_transcript")
    return out.withColumn("weight", rt.rounded(F.col("weight")))


EPS = 0.7


PAIRS_SQL = VEC_SQL + f", p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, 1 - ({COS.format('a.v', 'b.v')}) AS distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id), pairs AS (SELECT * FROM p WHERE distance <= 0.7)"


@query("h02_cosine_to_centroid", f"WITH {VEC_SQL}, u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY ALL) SELECT vec_id, {r6(COS.format('v', 'c'), 5)} AS cosine FROM e JOIN c USING (label)")
def h02(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return rows.join(vec.centroids(rows, "label"), "label").select("vec_id", rt.rounded(vec.cosine(F.col("embedding"), F.col("centroid")), 5).alias("cosine"))


@query("h03_most_similar", f"WITH {VEC_SQL}, s AS (SELECT q.vec_id AS query_id, e.vec_id, {r6('least(greatest(' + COS.format('q.v', 'e.v') + ', 0), 1)')} AS score FROM e q, e WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 1")
def h03(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return rt.dense_search(rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows, 1)


@query("h04_feature_matrix", """SELECT vec_id, list_concat(list_transform(embedding, lambda x: x::DOUBLE), list_transform([0, 1, 2], lambda i: CASE WHEN vec_id % 3 = i THEN 0.3::DOUBLE ELSE 0 END),
  list_transform(range(10), lambda i: CASE WHEN label = i THEN 0.6::DOUBLE ELSE 0 END)) AS features FROM embeddings""")
def h04(spark, sf_dir):
    kinds = F.get(F.array(*[F.lit(x) for x in ("academic", "brainstorm", "todo")]), (F.col("vec_id") % 3).cast("int"))
    rows = read(spark, sf_dir, "embeddings").withColumn("note_type", kinds).withColumn("embedding", F.col("embedding").cast("array<double>"))
    features = vec.feature_vectors(rows, "embedding", {"note_type": (["academic", "brainstorm", "todo"], 0.3), "label": (list(range(10)), 0.6)})
    return rows.select("vec_id", features.alias("features"))


@query("h05_neighbour_pairs", f"WITH {PAIRS_SQL} SELECT label, a, b, {r6('distance', 5)} AS distance FROM pairs")
def h05(spark, sf_dir):
    return metric.neighbour_pairs(read(spark, sf_dir, "embeddings"), "vec_id", "label", EPS).withColumn("distance", rt.rounded(F.col("distance"), 5))


@query("h06_dbscan", f"""WITH RECURSIVE {PAIRS_SQL}, sides AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
cores AS (SELECT a AS core FROM sides GROUP BY a HAVING count(*) >= 1), links AS (SELECT a, b FROM sides WHERE a IN (FROM cores) AND b IN (FROM cores)),
reach AS (SELECT core AS v, core AS r FROM cores UNION SELECT l.b, r.r FROM reach r JOIN links l ON l.a = r.v),
lab AS (SELECT v, min(r) AS label FROM reach GROUP BY v), num AS (SELECT v, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM lab),
border AS (SELECT b.a AS v, min(n.cluster) AS reached FROM sides b JOIN num n ON n.v = b.b GROUP BY b.a)
SELECT vec_id, coalesce(n.cluster, reached, -1) AS cluster FROM e LEFT JOIN num n ON n.v = vec_id LEFT JOIN border d ON d.v = vec_id""")
def h06(spark, sf_dir):
    return metric.dbscan(read(spark, sf_dir, "embeddings"), "vec_id", "label", EPS, 2, graphs.components)


CENTROID_SQL = VEC_SQL + f""", u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL),
c AS (SELECT label, list(x ORDER BY i) AS centroid FROM m GROUP BY ALL), near AS (SELECT label, vec_id, round_even({COS.format('v', 'centroid')}, 6) AS score FROM e JOIN c USING (label))"""


@query("h08_representative", f"WITH {CENTROID_SQL} SELECT label, vec_id, score FROM near QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1")
def h08(spark, sf_dir):
    return vec.representatives(read(spark, sf_dir, "embeddings"), "vec_id", "label")


@query("h10_subject_centroid", f"WITH {CENTROID_SQL} SELECT label, i, {r6('x')} AS x FROM m")
def h10(spark, sf_dir):
    return vec.centroids(read(spark, sf_dir, "embeddings"), "label").select("label", F.posexplode("centroid").alias("p", "x")).select("label", (F.col("p") + 1).alias("i"), rt.rounded(F.col("x")).alias("x"))


@query("h11_match_topic", f"""WITH {CENTROID_SQL}, s AS (SELECT vec_id, c.label AS topic, {r6(COS.format('v', 'centroid'))} AS score FROM e, c)
SELECT vec_id, topic, score FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, topic) = 1""")
def h11(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    topics = vec.centroids(rows, "label").withColumnRenamed("label", "candidate")
    return vec.best_candidate(rows, topics, "vec_id", 0.3).withColumnRenamed("candidate", "topic")


@query("r01_chunk_text")
def r01(spark, sf_dir):
    return rt.chunk_index(notes(spark, sf_dir)).select("chunk_id", "note_id", "chunk_index", "document")


@query("r02_chunk_metadata")
def r02(spark, sf_dir):
    return rt.chunk_index(notes(spark, sf_dir)).drop("document")


FILTER_SQL = QUERIES_SQL + """, f AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN ['src0', 'src1'] END AS subjects, CASE WHEN query_id % 3 = 0 THEN ['todo'] END AS note_types, 1704067200 + query_id * 1000 AS after, 1706000000 AS before FROM queries)"""


def filters(spark, sf_dir):
    empty = F.lit(None).cast("array<string>")
    return questions(spark, sf_dir).select("query_id", F.when(F.col("query_id") % 2 == 0, F.array(F.lit("src0"), F.lit("src1"))).alias("subjects"), empty.alias("topics"), F.when(F.col("query_id") % 3 == 0, F.array(F.lit("todo"))).alias("note_types"), (F.lit(1704067200) + F.col("query_id") * 1000).alias("after"), F.lit(1706000000).alias("before"))


ALLOWED_SQL = "(subjects IS NULL OR list_contains(subjects, source)) AND (note_types IS NULL OR list_contains(note_types, note_type)) AND created_epoch BETWEEN after AND before"


@query("r03_retrieval_filter", f"WITH {FILTER_SQL} SELECT query_id, count(*) AS n FROM notes JOIN f ON {ALLOWED_SQL} GROUP BY ALL")
def r03(spark, sf_dir):
    return rt.filtered(filters(spark, sf_dir), notes(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("n"))


@query("r04_vector_topk", f"WITH {SEARCH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector DESC, note_id) AS rank FROM vector) SELECT query_id, note_id, vector, rank FROM r WHERE rank <= 15")
def r04(spark, sf_dir):
    return rt.vector_topk(questions(spark, sf_dir), notes(spark, sf_dir), 15)


@query("r05_query_keywords", f"WITH {SEARCH_SQL} SELECT query_id, list_sort(terms) AS terms FROM terms")
def r05(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", F.array_sort(rt.query_keywords(F.col("query"))).alias("terms"))


@query("r06_collision_guard", f"WITH {SEARCH_SQL} SELECT query_id, count(*) AS n FROM guarded GROUP BY ALL")
def r06(spark, sf_dir):
    q, n = questions(spark, sf_dir), notes(spark, sf_dir)
    return rt.pair_scores(q, n).where("vector IS NOT NULL").groupBy("query_id").agg(F.count("*").alias("n"))


@query("r07_best_chunk_per_note")
def r07(spark, sf_dir):
    """Best chunk of each note by keyword share."""
    return rt.best_chunks(questions(spark, sf_dir), notes(spark, sf_dir))


@query("r08_lexical_scores", f"WITH {SEARCH_SQL} SELECT * FROM lexical")
def r08(spark, sf_dir):
    return rt.lexical_scores(questions(spark, sf_dir), notes(spark, sf_dir))


@query("r08_newest_lexical", f"WITH {SEARCH_SQL} SELECT lexical.* FROM lexical JOIN (SELECT note_id FROM notes ORDER BY created_epoch DESC, note_id LIMIT 300) USING (note_id)")
def r08_newest(spark, sf_dir):
    """Keyword scores of the 300 newest notes, the limit of an interactive search."""
    return rt.lexical_scores(questions(spark, sf_dir), notes(spark, sf_dir), newest=300)


@query("r09_fuse_scores", f"WITH {SEARCH_SQL} SELECT * FROM fused")
def r09(spark, sf_dir):
    return rt.fuse(rt.pair_scores(questions(spark, sf_dir), notes(spark, sf_dir)))


@query("r10_rank_and_floor", f"WITH {SEARCH_SQL} SELECT query_id, note_id, score, rank FROM found")
def r10(spark, sf_dir):
    return found(spark, sf_dir).select("query_id", "note_id", "score", "rank")


@query("r11_hybrid_search", f"WITH {SEARCH_SQL} SELECT * FROM found")
def r11(spark, sf_dir):
    return found(spark, sf_dir)


@query("r12_browse", f"WITH {FILTER_SQL} SELECT query_id, note_id, 1.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY created_epoch DESC, note_id) AS rank FROM notes JOIN f ON {ALLOWED_SQL} QUALIFY rank <= 5")
def r12(spark, sf_dir):
    return rt.browse(filters(spark, sf_dir), notes(spark, sf_dir))


@query("r14_live_placement", f"WITH {NOTES_SQL} SELECT source, language, count(*) AS n FROM notes WHERE note_type <> 'todo' GROUP BY ALL")
def r14(spark, sf_dir):
    """Chunks whose note is gone drop out; the note's own subject replaces the indexed one."""
    base = notes(spark, sf_dir)
    index = base.select("note_id", F.lit("old").alias("source"))
    live = base.where("note_type <> 'todo'")
    return index.drop("source").join(live, "note_id").groupBy("source", "language").agg(F.count("*").alias("n"))


@query("r15_citation", f"WITH {SEARCH_SQL} SELECT query_id, rank AS index, note_id, topic_name || ', under ' || source AS location, strftime(make_timestamp(created_epoch * 1000000), '%Y-%m-%d') AS created FROM found JOIN notes USING (note_id)")
def r15(spark, sf_dir):
    return rt.citations(found(spark, sf_dir), notes(spark, sf_dir))


@query("r16_dense_search", f"WITH {VEC_SQL}, s AS (SELECT q.vec_id AS query_id, e.vec_id, {r6('least(greatest(' + COS.format('q.v', 'e.v') + ', 0), 1)')} AS score FROM e q, e WHERE q.vec_id % 20 = 0) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5")
def r16(spark, sf_dir):
    """The stated query set is every row whose id is divisible by 20, against all rows."""
    rows = read(spark, sf_dir, "embeddings")
    return rt.dense_search(rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows)


@query("a01_build_context")
def a01(spark, sf_dir):
    return rt.context(found(spark, sf_dir), notes(spark, sf_dir))


@query("a02_answer_confidence", f"WITH {SEARCH_SQL} SELECT query_id, {r6('least(1.0::DOUBLE, max(score) + 0.05::DOUBLE * least(count(*) - 1, 2))', 3)} AS confidence FROM found GROUP BY ALL")
def a02(spark, sf_dir):
    return rt.answer_confidence(found(spark, sf_dir))


@query("a03_citations", f"WITH {SEARCH_SQL} SELECT query_id, list(note_id ORDER BY rank) AS notes FROM found GROUP BY ALL")
def a03(spark, sf_dir):
    cited = rt.citations(found(spark, sf_dir), notes(spark, sf_dir))
    return cited.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "note_id"))), lambda x: x["note_id"]).alias("notes"))


ANSWER_SQL = SEARCH_SQL + f""", sent AS (SELECT query_id, rank, terms, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT f.query_id, rank, terms, {SENTENCES_SQL.format('raw_transcript')} AS s FROM found f JOIN notes USING (note_id) JOIN terms t ON t.query_id = f.query_id)),
kw AS (SELECT *, {KEYWORDS.format(match_tokens('sentence'))} AS words, len(list_filter(regexp_split_to_array(trim(sentence), '\\s+'), lambda w: true)) AS n FROM sent),
sc AS (SELECT *, {r6("CASE WHEN len(terms) = 0 THEN 1 WHEN len(words) = 0 THEN 0 ELSE len(list_intersect(terms, words)) / len(terms) END")} AS score FROM kw),
run AS (SELECT *, row_number() OVER w AS place, sum(n) OVER w AS used FROM sc WHERE score > 0 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, rank, pos)),
ov AS (SELECT *, max(CASE WHEN used > 45 AND place > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos) AS over FROM run),
best AS (SELECT query_id, string_agg(sentence, ' ' ORDER BY place) || ' ' || array_to_string(list_transform(list_sort(list_distinct(list(rank))), lambda i: '[' || i || ']'), ' ') AS answer FROM ov WHERE over = 0 GROUP BY ALL),
first AS (SELECT query_id, sentence || ' [1]' AS first FROM sent WHERE rank = 1 AND pos = 0),
answers AS (SELECT query_id, coalesce(answer, first) AS answer FROM queries LEFT JOIN best USING (query_id) LEFT JOIN first USING (query_id) WHERE coalesce(answer, first) IS NOT NULL)"""


def answers(spark, sf_dir):
    return rt.extractive_answers(questions(spark, sf_dir), found(spark, sf_dir), notes(spark, sf_dir))


@query("a04_extractive_answer", f"WITH {ANSWER_SQL} SELECT * FROM answers")
def a04(spark, sf_dir):
    return answers(spark, sf_dir)


@query("a05_empty_answer", f"""WITH {QUERIES_SQL}, s AS (SELECT query_id, CASE WHEN len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '')) > 6 THEN '' ELSE query END AS q FROM queries)
SELECT query_id, CASE WHEN q = '' AND query_id % 2 = 0 THEN 'I don''t have any notes matching that.' ELSE 'I don''t have any notes' || CASE WHEN q <> '' THEN ' about ' || q ELSE '' END || CASE WHEN query_id % 2 = 1 THEN ' in last week' ELSE '' END || '.' END AS answer FROM s""")
def a05(spark, sf_dir):
    scope = F.when(F.col("query_id") % 2 == 1, "last week")
    return questions(spark, sf_dir).select("query_id", rt.empty_answer(F.col("query"), scope).alias("answer"))


@query("a06_to_spoken", f"WITH {ANSWER_SQL} SELECT query_id, trim(regexp_replace(regexp_replace(answer, '\\s*\\[\\d+\\]', '', 'g'), '\\s+', ' ', 'g')) AS spoken FROM answers")
def a06(spark, sf_dir):
    return answers(spark, sf_dir).select("query_id", rt.to_spoken(F.col("answer")).alias("spoken"))


@query("a07_when_prefix", f"WITH {SEARCH_SQL} SELECT query_id, 'You mentioned that on ' || strftime(make_timestamp(created_epoch * 1000000), '%A, %d %B') || '.' AS spoken FROM found JOIN notes USING (note_id) WHERE rank = 1")
def a07(spark, sf_dir):
    top = notes(spark, sf_dir).join(rt.fitting(found(spark, sf_dir).where("rank = 1")), "note_id")
    return top.select("query_id", F.concat(F.lit("You mentioned that on "), F.date_format(F.timestamp_seconds("created_epoch"), "EEEE, dd MMMM"), F.lit(".")).alias("spoken"))


@query("a08_digest_notes", f"WITH {SEARCH_SQL}, d AS (SELECT query_id, rank, ({SENTENCES_SQL.format('raw_transcript')})[1] AS first FROM found JOIN notes USING (note_id) WHERE rank <= 3) SELECT query_id, string_agg(first, ' ' ORDER BY rank) AS digest FROM d WHERE first IS NOT NULL GROUP BY ALL")
def a08(spark, sf_dir):
    return rt.digest(found(spark, sf_dir), notes(spark, sf_dir))


@query("a12_answer_queries", f"WITH {ANSWER_SQL}, c AS (SELECT query_id, {r6('least(1.0::DOUBLE, max(score) + 0.05::DOUBLE * least(count(*) - 1, 2))', 3)} AS confidence FROM found GROUP BY ALL) SELECT query_id, answer IS NOT NULL AS ok, CASE WHEN answer IS NULL THEN 'empty' ELSE 'extractive' END AS method, coalesce(confidence, 0) AS confidence FROM queries LEFT JOIN answers USING (query_id) LEFT JOIN c USING (query_id)")
def a12(spark, sf_dir):
    hits = found(spark, sf_dir)
    out = questions(spark, sf_dir).select("query_id").join(rt.extractive_answers(questions(spark, sf_dir), hits, notes(spark, sf_dir)), "query_id", "left").join(rt.answer_confidence(hits), "query_id", "left")
    return out.select("query_id", F.col("answer").isNotNull().alias("ok"), F.when(F.col("answer").isNull(), "empty").otherwise("extractive").alias("method"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
