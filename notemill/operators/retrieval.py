"""Hybrid retrieval for tables of questions: chunks, filters, vector and keyword scores, fusion.

Questions are a table (``query_id, query``) and are broadcast when they fit; notes are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions import fixed, text
from notemill.functions.text import let
from notemill.operators import metric
from notemill.operators import questions as qs
from notemill.operators import vectors as vec
from notemill.operators.graphs import cut_lineage

MAX_CHARS, OVERLAP = 900, 120
VECTOR_SHARE, FLOOR, TOP = 0.65, 0.08, 5
MOST_QUERIES = 100_000


def rounded(value: Column, places: int = 6) -> Column:
    return F.floor(value * 10**places + 0.5) / 10**places


def chunks(body: Column, most: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Windows of a text on sentence bounds; each starts with the end of the one before."""
    body = F.btrim(F.coalesce(body, F.lit("")), F.lit(" \t\n\r"))
    pieces = F.filter(F.transform(F.split(body, "[.!?]"), lambda p: F.btrim(p, F.lit(" \t\n\r"))), lambda p: p != "")
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, piece: Column) -> Column:
        longer = F.concat(F.when(s["now"] == "", "").otherwise(F.concat(s["now"], F.lit(" "))), piece, F.lit("."))
        return let(longer, lambda x: F.struct(F.when(F.length(x) >= most, "").otherwise(x).alias("now"), F.when(F.length(x) >= most, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out")))

    whole = F.aggregate(pieces, start, step, lambda s: F.when(s["now"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["now"]))))
    cut = lambda c: F.transform(F.sequence(F.lit(1), F.length(c), F.lit(most - overlap)), lambda i: F.btrim(F.substring(c, i, F.lit(most))))
    parts = F.filter(F.flatten(F.transform(whole, lambda c: F.when(F.length(c) <= most, F.array(c)).otherwise(cut(c)))), lambda c: c != "")
    joined = let(parts, lambda p: F.transform(p, lambda c, i: F.when(i == 0, c).otherwise(F.btrim(F.concat(F.right(F.get(p, i - 1), F.lit(overlap)), F.lit(" "), c)))))
    return F.when(body == "", F.array().cast("array<string>")).when(F.length(body) <= most, F.array(body)).otherwise(joined)


def chunk_index(notes: DataFrame, body: str = "raw_transcript") -> DataFrame:
    """One row per chunk with the columns that searches filter by."""
    cut = notes.withColumn("parts", chunks(F.col(body)))
    rest = [c for c in notes.columns if c != body]
    return cut.select(*rest, F.size("parts").alias("chunk_count"), F.posexplode("parts").alias("chunk_index", "document")).withColumn("chunk_id", F.concat_ws("::", "note_id", "chunk_index"))


def query_keywords(query: Column) -> Column:
    return F.array_distinct(F.filter(text.match_tokens(query), lambda t: (F.length(t) > 2) & ~t.isin(fixed.QUERY_STOPWORDS)))


def fitting(queries: DataFrame) -> DataFrame:
    """Broadcast when counted to be few."""
    return vec.fitting(queries, MOST_QUERIES)


ANY = "\u0000"


def filtered(queries: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes that pass each query's filters, with the query's columns: null means no limit, both ends of the time are inside.

    A query has a key for each subject, topic and type it allows, or one for any; a note has those of its own and of any, so
    they meet by key. Without any filter each note is a result of the query.
    """
    one = lambda names: F.explode(F.when(F.col(names).isNull(), F.array(F.lit(ANY))).otherwise(F.array_distinct(names)))
    own = lambda c: F.explode(F.array_distinct(F.array(F.coalesce(c, F.lit("")), F.lit(ANY))))
    asked = queries.withColumn("f1", one("subjects")).withColumn("f2", one("topics")).withColumn("f3", one("note_types"))
    held = notes.withColumn("k1", own("source")).withColumn("k2", own("topic_name")).withColumn("k3", own("note_type"))
    within = (F.col("after").isNull() | (F.col("created_epoch") >= F.col("after"))) & (F.col("before").isNull() | (F.col("created_epoch") <= F.col("before")))
    both = held.join(fitting(asked), (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")) & (F.col("k3") == F.col("f3"))).where(within)
    return both.drop("f1", "f2", "f3", "k1", "k2", "k3")


def newest_notes(notes: DataFrame, most: int | None) -> DataFrame:
    """The ``most`` newest notes, the smaller id first on a tie; all where that is None."""
    return notes if most is None else notes.orderBy(F.desc("created_epoch"), "note_id").limit(most)


def lexical_scores(queries: DataFrame, notes: DataFrame, body: str = "raw_transcript", newest: int | None = None) -> DataFrame:
    """Share of a query's keywords that occur in the note, inside words too; notes with none are left out.

    With ``newest`` only so many notes are looked at, the newest ones, as a search within a fixed time does.
    """
    return qs.pair_scores(queries, newest_notes(notes, newest), body, vectors=False).drop("vector")


def pair_scores(queries: DataFrame, notes: DataFrame, body: str = "raw_transcript") -> DataFrame:
    """``query_id, note_id, lexical, vector``: also the cosine of hashed vectors; null for pairs without a common bucket.

    Vector matches without a shared keyword are hash collisions and have no row.
    """
    return qs.pair_scores(queries, notes, body)


def vector_topk(queries: DataFrame, notes: DataFrame, k: int, body: str = "raw_transcript") -> DataFrame:
    """``query_id, note_id, vector, rank``: the notes nearest to each query, of all notes."""
    found = qs.best_pairs(queries, notes, body, k, 0.0, lambda lexical, vector: vector, guarded=False)
    return vec.top_k(found, "query_id", "note_id", k, "vector").select("query_id", "note_id", "vector", "rank")


def best_chunks(queries: DataFrame, notes: DataFrame, body: str = "raw_transcript") -> DataFrame:
    """``query_id, note_id, chunk_id, lexical``: the chunk of each note with the largest share of a query's keywords."""
    found = qs.best_parts(queries, qs.dealt(notes.select("note_id", body)).select("note_id", chunks(F.col(body)).alias("parts")))
    return found.select("query_id", "note_id", F.concat_ws("::", "note_id", "part").alias("chunk_id"), "lexical")


def fuse(scored: DataFrame, share: float = VECTOR_SHARE) -> DataFrame:
    """``vector, lexical`` of pairs in one score, and which of them is there."""
    v, x = F.coalesce("vector", F.lit(0.0)), F.coalesce("lexical", F.lit(0.0))
    by = F.array_compact(F.array(F.when(F.col("vector").isNotNull(), "vector"), F.when(F.col("lexical").isNotNull(), "keyword")))
    return scored.select("query_id", "note_id", v.alias("vector"), x.alias("lexical"), rounded(share * v + (1 - share) * x).alias("score"), by.alias("matched_by"))


def best(fused: DataFrame, floor: float = FLOOR, k: int = TOP) -> DataFrame:
    return vec.top_k(fused.where(F.col("score") >= floor), "query_id", "note_id", k)


def hybrid_search(queries: DataFrame, notes: DataFrame, body: str = "raw_transcript", k: int = TOP, newest: int | None = None) -> DataFrame:
    """``query_id, note_id, vector, lexical, score, matched_by, rank``.

    Vector matches without a shared keyword are hash collisions and drop out; notes found by keyword alone stay. Each task keeps the
    ``k`` best of its notes for a query. Only the ``newest`` notes are searched, all where that is None.
    """
    score = lambda lexical, vector: qs.rounded(VECTOR_SHARE * vector + (1 - VECTOR_SHARE) * lexical)
    found = qs.best_pairs(queries, newest_notes(notes, newest), body, k, FLOOR, score)
    return cut_lineage(best(fuse(found), k=k))  # read several times


def browse(queries: DataFrame, notes: DataFrame, k: int = TOP) -> DataFrame:
    """Newest notes that pass the filters of queries without words."""
    order = Window.partitionBy("query_id").orderBy(F.desc("created_epoch"), "note_id")
    found = filtered(queries, notes)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "note_id", F.lit(1.0).alias("score"), "rank")


def dense_search(queries: DataFrame, index: DataFrame, k: int = TOP, vector: str = "embedding", exact: bool = True, probes: int = 8) -> DataFrame:
    """``query_id, vec_id, score, rank``: nearest rows of an index of dense vectors.

    Without ``exact`` only the ``probes`` lists nearest to a query are searched.
    """
    found = metric.InvertedFile(index, "vec_id", vector).search(queries.select("query_id", F.col(vector).alias("vector")), k, probes, exact)
    return found.withColumnRenamed("key", "vec_id")


# ---- answers ----


def answer_confidence(found: DataFrame) -> DataFrame:
    """Best score, and 0.05 for each of up to two more notes."""
    return found.groupBy("query_id").agg(F.max("score").alias("top"), F.count("*").alias("n")).select("query_id", rounded(F.least(F.lit(1.0), F.col("top") + 0.05 * F.least(F.col("n") - 1, F.lit(2))), 3).alias("confidence"))


def citations(found: DataFrame, notes: DataFrame) -> DataFrame:
    at = F.date_format(F.timestamp_seconds("created_epoch"), "yyyy-MM-dd")
    return notes.join(fitting(found), "note_id").select("query_id", F.col("rank").alias("index"), "note_id", F.concat(F.col("topic_name"), F.lit(", under "), F.col("source")).alias("location"), at.alias("created"))


def extractive_answers(queries: DataFrame, found: DataFrame, notes: DataFrame, most_words: int = 45, body: str = "raw_transcript") -> DataFrame:
    """Sentences of the found notes that share most keywords with the question, best first up to a number of words.

    Questions whose notes share none get the first sentence of the best note.
    """
    terms = queries.select("query_id", query_keywords(F.col("query")).alias("terms"))
    texts = cut_lineage(notes.select("note_id", body).join(fitting(found), "note_id").select("query_id", "rank", body).repartition("query_id"))  # read twice
    said = texts.join(fitting(terms), "query_id").select("query_id", "rank", "terms", F.posexplode(text.sentences(F.col(body))).alias("pos", "sentence"))
    of = lambda words: F.when(F.size("terms") == 0, 1.0).when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_intersect("terms", words)) / F.size("terms"))
    share = let(query_keywords(F.col("sentence")), of)
    scored = said.withColumn("score", rounded(share)).withColumn("n", F.size(F.split(F.trim("sentence"), r"\s+")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "pos")
    running = scored.where("score > 0").withColumn("place", F.row_number().over(order)).withColumn("used", F.sum("n").over(order))
    over = F.max(((F.col("used") > most_words) & (F.col("place") > 1)).cast("int")).over(order)
    picked = running.withColumn("over", over).where("over = 0")
    out = picked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "sentence"))).alias("s"), F.array_sort(F.collect_set("rank")).alias("notes"))
    cited = F.array_join(F.transform("notes", lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), " ")
    best_ = out.select("query_id", F.concat_ws(" ", F.array_join(F.transform("s", lambda x: x["sentence"]), " "), cited).alias("answer"))
    first = said.where("rank = 1 AND pos = 0").select("query_id", F.concat(F.col("sentence"), F.lit(" [1]")).alias("first"))
    return queries.select("query_id").join(best_, "query_id", "left").join(first, "query_id", "left").where("answer IS NOT NULL OR first IS NOT NULL").select("query_id", F.coalesce("answer", "first").alias("answer"))


def context(found: DataFrame, notes: DataFrame, most: int = 6000, body: str = "raw_transcript") -> DataFrame:
    """Numbered entries of the found notes within a number of characters; the last one is cut."""
    cited = citations(found, notes)
    entries = notes.select("note_id", body).join(fitting(found), "note_id").join(cited, ["query_id", "note_id"])
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.col("location"), F.lit(", "), F.col("created"), F.lit(") "))
    entries = entries.select("query_id", "rank", head.alias("head"), F.trim(body).alias("body")).withColumn("size", F.length("head") + F.length("body"))
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    left = entries.withColumn("left", most - F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("left") > 0)
    body_ = F.when(F.length("body") > F.col("left"), F.concat(F.rtrim(F.expr("left(body, cast(`left` AS int))")), F.lit("..."))).otherwise(F.col("body"))
    return left.select("query_id", "rank", F.concat("head", body_).alias("entry"))


def empty_answer(query: Column, scope: Column) -> Column:
    """What is said when nothing was found; a question of more than six words is not read back."""
    short = F.when(F.size(F.filter(F.split(F.coalesce(query, F.lit("")), r"\s+"), lambda w: w != "")) > 6, "").otherwise(F.coalesce(query, F.lit("")))
    scope = F.coalesce(scope, F.lit(""))
    about = F.when(short != "", F.concat(F.lit(" about "), short)).otherwise("")
    inside = F.when(scope != "", F.concat(F.lit(" in "), scope)).otherwise("")
    return F.when((short == "") & (scope == ""), "I don't have any notes matching that.").otherwise(F.concat(F.lit("I don't have any notes"), about, inside, F.lit(".")))


def to_spoken(answer: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(answer, r"\s*\[\d+\]", ""), r"\s+", " "))


def digest(found: DataFrame, notes: DataFrame, body: str = "raw_transcript") -> DataFrame:
    """First sentences of the three best notes."""
    texts = notes.select("note_id", body).join(fitting(found.where("rank <= 3")), "note_id")
    said = texts.select("query_id", "rank", F.get(text.sentences(F.col(body)), F.lit(0)).alias("first")).where("first IS NOT NULL")
    return said.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "first"))), lambda x: x["first"]), " ").alias("digest"))
