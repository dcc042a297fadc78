"""Where notes belong: names for new topics, placement, moves, re-clustering, summaries of a time range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions import fixed
from notemill.functions.text import let, title_case
from notemill.operators import entities as en
from notemill.operators import filing
from notemill.operators import library as lb
from notemill.operators import vectors as vec

PROFILE_NOTES, NAME_WORDS, RANGE_WORDS = 30, 4, 80
#: How sure a new name is, by how it was found.
NAME_CONFIDENCE = {"lnt-theme": 0.55, "lnt-lda": 0.55, "key-phrase": 0.5, "heuristic": 0.3}
UNFILED = "Unfiled"


def word_list(said: Column) -> Column:
    return F.filter(F.split(F.trim(said), r"\s+"), lambda w: w != "")


def topic_profiles(topics: DataFrame, notes: DataFrame, most: int = PROFILE_NOTES, body: str = "raw_transcript") -> DataFrame:
    """``source, topic_name, profile``: a topic's name, its summary and the texts of its newest notes.

    ``topics`` has ``source, topic_name`` and may have ``summary``; a topic without notes has its name only.
    """
    order = Window.partitionBy("source", "topic_name").orderBy(F.desc("created_epoch"), F.desc("note_id"))
    said = notes.where(F.trim(F.coalesce(body, F.lit(""))) != "").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    texts = said.groupBy("source", "topic_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(body).alias("t")))), lambda x: x["t"]).alias("texts"))
    summary = F.coalesce(F.col("summary"), F.lit("")) if "summary" in topics.columns else F.lit("")
    parts = F.concat(F.array("topic_name", summary), F.coalesce("texts", F.array().cast("array<string>")))
    return topics.join(texts, ["source", "topic_name"], "left").select("source", "topic_name", F.array_join(F.filter(parts, lambda p: p != ""), ". ").alias("profile"))


def tidy_name(phrase: Column) -> Column:
    """Title case without container words at the end; one word always stays."""
    words = word_list(phrase)
    last = lambda w: F.greatest(F.array_max(F.transform(w, lambda x, i: F.when(F.lower(x).isin(fixed.CONTAINER_WORDS), 0).otherwise(i + 1))), F.lit(1))
    return let(words, lambda w: title_case(F.array_join(F.slice(w, F.lit(1), last(w)), " ")))


def name_from_key_phrases(phrases: DataFrame) -> DataFrame:
    """``note_id, name``: a note's best phrase of one to four words as a heading.

    Phrases with a word of action lose 0.15, those of two words gain 0.05; of equal ones the earliest counts.
    """
    words = word_list(F.lower("value"))
    score = F.col("confidence") - F.when(F.exists(words, lambda w: w.isin(fixed.ACTION_WORDS)), 0.15).otherwise(0.0) + F.when(F.size(words) == 2, 0.05).otherwise(0.0)
    rows = phrases.where(F.size(words).between(1, 4)).withColumn("points", F.round(score, 6))
    best = rows.groupBy("note_id").agg(F.max(F.struct("points", (-F.coalesce("start", F.lit(10**6))).alias("early"), F.trim("value").alias("value"))).alias("x"))
    return best.select("note_id", tidy_name(F.col("x.value")).alias("name"))


def propose_names(notes: DataFrame, phrases: DataFrame, themes: DataFrame | None = None, labels: DataFrame | None = None, body: str = "raw_transcript") -> DataFrame:
    """``note_id, name, method``: the heaviest theme, else a topic model's label, else a key phrase, else the first words.

    ``themes`` has ``note_id, theme, weight``, ``labels`` has ``note_id, label``; both may be missing.
    """
    rows = notes.select("note_id", F.col(body).alias("t")).join(name_from_key_phrases(phrases).withColumnRenamed("name", "phrase"), "note_id", "left")
    if themes is not None:
        rows = rows.join(themes.groupBy("note_id").agg(F.max_by("theme", F.struct("weight", "theme")).alias("theme")), "note_id", "left")
    if labels is not None:
        rows = rows.join(labels.groupBy("note_id").agg(F.min("label").alias("label")), "note_id", "left")
    theme = F.nullif("theme", F.lit("")) if themes is not None else F.lit(None).cast("string")
    label = F.nullif("label", F.lit("")) if labels is not None else F.lit(None).cast("string")
    first = let(word_list(F.coalesce("t", F.lit(""))), lambda w: F.rtrim(F.array_join(F.slice(w, 1, NAME_WORDS), " "), F.lit(".")))
    heading = title_case(F.coalesce(F.nullif(first, F.lit("")), F.lit("New Topic")))
    method = F.when(theme.isNotNull(), "lnt-theme").when(label.isNotNull(), "lnt-lda").when(F.col("phrase").isNotNull(), "key-phrase").otherwise("heuristic")
    return rows.select("note_id", F.coalesce(theme, label, "phrase", heading).alias("name"), method.alias("method"))


def embedded(rows: DataFrame, key: str, body: str) -> DataFrame:
    """``key, embedding`` of hashed words; rows without a word have none."""
    return vec.densify(vec.embed_sparse(rows, key, body), key)


def placements(names: DataFrame, topics: DataFrame) -> DataFrame:
    """``name, source, topic_name, created_topic`` of each spoken place: a topic, else a subject's default topic, else a new one.

    ``topics`` has the existing ``source, topic_name``. A name of topics in several subjects means the first of them.
    """
    first = topics.groupBy(F.col("topic_name").alias("found")).agg(F.min("source").alias("source"))
    as_topic = filing.lookup_names(names, topics.select(F.col("topic_name").alias("name"))).join(first, "found", "left").select("name", F.col("found").alias("topic"), F.col("source").alias("topic_source"))
    as_subject = filing.lookup_names(names, topics.select(F.col("source").alias("name")).distinct()).withColumnRenamed("found", "subject")
    general = topics.where(F.lower("topic_name") == fixed.DEFAULT_SUBJECT.lower()).select(F.col("source").alias("subject"), F.lit(True).alias("has_general")).distinct()
    both = as_topic.join(as_subject, "name").join(general, "subject", "left")
    new = title_case(F.trim("name"))
    source = F.coalesce("topic_source", "subject", new)
    topic = F.coalesce(F.col("topic"), F.when(F.col("subject").isNotNull(), F.lit(fixed.DEFAULT_SUBJECT)), new)
    return both.select("name", source.alias("source"), topic.alias("topic_name"), (F.col("topic").isNull() & ~F.coalesce("has_general", F.lit(False))).alias("created_topic"))


def organize_notes(notes: DataFrame, library: DataFrame, body: str = "raw_transcript", topic_cutoff: float = fixed.TOPIC_CUTOFF, subject_cutoff: float = fixed.SUBJECT_CUTOFF) -> DataFrame:
    """``note_id, source, topic_name, confidence, method`` for new notes against a library of filed ones.

    Blank notes are unfiled; a note that names its place goes there; else it joins the topic whose profile is nearest,
    from ``topic_cutoff`` on; else it gets a topic of its own name, under the nearest subject from ``subject_cutoff`` on
    or the default one. ``library`` has ``note_id, source, topic_name, created_epoch`` and the text.
    """
    rows = notes.select("note_id", F.trim(F.coalesce(body, F.lit(""))).alias("t")).withColumn("place", F.when(F.col("t") != "", en.explicit_placement(F.col("t"))))
    blank = rows.where("t = ''").select("note_id", F.lit(UNFILED).alias("source"), F.lit(UNFILED).alias("topic_name"), F.lit(0.0).alias("confidence"), F.lit("unfiled").alias("method"))
    topics = library.where(F.col("source") != UNFILED).select("source", "topic_name").distinct()
    said = rows.where("place IS NOT NULL")
    told = said.join(placements(said.select(F.col("place").alias("name")), topics).withColumnRenamed("name", "place"), "place").select("note_id", "source", "topic_name", F.lit(1.0).alias("confidence"), F.lit("explicit").alias("method"))
    rest = rows.where("t <> '' AND place IS NULL").select("note_id", "t")
    vectors = embedded(rest, "note_id", "t")
    profiles = topic_profiles(topics, library, body=body).withColumn("candidate", F.struct("source", "topic_name"))
    known = embedded(profiles, "candidate", "profile").withColumnRenamed("embedding", "centroid")
    near = vec.best_candidate(vectors, known, "note_id", topic_cutoff)
    matched = near.select("note_id", "candidate.source", "candidate.topic_name", F.round("score", 3).alias("confidence"), F.lit("embedding").alias("method"))
    open_ = rest.join(near.select("note_id"), "note_id", "left_anti")
    subjects = vec.centroids(known.select(F.col("candidate.source").alias("candidate"), F.col("centroid").alias("embedding")), "candidate")
    home = vec.best_candidate(vectors.join(open_.select("note_id"), "note_id", "left_semi"), subjects, "note_id", subject_cutoff).select("note_id", F.col("candidate").alias("source"))
    names = propose_names(open_, en.key_phrases(open_, "t"), body="t")
    sure = F.element_at(F.create_map(*[F.lit(x) for kv in NAME_CONFIDENCE.items() for x in kv]), F.col("method"))
    named = names.join(home, "note_id", "left").select("note_id", F.coalesce("source", F.lit(fixed.DEFAULT_SUBJECT)).alias("source"), F.col("name").alias("topic_name"), sure.alias("confidence"), "method")
    return blank.unionByName(told).unionByName(matched).unionByName(named)


def move_notes(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """``notes`` with the primary topic of moved ones changed; ``moves`` has ``note_id, target``, a spoken name.

    Of several moves of a note the one with the greatest ``seq`` counts, where there is such a column. Blank targets move nothing.
    """
    order = F.desc("seq") if "seq" in moves.columns else F.desc("target")
    last = moves.where(F.trim(F.coalesce("target", F.lit(""))) != "").withColumn("n", F.row_number().over(Window.partitionBy("note_id").orderBy(order))).where("n = 1")
    found = placements(last.select(F.col("target").alias("name")), notes.select("source", "topic_name").distinct())
    to = last.join(found, F.col("target") == F.col("name")).select("note_id", F.col("source").alias("to_source"), F.col("topic_name").alias("to_topic"))
    out = notes.join(to, "note_id", "left")
    return out.select(*[F.coalesce("to_source", c).alias(c) if c == "source" else F.coalesce("to_topic", c).alias(c) if c == "topic_name" else F.col(c) for c in notes.columns], F.col("to_topic").isNotNull().alias("moved"))


def recluster(points: DataFrame, labels: DataFrame, by: str, key: str, topic: str, names: DataFrame) -> DataFrame:
    """``by, key, topic, created``: clusters of a subject as its topics.

    ``labels`` has ``key, cluster``, -1 for noise, which is a group of its own. A group keeps the topic that most of its
    members have, the first in order on a tie; a group without one gets the name of its representative from ``names``
    (``by, group, name``), where ``group`` is the cluster as text or ``noise-`` and the key.
    """
    group = F.when(F.col("cluster") == -1, F.concat(F.lit("noise-"), F.col(key).cast("string"))).otherwise(F.col("cluster").cast("string"))
    rows = points.select(by, key, topic).join(labels, key).withColumn("group", group)
    votes = rows.where(F.col(topic).isNotNull()).groupBy(by, "group", topic).agg(F.count("*").alias("votes"))
    most = votes.groupBy(by, "group").agg(F.min(F.struct((-F.col("votes")).alias("v"), topic)).alias("x")).select(by, "group", F.col(f"x.{topic}").alias("kept"))
    out = rows.select(by, key, "group").join(most, [by, "group"], "left").join(names, [by, "group"], "left")
    return out.select(by, key, F.coalesce("kept", "name", F.lit("New topic")).alias(topic), F.col("kept").isNull().alias("created"))


def range_rollup(notes: DataFrame, ranges: DataFrame, most: int = RANGE_WORDS, body: str = "raw_transcript") -> DataFrame:
    """``range_id, notes, summary, spoken`` for each of ``range_id, start, end, scope``: notes from start to before end, in a subject or anywhere.

    Null ends are open. The summary is the note nearest to the mean of those in range, cut to ``most`` words. A note
    meets the ranges by day, so nothing is compared with every range; open ends reach to the first and last day of the notes.
    """
    days = notes.agg(F.min(F.floor(F.col("created_epoch") / 86400)).alias("d0"), F.max(F.floor(F.col("created_epoch") / 86400)).alias("d1")).first()
    if days.d0 is None:
        held = notes.select("note_id").withColumn("range_id", F.lit(None).cast(ranges.schema["range_id"].dataType)).where("false")
    else:
        low = F.greatest(F.lit(days.d0), F.floor(F.coalesce(F.col("start") / 86400, F.lit(days.d0))))
        high = F.least(F.lit(days.d1), F.floor(F.coalesce(F.col("end") / 86400, F.lit(days.d1))))
        by_day = ranges.where(low <= high).select("*", F.explode(F.sequence(low, high)).alias("day"))
        inside = (F.col("start").isNull() | (F.col("created_epoch") >= F.col("start"))) & (F.col("end").isNull() | (F.col("created_epoch") < F.col("end"))) & (F.col("scope").isNull() | (F.col("scope") == F.col("source")))
        held = notes.withColumn("day", F.floor(F.col("created_epoch") / 86400)).join(by_day, "day").where(inside).select("range_id", "note_id")
    counts = held.groupBy("range_id").agg(F.count("*").alias("notes"))
    best = lb.group_summaries(notes, "range_id", body, most, held)
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")
    said = F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), F.concat(F.lit("from "), day("start"), F.lit(" to "), day("end"))).when(F.col("start").isNotNull(), F.concat(F.lit("since "), day("start"))).when(F.col("end").isNotNull(), F.concat(F.lit("up to "), day("end"))).otherwise("across all time")
    out = ranges.join(counts, "range_id", "left").join(best.select("range_id", "summary"), "range_id", "left")
    n = F.coalesce("notes", F.lit(0))
    summary = F.when(n == 0, "No notes in that time range.").otherwise(F.coalesce("summary", F.lit("")))
    scope = F.when(F.col("scope").isNotNull(), F.concat("scope", F.lit(", "))).otherwise("")
    spoken = F.concat(scope, said, F.lit(". "), n.cast("string"), F.when(n == 1, " note. ").otherwise(" notes. "), summary)
    return out.select("range_id", n.alias("notes"), summary.alias("summary"), spoken.alias("spoken"))
