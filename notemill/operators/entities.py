"""Note types and entities by rules: people, dates, times, tasks, key phrases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions import fixed
from notemill.functions.text import any_of, let, spans, word_hit

# ---- fixed values: patterns ----
DAYS, MONTHS, TITLES = "|".join(fixed.WEEKDAYS), "|".join(fixed.MONTHS), "|".join(fixed.TITLES)
PERSON_CUES = ["call", "called", "email", "emailed", "message", "text", "ask", "asked", "tell", "told", "meet", "meeting with", "with", "contact", "remind", "thank", "thanks to", "spoke to", "talk to", "talked to", "see"]
NOT_NAMES = [*fixed.WEEKDAYS, *fixed.MONTHS, *fixed.TITLES, *"i the a an also reminder remember note todo today tomorrow yesterday tonight next last then so but and however finally first second third okay ok yes no please let lets need must should will call email submit finish review buy send write read check make take get add important key main topic idea what if maybe".split()]
DATE = "(?i)" + "|".join(
    rf"(?:{p})"
    for p in [
        rf"\b(?:next|this|coming|last|previous)\s+(?:{DAYS})\b",
        rf"\b(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?\b",
        rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?(?:{MONTHS})\b",
        rf"\b(?:{DAYS})\b",
        r"\b(?:today|tomorrow|tonight|yesterday)\b",
        r"\bin\s+(?:a|an|one|two|three|four|five|six|seven|eight|nine|ten|\d+)\s+(?:day|days|week|weeks|month|months|hour|hours)\b",
        r"\b(?:end\s+of\s+(?:the\s+)?(?:day|week|month))\b",
        r"\b\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\b",
        r"\b\d{4}-\d{2}-\d{2}\b",
        r"\bthe\s+\d{1,2}(?:st|nd|rd|th)\b",
    ]
)
MERIDIEM = r"(?:a\.?m\.?|p\.?m\.?)"
TIME = rf"(?i)(?:\b\d{{1,2}}[:.]\d{{2}}\s*{MERIDIEM}\b)|(?:\b\d{{1,2}}:\d{{2}}\b)|(?:\b\d{{1,2}}\s*{MERIDIEM}\b)|(?:\b\d{{1,2}}\s*o'?clock\b)"
TASK_CUES = ["i need to", "i have to", "i must", "i should", "i want to", "remind me to", "remember to", "don't forget to", "do not forget to", "make sure to", "i'll", "i will", "todo", "to do", "action item", "follow up"]
TASK_VERBS = "call|email|submit|send|finish|complete|review|buy|write|read|check|prepare|schedule|book|pay|fix|update|contact|ask|meet|start|reply|print|order"
LEADS = "also|then|next|finally|first|second|secondly|third|thirdly|lastly|additionally|besides|afterwards|later"
TASK_CUE = rf"(?i:{'|'.join(TASK_CUES)})\s+([^\n]{{3,120}}?)(?=[.!?;]|$)"
IMPERATIVE = rf"(?:^|[.!?]\s+|\band\s+)(?:(?i:{LEADS})\s*,?\s+)?((?i:{TASK_VERBS})\s+[^\n]{{3,120}}?)(?=[.!?;]|$)"
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten".split())} | {"a": 1, "an": 1}
KEY_HEADS = "key|the|about|regarding|idea|main|important|focus"
KEY_CUES = r"(?i:key topic is|the topic is|about|regarding|idea is|main point is|important thing is|focus on)\s+([^\n]{3,60}?)(?=[.!?,;]|$)"


def led(words: list[str] | str, pattern: str) -> str:
    """A pattern whose matches start with one of ``words``: their first letters are looked at before anything else is tried."""
    heads = {w[0] for w in (words.split("|") if isinstance(words, str) else words)}
    return "(?=[" + "".join(sorted(heads | {c.upper() for c in heads})) + "])" + pattern


#: The same matches as ``DATE`` and ``TIME``, which SQL shares: what all their forms begin with is asked once.
DATE_AT = r"(?i)\b(?:" + DATE.removeprefix("(?i)").replace(r"(?:\b", "(?:") + ")"
TIME_AT = rf"(?=\d)(?:{TIME})"


def cue_scores(body: Column) -> Column:
    """Struct of the score and the hits of each note type; each phrase counts once."""
    low = F.lower(body)
    out = []
    for kind, cues in fixed.CUES.items():
        hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)) & low.rlike(word_hit(p)), F.struct(F.lit(p).alias("phrase"), F.lit(w).alias("weight"))) for p, w in cues.items()]))
        out.append(hits.alias(kind))
    return F.struct(*out)


def classify(notes: DataFrame, body: str = "raw_transcript", tasks: Column | None = None, deadlines: Column | None = None) -> DataFrame:
    """``note_id, note_type, confidence, hits, scores``; ties go to todo, then brainstorm, then academic."""
    t, d = tasks if tasks is not None else F.lit(0), deadlines if deadlines is not None else F.lit(0)
    bonus = fixed.TASK_WEIGHT * F.least(t, F.lit(fixed.MOST_COUNTED)) + fixed.DEADLINE_WEIGHT * F.least(d, F.lit(fixed.MOST_COUNTED))
    rows = notes.select("note_id", cue_scores(F.col(body)).alias("c"), bonus.cast("double").alias("bonus"))
    total = lambda k: F.aggregate(F.col(f"c.{k}"), F.lit(0.0), lambda s, x: s + x["weight"])
    rows = rows.select("note_id", "c", (total("todo") + F.col("bonus")).alias("todo"), total("brainstorm").alias("brainstorm"), total("academic").alias("academic"))
    most, whole = F.greatest("todo", "brainstorm", "academic"), F.col("todo") + F.col("brainstorm") + F.col("academic")
    winner = F.when(whole <= 0, "academic").when(F.col("todo") == most, "todo").when(F.col("brainstorm") == most, "brainstorm").otherwise("academic")
    confidence = F.when(whole <= 0, 0.2).otherwise(F.floor(most / whole * F.least(F.lit(1.0), whole / fixed.SATURATION) * 1000 + 0.5) / 1000)
    hits = F.slice(F.transform(F.when(winner == "todo", F.col("c.todo")).when(winner == "brainstorm", F.col("c.brainstorm")).otherwise(F.col("c.academic")), lambda x: x["phrase"]), 1, 4)
    return rows.select("note_id", winner.alias("note_type"), confidence.alias("confidence"), hits.alias("hits"), "todo", "brainstorm", "academic")


def needs_review(confidence: Column, least: float = 0.55) -> Column:
    return confidence < least


def exploded(notes: DataFrame, found: Column) -> DataFrame:
    return notes.select("note_id", F.explode(found).alias("x")).select("note_id", "x.start", "x.end", "x.value")


def best_by_name(rows: DataFrame, kind: str) -> DataFrame:
    """The most confident mention of each lower-case value of a note, the first on a tie."""
    order = Window.partitionBy("note_id", F.lower("value")).orderBy(F.desc("confidence"), "tier", "start")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("note_id", F.lit(kind).alias("kind"), "value", F.col("value").alias("normalized"), "confidence", "start", "end")


def people(notes: DataFrame, body: str = "raw_transcript") -> DataFrame:
    """Names after a title (.90), after a cue (.75), or capitalised inside a sentence (.45)."""
    text = F.col(body)
    titled = exploded(notes, spans(text, r"\b" + led(TITLES, rf"(?i:{TITLES})\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"), 1)).select("*", F.lit(0.90).alias("confidence"), F.lit(0).alias("tier"))
    cued = exploded(notes, spans(text, r"\b" + led(PERSON_CUES, rf"(?i:{'|'.join(PERSON_CUES)})\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"), 1)).select("*", F.lit(0.75).alias("confidence"), F.lit(1).alias("tier"))
    bare = exploded(notes, spans(text, r"(?=[A-Z])(?<!^)(?<![.!?]\s)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b")).select("*", F.lit(0.45).alias("confidence"), F.lit(2).alias("tier"))
    rows = titled.unionByName(cued).unionByName(bare)
    title = rf"^(?i:{TITLES})\.?\s+"
    rows = rows.withColumn("start", F.col("start") + F.length(F.regexp_extract("value", title, 0))).withColumn("value", F.regexp_replace("value", title, ""))
    parts = F.split("value", r"\s+")
    return best_by_name(rows.where(F.forall(parts, lambda p: (F.length(p) > 1) & ~F.lower(p).isin(NOT_NAMES))), "person")


def iso_date(value: Column, epoch: Column) -> Column:
    """A spoken date against the day of ``epoch`` (seconds), future-leaning; null if no rule fits."""
    day = F.to_date(F.timestamp_seconds(epoch))
    low = F.lower(F.trim(value))
    bare = F.regexp_replace(low, r"^(?:next|this|coming)\s+", "")
    out = F.when(low.isin("today", "tonight"), day).when(low == "tomorrow", F.date_add(day, 1)).when(low == "yesterday", F.date_sub(day, 1))
    for name in fixed.WEEKDAYS:
        out = out.when(bare == name, F.next_day(day, name[:3]))
    amount = F.regexp_extract(low, r"^in\s+(\w+)\s+(day|week|month)", 1)
    number = F.coalesce(amount.try_cast("int"), F.try_element_at(F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv]), amount))
    unit = F.regexp_extract(low, r"^in\s+\w+\s+(day|week|month)", 1)
    out = out.when(unit == "day", F.date_add(day, number)).when(unit == "week", F.date_add(day, number * 7)).when(unit == "month", F.add_months(day, number))
    out = out.when(low.rlike(r"^end\s+of\s+(?:the\s+)?month"), F.last_day(day)).when(low.rlike(r"^end\s+of\s+(?:the\s+)?day"), day)
    month = F.regexp_extract(low, f"({MONTHS})", 1)
    number_of = F.try_element_at(F.create_map(*[x for i, m in enumerate(fixed.MONTHS) for x in (F.lit(m), F.lit(i + 1))]), month)
    dom = F.regexp_extract(low, r"(\d{1,2})", 1).try_cast("int")
    this = F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(day), number_of, dom))
    out = out.when(month != "", F.when(this < day, F.add_months(this, 12)).otherwise(this))
    return F.date_format(F.coalesce(out, F.try_to_date(low, "yyyy-MM-dd")), "yyyy-MM-dd")


def dates(notes: DataFrame, body: str = "raw_transcript", epoch: str = "created_epoch") -> DataFrame:
    """Date expressions; those with a due cue in the 30 characters before are deadlines."""
    found = notes.select("note_id", F.col(body).alias("t"), F.col(epoch).alias("e"), F.explode(spans(F.col(body), DATE_AT)).alias("x")).select("note_id", "t", "e", "x.*")
    before = F.lower(F.substring("t", F.greatest(F.col("start") - 30, F.lit(0)) + 1, F.least(F.col("start"), F.lit(30))))
    cue = F.lit(False)
    for c in fixed.DEADLINE_CUES:
        cue = cue | F.contains(before, F.lit(c))
    normal = iso_date(F.col("value"), F.col("e"))
    return found.select("note_id", F.when(cue, "deadline").otherwise("date").alias("kind"), F.trim("value").alias("value"), normal.alias("normalized"), F.when(normal.isNull(), 0.5).otherwise(0.85).alias("confidence"), "start", "end")


def clock(value: Column) -> Column:
    """HH:MM:SS of a spoken time; null when it is none."""
    low = F.lower(value)
    pm = rf"\b(\d{{1,2}})(?:[:.](\d{{2}}))?\s*({MERIDIEM})"
    hour, minute = F.regexp_extract(low, pm, 1).try_cast("int"), F.coalesce(F.regexp_extract(low, pm, 2).try_cast("int"), F.lit(0))
    half = F.replace(F.regexp_extract(low, pm, 3), F.lit("."), F.lit(""))
    full = F.when((half == "pm") & (hour != 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    h24, m24 = F.regexp_extract(low, r"\b(\d{1,2}):(\d{2})\b", 1).try_cast("int"), F.regexp_extract(low, r"\b(\d{1,2}):(\d{2})\b", 2).try_cast("int")
    oclock = F.regexp_extract(low, r"\b(\d{1,2})\s*o'?clock\b", 1).try_cast("int")
    put = lambda h, m: F.format_string("%02d:%02d:00", h, m)
    return F.when(half != "", F.when(hour.between(1, 12) & (minute < 60), put(full, minute))).when(oclock.isNotNull(), F.when(oclock.between(1, 12), put(oclock, F.lit(0)))).when(h24.between(0, 23) & (m24 < 60), put(h24, m24))


def time_is_ambiguous(value: Column) -> Column:
    """An hour of 1 to 12 without am or pm."""
    low = F.lower(value)
    hour = F.regexp_extract(low, r"\b(\d{1,2})(?:\s*o'?clock\b|:\d{2}\b)", 1).try_cast("int")
    return ~low.rlike(rf"\b\d{{1,2}}(?:[:.]\d{{2}})?\s*{MERIDIEM}") & F.coalesce(hour.between(1, 12), F.lit(False))


def times(notes: DataFrame, body: str = "raw_transcript") -> DataFrame:
    rows = exploded(notes, spans(F.col(body), TIME_AT))
    normal = clock(F.col("value"))
    return rows.select("note_id", F.lit("time").alias("kind"), F.trim("value").alias("value"), normal.alias("normalized"), F.when(normal.isNull(), 0.5).otherwise(0.85).alias("confidence"), "start", "end")


def tasks(notes: DataFrame, body: str = "raw_transcript") -> DataFrame:
    """Commitments after a cue (.85) or as a bare imperative (.60), at least two words."""
    text = F.col(body)
    rows = exploded(notes, spans(text, led(TASK_CUES, TASK_CUE), 1)).select("*", F.lit(0.85).alias("confidence"), F.lit(0).alias("tier"))
    rows = rows.unionByName(exploded(notes, spans(text, IMPERATIVE, 1)).select("*", F.lit(0.60).alias("confidence"), F.lit(1).alias("tier")))
    bare = F.regexp_replace(F.btrim(F.trim("value"), F.lit(" ,;:")), r"^(?i:to|that|the)\s+", "")
    rows = rows.withColumn("value", F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 2**31 - 1))).where(F.size(F.split("value", r"\s+")) >= 2)
    return best_by_name(rows, "task")


def key_phrases(notes: DataFrame, body: str = "raw_transcript", limit: int = 10) -> DataFrame:
    """Phrases after a cue (.85) and runs of two or more content words."""
    text = F.col(body)
    cued = exploded(notes, spans(text, led(KEY_HEADS, KEY_CUES), 1)).select("*", F.lit(0.85).alias("confidence"), F.lit(0).alias("tier"))
    by_head = {w[0]: [x[1:] for x in fixed.QUALITY_STOPWORDS if x[0] == w[0]] for w in fixed.QUALITY_STOPWORDS}
    stop = "|".join(f"{re.escape(c)}(?:{any_of(rest)})" for c, rest in by_head.items())
    word = rf"(?!(?i:{stop})(?![A-Za-z'-]))[A-Za-z'-]{{3,}}+"  # possessive: no recursion on long runs
    runs = exploded(notes, spans(text, rf"(?=[A-Za-z'-])(?<![A-Za-z'-]){word}(?:\s++{word})++")).select("*", (0.45 + 0.1 * F.least(F.size(F.split("value", r"\s+")), F.lit(3))).alias("confidence"), F.lit(1).alias("tier"))
    rows = cued.unionByName(runs).withColumn("value", F.lower(F.btrim("value", F.lit(" ,.;:")))).withColumn("n", F.size(F.split("value", r"\s+"))).where("n BETWEEN 1 AND 4").drop("n")
    order = Window.partitionBy("note_id").orderBy(F.desc("confidence"), "start", "value")
    best = best_by_name(rows, "key_phrase")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place")


def drop_overlaps(phrases: DataFrame, claimed: DataFrame) -> DataFrame:
    c = claimed.select("note_id", F.col("start").alias("cs"), F.col("end").alias("ce"))
    p = phrases.alias("p")
    return p.join(c.alias("c"), (F.col("p.note_id") == F.col("c.note_id")) & (F.col("p.start") < F.col("ce")) & (F.col("p.end") > F.col("cs")), "left_anti")


def extract_all(notes: DataFrame, body: str = "raw_transcript") -> DataFrame:
    """All entities of each note, one per kind and lower-case normal form."""
    found = people(notes, body).unionByName(dates(notes, body)).unionByName(times(notes, body))
    phrases = drop_overlaps(key_phrases(notes, body, 20), found)
    return dedupe(found.unionByName(tasks(notes, body)).unionByName(phrases).withColumn("origin", F.lit(0))).drop("origin")


def dedupe(rows: DataFrame) -> DataFrame:
    """Highest confidence of each (note, kind, lower normal form); the lower ``origin`` wins ties."""
    order = Window.partitionBy("note_id", "kind", F.lower(F.coalesce("normalized", "value"))).orderBy(F.desc("confidence"), "origin", "start", "value")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def extraction_is_weak(entities: DataFrame, least: float = 0.5) -> DataFrame:
    solid = F.col("kind").isin("person", "date", "deadline", "task")
    return entities.groupBy("note_id").agg((F.coalesce(F.max(F.when(solid, F.col("confidence"))), F.lit(0.0)) < least).alias("weak"))


def by_kind(entities: DataFrame) -> DataFrame:
    kinds = ["person", "date", "deadline", "time", "task", "key_phrase"]
    return entities.groupBy("note_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(k) for k in kinds])


def email_phone(body: Column) -> tuple[Column, Column]:
    pick = lambda p: F.nullif(F.regexp_extract(body, p, 0), F.lit(""))
    return pick(fixed.EMAIL), pick(fixed.PHONE)


def event_mention(body: Column) -> Column:
    word = F.regexp_extract(body, rf"(?i)\b(?:i\s+have(?:\s+got)?|i['’]ve\s+got|i\s+got|there(?:['’]s|\s+is)|my)\s+(?:a|an|the)?\s*({'|'.join(fixed.EVENTS)})\b", 1)
    return F.when(word != "", F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 100))))


def explicit_placement(body: Column) -> Column:
    """The place that a note asks for at its end, as spoken; null without one. The first pattern that matches counts."""
    said = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")
    names = [F.nullif(F.btrim(F.regexp_extract(said, p.replace("(?i)", "(?id)"), 1), F.lit(" .!")), F.lit("")) for p in fixed.EXPLICIT_PLACEMENTS]
    return F.coalesce(*names)


def first_sentences(body: Column, most_words: int = 36) -> Column:
    """Struct of definition, example and summary of a note, taken from its sentences."""
    from notemill.functions.text import sentences

    def cue(words: list[str]) -> str:
        return rf"(?i)\b(?:{any_of(words)})\b"

    def first(s: Column, words: list[str], skip: Column) -> Column:
        return F.array_position(F.transform(s, lambda x, i: x.rlike(cue(words)) & (i + 1 != skip)), F.lit(True)).cast("int")

    def rest(s: Column, d: Column, e: Column) -> Column:
        left = F.filter(s, lambda x, i: (i + 1 != d) & (i + 1 != e))
        source = let(left, lambda x: F.when(F.size(x) > 0, F.array_join(x, " ")).otherwise(F.trim(body)))
        cut = lambda t: let(F.filter(F.split(t, r"\s+"), lambda w: w != ""), lambda w: F.when(F.size(w) <= most_words, F.trim(t)).otherwise(F.concat(F.array_join(F.slice(w, 1, most_words), " "), F.lit("…"))))
        pick = lambda n: F.when(n > 0, F.get(s, n - 1)).otherwise("")
        return F.struct(pick(d).alias("definition"), pick(e).alias("example"), let(source, cut).alias("summary"))

    def examples(s: Column, d: Column) -> Column:
        found = let(first(s, fixed.STRONG_EXAMPLES, d), lambda n: F.when(n > 0, n).otherwise(first(s, fixed.WEAK_EXAMPLES, d)))
        return let(found, lambda e: rest(s, d, e))

    def of(s: Column) -> Column:
        return let(first(s, fixed.DEFINITION_CUES, F.lit(0)), lambda d: examples(s, d))

    return let(sentences(body), of)


def initial_markdown(definition: Column, example: Column, summary: Column) -> Column:
    """The text that editing starts from: the parts that there are, each with its heading."""
    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"**{n}:** "), c)) for n, c in (("Definition", definition), ("Example", example), ("Summary", summary))]
    return F.array_join(F.array_compact(F.array(*parts)), "\n\n")


def regenerate_content(notes: DataFrame, existing: DataFrame, force: bool = False, body: str = "raw_transcript") -> DataFrame:
    """``note_id, definition, example, summary, method``: content written anew, but not over a model's unless ``force``.

    Blank notes keep what they have.
    """
    held = existing.where(F.col("method") == "llm") if not force else existing.where("false")
    open_ = notes.where(F.trim(F.coalesce(body, F.lit(""))) != "").join(held.select("note_id"), "note_id", "left_anti")
    new = open_.select("note_id", first_sentences(F.col(body)).alias("c")).select("note_id", "c.*", F.lit("extractive").alias("method"))
    kept = existing.join(new.select("note_id"), "note_id", "left_anti").select("note_id", "definition", "example", "summary", "method")
    return kept.unionByName(new)
