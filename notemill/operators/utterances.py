"""What an utterance asks for: intent, slots, note types, time range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notemill.functions import fixed
from notemill.functions.text import as_re2

# ---- fixed values: patterns in the order in which they are tried; group 1 is the slot ----
PATTERNS = {
    "organize": r"(?i)^\s*(?:move|file|put|organi[sz]e)\b.*\b(?:to|under)\b",
    "reminders": r"(?i)\bwhat(?:'s|\s+is)?\s+due\b|\bwhat\s+are\s+my\s+(?:reminders?|deadlines?)\b|\bany(?:thing)?\s+due\b|\bwhat\s+do\s+i\s+have\s+due\b|\bupcoming\s+(?:reminders?|deadlines?|tasks?)\b|\blist\s+(?:my\s+)?reminders?\b",
    "list_subjects": r"(?i)^\s*(?:what|which)\s+subjects?\s+(?:do\s+i\s+have|are\s+there|exist)|^\s*list\s+(?:my\s+)?subjects?|^\s*what\s+are\s+my\s+subjects?",
    "count_notes": r"(?i)^\s*how\s+many\s+notes?\s+(?:are\s+|do\s+i\s+have\s+)?(?:under|in|about)\s+(?:my\s+)?(.+?)\s*\??\s*$",
    "notes_under": r"(?i)^\s*(?:what|which)\s+notes?\s+(?:are\s+|do\s+i\s+have\s+)?under\s+(?:my\s+)?(.+?)(?:\s+(?:topic|project))?\s*\??\s*$",
    "topics_under": r"(?i)^\s*what(?:'s|\s+is|\s+are)?\s+(?:the\s+)?(?:topics?\s+)?under\s+(?:my\s+)?(.+?)(?:\s+(?:subject|topic|project))?\s*\??\s*$",
    "navigate": r"(?i)^\s*(?:take\s+me\s+to|go\s+to|open|navigate\s+to|jump\s+to|show\s+me)\s+(?:my\s+)?(.+?)(?:\s+(?:subject|topic|project|notes?))?\s*[.!?]?\s*$",
    "read_aloud": r"(?i)^\s*(?:please\s+)?(?:read|play|say)\s+(?:me\s+|out\s+|aloud\s+|back\s+)*(?:my\s+|the\s+)?(?:notes?\s+)?(?:(?:on|about|for|regarding)\s+)?(.+?)(?:\s+(?:notes?|aloud|out\s+loud|to\s+me|back))*\s*[.!?]?\s*$",
    "summarize": r"(?i)^\s*(?:summari[sz]e|give\s+me\s+a\s+summary\s+of|sum\s+up)\s+(.+?)\s*[.!?]?\s*$",
    "when": r"(?i)^\s*when\s+(?:did|do|was|were)\s+(?:i\s+)?(?:mention|mentioned|write|wrote|say|said|note|noted|record|recorded|add|added|talk\s+about)?\s*(.+?)\s*\??\s*$",
    "search": r"(?i)^\s*(?:what\s+did\s+i\s+(?:write|say|note|record)|what\s+have\s+i\s+(?:written|said|noted)|find\s+(?:my\s+)?notes?|search\s+(?:my\s+)?notes?|show\s+me\s+(?:my\s+)?notes?|what\s+notes?\s+do\s+i\s+have|do\s+i\s+have\s+(?:any\s+)?notes?|do\s+i\s+have\s+anything|are\s+there\s+(?:any\s+)?notes?|have\s+i\s+(?:got\s+|written\s+|made\s+|taken\s+)?(?:any\s+)?notes?|what\s+(?:ideas?|tasks?|to-?dos?|thoughts?)\s+did\s+i\s+have)\s*(.*?)\s*\??\s*$",
}
NO_SLOT, TARGETS = ("organize", "reminders", "list_subjects"), ("count_notes", "notes_under", "topics_under", "navigate", "read_aloud")
ABOUT = r"(?i)\b(?:about|on|regarding|mentioning)\b"
TIME_WORDS = r"(?i)\s*\b(?:today|yesterday|this\s+week|last\s+week|this\s+month|last\s+month|this\s+year|recently|in\s+the\s+last\s+\d+\s+\w+|last\s+\d+\s+\w+)\b\s*"
CARRIER = r"(?i)^\s*(?:about|on|regarding|concerning|for|of|to\s+do\s+with|related\s+to)\s+"
LEADING = [r"(?i)^(?:my\s+)?notes?\s+(?:about|on|regarding)\s+", r"(?i)^(?:my\s+)?(?:notes?|ideas?|tasks?|thoughts?)\b\s*"]
RELATIVE = r"(?i)\b(?:in\s+the\s+)?(?:last|past|previous)\s+(\d+)\s+(day|week|month)s?\b"
EDGE = " ?.!,"
MOVE = r"(?i)^\s*(?:move|file|put)\s+(?:this(?:\s+note)?|it)?\s*(?:to|under|in)\s+(?:my\s+)?(.+?)\s*[.!?]?\s*$"


def is_kind(kind: str, said: Column) -> Column:
    pattern = as_re2(PATTERNS[kind])
    hit = said.rlike(pattern)
    if kind == "navigate":
        return hit & ~F.regexp_extract(said, pattern, 1).rlike(as_re2(ABOUT))
    if kind == "read_aloud":
        return hit & (F.btrim(F.regexp_extract(said, pattern, 1), F.lit(EDGE)) != "")
    return hit


def classify(said: Column) -> Column:
    """The first pattern that fits; other utterances are questions, blank ones unknown."""
    out = F.when(F.trim(F.coalesce(said, F.lit(""))) == "", "unknown")
    for kind in PATTERNS:
        out = out.when(is_kind(kind, F.trim(said)), kind)
    return out.otherwise("ask")


def slot(said: Column, intent: Column) -> Column:
    out = F.when(intent == "ask", F.trim(said))
    for kind, pattern in PATTERNS.items():
        if kind not in NO_SLOT:
            out = out.when(intent == kind, F.regexp_extract(F.trim(said), as_re2(pattern), 1))
    return F.coalesce(out, F.lit(""))


def clean_query(said: Column) -> Column:
    out = F.regexp_replace(F.trim(F.regexp_replace(said, as_re2(TIME_WORDS), " ")), as_re2(CARRIER), "")
    out = F.btrim(F.regexp_replace(out, as_re2(r"\s+"), " "), F.lit(EDGE))
    for pattern in LEADING:
        out = F.regexp_replace(out, as_re2(pattern), "")
    return F.btrim(out, F.lit(EDGE))


def note_types(said: Column) -> Column:
    low = F.lower(F.coalesce(said, F.lit("")))
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.rlike(as_re2(rf"\b{p}\b")), kind) for p, kind in fixed.TYPE_WORDS.items()])))


def time_phrase(said: Column) -> Column:
    low = F.lower(said)
    out = None
    for phrase, pattern in (("today", r"\btoday\b"), ("yesterday", r"\byesterday\b"), ("this week", r"\bthis\s+week\b"), ("last week", r"\blast\s+week\b"), ("this month", r"\bthis\s+month\b"), ("last month", r"\blast\s+month\b"), ("this year", r"\bthis\s+year\b")):
        out = F.when(low.rlike(as_re2(pattern)), phrase) if out is None else out.when(low.rlike(as_re2(pattern)), phrase)
    return out.when(low.rlike(as_re2(RELATIVE)), F.trim(F.regexp_extract(low, as_re2(RELATIVE), 0))).when(low.rlike(as_re2(r"\brecent(?:ly)?\b")), "recently").otherwise("")


def time_range(said: Column, now: Column) -> tuple[Column, Column]:
    """First and last second of the time an utterance names, from ``now`` in epoch seconds; weeks start on Monday."""
    phrase, low = time_phrase(said), F.lower(said)
    today = now - now % 86400
    week = today - ((F.floor(now / 86400) + 3) % 7) * 86400
    at = F.timestamp_seconds(now)
    month = F.unix_timestamp(F.date_trunc("month", at))
    before_month = F.unix_timestamp(F.date_trunc("month", F.timestamp_seconds(month - 1)))
    year = F.unix_timestamp(F.date_trunc("year", at))
    days = F.regexp_extract(low, as_re2(RELATIVE), 1).try_cast("long") * F.when(F.regexp_extract(low, as_re2(RELATIVE), 2) == "day", 1).when(F.regexp_extract(low, as_re2(RELATIVE), 2) == "week", 7).otherwise(30)
    after = F.when(phrase == "today", today).when(phrase == "yesterday", today - 86400).when(phrase == "this week", week).when(phrase == "last week", week - 7 * 86400).when(phrase == "this month", month).when(phrase == "last month", before_month).when(phrase == "this year", year).when(phrase == "recently", now - 7 * 86400).when(phrase != "", now - days * 86400)
    before = F.when(phrase == "yesterday", today).when(phrase == "last week", week).when(phrase == "last month", month).when(phrase != "", now)
    return after.cast("long"), before.cast("long")


def window_hours(said: Column, now: Column, default: int = 24) -> Column:
    """How far ahead a question about reminders looks."""
    phrase = time_phrase(said)
    after, before = time_range(said, now)
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.WINDOW_HOURS.items() for x in kv]), phrase)
    return F.when(phrase == "", F.when(F.contains(F.lower(said), F.lit("tomorrow")), 48).otherwise(default)).otherwise(F.coalesce(known, F.greatest(F.lit(1), F.floor((before - after) / 3600).cast("int"))))


def move_target(said: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(said), as_re2(MOVE), 1), F.lit(""))
