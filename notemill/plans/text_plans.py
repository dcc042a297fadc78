"""Queries T01 to T16: text cleaning over notes."""

from __future__ import annotations

from notemill.functions import fixed, text
from notemill.plans.base import query, quoted
from notemill.sources.notes import NOTES_SQL, SPOKEN_SQL, notes, spoken_notes
from pyspark.sql import functions as F

WORDS_SQL = "regexp_extract_all({}, '[A-Za-z0-9'']+')"
SENTENCES_SQL = "list_filter(list_transform(string_split(regexp_replace(trim({}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def trimmed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def whitespace(x: str) -> str:
    return trimmed(f"array_to_string(list_transform(string_split(regexp_replace(regexp_replace({x}, '[^\\S\\n]+', ' ', 'g'), '\\n\\n\\n+', chr(10) || chr(10), 'g'), chr(10)), lambda l: trim(l)), chr(10))")


def folded(x: str) -> str:
    for a, b in fixed.SMART_CHARS.items():
        x = f"replace({x}, chr({ord(a)}), '{b.replace(chr(39), chr(39) * 2)}')"
    return x


def punctuation(x: str) -> str:
    for c in ",.!?;:":
        x = f"regexp_replace({x}, '[{c}][{c}]+', '{c}', 'g')"
    x = f"regexp_replace({x}, '\\s+([,.;:!?%)\\]])', '\\1', 'g')"
    x = f"regexp_replace({x}, '([(\\[])\\s+', '\\1', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '([,;:])([^\\s\\d])', '\\1 \\2', 'g')"
    return x


def fillers(x: str) -> str:
    phrases, words = "|".join(fixed.FILLER_PHRASES), "|".join(sorted(fixed.FILLER_WORDS, key=len, reverse=True))
    for _ in range(2):
        x = f"regexp_replace({x}, '(?i)(^|[^\\w''])(?:{phrases})\\s*,\\s*', '\\1', 'g')"
    for _ in range(3):
        x = f"regexp_replace({x}, '(?i)(^|[^\\w''])(?:{words})(?:[\\s,]+|([^\\w'']|$))', '\\1\\2', 'g')"
    return x


def singular(w: str) -> str:
    es = " OR ".join(f"(ends_with({w}, '{e}') AND length({w}) > {len(e) + 1})" for e in fixed.ES_ENDINGS)
    return f"""CASE WHEN length({w}) <= 3 OR {w} IN ({quoted(fixed.NOT_PLURAL)}) OR NOT ends_with({w}, 's') THEN {w}
      WHEN ends_with({w}, 'ies') AND length({w}) > 4 THEN left({w}, -3) || 'y' WHEN {es} THEN left({w}, -2)
      WHEN NOT ends_with({w}, 'ss') THEN left({w}, -1) ELSE {w} END"""


def sentence_case(x: str) -> str:
    for _ in range(2):
        x = f"regexp_replace({x}, '(^|[^\\w''])i([^\\w'']|$)', '\\1I\\2', 'g')"
    tidy = f"list_filter(list_transform({SENTENCES_SQL.format(x)}, lambda s: regexp_replace(s, '^[\\s,;:.!?-]+', '')), lambda s: s <> '')"
    return f"array_to_string(list_transform({tidy}, lambda s: upper(s[1]) || s[2:]), ' ')"


def terminal(x: str) -> str:
    return f"list_transform([regexp_replace({x}, '\\s+$', '')], lambda t: CASE WHEN t <> '' AND NOT regexp_matches(t, '[.!?]$') THEN t || '.' ELSE t END)[1]"


def match_tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all(lower({x}), '[a-z0-9'']+'), lambda w: {singular('w')})"


def on_notes(name: str, f, sql: str | None, spoken: bool = False):
    source, cte, table = (spoken_notes, SPOKEN_SQL, "spoken") if spoken else (notes, NOTES_SQL, "notes")
    full = f"WITH {cte} SELECT note_id, {sql} AS result FROM {table}" if sql else None

    def run(spark, sf_dir):
        return source(spark, sf_dir).select("note_id", f(F.col("raw_transcript")).alias("result"))

    query(name, full)(run)


T = "raw_transcript"
on_notes("t01_normalize_unicode", text.normalize_unicode, folded(T))
on_notes("t02_normalize_whitespace", text.normalize_whitespace, whitespace(T))
on_notes("t03_normalize_punctuation", text.normalize_punctuation, punctuation(T))
on_notes("t04_remove_fillers", text.remove_fillers, fillers(T), spoken=True)
on_notes("t05_collapse_repetitions", text.collapse_repetitions, None, spoken=True)
on_notes("t06_split_sentences", text.sentences, SENTENCES_SQL.format(T))
on_notes("t07_restore_sentence_case", text.restore_sentence_case, sentence_case(T), spoken=True)
on_notes("t08_ensure_terminal_punctuation", text.ensure_terminal_punctuation, terminal(T))
on_notes("t09_clean_notes", text.clean_note, None, spoken=True)
on_notes("t10_collapse_abbreviations", text.collapse_abbreviations, None)
on_notes("t11_singularize", lambda c: F.transform(text.words(F.lower(c)), text.singularize), f"list_transform({WORDS_SQL.format('lower(raw_transcript)')}, lambda w: {singular('w')})")
on_notes("t12_analysis_text", text.analysis_text, None)
on_notes("t13_normalize_tokens", text.match_text, f"array_to_string({match_tokens(T)}, ' ')")
on_notes("t14_clean_for_summary", text.summary_text, f"lower(trim(regexp_replace(regexp_replace({T}, '[^\\p{{L}}\\p{{N}}_\\s.]', ' ', 'g'), '\\s+', ' ', 'g')))")
on_notes("t15_fold_typographic", text.fold_typographic, folded(T))
on_notes("t16_tokenize_words", text.words, WORDS_SQL.format(T))
