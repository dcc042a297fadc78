"""Operator 3: personal data found with column expressions alone.

Patterns propose matches, checks confirm them and words nearby move a score:

* base kinds ``email``, ``ip``, ``card``, ``phone`` by fixed patterns and checks
  (parts of at most 255, Luhn, number of digits). A confirmed base match always stays.
* added kinds ``iban`` (mod-97), ``account`` (12 to 19 digits that pass Luhn and are no
  base card; fewer than 16 are kept only when words such as "card" stand before them),
  ``tel`` (a written-out number that the base rule loses to digits after it) and ``secret`` (key-like strings: kept by their own form or by words such as "password"
  before them).

Positions are code points. Spark has no function for the positions of all matches, so
they come from what lies between: splitting at a pattern and extracting the pattern walk
through the same matches, hence the start of match i is the length of the first i + 1
gaps and i matches. Patterns are possessive and start only where a run starts (or where
the match before ended), which changes no match but keeps the time linear on long runs.

Everything happens inside a row: no shuffle, no Python. Null text counts as empty;
repeated rows give repeated results; an empty table gives an empty one; of two matches of one kind that overlap the first
stands, and an added one that overlaps a base one goes; columns with the names of span columns are replaced, others carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import running, running_sums
from notemill.llm.common import let

BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["iban", "account", "tel", "secret"]
LOCAL, DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{DOMAIN}]++(?:\.[{DOMAIN}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "account": r"(?<![0-9])[0-9]{12,19}+(?![0-9])",
    "tel": r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_])(?:AKIA[A-Z0-9]{16}|[A-Fa-f0-9]{16,64})(?![A-Za-z0-9_])",
}
#: What a text must contain at least for the pattern to be tried.
NEEDS = {"email": "@", "phone": "+", "tel": "+"}
LIKELY = {"ip": r"[0-9]\.[0-9]", "card": "[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "account": "[0-9]{12}", "secret": "[0-9]|AKIA|[A-Fa-f]{16}"}
#: Score of a confirmed match before its context, per kind; and what context adds.
SCORES = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "account": 0.4, "tel": 0.7, "secret": 0.4}
CONTEXT, BONUS, KEEP = 32, 0.4, 0.6
#: Words whose presence just before a match raises its score.
CONTEXT_WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account",
    "account": "card|account|payment|credit",
    "tel": "phone|call|tel|mobile|fax",
    "secret": "key|token|secret|passw",
}


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, value>>`` of all matches, left to right."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(values: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        sizes = let(F.transform(values, F.length), lambda n: F.zip_with(F.slice(gaps, 1, F.size(n)), n, lambda g, v: g + v))
        starts = F.zip_with(running_sums(sizes), values, lambda e, v: e - F.length(v))
        return F.zip_with(starts, values, lambda s, v: F.struct(s.alias("start"), v.alias("value")))

    return let(found, lambda values: F.when(F.size(values) > 0, place(values)).otherwise(F.array().cast("array<struct<start:int,value:string>>")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: let(d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)  # noqa: E731  A is 10
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: let(code(c), lambda n: (a * F.when(n > 9, 100).otherwise(10) + n) % 97)) == 1


def byte_parts(value: Column) -> Column:
    """Whether each part of an address is at most 255, leading zeros aside."""
    return F.forall(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return byte_parts(value)
    if kind == "card":
        return let(digits(value), lambda d: F.length(d).between(16, 19) & luhn(d))
    if kind in ("phone", "tel"):
        return F.length(digits(value)).between(8, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "account":
        return luhn(value)
    return F.lit(True)


def spans_of(kind: str, text: Column) -> Column:
    """``array<struct<kind, start, end, value, score>>`` of the confirmed matches of one kind."""
    none = F.array().cast("array<struct<start:int,value:string>>")
    need = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(LIKELY[kind])
    kept = F.filter(F.when(need, matches(text, PATTERNS[kind])).otherwise(none), lambda m: confirmed(kind, m["value"]))

    def scored(m: Column) -> Column:
        near = F.lower(F.substring(text, F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT))))
        own = F.when(m["value"].startswith("AKIA"), BONUS).otherwise(0.0) if kind == "secret" else F.when(F.length(m["value"]) >= 16, BONUS).otherwise(0.0) if kind == "account" else F.lit(0.0)
        score = F.least(F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT_WORDS[kind]), BONUS).otherwise(own), F.lit(1.0))
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value"), score.alias("score"))

    return F.transform(kept, scored)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one array of spans per kind, ``pii_<kind>``: ``kind, start, end, value, score``.

    Added kinds hold spans of ``KEEP`` or more that overlap no base span.
    """
    docs = docs.drop(*[f"pii_{k}" for k in BASE_KINDS + ADDED_KINDS])  # columns of these names are replaced
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.select("*", *[spans_of(k, whole).alias(f"pii_{k}") for k in BASE_KINDS + ADDED_KINDS])
    base = F.flatten(F.array(*[F.col(f"pii_{k}") for k in BASE_KINDS]))
    clear = lambda s: (s["score"] >= KEEP) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return out.withColumns({f"pii_{k}": F.filter(f"pii_{k}", clear) for k in ADDED_KINDS})


def joined(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans, by kind as listed, then start."""
    return F.array_join(F.flatten(F.array(*[F.transform(f"pii_{k}", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])) for k in kinds])), ",")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replaces each span of ``find_pii`` by ``<kind>`` and drops the span columns.

    Spans may overlap; then the one that starts first stands (the longer on a tie) and the rest of the other is cut away with it.
    Texts without spans stay as they are, null ones too; repeated rows give repeated results.
    """
    every = F.array_sort(F.flatten(F.array(*[F.transform(f"pii_{k}", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))) for k in BASE_KINDS + ADDED_KINDS])))
    whole = F.col(text)

    def cut(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda x: -x["back"]), lambda a, b: F.greatest(a, b))

        def of(ends: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
            piece = lambda x, i: let(before(i), lambda at: F.when(x["start"] >= at, F.concat(F.substring(whole, at + 1, x["start"] - at), F.lit("<"), x["kind"], F.lit(">"))).otherwise(""))
            return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(whole, F.element_at(ends, -1) + 1, F.length(whole)))

        return let(ends, of)

    clean = let(every, cut)
    names = [c for c in found.columns if c not in {f"pii_{k}" for k in BASE_KINDS + ADDED_KINDS}]
    touched = F.size(every) > 0
    return found.withColumn(text, F.when(touched, clean).otherwise(whole)).select(*[F.col(f"`{c}`") for c in names])
