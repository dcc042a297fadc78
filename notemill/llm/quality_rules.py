"""Operator 5: quality rules with risk-controlled cutoffs.

Each rule compares one figure of a text with a cutoff. For each stratum (language) a sequence of stages goes from loose to
strict: at each stage every rule has its next stricter cutoff, so the documents that any rule rejects only become more. The stages
are tested in this order on labelled holdout documents: the exact binomial test has to show that at most ``ALPHA`` of
the good ones are rejected by all rules together. The last stage before the first that fails gives the cutoffs. Since the order is
fixed beforehand and the first failure ends it, the number of stages costs nothing (fixed-sequence testing); ``DELTA``, the chance that
any stratum is wrong, is split over the strata that have enough labels to show anything at all (Bonferroni; which they are
follows from their sizes alone). Where the labels cannot show as much at the loosest stage, a stratum has no cutoffs and
rejects nothing.

Figures come from column expressions inside a row. Only their few numbers are written
down, joined with labels and counted per stratum; each document meets its stratum's cutoffs by a join.
Every language is a stratum of its own, however few labels it has.

Words are runs without ASCII white space. Null text has no words; a text without words
fails the base rule. Repeated rows give repeated results. In the holdout equal texts of a stratum count once, however
often they occur or are labelled, since the test takes its documents as independent; null languages are a stratum.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import let, small, stash

SPACE = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Base rule: fewer words, or a larger share of repeated words in hundredths, fails.
MIN_WORDS, MAX_REPEAT = 20, 30
ALPHA, DELTA = 0.02, 0.05
#: Strata whose cutoffs may be broadcast.
MOST_STRATA = 10_000
#: Rule name, and cutoffs from strict to loose, one for each stage. All reject what is larger than the cutoff.
RULES: dict[str, list[float]] = {
    "symbol_share": [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2],
    "dup_line_share": [0.1, 0.2, 0.3, 0.4, 0.5, 0.7],
    "repeat_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25],
    "word_length_over": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0],
    "word_length_under": [-4.5, -4.0, -3.5, -3.0, -2.5, -2.0],
}


def words_of(text: Column) -> Column:
    """Runs without ASCII white space."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(inner) > 0, F.split(inner, SPACE + "+")).otherwise(F.array().cast("array<string>"))


def repeat_words(words: Column) -> Column:
    """Number of words inside a window of eight that occurs twice or more."""

    def later(xs: Column, n: int) -> Column:
        return F.slice(xs, n + 1, F.greatest(F.size(xs) - n, F.lit(0)))

    def pairs(xs: Column, n: int) -> Column:
        """Hash of each element with the one n further on."""
        return let(xs, lambda x: F.slice(F.zip_with(x, later(x, n), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(x) - n, F.lit(0))))

    windows = pairs(pairs(pairs(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            """Whether each of the sorted windows equals the next."""
            return F.zip_with(s, later(s, 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))

        def starts(s: Column) -> Column:
            same = let(flagged(s), lambda e: F.zip_with(e, F.concat(F.array(F.lit(False)), e), lambda a, b: F.coalesce(a, F.lit(False)) | b))
            marked = F.zip_with(s, same, lambda x, m: F.when(m, x["i"]))
            return F.sort_array(F.array_compact(marked))

        return let(
            let(ranked, starts),
            lambda at: F.aggregate(F.zip_with(at, later(at, 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda s, x: s + x),
        )

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with its hash ``_text``, the counts and the figures of ``RULES``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    rest = [c for c in docs.columns if c != text]
    out = docs.select(
        *[F.col(f"`{c}`") for c in rest],
        F.xxhash64(whole, F.lit("text")).alias("_text"),
        let(words_of(whole), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"))).alias("_w"),
        F.length(F.translate(whole, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("_l"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    return out.select(*[F.col(f"`{c}`") for c in rest], "_text", "_w.*", "word_chars", "n_symbols", "_l.*").withColumns(
        {
            "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / n,
            "word_length_over": F.col("word_chars") / n,
            "word_length_under": -F.col("word_chars") / n,
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")),
        }
    )


def log_factorial(n: Column) -> Column:
    """log(n!) by Stirling's series at n + 8, taken back to n."""
    x = n + 8.0
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    back = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0.0), lambda s, i: s + F.log(n + i.cast("double")))
    return series - back


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials with chance p; summed from k down, for k below the mean."""
    kd, nd = k.cast("double"), n.cast("double")
    top = F.exp(log_factorial(nd) - log_factorial(kd) - log_factorial(nd - kd) + kd * math.log(p) + (nd - kd) * math.log1p(-p))
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        down = s["term"] * (kd - i + 1) / (nd - kd + i) * odds
        return F.struct(down.alias("term"), (s["sum"] + down).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(kd >= nd * p, 1.0).otherwise(top * F.aggregate(terms, start, step, lambda s: s["sum"]))


def cutoffs(holdout: DataFrame, rules: dict[str, list[float]] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The cutoffs of the strictest stage that is shown to be safe: ``stratum, rule, cutoff, n, k, bound``, none where no stage is.

    ``holdout`` has good documents only, with ``stratum`` and the rules' figures; ``k`` of ``n`` are rejected by any rule at that stage.
    """
    stages = [{r: cs[max(0, len(cs) - 1 - j)] for r, cs in rules.items()} for j in range(max(map(len, rules.values())))]

    def any_rule(stage: dict[str, float]) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(F.col(r) > c, F.lit(False)) for r, c in stage.items()])

    counts = holdout.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(any_rule(s)).alias(f"k{j}") for j, s in enumerate(stages)])
    counts = stash(counts, "holdout")  # a row for each stratum
    enough = lambda strata: math.log(delta / strata) / math.log1p(-alpha)  # noqa: E731  good documents that show it if none is rejected
    tested = max(1, counts.where(F.col("n") >= enough(1)).count())  # no fewer than can pass at delta / tested
    tried = F.array(*[F.struct(F.lit(j).alias("stage"), F.col(f"k{j}").alias("k"), binomial_tail(F.col(f"k{j}"), F.col("n"), alpha).alias("bound")) for j in range(len(stages))])
    rows = counts.where(F.col("n") >= enough(tested)).select("stratum", "n", tried.alias("tried"))
    failed = F.array_position(F.transform("tried", lambda x: x["bound"] > delta / tested), F.lit(True)).cast("int")  # from 1 on, 0 if none
    last = F.when(failed == 0, F.lit(len(stages))).otherwise(failed - 1)
    safe = rows.withColumn("last", last).where("last > 0").withColumn("x", F.get("tried", F.col("last") - 1))
    chosen = F.explode(F.get(F.array(*[F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff")) for r, c in s.items()]) for s in stages]), F.col("x.stage")))
    return safe.select("stratum", "n", "x.k", "x.bound", chosen.alias("c")).select("stratum", "c.rule", "c.cutoff", "n", "k", "bound")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id") -> DataFrame:
    """``docs`` without text, with its figures, ``base_failed`` and ``kept``.

    ``labels`` has ``key`` and ``quality``; rows of quality 1 that pass the base rule are the holdout.
    """
    found = stash(figures(docs.select(key, "text", stratum).toDF("_key", "text", "_lang")), "figures")
    found = found.withColumn("_stratum", F.when(F.col("_lang").isNull(), "").otherwise(F.concat(F.lit("="), "_lang")))
    labelled = labels.where("quality = 1").select(F.col(key).alias("_key")).distinct()
    good = found.where(~F.col("base_failed")).join(labelled, "_key").dropDuplicates(["_stratum", "_text"]).withColumn("stratum", F.col("_stratum"))
    limits = cutoffs(good).groupBy(F.col("stratum").alias("_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_limits"))
    both = found.join(F.broadcast(limits) if small(limits, 1, MOST_STRATA) else limits, "_stratum", "left")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(F.col(rule) > F.try_element_at("_limits", F.lit(rule)), F.lit(False))
    return both.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum", "_limits", "_text").withColumnsRenamed({"_key": key, "_lang": stratum})
