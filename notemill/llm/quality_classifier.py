"""Operator 10: quality by a document classifier and hierarchical empirical Bayes over sites.

1. Evidence. A naive Bayes classifier over binned figures of a text (share of symbols, capitals,
   repeated words, ...), counted from labelled documents; ``TEMPER`` scales its log odds, since the
   figures are not independent.
2. Sites. The evidence of *all* documents is summed per host and per path of a host (partial
   aggregation, no group is gathered). A host's mean is shrunk toward the global mean, a path's
   toward its host's, by the strength that the spread between sites shows (method of moments):
   sparse sites end near their prior, large ones near their own mean.
3. Both. A document's log odds are its evidence plus what its path's posterior, taken without the
   document itself, adds to the global one.

``host`` and ``path`` are any two columns; ``site_of_url`` makes them from URLs. The driver only
sees the bins' counts and a few sums.

Defined results: null or empty text has all figures 0; null hosts and paths are sites of their
own; a document labelled more than once counts once per label; without labels of both kinds the evidence is
0 and every document is as good as the prior of 0.5; extra columns are left out; an empty table gives an empty one; figures are
shares, so a text of any length is one row of them; documents with equal figures on equal sites have equal results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import let, small, stash

#: Figures and their bin edges.
EDGES: dict[str, list[float]] = {
    "words": [5, 20, 50, 100, 300, 1000, 3000],
    "word_length": [2.5, 3, 3.5, 4, 4.5, 5, 6, 7, 9, 12],
    "symbols": [0.001, 0.01, 0.03, 0.06, 0.1, 0.2],
    "capitals": [0.005, 0.02, 0.05, 0.1, 0.3, 0.6],
    "digits": [0.001, 0.01, 0.05, 0.1, 0.3],
    "punctuation": [0.005, 0.02, 0.04, 0.08, 0.15],
    "different_words": [0.1, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9],
    "different_lines": [0.2, 0.5, 0.8, 0.95],
}
TEMPER = 0.6
#: Documents below this chance of being good are not kept.
KEEP = 0.15
STRENGTH = (2.0, 1e6)
BROADCAST_BYTES = 8 << 20


def site_of_url(url: Column) -> tuple[Column, Column]:
    """Host, and host with the first folder."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return host, F.concat(host, F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^/?#]*)/", 1))


def figures(text: Column) -> Column:
    """Struct of the figures of a text."""
    whole = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(whole), F.lit(1))
    without = lambda chars: F.length(whole) - F.length(F.translate(whole, chars, ""))

    def of(w: Column) -> Column:
        many = F.greatest(F.size(w), F.lit(1))
        lines = F.split(whole, "\n")
        return F.struct(
            F.size(w).cast("double").alias("words"),
            (F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)) / many).alias("word_length"),
            (without("#*$%&|<>") / n).alias("symbols"),
            (F.length(F.regexp_replace(whole, r"[^\p{Lu}]+", "")) / n).alias("capitals"),
            (without("0123456789") / n).alias("digits"),
            (without(".,;:!?") / n).alias("punctuation"),
            (F.size(F.array_distinct(w)) / many).alias("different_words"),
            (F.size(F.array_distinct(lines)) / F.size(lines)).alias("different_lines"),
        )

    return let(F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda x: x != ""), of)


def bins(figure: Column) -> Column:
    """Bin of each figure, in the order of ``EDGES``."""
    return F.array(*[sum((F.when(figure[k] >= e, 1).otherwise(0) for e in edges), F.lit(0)) for k, edges in EDGES.items()])


def evidence_of(train: DataFrame) -> Column:
    """Log odds of the bins column ``b``, from rows with ``b`` and ``good``."""
    counts: dict[tuple[int, int], tuple[int, int]] = {}
    rows = train.select("good", F.posexplode("b").alias("f", "bin")).groupBy("f", "bin").agg(F.sum(F.col("good").cast("long")).alias("g"), F.count("*").alias("n")).collect()
    for r in rows:  # one row per figure and bin
        counts[r.f, r.bin] = (r.g, r.n - r.g)
    good = sum(g for (f, _), (g, _) in counts.items() if f == 0)
    bad = sum(b for (f, _), (_, b) in counts.items() if f == 0)
    if not good or not bad:
        return F.lit(0.0)
    out = F.lit(math.log(good / bad))
    for f, edges in enumerate(EDGES.values()):
        k = len(edges) + 1
        weights = [TEMPER * (math.log((counts.get((f, i), (0, 0))[0] + 1) / (good + k)) - math.log((counts.get((f, i), (0, 0))[1] + 1) / (bad + k))) for i in range(k)]
        out = out + F.get(F.array(*[F.lit(w) for w in weights]), F.get("b", F.lit(f)))
    return out


def chance(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def log_odds(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6)))


def strength(n: Column, mean: Column, prior: Column) -> Column:
    """Pseudo-documents of a prior, from the spread of site means around their priors beyond chance."""
    noise = F.sum(prior * (1 - prior) * F.lit(1.0))
    spread = F.sum(n * F.pow(mean - prior, 2)) - noise
    between = spread / F.greatest(F.sum(n) - F.sum(n * n) / F.sum(n), F.lit(1.0))
    own = F.avg(prior * (1 - prior))
    return F.least(F.greatest(F.coalesce(F.try_divide(own, F.greatest(between, F.lit(1e-9))) - 1, F.lit(STRENGTH[1])), F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))


def fitting(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if small(df, row_bytes, BROADCAST_BYTES) else df


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, evidence, host_quality, path_quality, quality, kept`` for each row of ``docs``."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`").cast("string")), F.lit("")).alias("h"), F.coalesce(F.concat(F.lit("="), F.col(f"`{path}`").cast("string")), F.lit("")).alias("p"), bins(figures(F.col(f"`{text}`"))).alias("b"))
    rows = stash(rows, "figures")
    known = rows.join(labels.where("quality IS NOT NULL").select(F.col(key).alias("lk"), (F.col("quality") == 1).alias("good")), F.col("k") == F.col("lk"))
    rows = rows.select("k", "h", "p", evidence_of(known).alias("e")).withColumn("c", chance(F.col("e")))

    paths = stash(rows.groupBy("h", "p").agg(F.count("*").alias("np"), F.sum("c").alias("sp")), "paths")
    hosts = paths.groupBy("h").agg(F.sum("np").alias("nh"), F.sum("sp").alias("sh"))
    total = hosts.agg(F.sum("nh").alias("n"), F.sum("sh").alias("s")).first()
    prior = (total.s / total.n) if total.n else 0.5
    m = hosts.agg(strength(F.col("nh"), F.col("sh") / F.col("nh"), F.lit(prior)).alias("m")).first().m or STRENGTH[1]
    hosts = hosts.withColumn("host_quality", (F.col("sh") + m * prior) / (F.col("nh") + m))
    sites = stash(paths.join(hosts.select("h", "nh", "sh", "host_quality"), "h"), "sites")
    mp = sites.agg(strength(F.col("np"), F.col("sp") / F.col("np"), F.col("host_quality")).alias("m")).first().m or STRENGTH[1]
    sites = sites.select(F.col("h").alias("sh_"), F.col("p").alias("sp_"), "np", "sp", "nh", "sh", "host_quality")

    both = rows.join(fitting(sites, 200), (F.col("h") == F.col("sh_")) & (F.col("p") == F.col("sp_")))
    alone = (F.col("sh") - F.col("c") + m * prior) / (F.col("nh") - 1 + m)
    there = (F.col("sp") - F.col("c") + mp * alone) / (F.col("np") - 1 + mp)
    both = both.withColumn("path_quality", there).withColumn("quality", chance(F.col("e") + log_odds(F.col("path_quality")) - log_odds(F.lit(prior))))
    return both.select(F.col("k").alias(key), F.col("e").alias("evidence"), "host_quality", "path_quality", "quality", (F.col("quality") >= KEEP).alias("kept"))
