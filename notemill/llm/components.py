"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import stash


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``v, label``: each end of a link with the smallest end in its component.

    Every round takes the least label among neighbours and then the label's own
    label, so long chains shrink by half. Both steps read written tables: a vertex
    with very many neighbours, or a label with very many vertices, is a hot key of a join
    whose two sides are freshly exchanged, which adaptive execution splits.
    """
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = stash(both.union(both.select("b", "a")).distinct(), "links")
    labels = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), "labels")
    while True:
        least = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("m"))
        lowered = labels.join(least, labels["v"] == least["a"]).select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        lowered = stash(lowered, "labels")
        of = lowered.select(F.col("v").alias("w"), F.col("label").alias("next"))
        jumped = stash(lowered.join(of, lowered["label"] == of["w"]).select("v", "old", F.col("next").alias("label")), "labels")
        if jumped.where("label <> old").isEmpty():
            return jumped.select("v", "label")
        labels = jumped.select("v", "label")
