"""Connected components and ranks of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.sources.scratch import shared_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's ``spark.checkpoint.dir``; a folder is set only where none is."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """``v, label`` of links ``a, b``: the smallest vertex of each one's component."""
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label"))
    while True:
        least = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("m"))
        lowered = cut_lineage(labels.join(least, labels["v"] == least["a"]).select("v", F.col("label").alias("old"), F.least("label", "m").alias("label")))
        of = lowered.select(F.col("v").alias("w"), F.col("label").alias("next"))
        jumped = cut_lineage(lowered.join(of, lowered["label"] == of["w"]).select("v", "old", F.col("next").alias("label")))
        labels = jumped.select("v", "label")
        if jumped.where("label <> old").isEmpty():
            return labels


def pagerank(vertices: DataFrame, links: DataFrame, group: str, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """Weighted ranks inside each group: vertices ``group, v``; links ``group, a, b, w``, each direction a row.

    Weight of vertices without links is spread evenly; all ranks of a group add up to 1.
    A group is done when a round changes its ranks by less than ``tolerance`` a vertex; that is looked at every five rounds.
    """
    size = vertices.groupBy(group).agg(F.count("*").alias("n"))
    out = links.groupBy(group, "a").agg(F.sum("w").alias("total"))
    shares = cut_lineage(links.join(out, [group, "a"]).where("total > 0").select(group, "a", "b", (F.col("w") / F.col("total")).alias("share")))
    ranks = cut_lineage(vertices.join(size, group).join(out.select(group, F.col("a").alias("v"), "total"), [group, "v"], "left").select(group, "v", "n", F.coalesce("total", F.lit(0.0)).alias("total"), (1 / F.col("n")).alias("rank")))
    done = None
    while True:
        for _ in range(5):
            given = shares.join(ranks.select(group, F.col("v").alias("a"), "rank"), [group, "a"]).groupBy(group, F.col("b").alias("v")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            idle = ranks.where("total = 0").groupBy(group).agg(F.sum("rank").alias("idle"))
            ranks = ranks.withColumnRenamed("rank", "old").join(given, [group, "v"], "left").join(idle, group, "left").withColumn("rank", (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.coalesce("idle", F.lit(0.0)) / F.col("n"))).withColumn("moved", F.abs(F.col("rank") - F.col("old"))).drop("got", "idle", "old")
            last, ranks = ranks, ranks.drop("moved")
        looked = cut_lineage(last.withColumn("open", F.sum("moved").over(Window.partitionBy(group)) >= F.col("n") * tolerance).drop("moved"))
        ended = looked.where("NOT open").select(group, "v", "rank")
        done = ended if done is None else done.unionByName(ended)
        ranks = looked.where("open").drop("open")
        if ranks.isEmpty():
            return done
