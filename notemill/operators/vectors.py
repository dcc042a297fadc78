"""Hashed and dense vectors: embedding, similarity, centroids, nearest rows, density clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions import fixed, text
from notemill.operators.graphs import cut_lineage

DIM = 256


def fitting(df: DataFrame, most: int) -> DataFrame:
    """Broadcast when counted to have ``most`` rows at most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bucket(token: Column, dim: int = DIM) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dim).cast("int")


def embed_tokens(body: Column, normalize: bool = False) -> Column:
    """Tokens that an embedding counts."""
    said = text.match_text(body) if normalize else F.lower(F.coalesce(body, F.lit("")))
    return F.filter(F.regexp_extract_all(said, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(fixed.EMBED_STOPWORDS))


def embed_sparse(rows: DataFrame, key: str, body: str, dim: int = DIM, normalize: bool = False) -> DataFrame:
    """``key, bucket, weight`` of unit length: counts of hashed tokens."""
    counts = rows.select(key, F.explode(embed_tokens(F.col(body), normalize)).alias("t")).groupBy(key, bucket(F.col("t"), dim).alias("bucket")).agg(F.count("*").alias("n"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def densify(sparse: DataFrame, key: str, dim: int = DIM) -> DataFrame:
    """``key, embedding array<double>``."""
    held = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a vector of zeros."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def sparse_cosine(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str) -> DataFrame:
    """``query_key, doc_key, score`` of unit vectors that share a bucket; queries are a table of their own."""
    q = queries.select(query_key, "bucket", F.col("weight").alias("qw"))
    return q.join(docs.select(doc_key, "bucket", "weight"), "bucket").groupBy(query_key, doc_key).agg(F.least(F.sum(F.col("qw") * F.col("weight")), F.lit(1.0)).alias("score"))


def centroids(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Mean vector of each group by position, partially aggregated."""
    parts = rows.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))


def representatives(rows: DataFrame, key: str, by: str, vector: str = "embedding") -> DataFrame:
    """The member nearest to its group's centroid, the smallest key on a tie."""
    near = rows.join(centroids(rows, by, vector), by).select(by, key, F.bround(cosine(F.col(vector), F.col("centroid")), 6).alias("score"))
    return near.groupBy(by).agg(F.max(F.struct("score", (-F.col(key)).alias("k"))).alias("x")).select(by, (-F.col("x.k")).alias(key), "x.score")


def top_k(scored: DataFrame, query_key: str, doc_key: str, k: int, score: str = "score") -> DataFrame:
    order = Window.partitionBy(query_key).orderBy(F.desc(score), doc_key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Candidates that lie in one array; each row meets every block of them.
BLOCK = 256


def block_scores(rows: DataFrame, candidates: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """``key, candidate, score``: cosine of each row with each of ``candidate, centroid``, for a stated set of candidates.

    Candidates are dealt into blocks of about ``BLOCK``; a row joins on the block and scores it as an array, so a
    ranking that follows can cut the scores before anything is shuffled. Nulls score 0.
    """
    blocks = -(-candidates.count() // BLOCK)
    if not blocks:
        return rows.select(key).where("false").crossJoin(candidates.select("candidate").where("false")).withColumn("score", F.lit(0.0))
    dealt = candidates.withColumn("block", F.pmod(F.xxhash64("candidate"), F.lit(blocks)).cast("int")).groupBy("block").agg(F.collect_list(F.struct("candidate", F.col("centroid").cast("array<double>").alias("c"))).alias("held"))
    met = rows.select(key, F.col(vector).cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(dealt, "block")
    scores = F.transform("held", lambda x: F.struct(x["candidate"].alias("candidate"), cosine(F.col("v"), x["c"]).alias("score")))
    return met.select(key, F.explode(scores).alias("x")).select(key, "x.candidate", "x.score")


def best_candidate(rows: DataFrame, candidates: DataFrame, key: str, least: float, vector: str = "embedding") -> DataFrame:
    """``key, candidate, score``: the candidate nearest to each row, from ``least`` on; the first in order on a tie."""
    scored = block_scores(rows, candidates, key, vector).withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)
    order = Window.partitionBy(key).orderBy(F.desc("score"), "candidate")
    return scored.where(F.col("score") >= least).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def feature_vectors(rows: DataFrame, vector: str, kinds: dict[str, tuple[list, float]]) -> Column:
    """A vector followed by weighted one-hot categories, each in sorted order."""
    parts = [F.col(vector)]
    for column, (values, weight) in kinds.items():
        parts.append(F.array(*[F.when(F.col(column) == v, weight).otherwise(0.0) for v in sorted(values)]))
    return F.concat(*parts)


def numbers(values: DataFrame, column: str, name: str) -> DataFrame:
    """``column, name``: different values numbered from 0 in their order, by ranges of them and counts of the ranges."""
    ranged = cut_lineage(values.repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    return ranged.withColumn("place", place).join(offsets.select("part", "offset"), "part").select(column, (F.col("place") + F.col("offset")).alias(name))
