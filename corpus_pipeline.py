"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. Language identification, the
n-gram join and decontamination only drop documents; the PII stage puts ``<kind>`` in place of personal
data; the last stage adds token ids.

For all stages: an empty table gives an empty one, repeated rows are treated alike, texts of any length are read whole,
and extra columns are carried along to the last stage. Names that stages use themselves are not theirs to carry: a column
``lang_pred``, ``lang_score`` or ``lang_rejected`` gets the stage's values, ``pii_*`` columns go, and names must have no dot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm import bpe, decontaminate, langid, ngram_join, pii
from notemill.llm.common import scratch, table
from notemill.llm.registry import WORD_BPE, vocabulary_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: those without text or without a letter, and those between two languages.

    A null ``lang`` teaches nothing; a null ``doc_id`` is not held out. Of two languages that fit equally well none is certain.
    """
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model).where(~F.col("lang_rejected")).select(docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays, all its rows if an id is repeated.

    Documents without text or without an id are linked to none and stay.
    """
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go, all rows of an id if one of them has it; those without text or without an id stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text. Null texts stay null.

    Of spans that overlap the one that starts first counts, the longer one on a tie.
    """
    clean = pii.redact(pii.find_pii(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else clean


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text that they decode to; null and empty texts have no ids and decode to the empty text."""
    out = bpe.bpe_encode(docs, vocabulary_file(WORD_BPE), decoded=True)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language", identify_language),
    ("near_copies", join_near_copies),
    ("decontaminate", drop_benchmark),
    ("pii", redact_pii),
    ("bpe", encode_tokens),
]

#: Stages use models, hashes and tokenizers that SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
