"""Queries of this subpackage, and the SQL that some are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm import bpe, conversations, decontaminate, langid, mixing, ngram_join, pii, quality_classifier, quality_rules, spelling, substring_dedup, token_table, warc
from notemill.llm.common import scratch, table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary_file(name: str) -> str:
    """Where the public tokenizers' files lie, here and on the workers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_encode(table(spark, sf_dir, "documents"), vocabulary_file(WORD_BPE), decoded=True)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(pii.BASE_KINDS), 256).alias("base_sha256"), pii.joined(pii.BASE_KINDS + pii.ADDED_KINDS).alias("spans"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_table.write_token_table(table(spark, sf_dir, "documents"), vocabulary_file(BYTE_BPE), scratch(spark, "tokens"))
    return token_table.read_token_table(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return warc.read_warc(manifest).drop("payload", "url")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversations.digest(conversations.repair(conversations.damage(turns)), turns)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "runs")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``corpus_pipeline.run``, with digests instead of ids and texts."""
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_bpe, op3_pii, op4_langid, op5_quality_rules, op6_decontaminate, op7_substring_dedup, op8_token_table, op9_warc, op10_quality_classifier, op11_conversation_repair, op12_spelling, op13_mixing, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op12_spelling": OP12_SQL}


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

#: crc32 of a hexadecimal string of bytes; ``crc`` is the table by the polynomial's rule.
CRC_TABLE = """crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length({0}) // 2), lambda i: ('0x' || substr({0}, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"

OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, rows AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations
), harmed AS (SELECT *, {CRC.format("h")} % 20 AS harm FROM rows, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE harm WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM harmed WHERE harm <> 0
), placed AS (
  SELECT *, left(role, 1) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM damaged
), r AS (
  SELECT *, last = '' AS blank, last <> '' AND seen AS duplicate, last <> '' AND NOT seen AND last NOT IN ('.', '!', '?') AS truncated, last = '' OR seen AS gone,
    lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), v AS (
  SELECT DISTINCT conv_id, n AS i, 0 AS v0, 6 AS v1, 3 AS v2, 0 AS v3 FROM r
  UNION ALL
  SELECT conv_id, i, least(x0, 3 + x2), least(x1, 3 + x2), least(x2, 3 + x3), least(x3, 3 + x2) FROM (
    SELECT conv_id, i, least(w0, 3 + w2) AS x0, least(w1, 3 + w2) AS x1, least(w2, 3 + w3) AS x2, least(w3, 3 + w2) AS x3 FROM (
      SELECT r.conv_id, r.i, least(4 + v0, free + 3 + v2, free + CASE x WHEN 's' THEN v1 WHEN 'u' THEN v2 ELSE 1000000 END) AS w0, least(4 + v1, free + 3 + v2, free + CASE x WHEN 'u' THEN v2 ELSE 1000000 END) AS w1,
        least(4 + v2, free + 3 + v3, free + CASE x WHEN 'a' THEN v3 ELSE 1000000 END) AS w2, least(4 + v3, free + 3 + v2, free + CASE x WHEN 'u' THEN v2 ELSE 1000000 END) AS w3
      FROM v JOIN (SELECT *, CASE WHEN gone THEN 1000000 WHEN truncated THEN 3 ELSE 0 END AS free FROM r) r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i - 1))
), costs AS (SELECT v.conv_id, v.i, [v0, v1, v2, v3] AS now FROM v),
steps AS (
  SELECT a.conv_id, a.i, a.now, b.now AS after, r.role, r.text, r.n, CASE WHEN r.gone THEN 1000000 WHEN r.truncated THEN 3 ELSE 0 END AS free,
    CASE r.x WHEN 's' THEN [1, -1, -1, -1] WHEN 'u' THEN [2, 2, -1, 2] WHEN 'a' THEN [-1, -1, 3, -1] ELSE [-1, -1, -1, -1] END AS keep
  FROM costs a LEFT JOIN costs b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = a.i + 1 LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.i = a.i
), walk AS (
  SELECT conv_id, 0 AS i, 0 AS s, '' AS audit, []::VARCHAR[] AS said, false AS ended FROM costs WHERE i = 0
  UNION ALL
  SELECT conv_id, i + CASE WHEN e IN ('I', '') THEN 0 ELSE 1 END, CASE e WHEN 'K' THEN keep[s + 1] WHEN 'D' THEN s WHEN '' THEN s ELSE f END, audit || e,
    CASE e WHEN 'K' THEN list_append(said, role || ':' || text) WHEN 'R' THEN list_append(said, o || text) WHEN 'I' THEN list_append(said, o) ELSE said END, e = '' FROM (
    SELECT w.conv_id, w.i, w.s, w.audit, w.said, keep, role, text, f, CASE f WHEN 2 THEN 'user:' ELSE 'assistant:' END AS o,
      CASE WHEN after IS NULL AND s IN (0, 3) THEN '' WHEN after IS NOT NULL AND now[s + 1] = 4 + after[s + 1] THEN 'D' WHEN now[s + 1] = 3 + now[f + 1] THEN 'I' WHEN keep[s + 1] >= 0 AND now[s + 1] = free + after[keep[s + 1] + 1] THEN 'K' ELSE 'R' END AS e
    FROM (SELECT *, CASE s WHEN 2 THEN 3 ELSE 2 END AS f FROM walk WHERE NOT ended) w JOIN steps t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i)
), faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(i > 0 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (FROM v WHERE i = 0) v ON v.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN (FROM walk WHERE ended) w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS k, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), kinds AS (SELECT k, w, count(*) AS n, hex(encode(k || ':' || w)) AS h FROM runs GROUP BY ALL),
hashed AS (SELECT w, n, {CRC.format("h")} AS c FROM kinds, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN c % 97 = 0 THEN left(w, c % length(w)) || substr(w, c % length(w) + 2) ELSE w END AS word, n FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), dels AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS v, b.n FROM dels a JOIN dels b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM dels a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM dels a JOIN words b ON a.d = b.word
), best AS (SELECT word, count(*) AS n_near, arg_min(v, {{'n': -n, 'v': v}}) AS v, max(n) AS m FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * w.n THEN v END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
follow AS (SELECT word, word AS root, 0 AS hops FROM forms UNION ALL SELECT r.word, f.form, hops + 1 FROM follow r JOIN forms f ON f.word = r.root AND f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, hops) AS root FROM follow GROUP BY word) USING (word)
"""
