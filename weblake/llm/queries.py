"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf, divergence, imi, langid, line_dedup, lm, mixing, ngram_join, packing, quality, toxicity, tput, warc
from .common import crc_mod, table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), k=4, percent=85).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("class_low").alias("class_id"), "n_links")


def op2_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", *(F.round(c, 9).alias(c) for c in ("position", "last_position")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.digests(docs, line_dedup.drop_bitmaps(docs, min_docs=10, min_chars=1))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_rules(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return (
        toxicity.fit(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))
        .score(docs.select("doc_id", "text"))
        .select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    contents = langid.dictionaries(docs.where(crc_mod(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", "text"), contents).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return imi.search(vectors, vectors.where("vec_id % 20 = 0"), visit_share=0.5)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    return lm.score(docs, lm.train(docs.where(~held_out))).withColumn("held_out", held_out)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = crf.described(F.col("spans"), *crf.KINDS)
    return crf.find(docs, crf.fit(docs)).select("doc_id", *map(count, crf.KINDS), F.sha2(base, 256).alias("base_sha256"), crf.described(F.col("spans")).alias("spans"))


def op12_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tput.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_curriculum_mixing, op3_line_dedup, op4_toxicity, op5_line_quality, op6_packing, op7_language_id, op8_multi_index, op9_warc, op10_lm_scoring, op11_secret_scan, op12_tput_search, op13_source_divergence)}
ORACLES: dict[str, str] = {}
ORACLES["op1_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words
), keyed AS (
  SELECT doc_id, s, len(s) AS n, md5(array_to_string(s, chr(10))) AS key FROM sets
), classes AS (
  SELECT key, n, min(doc_id) AS low, any_value(s) AS s FROM keyed WHERE n > 0 GROUP BY key, n
), tokens AS (
  SELECT key, n, unnest(s) AS t FROM classes
), pairs AS (
  SELECT a.key AS a, b.key AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.key < b.key AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.key, b.key, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT key, low FROM classes UNION SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.key
), lows AS (
  SELECT key, min(low) AS component_id FROM reach GROUP BY key
), counts AS (
  SELECT a AS key, count(*) AS n_links FROM edges GROUP BY a
)
SELECT k.doc_id, k.n::BIGINT AS n_shingles, coalesce(l.component_id, k.doc_id) AS component_id, coalesce(c.low, k.doc_id) AS class_id, coalesce(n.n_links, 0) AS n_links
FROM keyed k LEFT JOIN classes c ON c.key = k.key AND k.n > 0 LEFT JOIN lows l ON l.key = c.key LEFT JOIN counts n ON n.key = c.key
"""
ORACLES["op5_line_quality"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)
), sizes AS (
  SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM words GROUP BY r
), grams AS (
  SELECT r, i, word AS a, lead(word) OVER (PARTITION BY r ORDER BY i) AS b, lead(word, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM words
), twice AS (
  SELECT r, a, b, c FROM grams WHERE c IS NOT NULL GROUP BY r, a, b, c HAVING count(*) > 1
), covered AS (
  SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM grams JOIN twice USING (r, a, b, c), (VALUES (0), (1), (2)) v(o) GROUP BY r
), lines AS (
  SELECT * FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), cores AS (
  SELECT r, source, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS core, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines
), frequent AS (
  SELECT c.source, c.core FROM cores c JOIN (SELECT source, least(100, greatest(10, count(*) * 0.01::DOUBLE)) AS most FROM docs GROUP BY source) h ON c.source IS NOT DISTINCT FROM h.source
  GROUP BY c.source, c.core, h.most HAVING count(DISTINCT c.r) > h.most
), removed AS (
  SELECT r, sum(n)::BIGINT AS removed_words FROM cores c JOIN frequent f ON c.core = f.core AND c.source IS NOT DISTINCT FROM f.source GROUP BY r
), repeats AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r
), counted AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM docs LEFT JOIN sizes USING (r) LEFT JOIN covered USING (r) LEFT JOIN repeats USING (r) LEFT JOIN removed USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND 100 * (n_words - removed_words) >= 30 * n_words AS kept FROM judged
"""
ORACLES["op9_warc"] = r"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest FROM payloads
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM named
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts
"""
ORACLES["op2_curriculum_mixing"] = mixing.ORACLE
ORACLES["op12_tput_search"] = tput.ORACLE
ORACLES["op13_source_divergence"] = divergence.ORACLE
ORACLES["op3_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
