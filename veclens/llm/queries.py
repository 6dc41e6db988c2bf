"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, lm_score, mixing, quality, secrets, simhash, substring, token_store, tokens, toxicity, variants, whitening
from .common import held_out, shared_dir, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = mixing.draws(table(spark, sf_dir, "documents"))
    return uses.groupBy("doc_id", "source", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.count("pass").alias("uses"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.cut_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))).withColumn("held_out", held_out(4, 2))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs.where(~held_out(5, 0)))).withColumn("held_out", held_out(5, 0))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents")).where("is_secret")
    return found.select("doc_id", "place", "nth", F.char_length("run").alias("n_chars"), F.sha2("run", 256).alias("secret_sha256"), "probability")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality.MEASURES, "failed_bits", "base_failed", "kept")


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/veclens-ids-{uuid.uuid4().hex}"
    token_store.write_ids(docs, path)
    return token_store.fetch(docs, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents")))


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
t AS (SELECT doc_id, i, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c, lag(word) OVER o AS a FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c) AS n FROM t WHERE c IS NOT NULL),
v AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n FROM t WHERE word = a GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals, coalesce(e.n, 0)::BIGINT AS n_doubled
      FROM w LEFT JOIN v USING (doc_id) LEFT JOIN e USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
             + CASE WHEN 100 * n_capitals > 40 * word_chars THEN 32 ELSE 0 END
             + CASE WHEN 100 * n_doubled > 20 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT *, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept FROM b
"""

_RULES = ", ".join(f"('{p.version}', '{r}', {p.mask}, {1 << i})" for p in quality.POLICIES.values() for i, r in enumerate(quality.RULES) if r in p.rules)
ABLATION_SQL = f"""
SELECT version, rule, count_if(failed_bits & bit <> 0)::BIGINT AS n_rejected, count_if(failed_bits & mask = bit)::BIGINT AS n_only
FROM ({QUALITY_SQL}) AS ledger, (VALUES {_RULES}) AS p(version, rule, mask, bit) GROUP BY version, rule
"""

SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word,
                  generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS i FROM documents),
g AS (SELECT doc_id, i, count(*) OVER o AS n, array_to_string(list(word) OVER o, ' ') AS gram
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT gram, min(doc_id) AS least FROM g WHERE n = 13 GROUP BY gram),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM g JOIN f USING (gram), (SELECT unnest(range(13)) AS k) WHERE n = 13 AND least < doc_id),
j AS (SELECT w.doc_id, count(*) AS n_words, count(c.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.i) FILTER (c.i IS NULL), '') AS kept
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.i = c.i GROUP BY w.doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN j USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_lm_score": op3_lm_score,
    "op4_decontamination": op4_decontamination,
    "op5_substrings": op5_substrings,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_language": op8_language,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
    "op11_token_ids": op11_token_ids,
    "op12_whitening": op12_whitening,
    "op13_spelling": op13_spelling,
    "quality_ablation": quality_ablation,
}
ORACLES: dict[str, str] = {"op5_substrings": SUBSTRING_SQL, "op10_quality": QUALITY_SQL, "quality_ablation": ABLATION_SQL}
