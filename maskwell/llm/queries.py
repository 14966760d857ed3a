"""One query per operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, context_mixing, fingerprint, jaccard_join, language_id, line_dedup, mixing, packing, quality, token_counts
from .common import read


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(read(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(read(spark, sf_dir, "documents"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(read(spark, sf_dir, "documents"), n=5, percent=80)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.kept_digests(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "passes")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(1).select(F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"))
    extra = extra.select(F.lit(-1).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", control.alias("text"))
    return chat.chat_digests(turns.unionByName(extra))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json", window=4096)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer="piece_bpe_32k.model")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_context_mixing, op2_fingerprints, op3_jaccard, op4_quality, op5_line_dedup, op6_language, op7_mixing, op8_chat, op9_packing, op10_token_counts)}


OP4 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('s' || source, 'n') AS host FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(gap, 5))) AS n FROM (SELECT doc_id, lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i AS gap FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id)),
l AS (SELECT doc_id, host, text, lower(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS key, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, host, text, unnest(ls) AS line FROM w)),
h AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
f AS (SELECT host, key, min(doc_id) AS first_doc FROM l JOIN h USING (host) GROUP BY host, key, docs HAVING count(DISTINCT text) > 50 AND count(DISTINCT text) > 0.1 * docs),
x AS (SELECT l.doc_id, sum(n)::BIGINT AS removed_words FROM l JOIN f USING (host, key) WHERE l.doc_id <> f.first_doc GROUP BY l.doc_id),
b AS (SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(removed_words, 0)::BIGINT AS removed_words FROM m LEFT JOIN x USING (doc_id))
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND n_words - removed_words < 10 AND n_words - removed_words < 0.2 * n_words) AS kept FROM b
"""

OP5 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP8 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', '')))
             + 4 * (length(text) - length(replace(text, '[', ''))) AS chars,
             coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role, false) AS joins FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars + CASE WHEN joins THEN 10 ELSE 12 + length(role) + 1 + 11 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": OP4, "op5_line_dedup": OP5, "op8_chat": OP8}
