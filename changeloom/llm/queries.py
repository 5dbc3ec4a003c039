"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm import chat, decontam, hmm_lm, near_dup, quality, repeats, token_blocks, token_count, vectors, word_bpe
from changeloom.llm.common import table


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_blocks.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_blocks.read(spark, files, digest=True)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.aggregate("removed", F.lit(0), lambda n, x: n + x["end"] - x["begin"]), F.lit(0))
    return repeats.remove_repeats(docs).select("doc_id", "text", "removed", size.alias("removed_chars"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "message", "user", odd, None), (-1, 1, "message", "assistant", odd, None)], chat.EVENTS)
    return chat.read_back(chat.format_log(chat.events_of(table(spark, sf_dir, "conversations")).unionByName(added)))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hmm_lm.scored(docs, *hmm_lm.train(docs))


def op10_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return word_bpe.digests(word_bpe.encode(docs, path).drop("text"), path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_blocks": op1_token_blocks,
    "op2_repeats": op2_repeats,
    "op3_token_counts": op3_token_counts,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_vector_duplicates": op7_vector_duplicates,
    "op8_chat_format": op8_chat_format,
    "op9_language_model": op9_language_model,
    "op10_word_bpe": op10_word_bpe,
}

_REACHED = """, reached AS (SELECT id, id AS c FROM nodes UNION SELECT l.b, r.c FROM reached r JOIN links l ON l.a = r.id)"""

_NEAR_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id AS id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
 ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS sh FROM w),
e AS (SELECT id, unnest(sh) AS g FROM s), nodes AS (SELECT id, CAST(len(sh) AS bigint) AS n FROM s),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id),
links AS (SELECT p.a, p.b FROM p JOIN nodes x ON x.id = p.a JOIN nodes y ON y.id = p.b WHERE 100 * k >= 80 * (x.n + y.n - k))""" + _REACHED + """
SELECT n.id AS doc_id, n.n AS n_shingles, min(r.c) AS component_id, min(r.c) = n.id AS kept FROM nodes n JOIN reached r ON r.id = n.id GROUP BY n.id, n.n"""

_VECTOR_SQL = """WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS double[]) AS e FROM embeddings),
nodes AS (SELECT id FROM v), usable AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.id AS a, b.id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.98)""" + _REACHED + """
SELECT n.id AS vec_id, (SELECT count(*) FROM links WHERE links.a = n.id) AS n_links, min(r.c) AS component_id, min(r.c) = n.id AS kept FROM nodes n JOIN reached r ON r.id = n.id GROUP BY n.id"""

_CHAT_SQL = """WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 2 * length(role) - length(regexp_replace(role, '[⟪⟫⁅]', '', 'g')) + 2 * length(text) - length(regexp_replace(text, '[⟪⟫⁅]', '', 'g')) + 5 AS size FROM t)
SELECT conv_id, CAST(count(*) AS bigint) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS bigint) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS bigint) AS formatted_chars FROM e GROUP BY conv_id"""

#: The other operators have no SQL form (tokenizers, trained models, retrieval, passage units); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op4_near_duplicates": _NEAR_SQL, "op7_vector_duplicates": _VECTOR_SQL, "op8_chat_format": _CHAT_SQL}
