"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mdframe.llm import bpe, chat, decontaminate, embeddings, language, minhash, quality, shards, toxicity, urls

OP2_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l USING (a))
SELECT x.vec_id, (SELECT count(*) FROM l WHERE l.a = x.vec_id)::BIGINT AS n_links, min(r.c) AS component_id, min(r.c) = x.vec_id AS kept
FROM embeddings x JOIN r ON r.a = x.vec_id GROUP BY x.vec_id
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l USING (a))
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.c) AS component_id, min(r.c) = s.doc_id AS kept
FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": urls.op1_url_filters,
        "op2_embedding_near_dedup": embeddings.op2_embedding_near_dedup,
        "op3_byte_bpe": bpe.op3_byte_bpe,
        "op4_minhash_near_dedup": minhash.op4_minhash_near_dedup,
        "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
        "op7_token_shards": shards.op7_token_shards,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_language_id": language.op9_language_id,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": urls.OP1_SQL, "op2_embedding_near_dedup": OP2_SQL, "op4_minhash_near_dedup": OP4_SQL, "op5_chat_formatting": chat.OP5_SQL,
        "op6_benchmark_decontamination": decontaminate.OP6_SQL,
    }
