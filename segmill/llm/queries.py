"""The thin queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from .pieces import vocabulary_path

VOCABULARY = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    ship(spark)
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    ship(spark)
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_chats

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return digests(format_chats(rows.unionByName(probe)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .webp import read_media, store_texts

    ship(spark)
    return read_media(store_texts(table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    ship(spark)
    return pack(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    ship(spark)
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))


def op8_pseudo_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudo_lm import score

    ship(spark)
    return score(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    ship(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    ship(spark)
    return main_text(table(spark, sf_dir, "pages"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    ship(spark)
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import ranked

    ship(spark)
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    ship(spark)
    return hard_negatives(table(spark, sf_dir, "embeddings"), "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()} | {"pipeline": pipeline}


_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *, CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'system' THEN 6
    ELSE 1 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c')) END AS label,
    length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e')) AS body,
    row_number() OVER w - 1 AS place, lag(role, 1, 'start') OVER w AS before
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), e AS (
  SELECT *, (before || '>' || role) NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS wrong FROM m
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + label + 2 + body + 8) AS BIGINT) AS formatted_chars,
  NOT bool_or(wrong) AND arg_max(role, place) = 'assistant' AS valid, CAST(min(place) FILTER (wrong) AS INTEGER) AS error_turn
FROM e GROUP BY conv_id
"""

_NEAREST = """
WITH v AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_RANKED = r"""
WITH d AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS r FROM documents
), w AS (
  SELECT r, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), p AS (SELECT r, doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY r),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
m AS (SELECT r, 100 - 50 + (50 * n * docs) // total AS m FROM n, s),
v AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
i AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), h AS (
  SELECT item_id, text, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM i JOIN v USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, text, r
), o AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM h WHERE score > 0 AND doc_id IS NOT NULL)
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(rank AS INTEGER) AS rank, CAST(doc_id AS BIGINT) AS doc_id, score FROM o WHERE rank <= 50
"""

_NEGATIVES = """
WITH v AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS vec_id,
    coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_nearest": _NEAREST, "op3_chat": _CHAT, "op12_ranked": _RANKED, "op13_negatives": _NEGATIVES}
