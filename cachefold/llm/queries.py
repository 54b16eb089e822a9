"""The operators as registered queries, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_remainder
    from .quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_remainder("doc_id", 5) == 0)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymize

    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_remainder
    from .langid import identify

    held_out = crc_remainder("doc_id", 4) == 2
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_products

    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import maximal_conversations

    return maximal_conversations(table(spark, sf_dir, "conversations"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_minhash": op2_minhash,
        "op3_warc": op3_warc,
        "op4_pii": op4_pii,
        "op5_ann": op5_ann,
        "op6_language": op6_language,
        "op7_packing": op7_packing,
        "op8_topk": op8_topk,
        "op9_chat": op9_chat,
        "op10_mixing": op10_mixing,
        "pipeline": pipeline,
    }


OP8_SQL = """
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(greatest(-9223372036854775807, least(9223372036854775807, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])))) AS BIGINT) AS score
  FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

OP9_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
o AS (
  SELECT *, row_number() OVER w AS pos,
    '<|im_start|>' || replace(coalesce(role, 'user'), '<|im_', '< |im_') || chr(10) || replace(coalesce(text, ''), '<|im_', '< |im_') || '<|im_end|>' || chr(10) AS shown,
    coalesce('r' || role, '-') || chr(1) || coalesce('t' || text, '-') || chr(2) AS exact
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST)),
p AS (
  SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg(exact, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix
  FROM o),
heads AS (SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos = n GROUP BY prefix, n),
kept AS (SELECT * FROM heads h WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = h.n AND p.prefix = h.prefix))
SELECT k.conv_id, CAST((o.pos - 1) // 64 AS BIGINT) AS part, CAST(any_value(k.n) AS BIGINT) AS n_turns,
  CAST(any_value(k.copies) AS BIGINT) AS copies, string_agg(o.shown, '' ORDER BY o.pos) AS rendered
FROM kept k JOIN o ON o.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id, (o.pos - 1) // 64
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_topk": OP8_SQL, "op9_chat": OP9_SQL}
