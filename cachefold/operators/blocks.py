"""Blocks of prompts: hash chains over text, chains from client hints, request shapes, token slots."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cachefold.functions.columns import div_ceil
from cachefold.plans.registry import query
from cachefold.sources import tables as S

BLOCK_CHARS, MOST_BLOCKS = 256, 64


@F.pandas_udf(T.ArrayType(T.StringType()))
def _whole_hashes(texts: pd.Series) -> pd.Series:
    """The hashes of all blocks; each text is read once, as the hash of a prefix goes on into the next."""

    def of(text: str | None) -> list[str | None]:
        if text is None:
            return [None]
        state, out = hashlib.md5(), []
        for at in range(0, max(len(text), 1), BLOCK_CHARS):
            state.update(text[at : at + BLOCK_CHARS].encode())
            out.append(state.hexdigest())
        return out

    return texts.map(of)


def text_blocks(prompts: DataFrame, keys: list[str], text: str, whole: bool = False) -> DataFrame:
    """(keys, pos, prefix_hash, block_hash, token_count): each block's hash covers all text up to its end.

    A text has ``MOST_BLOCKS`` blocks at most, as the reference guards a request, unless it is read ``whole``.
    """
    length = F.char_length(text)
    n = F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(length / BLOCK_CHARS).cast("int")))
    # The hash of the previous block is computed beside it, so no window over blocks is needed.
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.md5(F.call_function("substring", F.col(text), F.lit(1), i * BLOCK_CHARS).cast("binary")))
    if whole:
        hashes = _whole_hashes(text)
    rows = prompts.select(*keys, length.alias("_length"), hashes.alias("_hashes")).select(*keys, "_length", "_hashes", F.posexplode("_hashes").alias("pos", "block_hash"))
    parent = F.when(F.col("pos") == 0, "root").otherwise(F.element_at("_hashes", F.greatest(F.col("pos"), F.lit(1))))
    size = F.least(F.lit(BLOCK_CHARS), F.col("_length") - F.col("pos") * BLOCK_CHARS)
    return rows.select(*keys, F.col("pos").cast("long").alias("pos"), parent.alias("prefix_hash"), "block_hash", F.greatest(F.lit(1), div_ceil(size, 4)).cast("long").alias("token_count"))


TEXT_BLOCKS_SQL = """SELECT {keys}, CAST(i AS BIGINT) AS pos, CASE WHEN i = 0 THEN 'root' ELSE md5(substr(text, 1, CAST(i * 256 AS BIGINT))) END AS prefix_hash,
  md5(substr(text, 1, CAST((i + 1) * 256 AS BIGINT))) AS block_hash, CAST(greatest(1, (least(256, length(text) - i * 256) + 3) // 4) AS BIGINT) AS token_count
FROM (SELECT *, unnest(range(greatest(1, least(64, CAST(ceil(length(text) / 256.0) AS BIGINT))))) AS i FROM {source}) t"""


@query("prefix_blocks_docs", TEXT_BLOCKS_SQL.format(keys="doc_id", source="documents"))
def prefix_blocks_docs(spark: SparkSession, sf: str) -> DataFrame:
    return text_blocks(S.table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text")


WHOLE_BLOCKS_SQL = TEXT_BLOCKS_SQL.replace("least(64, CAST(ceil(length(text) / 256.0) AS BIGINT))", "CAST(ceil(length(text) / 256.0) AS BIGINT)")


@query("prefix_blocks_docs_whole", WHOLE_BLOCKS_SQL.format(keys="doc_id", source="documents"))
def prefix_blocks_docs_whole(spark: SparkSession, sf: str) -> DataFrame:
    return text_blocks(S.table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text", whole=True)


CHAT_SQL = """SELECT conv_id, turn, text FROM (SELECT c.conv_id, c.turn, c.role, concat(b.text, string_agg(concat(c.role, ':', c.text, chr(10)), '') OVER (PARTITION BY c.conv_id ORDER BY c.turn)) AS text
  FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % 4) t WHERE role = 'user'"""


def chat_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, text): at each user turn, a shared system text and the conversation so far, as much as blocks read.

    A prompt is a prefix of its conversation, so the text that blocks read is gathered once a conversation, from the turns
    that begin inside it, and each turn takes its share.
    """
    most = BLOCK_CHARS * MOST_BLOCKS
    turns, system = S.table(spark, sf, "conversations"), S.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("system"))
    said = F.concat("role", F.lit(":"), "text", F.lit("\n"))
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select("conv_id", "turn", "role", said.alias("said")).withColumn("size", F.coalesce(F.char_length("said"), F.lit(0)))
    rows = rows.withColumn("upto", F.sum("size").over(so_far))
    told = rows.where(F.col("upto") - F.col("size") < most).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.left("said", F.lit(most)).alias("said")))).alias("x"))
    told = told.select("conv_id", F.array_join("x.said", "").alias("told"))
    asked = rows.where("role = 'user'").select("conv_id", "turn", "upto").join(told, "conv_id").join(system, F.col("conv_id") % 4 == F.col("item_id"))
    return asked.select("conv_id", "turn", F.concat("system", F.left("told", F.least("upto", F.lit(most)).cast("int"))).alias("text"))


@query("prefix_blocks_chat", "WITH chat AS (" + CHAT_SQL + ") " + TEXT_BLOCKS_SQL.format(keys="conv_id, turn", source="chat"))
def prefix_blocks_chat(spark: SparkSession, sf: str) -> DataFrame:
    return text_blocks(chat_prompts(spark, sf), ["conv_id", "turn"], "text")


@query("chat_prefix_reuse", "WITH chat AS (" + CHAT_SQL + "), b AS (" + TEXT_BLOCKS_SQL.format(keys="conv_id, turn", source="chat") + """)
SELECT turn, CAST(count(*) AS BIGINT) AS n_blocks, CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM b p WHERE p.block_hash = b.block_hash AND (p.turn < b.turn OR p.turn = b.turn AND p.conv_id < b.conv_id))) AS BIGINT) AS reused
FROM b GROUP BY turn""")
def chat_prefix_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that an earlier prompt already made, by turn: the order is (turn, conversation)."""
    blocks = text_blocks(chat_prompts(spark, sf), ["conv_id", "turn"], "text").select("conv_id", "turn", "block_hash")
    first = blocks.groupBy("block_hash").agg(F.min(F.struct("turn", "conv_id")).alias("first"))
    rows = blocks.join(first, "block_hash")
    return rows.groupBy("turn").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("first") < F.struct("turn", "conv_id")).alias("reused"))


def hinted_blocks(hints: DataFrame) -> DataFrame:
    """Chains from hints (request_id, session_id, hashes, tokens): the first parent is the session, or root."""
    rows = hints.select("request_id", "session_id", "hashes", "tokens", F.posexplode("hashes").alias("pos", "block_hash"))
    parent = F.when(F.col("pos") == 0, F.coalesce("session_id", F.lit("root"))).otherwise(F.element_at("hashes", F.greatest("pos", F.lit(1))))
    return rows.select("request_id", F.col("pos").cast("long").alias("pos"), parent.alias("prefix_hash"), "block_hash", F.coalesce("tokens", F.lit(64)).cast("long").alias("token_count"))


@query("hint_block_chain", S.sql("""
SELECT request_id, pos, CASE WHEN pos = 0 THEN coalesce(CASE WHEN request_no % 2 = 0 THEN concat('s', CAST(request_no % 7 AS VARCHAR)) END, 'root') ELSE concat('b', CAST(first_k + pos - 1 AS VARCHAR)) END AS prefix_hash,
  concat('b', CAST(first_k + pos AS VARCHAR)) AS block_hash, CAST(coalesce(CASE WHEN request_no % 3 = 0 THEN 16 END, 64) AS BIGINT) AS token_count
FROM (SELECT *, unnest(range(n_blocks)) AS pos FROM requests) t""", "requests"))
def hint_block_chain(spark: SparkSession, sf: str) -> DataFrame:
    r = S.requests(spark, sf)
    hashes = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1), lambda i: F.concat(F.lit("b"), (F.col("first_k") + i).cast("string")))
    session = F.when(F.col("request_no") % 2 == 0, F.concat(F.lit("s"), (F.col("request_no") % 7).cast("string")))
    return hinted_blocks(r.select("request_id", session.alias("session_id"), hashes.alias("hashes"), F.when(F.col("request_no") % 3 == 0, 16).alias("tokens")))


SHAPES = """SELECT event_id, concat('{"model":', CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '"m' || CAST(event_id % 3 AS VARCHAR) || '"' END,
  CASE WHEN event_id % 2 = 0 THEN ',"max_tokens":' || CAST(event_id % 300 AS VARCHAR) ELSE '' END,
  CASE WHEN event_id % 7 = 0 THEN ',"kv":{"tenant":"ten' || CAST(event_id % 3 AS VARCHAR) || '","decode_tokens":' || CAST(event_id % 90 AS VARCHAR) || '}' ELSE '' END, '}') AS body FROM events"""


@query("openai_request_shape", "WITH shapes AS (" + SHAPES + """)
SELECT event_id, coalesce(json_extract_string(body, '$.model'), 'unknown-model') AS model_id, coalesce(json_extract_string(body, '$.model'), 'unknown-model') AS tokenizer_id,
  coalesce(json_extract_string(body, '$.kv.tenant'), 'default') AS tenant_id,
  CAST(coalesce(json_extract_string(body, '$.kv.decode_tokens'), json_extract_string(body, '$.max_tokens'), '128') AS BIGINT) AS decode_tokens FROM shapes""")
def openai_request_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of chat requests with optional hints, as shapes with defaults."""
    e = F.col("event_id")
    model = F.when(e % 5 == 0, "null").otherwise(F.concat(F.lit('"m'), (e % 3).cast("string"), F.lit('"')))
    most = F.when(e % 2 == 0, F.concat(F.lit(',"max_tokens":'), (e % 300).cast("string"))).otherwise("")
    hint = F.when(e % 7 == 0, F.concat(F.lit(',"kv":{"tenant":"ten'), (e % 3).cast("string"), F.lit('","decode_tokens":'), (e % 90).cast("string"), F.lit("}"))).otherwise("")
    return request_shapes(S.table(spark, sf, "events").select("event_id", F.concat(F.lit('{"model":'), model, most, hint, F.lit("}")).alias("body")))


def request_shapes(bodies: DataFrame) -> DataFrame:
    schema = "model string, tokenizer string, max_tokens bigint, kv struct<tenant:string, decode_tokens:bigint>"
    rows = bodies.withColumn("r", F.from_json("body", schema))
    model: Column = F.coalesce("r.model", F.lit("unknown-model"))
    return rows.select("event_id", model.alias("model_id"), F.coalesce("r.tokenizer", model).alias("tokenizer_id"), F.coalesce("r.kv.tenant", F.lit("default")).alias("tenant_id"), F.coalesce("r.kv.decode_tokens", "r.max_tokens", F.lit(128)).cast("long").alias("decode_tokens"))


@query("slot_mapping", S.sql("""
SELECT request_id, pos * 64 + o AS token_index, (first_k + pos) * 64 + o AS slot FROM (SELECT *, unnest(range(n_blocks)) AS pos FROM requests) t, range(64) r(o)
WHERE pos * 64 + o < ((n_blocks * 64 - decode_tokens % 7) - 1) // 16 * 16""", "requests"))
def slot_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Slots of a request's tokens, aligned down to whole runs of 16 that leave at least one token to compute."""
    r = S.requests(spark, sf)
    tokens = F.col("n_blocks") * 64 - F.col("decode_tokens") % 7
    aligned = F.floor((tokens - 1) / 16) * 16
    rows = r.select("request_id", "first_k", F.explode(F.sequence(F.lit(0).cast("long"), aligned - 1)).alias("token_index"))
    return rows.select("request_id", "token_index", (F.col("first_k") * 64 + F.col("token_index")).alias("slot"))


#: The size of the index benchmark's workload.
BENCH_REQUESTS, BENCH_SHARED, BENCH_OWN, BENCH_BYTES = 2000, 16, 4, 4 << 20
PUTS_SQL = """SELECT concat('req-', CAST(r AS VARCHAR)) AS request_id, i AS pos, CASE WHEN i < 16 THEN concat('shared-', CAST(i AS VARCHAR)) ELSE concat('uniq-', CAST(r AS VARCHAR), '-', CAST(i - 16 AS VARCHAR)) END AS block_hash,
CASE WHEN i < 16 THEN concat('sp-', CAST(i AS VARCHAR)) ELSE concat('uq-', CAST(r AS VARCHAR), '-', CAST(i - 16 AS VARCHAR)) END AS prefix_hash, r * 20 + i AS seq FROM range(2000) t(r), range(20) u(i)"""


def bench_puts(spark: SparkSession, requests: int = BENCH_REQUESTS, shared: int = BENCH_SHARED, own: int = BENCH_OWN) -> DataFrame:
    """The puts of the index benchmark in order: all requests share their leading blocks, the others are their own."""
    rows = spark.range(requests).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shared + own - 1).cast("long"))).alias("pos"))
    named = lambda both, one: F.when(F.col("pos") < shared, F.format_string(f"{both}-%d", "pos")).otherwise(F.format_string(f"{one}-%d-%d", "r", F.col("pos") - shared))
    seq = (F.col("r") * (shared + own) + F.col("pos")).alias("seq")
    return rows.select(F.format_string("req-%d", "r").alias("request_id"), "pos", named("shared", "uniq").alias("block_hash"), named("sp", "uq").alias("prefix_hash"), seq)


@query("bench_workload", f"SELECT request_id, pos, block_hash, prefix_hash, seq FROM ({PUTS_SQL}) p")
def bench_workload(spark: SparkSession, sf: str) -> DataFrame:
    return bench_puts(spark)


@query("bench_residency", f"SELECT prefix_hash, block_hash, max(pos) AS block_index, max(seq) AS put_seq, CAST(4194304 AS BIGINT) AS bytes, count(*) AS puts FROM ({PUTS_SQL}) p GROUP BY 1, 2")
def bench_residency(spark: SparkSession, sf: str) -> DataFrame:
    """What the index holds after the benchmark's puts: the last put of each block."""
    last = bench_puts(spark).groupBy("prefix_hash", "block_hash").agg(F.max(F.struct("seq", "pos")).alias("x"), F.count("*").alias("puts"))
    return last.select("prefix_hash", "block_hash", F.col("x.pos").alias("block_index"), F.col("x.seq").alias("put_seq"), F.lit(BENCH_BYTES).cast("long").alias("bytes"), "puts")


@query("fp8_bytes", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(round_even(greatest(-448.0, least(448.0, l_extendedprice / 100.0)), 0) AS BIGINT) & 255 AS BIGINT) AS code FROM lineitem""")
def fp8_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Values clamped to the range of an 8-bit float, rounded half to even, low byte."""
    x = F.rint(F.greatest(F.lit(-448.0), F.least(F.lit(448.0), F.col("l_extendedprice") / 100.0)))
    return S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.cast("long").bitwiseAND(F.lit(255).cast("long")).alias("code"))
