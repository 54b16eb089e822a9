"""Residency algebra: folds of the event log, lookups, upserts and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cachefold.functions.columns import tier_of
from cachefold.plans.registry import query
from cachefold.sources import tables as S

KEY = ["tenant_id", "adapter_id", "prefix_hash", "block_hash", "block_index", "token_count"]


def same(left: DataFrame, right: DataFrame, names: list[str]):  # noqa: ANN201
    """Null-safe equality of the named columns; a missing adapter matches only a missing adapter."""
    on = F.lit(True)
    for n in names:
        on = on & (left[n].eqNullSafe(right[n]) if n == "adapter_id" else left[n] == right[n])
    return on


def fold_events(events: DataFrame, precise: bool = True) -> DataFrame:
    """The rows that a log leaves resident: the last store of a key, worker and tier, unless removed or cleared later.

    A later store replaces an earlier one, so the last one's bytes count. ``precise=False`` ignores removals, as a prefix
    table does that hears of stores and lost workers only. The last of each key and operation is a partial aggregate, so
    hot keys are folded before they are shuffled; stores and removals of a block meet in a second one, without a join.
    """
    names = ["worker_id", "tenant_id", "adapter_id", "block_hash"]
    rest = [k for k in KEY if k not in names]
    last = F.max(F.struct("seq", "bytes")).alias("last")
    wanted = ["block_stored", "block_removed"] if precise else ["block_stored"]
    latest = events.where(F.col("op").isin(wanted)).groupBy("worker_id", *KEY, "tier", "op").agg(last)
    out = latest.select("worker_id", *KEY, "tier", F.col("last.seq").alias("put_seq"), F.col("last.bytes").alias("bytes"))
    if precise:
        held = F.when(F.col("op") == "block_stored", F.struct(*rest, "tier", F.col("last.seq").alias("put_seq"), F.col("last.bytes").alias("bytes")))
        gone = F.max(F.when(F.col("op") == "block_removed", F.col("last.seq"))).alias("rm_seq")
        block = latest.groupBy(*names).agg(gone, F.collect_list(held).alias("held"))
        out = block.select(*names, F.explode(F.filter("held", lambda x: x["put_seq"] > F.coalesce("rm_seq", F.lit(-1)))).alias("x")).select(*names, "x.*")
    cleared = events.where("op = 'all_blocks_cleared'").groupBy("worker_id").agg(F.max("seq").alias("cl_seq"))
    out = out.join(cleared, "worker_id", "left").where(F.col("put_seq") > F.coalesce("cl_seq", F.lit(-1)))
    return out.select("worker_id", *KEY, "tier", "put_seq", "bytes")


def upsert(resident: DataFrame, puts: DataFrame) -> DataFrame:
    """Later puts replace rows of the same key, worker and tier; puts carry larger ``put_seq``."""
    rows = resident.unionByName(puts)
    last = F.max(F.struct("put_seq", "bytes")).alias("last")
    return rows.groupBy("worker_id", *KEY, "tier").agg(last).select("worker_id", *KEY, "tier", "last.put_seq", "last.bytes")


@query("residency_fold", S.sql("SELECT worker_id, tenant_id, adapter_id, prefix_hash, block_hash, block_index, token_count, tier, put_seq, bytes FROM residency", "residency"))
def residency_fold(spark: SparkSession, sf: str) -> DataFrame:
    return fold_events(S.kv_events(spark, sf))


@query("residency_point_lookup", S.sql("""
SELECT b.request_id, b.pos, CAST(count(r.worker_id) AS BIGINT) AS n_rows, coalesce(string_agg(DISTINCT r.worker_id, ',' ORDER BY r.worker_id), '') AS holders
FROM request_blocks b LEFT JOIN residency r ON b.tenant_id = r.tenant_id AND b.adapter_id IS NOT DISTINCT FROM r.adapter_id
  AND b.prefix_hash = r.prefix_hash AND b.block_hash = r.block_hash AND b.pos = r.block_index AND b.token_count = r.token_count
GROUP BY b.request_id, b.pos""", "residency", "request_blocks"))
def residency_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    blocks = S.request_blocks(spark, sf).withColumnRenamed("pos", "block_index")
    held = S.residency(spark, sf)
    rows = blocks.join(held, same(blocks, held, KEY), "left").select(blocks["request_id"], blocks["block_index"].alias("pos"), "worker_id")
    holders = F.array_join(F.array_sort(F.collect_set("worker_id")), ",")
    return rows.groupBy("request_id", "pos").agg(F.count("worker_id").alias("n_rows"), holders.alias("holders"))


@query("residency_prefix_scan", S.sql("""
SELECT worker_id, block_hash, block_index, tier, put_seq FROM residency WHERE tenant_id = 'ten1' AND adapter_id IS NULL AND prefix_hash = 'root'""", "residency"))
def residency_prefix_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All blocks of one scope behind one prefix; the filter reaches the events before the fold."""
    scope = "tenant_id = 'ten1' and adapter_id is null"
    return fold_events(S.kv_events(spark, sf).where(f"op = 'all_blocks_cleared' or ({scope})")).where(f"{scope} and prefix_hash = 'root'").select("worker_id", "block_hash", "block_index", "tier", "put_seq")


@query("residency_content_hash", S.sql("""
SELECT r.block_hash, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT tenant_id) AS BIGINT) AS n_tenants, CAST(count(DISTINCT worker_id) AS BIGINT) AS n_workers
FROM residency r WHERE r.block_hash IN (SELECT block_hash FROM request_blocks) GROUP BY r.block_hash""", "residency", "request_blocks"))
def residency_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with the content of a wanted block, whatever their scope."""
    wanted = S.request_blocks(spark, sf).select("block_hash")
    rows = S.residency(spark, sf).join(wanted, "block_hash", "left_semi")
    return rows.groupBy("block_hash").agg(F.count("*").alias("n_rows"), F.countDistinct("tenant_id").alias("n_tenants"), F.countDistinct("worker_id").alias("n_workers"))


@query("index_metrics", S.sql("""
SELECT (SELECT count(*) FROM residency) AS resident, (SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM residency) AS bytes,
  CAST(count(*) FILTER (WHERE op = 'block_stored') AS BIGINT) AS puts, CAST(count(*) FILTER (WHERE op = 'block_removed') AS BIGINT) AS removes FROM kv_events""", "residency"))
def index_metrics(spark: SparkSession, sf: str) -> DataFrame:
    events = S.kv_events(spark, sf)
    now = fold_events(events).agg(F.count("*").alias("resident"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))
    log = events.agg(F.count_if(F.col("op") == "block_stored").alias("puts"), F.count_if(F.col("op") == "block_removed").alias("removes"))
    return now.join(log)


@query("tier_bytes", S.sql("""
SELECT worker_id, CAST(coalesce(sum(bytes) FILTER (WHERE tier IN ('hbm', 'remote_hbm')), 0) AS BIGINT) AS hbm_bytes,
  CAST(coalesce(sum(bytes) FILTER (WHERE tier = 'cpu_dram'), 0) AS BIGINT) AS dram_bytes, CAST(coalesce(sum(bytes) FILTER (WHERE tier = 'local_ssd'), 0) AS BIGINT) AS ssd_bytes,
  CAST(coalesce(sum(bytes) FILTER (WHERE tier = 'object_store'), 0) AS BIGINT) AS object_bytes, CAST(count(*) AS BIGINT) AS n_rows
FROM residency GROUP BY worker_id""", "residency"))
def tier_bytes(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda tiers, name: F.sum(F.when(F.col("tier").isin(tiers), F.col("bytes")).otherwise(0)).alias(name)
    return S.residency(spark, sf).groupBy("worker_id").agg(
        part(["hbm", "remote_hbm"], "hbm_bytes"), part(["cpu_dram"], "dram_bytes"), part(["local_ssd"], "ssd_bytes"), part(["object_store"], "object_bytes"), F.count("*").alias("n_rows")
    )


@query("coldest_block", S.sql("""
SELECT worker_id, tier, block_hash, prefix_hash, tenant_id, put_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY worker_id, tier ORDER BY put_seq) AS r FROM residency) t WHERE r = 1""", "residency"))
def coldest_block(spark: SparkSession, sf: str) -> DataFrame:
    coldest = F.min(F.struct("put_seq", "block_hash", "prefix_hash", "tenant_id")).alias("x")
    return S.residency(spark, sf).groupBy("worker_id", "tier").agg(coldest).select("worker_id", "tier", "x.block_hash", "x.prefix_hash", "x.tenant_id", "x.put_seq")


@query("kv_event_ingest_summary", S.sql("""
SELECT e.worker_id, CAST(count(*) FILTER (WHERE op = 'block_stored') AS BIGINT) AS stored, CAST(count(*) FILTER (WHERE op = 'block_removed') AS BIGINT) AS removed,
  bool_or(op = 'all_blocks_cleared') AS cleared, CAST(coalesce(max(n), 0) AS BIGINT) AS total
FROM kv_events e LEFT JOIN (SELECT worker_id, count(*) AS n FROM residency GROUP BY worker_id) r ON e.worker_id = r.worker_id GROUP BY e.worker_id""", "residency"))
def kv_event_ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    events = S.kv_events(spark, sf)
    is_op = lambda op: F.col("op") == op
    log = events.groupBy("worker_id").agg(F.count_if(is_op("block_stored")).alias("stored"), F.count_if(is_op("block_removed")).alias("removed"), F.bool_or(is_op("all_blocks_cleared")).alias("cleared"))
    held = fold_events(events).groupBy("worker_id").agg(F.count("*").alias("n"))
    return log.join(held, "worker_id", "left").select("worker_id", "stored", "removed", "cleared", F.coalesce("n", F.lit(0)).alias("total"))


RAW_EVENTS = """SELECT event_id, CASE event_type WHEN 'click' THEN 'BlockStored' WHEN 'purchase' THEN 'kv_cache_STORE' WHEN 'error' THEN 'BlockRemoved'
    WHEN 'signup' THEN 'AllBlocksCleared' ELSE 'heartbeat' END AS raw_type,
  CASE event_id % 6 WHEN 0 THEN 'GPU' WHEN 1 THEN 'nvme' WHEN 2 THEN 's3' WHEN 3 THEN 'DRAM' WHEN 4 THEN 'tape' END AS medium, user_id % 4 AS block_size, user_id % 5 AS n_tokens FROM events"""


@query("kv_event_normalize", "WITH raw AS (" + RAW_EVENTS + """)
SELECT CASE WHEN contains(lower(raw_type), 'stor') THEN 'block_stored' WHEN contains(lower(raw_type), 'remov') THEN 'block_removed'
    WHEN contains(lower(raw_type), 'clear') THEN 'all_blocks_cleared' END AS op,
  CASE lower(coalesce(medium, 'gpu')) WHEN 'gpu' THEN 'hbm' WHEN 'nvme' THEN 'local_ssd' WHEN 's3' THEN 'object_store' WHEN 'dram' THEN 'cpu_dram' ELSE 'hbm' END AS tier,
  coalesce(nullif(block_size, 0), nullif(n_tokens, 0), 16) AS block_tokens, CAST(count(*) AS BIGINT) AS n
FROM raw WHERE contains(lower(raw_type), 'stor') OR contains(lower(raw_type), 'remov') OR contains(lower(raw_type), 'clear') GROUP BY 1, 2, 3""")
def kv_event_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Engine events with loose type names and media, as operations on tiers; others are dropped."""
    events = S.table(spark, sf, "events")
    kinds = {"click": "BlockStored", "purchase": "kv_cache_STORE", "error": "BlockRemoved", "signup": "AllBlocksCleared"}
    raw_type = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in kinds.items()), F.lit("heartbeat"))
    medium = F.element_at(F.array(*map(F.lit, ["GPU", "nvme", "s3", "DRAM", "tape"]), F.lit(None).cast("string")), (F.col("event_id") % 6 + 1).cast("int"))
    raw = events.select(raw_type.alias("raw_type"), medium.alias("medium"), (F.col("user_id") % 4).alias("block_size"), (F.col("user_id") % 5).alias("n_tokens"))
    return normalized_events(raw).groupBy("op", "tier", "block_tokens").agg(F.count("*").alias("n"))


def normalized_events(raw: DataFrame) -> DataFrame:
    """(op, tier, block_tokens) from (raw_type, medium, block_size, n_tokens)."""
    low = F.lower("raw_type")
    op = F.when(low.contains("stor"), "block_stored").when(low.contains("remov"), "block_removed").when(low.contains("clear"), "all_blocks_cleared")
    positive = lambda c: F.when(F.col(c) != 0, F.col(c))
    rows = raw.select(op.alias("op"), tier_of(F.coalesce("medium", F.lit("gpu"))).alias("tier"), F.coalesce(positive("block_size"), positive("n_tokens"), F.lit(16).cast("long")).alias("block_tokens"))
    return rows.where("op is not null")


BATCH_SCHEMA = (
    "engine_id string, ts_ms long, model_id string, tokenizer_id string, adapter_id string, tenant_id string, bytes_per_block long, "
    "events array<struct<type:string,block_hashes:array<string>,parent_block_hash:string,token_ids:array<long>,block_size:long,medium:string,lora_name:string,bytes_per_block:long>>"
)
#: Fixed value: bytes of a block of which neither event nor batch tells them.
BLOCK_BYTES = 4 << 20


def event_rows(bodies: DataFrame, engines: DataFrame) -> DataFrame:
    """Rows of (batch_no, body), a JSON batch of events each, as operations on blocks: a row a block, or a row a clearing.

    engines: (engine_id, default_model, default_tokenizer, default_tenant). Batches of other engines, and bodies that are
    no JSON, give no rows. What an event does not tell comes from its batch, then from its engine; the parent of a block
    is the block before it, of the first one the event's parent, or root.
    """
    b = bodies.select("batch_no", F.from_json("body", BATCH_SCHEMA).alias("b")).select("batch_no", "b.*").join(engines, "engine_id")
    e = b.select(
        "batch_no", "engine_id", F.coalesce("ts_ms", F.lit(0).cast("long")).alias("ts_ms"), F.coalesce("model_id", "default_model").alias("model_id"), F.coalesce("tokenizer_id", "default_tokenizer").alias("tokenizer_id"),
        F.coalesce("tenant_id", "default_tenant").alias("tenant_id"), "adapter_id", F.col("bytes_per_block").alias("batch_bytes"), F.posexplode("events").alias("event_no", "e"),
    )
    stored, cleared = F.col("e.type") == "block_stored", F.col("e.type") == "all_blocks_cleared"
    hashes = F.when(cleared, F.array(F.lit(None).cast("string"))).otherwise(F.col("e.block_hashes"))
    rows = e.where("e.type in ('block_stored', 'block_removed', 'all_blocks_cleared')").select("*", F.posexplode(hashes).alias("pos", "block_hash"))
    before = F.when(F.col("pos") == 0, F.coalesce("e.parent_block_hash", F.lit("root"))).otherwise(F.element_at("e.block_hashes", F.greatest("pos", F.lit(1))))
    told = lambda c: F.when(stored, c)
    return rows.select(
        "batch_no", "event_no", F.col("engine_id").alias("worker_id"), F.col("e.type").alias("op"), "model_id", "tokenizer_id", "tenant_id",
        F.when(stored, F.coalesce("adapter_id", "e.lora_name")).otherwise(F.col("adapter_id")).alias("adapter_id"), told(before).alias("prefix_hash"), "block_hash", told(F.col("pos").cast("long")).alias("block_index"),
        told(F.col("e.block_size")).alias("token_count"), told(tier_of(F.coalesce("e.medium", F.lit("hbm")))).alias("tier"), told(F.coalesce("e.bytes_per_block", "batch_bytes", F.lit(BLOCK_BYTES))).alias("bytes"), "ts_ms",
    )


def wire_event(kind: Column, hashes: Column, parent: Column, tokens: Column, block_size: Column, medium: Column, lora: Column, typed: bool) -> Column:
    """An engine's event in the JSON form of a batch; hashes and parent are binary and become hexadecimal.

    ``typed`` events have exact kinds and block sizes and default to fast memory; loose ones are told by parts of their
    kind's name, or by having hashes, and their block size falls back to the number of tokens, then to 16.
    """
    low, text = F.lower(F.coalesce(kind, F.lit(""))), lambda h: F.lower(F.hex(h))
    if typed:
        op = F.when(kind == "BlockStored", "block_stored").when(kind == "BlockRemoved", "block_removed").when(kind == "AllBlocksCleared", "all_blocks_cleared")
        where, size = F.coalesce(F.when(medium != "", medium), F.lit("gpu")), block_size
    else:
        op = F.when(low.contains("clear"), "all_blocks_cleared").when(low.contains("remov"), "block_removed").when(low.contains("stor") | (F.size(hashes) > 0), "block_stored")
        where, size = medium, F.coalesce(F.when(block_size != 0, block_size), F.when(F.size(tokens) > 0, F.size(tokens).cast("long")), F.lit(16).cast("long"))
    stored = op == "block_stored"
    return F.struct(
        op.alias("type"), F.when(op != "all_blocks_cleared", F.transform(hashes, text)).alias("block_hashes"), F.when(stored, text(parent)).alias("parent_block_hash"),
        F.when(stored, size).alias("block_size"), F.when(op != "all_blocks_cleared", where).alias("medium"), F.when(stored, lora).alias("lora_name"),
    )


def wire_batches(events: DataFrame, typed: bool) -> DataFrame:
    """(batch_no, body): the event log as engines would send it, eight events a batch, in JSON."""
    e = F.col("event_id")
    kinds = {"click": "BlockStored", "purchase": "BlockStored", "error": "BlockRemoved", "signup": "AllBlocksCleared"} if typed else {"click": "kv_STORED", "purchase": "", "error": "blockRemoved", "signup": "cleared-all"}
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in kinds.items()), F.lit("Heartbeat"))
    n = F.when(kind == "Heartbeat", 0).otherwise(e % 3 + 1)
    hashes = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")), lambda i: F.encode(F.concat(F.lit("h"), (e % 97 + i).cast("string")), "UTF-8"))
    parent = F.when(e % 4 == 0, F.encode(F.concat(F.lit("h"), (e % 97 - 1).cast("string")), "UTF-8"))
    tokens = F.when(e % 5 < 3, F.sequence(F.lit(1).cast("long"), e % 5 + 1)).otherwise(F.array().cast("array<bigint>"))
    medium = F.element_at(F.array(*map(F.lit, ["GPU", "nvme", "s3", "DRAM", ""]), F.lit(None).cast("string")), (e % 6 + 1).cast("int"))
    size = F.lit(32).cast("long") if typed else F.when(e % 7 > 1, e % 7)
    rows = events.withColumn("w", wire_event(kind, F.slice(hashes, F.lit(1), n.cast("int")), parent, tokens, size, medium, F.when(e % 9 == 0, "lora-b"), typed))
    batch = F.floor(e / 8)
    rows = rows.groupBy(batch.alias("batch_no")).agg(F.sort_array(F.collect_list(F.struct("event_id", "w"))).alias("x"), F.min("event_id").alias("first"))
    events_ = F.filter(F.col("x.w"), lambda w: w["type"].isNotNull())
    body = F.struct(
        F.concat(F.lit("w"), (F.col("batch_no") % 10).cast("string")).alias("engine_id"), F.when(F.col("batch_no") % 3 > 0, F.col("first") * 10).alias("ts_ms"), F.when(F.col("batch_no") % 4 == 1, "model-x").alias("model_id"),
        F.when(F.col("batch_no") % 5 == 2, "lora-a").alias("adapter_id"), F.when(F.col("batch_no") % 3 == 1, "ten9").alias("tenant_id"), F.when(F.col("batch_no") % 2 == 1, F.lit(1 << 20).cast("long")).alias("bytes_per_block"), events_.alias("events"),
    )
    return rows.select("batch_no", F.to_json(body).alias("body"))


def engine_defaults(workers: DataFrame) -> DataFrame:
    return workers.select(F.col("worker_id").alias("engine_id"), F.lit("m").alias("default_model"), F.lit("t").alias("default_tokenizer"), F.concat(F.lit("ten"), (F.col("ord") % 3).cast("string")).alias("default_tenant"))


def _wire_sql(typed: bool) -> str:
    op = "CASE event_type WHEN 'click' THEN 'block_stored' WHEN 'purchase' THEN 'block_stored' WHEN 'error' THEN 'block_removed' WHEN 'signup' THEN 'all_blocks_cleared' END"
    tokens = "CASE WHEN event_id % 5 < 3 THEN event_id % 5 + 1 END"
    size = "32" if typed else f"coalesce(CASE WHEN event_id % 7 > 1 THEN event_id % 7 END, {tokens}, 16)"
    return S.sql(f"""SELECT b AS batch_no, CAST(r - 1 AS INTEGER) AS event_no, w.worker_id, op, CASE WHEN b % 4 = 1 THEN 'model-x' ELSE 'm' END AS model_id, 't' AS tokenizer_id, CASE WHEN b % 3 = 1 THEN 'ten9' ELSE concat('ten', CAST(ord % 3 AS VARCHAR)) END AS tenant_id,
  CASE WHEN b % 5 = 2 THEN 'lora-a' WHEN op = 'block_stored' AND event_id % 9 = 0 THEN 'lora-b' END AS adapter_id,
  CASE WHEN op = 'block_stored' THEN CASE WHEN i > 0 THEN lower(hex(concat('h', CAST(event_id % 97 + i - 1 AS VARCHAR)))) WHEN event_id % 4 = 0 THEN lower(hex(concat('h', CAST(event_id % 97 - 1 AS VARCHAR)))) ELSE 'root' END END AS prefix_hash,
  CASE WHEN op <> 'all_blocks_cleared' THEN lower(hex(concat('h', CAST(event_id % 97 + i AS VARCHAR)))) END AS block_hash, CASE WHEN op = 'block_stored' THEN i END AS block_index, CASE WHEN op = 'block_stored' THEN CAST({size} AS BIGINT) END AS token_count,
  CASE WHEN op = 'block_stored' THEN CASE event_id % 6 WHEN 1 THEN 'local_ssd' WHEN 2 THEN 'object_store' WHEN 3 THEN 'cpu_dram' ELSE 'hbm' END END AS tier,
  CASE WHEN op = 'block_stored' THEN CASE WHEN b % 2 = 1 THEN 1048576 ELSE 4194304 END END AS bytes, CASE WHEN b % 3 > 0 THEN first_id * 10 ELSE 0 END AS ts_ms
FROM (SELECT *, unnest(range(CASE WHEN op = 'all_blocks_cleared' THEN 1 ELSE event_id % 3 + 1 END)) AS i FROM (
  SELECT *, row_number() OVER (PARTITION BY b ORDER BY event_id) AS r FROM (SELECT event_id, event_id // 8 AS b, {op} AS op, min(event_id) OVER (PARTITION BY event_id // 8) AS first_id FROM events) x WHERE op IS NOT NULL) y) z
JOIN workers w ON w.worker_id = concat('w', CAST(b % 10 AS VARCHAR))""", "workers")


def _wire(name: str, typed: bool) -> None:
    @query(name, _wire_sql(typed))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return event_rows(wire_batches(S.table(spark, sf, "events"), typed), engine_defaults(S.workers(spark, sf)))


_wire("kv_event_rows", typed=True)
_wire("kv_event_rows_loose", typed=False)


@query("unknown_engines", S.sql("""
SELECT e.worker_id AS engine_id, CASE WHEN w.worker_id IS NULL THEN 'unknown_engine' ELSE 'accepted' END AS outcome, CAST(count(*) AS BIGINT) AS n
FROM (SELECT * REPLACE (concat(worker_id, CASE WHEN seq % 50 = 0 THEN 'x' ELSE '' END) AS worker_id) FROM kv_events) e LEFT JOIN workers w ON e.worker_id = w.worker_id GROUP BY 1, 2""", "kv_events", "workers"))
def unknown_engines(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of engines that no configuration names are rejected, not dropped."""
    events = S.kv_events(spark, sf).select(F.concat("worker_id", F.when(F.col("seq") % 50 == 0, "x").otherwise("")).alias("engine_id"))
    known = S.workers(spark, sf).select("worker_id")
    rows = events.groupBy("engine_id").agg(F.count("*").alias("n")).join(known, F.col("engine_id") == F.col("worker_id"), "left")
    return rows.select("engine_id", F.when(F.col("worker_id").isNull(), "unknown_engine").otherwise("accepted").alias("outcome"), "n")
