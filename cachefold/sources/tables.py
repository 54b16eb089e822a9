"""Cache-state tables derived from the benchmark tables: as DataFrames, and as SQL views for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _c(name: str):  # noqa: ANN202
    return F.col(name)


def _long(name: str):  # noqa: ANN202
    return F.col(name).cast("long")


WORKERS = 8


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fleet: eight workers, each made of its share of all suppliers."""
    rows = table(spark, sf_dir, "supplier").groupBy((_c("s_suppkey") % WORKERS).cast("long").alias("ord"))
    rows = rows.agg(F.sum(F.floor(F.abs("s_acctbal")).cast("long")).alias("balance"), F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"))
    role = F.when(_c("ord") % 4 == 0, "prefill").when(_c("ord") % 4 == 1, "decode").otherwise("aggregated")
    return rows.select(
        F.concat(F.lit("w"), _c("ord").cast("string")).alias("worker_id"),
        "ord",
        role.alias("role"),
        F.concat(F.lit("dom"), (_c("ord") % 2).cast("string")).alias("locality_domain"),
        F.lit(85899345920).cast("long").alias("hbm_capacity_bytes"),
        (F.floor(_c("balance") / _c("n")).cast("long") * 8000000).alias("hbm_used_bytes"),
        ((_c("keys") * 37) % 2000).cast("long").alias("queued_prefill_tokens"),
        ((_c("keys") * 5) % 7).cast("long").alias("running_decodes"),
    )


def kv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log; ``seq`` is the order of arrival."""
    return kv_events_of(table(spark, sf_dir, "events"))


def kv_events_of(events: DataFrame) -> DataFrame:
    rows = events.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("long"))
    op = F.when((_c("event_type") == "signup") & (_c("event_id") % 40 == 0), "all_blocks_cleared").when(_c("event_type") == "error", "block_removed").otherwise("block_stored")
    tier = F.when(_c("event_type") == "click", "cpu_dram").when(_c("event_type") == "purchase", "local_ssd").otherwise("hbm")
    return rows.select(
        _c("event_id").alias("seq"),
        F.concat(F.lit("w"), (_c("user_id") % 8).cast("string")).alias("worker_id"),
        op.alias("op"),
        tier.alias("tier"),
        F.concat(F.lit("ten"), (_c("user_id") % 3).cast("string")).alias("tenant_id"),
        F.when(_c("user_id") % 5 == 0, "lora-a").alias("adapter_id"),
        F.concat(F.lit("b"), _c("k").cast("string")).alias("block_hash"),
        F.when(_c("k") % 8 == 0, "root").otherwise(F.concat(F.lit("b"), (_c("k") - 1).cast("string"))).alias("prefix_hash"),
        (_c("k") % 8).alias("block_index"),
        F.lit(64).cast("long").alias("token_count"),
        (F.lit(4194304) - _c("event_id") % 5 * 524288).cast("long").alias("bytes"),
    )


def residency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the event log leaves resident."""
    from cachefold.operators.index import fold_events

    return fold_events(kv_events(spark, sf_dir))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        _c("user_id").alias("request_no"),
        F.concat(F.lit("req-"), _c("user_id").cast("string")).alias("request_id"),
        F.concat(F.lit("ten"), (_c("user_id") % 3).cast("string")).alias("tenant_id"),
        F.when(_c("user_id") % 5 == 0, "lora-a").alias("adapter_id"),
        ((_c("user_id") * 7) % 12 * 8).cast("long").alias("first_k"),
        (1 + _c("user_id") % 8).cast("long").alias("n_blocks"),
        (32 + _c("user_id") % 4 * 32).cast("long").alias("decode_tokens"),
        F.lit(800).cast("long").alias("ttft_ms"),
        F.lit(80).cast("long").alias("tpot_ms"),
    )


def request_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a block of each request, in order, each with its parent."""
    rows = requests(spark, sf_dir).withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), _c("n_blocks") - 1)))
    return rows.select(
        "request_no", "request_id", "tenant_id", "adapter_id", "pos",
        F.concat(F.lit("b"), (_c("first_k") + _c("pos")).cast("string")).alias("block_hash"),
        F.when(_c("pos") == 0, "root").otherwise(F.concat(F.lit("b"), (_c("first_k") + _c("pos") - 1).cast("string"))).alias("prefix_hash"),
        F.lit(64).cast("long").alias("token_count"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-hash blocks under several identities."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(_c("text").cast("binary")).alias("block_hash"),
        F.concat(F.lit("model-"), "lang").alias("model_id"),
        F.concat(F.lit("tok-"), "lang").alias("tokenizer_id"),
        F.when(_c("doc_id") % 3 == 0, F.concat(F.lit("lora-"), (_c("doc_id") % 2).cast("string"))).alias("adapter_id"),
        _c("source").alias("tenant_id"),
        F.concat(F.lit("w"), (_c("doc_id") % 8).cast("string")).alias("worker_id"),
        _c("n_chars").alias("bytes"),
    )


def layer_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers of each transfer, numbered from 0."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long") - 1
    return table(spark, sf_dir, "lineitem").select(
        _c("l_orderkey").alias("transfer_id"),
        place.alias("layer_index"),
        (_long("l_quantity") * 65536).alias("layer_bytes"),
        F.floor("l_extendedprice").cast("long").alias("done_us"),
        ((_c("l_returnflag") == "R") & (_c("l_discount") > 0.09)).alias("failed"),
    )


NOW = 1500  # the logical clock of the object store


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("qc/"), "p_brand", F.lit("/"), _c("p_partkey").cast("string")).alias("object_key"),
        _c("p_brand").alias("segment_name"),
        (_long("p_size") * 1048576).alias("size"),
        F.concat(F.lit("ten"), (_c("p_partkey") % 3).cast("string")).alias("tenant_id"),
        (_c("p_partkey") % 4 != 0).alias("complete"),
        (_c("p_partkey") % 11 == 0).alias("soft_pinned"),
        (_c("p_partkey") % 37 == 0).alias("hard_pinned"),
        F.floor("p_retailprice").cast("long").alias("last_access"),
        ((_c("p_partkey") * 13) % 2500).cast("long").alias("lease_until"),
    )


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "workers": ((), """SELECT concat('w', CAST(ord AS VARCHAR)) AS worker_id, CAST(ord AS BIGINT) AS ord,
  CASE ord % 4 WHEN 0 THEN 'prefill' WHEN 1 THEN 'decode' ELSE 'aggregated' END AS role,
  concat('dom', CAST(ord % 2 AS VARCHAR)) AS locality_domain, CAST(85899345920 AS BIGINT) AS hbm_capacity_bytes,
  (balance // n) * 8000000 AS hbm_used_bytes,
  CAST((keys * 37) % 2000 AS BIGINT) AS queued_prefill_tokens, CAST((keys * 5) % 7 AS BIGINT) AS running_decodes
FROM (SELECT s_suppkey % 8 AS ord, CAST(sum(CAST(floor(abs(s_acctbal)) AS BIGINT)) AS BIGINT) AS balance, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS keys FROM supplier GROUP BY 1) t"""),
    "kv_events": ((), """SELECT event_id AS seq, concat('w', CAST(user_id % 8 AS VARCHAR)) AS worker_id,
  CASE WHEN event_type = 'signup' AND event_id % 40 = 0 THEN 'all_blocks_cleared'
       WHEN event_type = 'error' THEN 'block_removed' ELSE 'block_stored' END AS op,
  CASE event_type WHEN 'click' THEN 'cpu_dram' WHEN 'purchase' THEN 'local_ssd' ELSE 'hbm' END AS tier,
  concat('ten', CAST(user_id % 3 AS VARCHAR)) AS tenant_id, CASE WHEN user_id % 5 = 0 THEN 'lora-a' END AS adapter_id,
  concat('b', CAST(k AS VARCHAR)) AS block_hash,
  CASE WHEN k % 8 = 0 THEN 'root' ELSE concat('b', CAST(k - 1 AS VARCHAR)) END AS prefix_hash,
  k % 8 AS block_index, CAST(64 AS BIGINT) AS token_count, CAST(4194304 - event_id % 5 * 524288 AS BIGINT) AS bytes
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events) t"""),
    "residency": (("kv_events",), """SELECT st.* FROM (
  SELECT worker_id, tenant_id, adapter_id, prefix_hash, block_hash, block_index, token_count, tier, max(seq) AS put_seq, arg_max(bytes, seq) AS bytes
  FROM kv_events WHERE op = 'block_stored' GROUP BY ALL) st
LEFT JOIN (SELECT worker_id, tenant_id, adapter_id, block_hash, max(seq) AS rm_seq FROM kv_events WHERE op = 'block_removed' GROUP BY ALL) rm
  ON st.worker_id = rm.worker_id AND st.tenant_id = rm.tenant_id AND st.block_hash = rm.block_hash AND st.adapter_id IS NOT DISTINCT FROM rm.adapter_id
LEFT JOIN (SELECT worker_id, max(seq) AS cl_seq FROM kv_events WHERE op = 'all_blocks_cleared' GROUP BY ALL) cl ON st.worker_id = cl.worker_id
WHERE put_seq > coalesce(rm_seq, -1) AND put_seq > coalesce(cl_seq, -1)"""),
    "requests": ((), """SELECT user_id AS request_no, concat('req-', CAST(user_id AS VARCHAR)) AS request_id,
  concat('ten', CAST(user_id % 3 AS VARCHAR)) AS tenant_id, CASE WHEN user_id % 5 = 0 THEN 'lora-a' END AS adapter_id,
  CAST((user_id * 7) % 12 * 8 AS BIGINT) AS first_k, CAST(1 + user_id % 8 AS BIGINT) AS n_blocks,
  CAST(32 + user_id % 4 * 32 AS BIGINT) AS decode_tokens, CAST(800 AS BIGINT) AS ttft_ms, CAST(80 AS BIGINT) AS tpot_ms
FROM (SELECT DISTINCT user_id FROM events) t"""),
    "request_blocks": (("requests",), """SELECT request_no, request_id, tenant_id, adapter_id, pos, concat('b', CAST(first_k + pos AS VARCHAR)) AS block_hash,
  CASE WHEN pos = 0 THEN 'root' ELSE concat('b', CAST(first_k + pos - 1 AS VARCHAR)) END AS prefix_hash, CAST(64 AS BIGINT) AS token_count
FROM (SELECT *, unnest(range(n_blocks)) AS pos FROM requests) t"""),
    "docs": ((), """SELECT doc_id, md5(text) AS block_hash, concat('model-', lang) AS model_id, concat('tok-', lang) AS tokenizer_id,
  CASE WHEN doc_id % 3 = 0 THEN concat('lora-', CAST(doc_id % 2 AS VARCHAR)) END AS adapter_id,
  source AS tenant_id, concat('w', CAST(doc_id % 8 AS VARCHAR)) AS worker_id, n_chars AS bytes FROM documents"""),
    "layer_transfers": ((), """SELECT l_orderkey AS transfer_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS layer_index,
  CAST(l_quantity AS BIGINT) * 65536 AS layer_bytes, CAST(floor(l_extendedprice) AS BIGINT) AS done_us,
  l_returnflag = 'R' AND l_discount > 0.09 AS failed FROM lineitem"""),
    "objects": ((), """SELECT concat('qc/', p_brand, '/', CAST(p_partkey AS VARCHAR)) AS object_key, p_brand AS segment_name,
  CAST(p_size AS BIGINT) * 1048576 AS size, concat('ten', CAST(p_partkey % 3 AS VARCHAR)) AS tenant_id,
  p_partkey % 4 <> 0 AS complete, p_partkey % 11 = 0 AS soft_pinned, p_partkey % 37 = 0 AS hard_pinned,
  CAST(floor(p_retailprice) AS BIGINT) AS last_access, CAST((p_partkey * 13) % 2500 AS BIGINT) AS lease_until FROM part"""),
}


def sql(body: str, *names: str, **views: str) -> str:
    """``body`` with the named views, those they need, and further ``views`` in front of it."""
    found: dict[str, str] = {}

    def add(name: str) -> None:
        needs, text = VIEWS[name]
        for n in needs:
            add(n)
        found[name] = text

    for n in names:
        add(n)
    found |= views
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in found.items()) + "\n" + body
