"""The control interval: observations of all tiers, and the actions that rules draw from one snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachefold.functions.columns import percent
from cachefold.functions.frames import first_by, small
from cachefold.operators.planner import decision_view, plan_sql
from cachefold.operators.prefix import ACCESS_SQL, HOLDERS_SQL, accesses, prefix_holders
from cachefold.operators.telemetry import GOODPUT_SQL, OBSERVED_SQL, RATES_SQL, TELEMETRY_SQL, cache_rates, goodput, traces, transfer_observation, transfer_telemetry
from cachefold.plans.registry import query
from cachefold.sources import tables as S

#: The thresholds of the rules.
POLICY = {
    "max_actions": 32, "min_goodput_pct": 95.0, "max_slo_miss_pct": 10.0, "remote_pct": 20.0, "hbm_pct": 90.0, "queue_depth": 16,
    "first_layer_ms": 20.0, "overlap_pct": 50.0, "replicas": 2, "prefix_hits": 8, "queue_per_decode": 512,
}


def data_plane(objects: DataFrame) -> DataFrame:
    """One row (hbm, dram, ssd): the bytes that the object store itself holds in each tier."""
    part = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).cast("long").alias(name)
    return objects.agg(part(F.col("hard_pinned"), "p_hbm"), part(~F.col("hard_pinned") & F.col("soft_pinned"), "p_dram"), part(~F.col("hard_pinned") & ~F.col("soft_pinned"), "p_ssd"))


def tier_state(workers: DataFrame, resident: DataFrame, plane: DataFrame) -> DataFrame:
    """Bytes of each tier as the data plane, the fleet and the index see them, the largest of these, and pressure on fast memory."""
    part = lambda *t: F.coalesce(F.sum(F.when(F.col("tier").isin(*t), F.col("bytes"))), F.lit(0)).cast("long")
    held = resident.agg(part("hbm", "remote_hbm").alias("r_hbm"), part("cpu_dram").alias("r_dram"), part("local_ssd").alias("r_ssd"), part("object_store").alias("object_bytes"))
    fleet = workers.agg(F.sum("hbm_used_bytes").alias("w_hbm"), F.sum("hbm_capacity_bytes").alias("hbm_capacity"))
    rows = held.join(fleet).join(plane).withColumn("hbm_bytes", F.greatest("p_hbm", "r_hbm", "w_hbm"))
    pressure = F.round(percent(F.col("hbm_bytes"), F.col("hbm_capacity")), 9).alias("hbm_pct")
    return rows.select("hbm_bytes", "hbm_capacity", F.greatest("p_dram", "r_dram").alias("dram_bytes"), F.greatest("p_ssd", "r_ssd").alias("ssd_bytes"), "object_bytes", pressure)


TIER_STATE_SQL = """SELECT greatest(p.h, r.h, w.u) AS hbm_bytes, w.c AS hbm_capacity, greatest(p.d, r.d) AS dram_bytes, greatest(p.s, r.s) AS ssd_bytes, r.o AS object_bytes, round(100.0::DOUBLE * greatest(p.h, r.h, w.u) / w.c, 9) AS hbm_pct FROM
  (SELECT CAST(coalesce(sum(bytes) FILTER (WHERE tier IN ('hbm', 'remote_hbm')), 0) AS BIGINT) AS h, CAST(coalesce(sum(bytes) FILTER (WHERE tier = 'cpu_dram'), 0) AS BIGINT) AS d,
    CAST(coalesce(sum(bytes) FILTER (WHERE tier = 'local_ssd'), 0) AS BIGINT) AS s, CAST(coalesce(sum(bytes) FILTER (WHERE tier = 'object_store'), 0) AS BIGINT) AS o FROM residency) r,
  (SELECT CAST(coalesce(sum(size) FILTER (WHERE hard_pinned), 0) AS BIGINT) AS h, CAST(coalesce(sum(size) FILTER (WHERE NOT hard_pinned AND soft_pinned), 0) AS BIGINT) AS d, CAST(coalesce(sum(size) FILTER (WHERE NOT hard_pinned AND NOT soft_pinned), 0) AS BIGINT) AS s FROM objects) p,
  (SELECT CAST(sum(hbm_used_bytes) AS BIGINT) AS u, CAST(sum(hbm_capacity_bytes) AS BIGINT) AS c FROM workers) w"""


@query("tier_observation", S.sql("SELECT * FROM t", "residency", "workers", "objects", t=TIER_STATE_SQL))
def tier_observation(spark: SparkSession, sf: str) -> DataFrame:
    return tier_state(S.workers(spark, sf), S.residency(spark, sf), data_plane(S.objects(spark, sf)))


@query("most_pressured_worker", S.sql("SELECT worker_id FROM workers WHERE hbm_capacity_bytes > 0 ORDER BY CAST(hbm_used_bytes AS HUGEINT) * 1000000 // hbm_capacity_bytes DESC, worker_id DESC LIMIT 1", "workers"))
def most_pressured_worker(spark: SparkSession, sf: str) -> DataFrame:
    return pressured(S.workers(spark, sf))


def pressured(workers: DataFrame) -> DataFrame:
    """The worker whose fast memory is fullest; the later id on ties. Capacities are equal or compared by exact ratio."""
    share = F.floor(F.col("hbm_used_bytes").cast("decimal(38,0)") * 1000000 / F.col("hbm_capacity_bytes"))
    return workers.where("hbm_capacity_bytes > 0").orderBy(share.desc(), F.col("worker_id").desc()).limit(1).select("worker_id")


def rule_actions(snapshot: DataFrame, hot: DataFrame, workers: DataFrame) -> DataFrame:
    """(seq, kind, target, source, prefix, tier, value), in the order of the rules and cut at the policy's maximum.

    snapshot: one row (ttft_ms, budget_ms, goodput_pct, remote_pct, first_layer_ms, full_ms, overlap_pct, queue_depth, hbm_pct).
    hot: (tenant_id, adapter_id, prefix_hash, accesses, holders). An unknown observation never triggers a rule.
    """
    p = POLICY
    text = lambda v: F.lit(v).cast("string")
    yes = lambda c: F.coalesce(c, F.lit(False))

    def act(rows: DataFrame, stage: int, kind: str, value: Column | str, target=None, source=None, prefix=None, tier=None) -> DataFrame:  # noqa: ANN001
        order = F.col("order") if "order" in rows.columns else F.lit(0)
        pick = lambda c: F.col(c) if c else text(None)
        return rows.select(F.lit(stage).alias("stage"), order.cast("long").alias("order"), F.lit(kind).alias("kind"), pick(target).alias("target"), pick(source).alias("source"), pick(prefix).alias("prefix"), text(tier).alias("tier"), (text(value) if isinstance(value, str) else value).alias("value"))

    fleet = workers.agg(
        F.bool_or(F.col("role").isin("prefill", "aggregated")).alias("can_prefill"), F.bool_or(F.col("role").isin("decode", "aggregated")).alias("can_decode"), F.count_if(F.col("role") == "prefill").alias("n_prefill"),
        F.count_if(F.col("role") == "decode").alias("n_decode"), F.sum("queued_prefill_tokens").alias("queued"), F.sum("running_decodes").alias("running"),
    )
    miss = 100.0 - F.col("goodput_pct")
    slo_bad = yes(F.col("ttft_ms") > F.col("budget_ms")) | yes(F.col("goodput_pct") < p["min_goodput_pct"]) | yes(miss > p["max_slo_miss_pct"])
    share = F.when((F.col("n_prefill") == 0) | (F.col("n_decode") == 0), "split_aggregated_worker_for_pd").when(F.col("queued") > p["queue_per_decode"] * F.col("running"), "increase_prefill_share").otherwise("rebalance_prefill_decode_share")
    out = act(snapshot.join(fleet).where(slo_bad & F.col("can_prefill") & F.col("can_decode")), 1, "adjust_pd_ratio", share)

    slow = F.col("full_ms") > p["first_layer_ms"]
    remote_bad = yes(F.col("remote_pct") >= p["remote_pct"]) | yes(slow & (F.col("first_layer_ms").isNull() | (F.col("full_ms") > F.col("first_layer_ms"))))
    few = hot.where((F.col("accesses") >= p["prefix_hits"]) & (F.size("holders") > 0) & (F.size("holders") < p["replicas"]))
    free = few.crossJoin(small(workers.select("worker_id", "running_decodes", "queued_prefill_tokens"))).where(~F.array_contains("holders", F.col("worker_id")))
    free = first_by(free, ["tenant_id", "adapter_id", "prefix_hash"], [F.col("running_decodes").asc(), F.col("queued_prefill_tokens").asc(), F.col("worker_id").asc()])
    top = free.orderBy(F.desc("accesses"), "prefix_hash", "tenant_id", F.col("adapter_id").asc_nulls_last()).limit(p["max_actions"])
    place = F.row_number().over(Window.orderBy(F.desc("accesses"), "prefix_hash", "tenant_id", F.col("adapter_id").asc_nulls_last()))  # over max_actions rows at most
    top = top.withColumn("order", place).withColumn("first_holder", F.element_at("holders", 1))
    copies = act(snapshot.where(remote_bad).select().join(top), 2, "replicate_hot_prefix", f"target_replicas={p['replicas']}", "worker_id", "first_holder", "prefix_hash", "hbm")
    full = yes(F.col("hbm_pct") >= p["hbm_pct"])
    demote = act(snapshot.where(full).select().join(pressured(workers), how="left"), 3, "demote_prefix", "demote_cold_hbm_blocks", "worker_id", None, None, "cpu_dram")
    queued = yes(F.col("queue_depth") >= p["queue_depth"])
    tune = yes(F.col("first_layer_ms") > p["first_layer_ms"]) | queued | yes(slow & (F.col("overlap_pct") < p["overlap_pct"]))
    depth = act(snapshot.where(tune), 4, "tune_transfer_depth", "prioritize_first_layer_or_switch_backend")
    reject = act(snapshot.where(yes(miss > p["max_slo_miss_pct"]) & queued & full), 5, "admission_reject", "enable_overload_rejection")
    rows = out.unionByName(copies).unionByName(demote).unionByName(depth).unionByName(reject)
    seq = F.row_number().over(Window.orderBy("stage", "order"))  # five rules and max_actions copies at most
    return rows.withColumn("seq", seq).where(F.col("seq") <= p["max_actions"]).drop("stage", "order")


def snapshot_of(spark: SparkSession, sf: str) -> DataFrame:
    trace = traces(spark, sf)
    slo = goodput(trace, 2 + F.col("ord")).select(F.col("mean_ttft_ms").alias("ttft_ms"), F.col("mean_budget_ms").alias("budget_ms"), "goodput_pct")
    moved = transfer_observation(transfer_telemetry(S.layer_transfers(spark, sf))).select("first_layer_ms", "full_ms", "overlap_pct", "queue_depth")
    tiers = tier_state(S.workers(spark, sf), S.residency(spark, sf), data_plane(S.objects(spark, sf))).select("hbm_pct")
    return slo.join(cache_rates(trace).select("remote_pct")).join(moved).join(tiers)


@query("cosched_actions", plan_sql("""SELECT CAST(row_number() OVER (ORDER BY stage, ord_no) AS INTEGER) AS seq, kind, target, source, prefix, tier, value FROM (
SELECT 1 AS stage, 0 AS ord_no, 'adjust_pd_ratio' AS kind, NULL AS target, NULL AS source, NULL AS prefix, NULL AS tier, CASE WHEN (SELECT count(*) FROM workers WHERE role = 'prefill') = 0 OR (SELECT count(*) FROM workers WHERE role = 'decode') = 0 THEN 'split_aggregated_worker_for_pd'
    WHEN (SELECT sum(queued_prefill_tokens) > 512 * sum(running_decodes) FROM workers) THEN 'increase_prefill_share' ELSE 'rebalance_prefill_decode_share' END AS value FROM g WHERE mean_ttft_ms > mean_budget_ms OR goodput_pct < 95 OR 100 - goodput_pct > 10
UNION ALL SELECT 2, row_number() OVER (ORDER BY accesses DESC, prefix_hash, tenant_id, adapter_id NULLS LAST), 'replicate_hot_prefix', (SELECT w.worker_id FROM workers w WHERE NOT list_contains(h.holders, w.worker_id) ORDER BY running_decodes, queued_prefill_tokens, worker_id LIMIT 1), h.holders[1], prefix_hash, 'hbm', 'target_replicas=2'
  FROM h, rt, o WHERE accesses >= 8 AND len(holders) < 2 AND (remote_pct >= 20 OR full_ms > 20 AND full_ms > first_layer_ms)
UNION ALL SELECT 3, 0, 'demote_prefix', (SELECT worker_id FROM workers ORDER BY CAST(hbm_used_bytes AS HUGEINT) * 1000000 // hbm_capacity_bytes DESC, worker_id DESC LIMIT 1), NULL, NULL, 'cpu_dram', 'demote_cold_hbm_blocks' FROM t WHERE hbm_pct >= 90
UNION ALL SELECT 4, 0, 'tune_transfer_depth', NULL, NULL, NULL, NULL, 'prioritize_first_layer_or_switch_backend' FROM o WHERE first_layer_ms > 20 OR queue_depth >= 16 OR full_ms > 20 AND overlap_pct < 50
UNION ALL SELECT 5, 0, 'admission_reject', NULL, NULL, NULL, NULL, 'enable_overload_rejection' FROM g, o, t WHERE 100 - goodput_pct > 10 AND queue_depth >= 16 AND hbm_pct >= 90) a QUALIFY row_number() OVER (ORDER BY stage, ord_no) <= 32""",
  "layer_transfers", "objects", d=decision_view("greedy"), g=GOODPUT_SQL, rt=RATES_SQL, tele=TELEMETRY_SQL, o=OBSERVED_SQL, t=TIER_STATE_SQL, acc=ACCESS_SQL, h=HOLDERS_SQL))
def cosched_actions(spark: SparkSession, sf: str) -> DataFrame:
    hot = prefix_holders(accesses(S.request_blocks(spark, sf)), S.residency(spark, sf))
    return rule_actions(snapshot_of(spark, sf), hot, S.workers(spark, sf))
