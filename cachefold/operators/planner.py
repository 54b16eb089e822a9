"""Routing: the cost of every request on every candidate worker, and the policies that pick one.

The sources of a resident block are gathered into one array (at most fleet x tiers entries) before requests meet them, so
a block that all requests share is one row there; costs on each candidate are then array expressions, and the only other
shuffle is the aggregation by request. A policy is an ordering of the candidates of a request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cachefold.functions.columns import DECODE_US, LOCAL_US, PREFILL_US, QUEUED_US, RUNNING_US, by_value, stable_hash, transfer_us, uniform
from cachefold.functions.frames import first_by, small, with_position
from cachefold.operators.index import KEY, fold_events, same
from cachefold.plans.registry import query
from cachefold.sources import tables as S

CAN_DECODE, CAN_PREFILL = ("decode", "aggregated"), ("prefill", "aggregated")
#: Fixed values of the block-cost policies: overlap credit by tier, tokens a block, load weight.
CREDIT = {"hbm": 1.0, "remote_hbm": 0.75, "cpu_dram": 0.75, "local_ssd": 0.25, "object_store": 0.25}
BLOCK_TOKENS, LOAD_SCALE = 64, 1.0


def candidates(workers: DataFrame) -> DataFrame:
    """Decode-capable workers, or all if there are none; ``slot`` is the place among them, ``fleet`` their number."""
    able = F.col("role").isin(*CAN_DECODE)
    any_able = workers.agg(F.coalesce(F.bool_or(able), F.lit(False)).alias("any_able"))
    rows = workers.join(any_able).where(able | ~F.col("any_able")).drop("any_able")
    return with_position(rows, "ord", "slot").join(rows.agg(F.count("*").alias("fleet")))


def block_sources(blocks: DataFrame, resident: DataFrame, workers: DataFrame) -> DataFrame:
    """The blocks, each with an array of where it lies: (worker, domain, tier, bytes, put_seq); null if nowhere."""
    keyed = blocks.withColumnRenamed("pos", "block_index")
    domains = small(workers.select("worker_id", F.col("locality_domain").alias("domain")))
    held = resident.join(domains, "worker_id", "left").groupBy(*KEY).agg(F.collect_list(F.struct("worker_id", "domain", "tier", "bytes", "put_seq")).alias("sources"))
    joined = keyed.join(held, same(keyed, held, KEY), "left")
    return joined.select("request_id", keyed["block_index"].alias("pos"), *(keyed[c] for c in ("tenant_id", "adapter_id", "prefix_hash", "block_hash", "token_count")), "sources")


def block_choices(blocks: DataFrame, resident: DataFrame, workers: DataFrame) -> DataFrame:
    """Each block on each candidate: reuse in place, fetch, or recompute, and its cost."""
    fleet = small(candidates(workers).select("worker_id", "ord", "slot", "fleet", "locality_domain", "queued_prefill_tokens", "running_decodes"))
    rows = block_sources(blocks, resident, workers).crossJoin(fleet)
    cost = lambda s: transfer_us(s["tier"], s["bytes"], s["worker_id"] == F.col("worker_id"), F.coalesce(s["domain"] == F.col("locality_domain"), F.lit(False)))
    choice = F.array_min(F.transform("sources", lambda s: F.struct(cost(s).alias("cost"), s["worker_id"].alias("source"), s["tier"].alias("tier"), s["bytes"].alias("bytes"))))
    rows = rows.withColumn("best", choice).withColumn("recompute", PREFILL_US * F.col("token_count"))
    use = F.coalesce(F.col("best.cost") < F.col("recompute"), F.lit(False))
    kind = F.when(use & (F.col("best.cost") == LOCAL_US), "local").when(use, "transfer").otherwise("recompute")
    on_worker = F.filter("sources", lambda s: s["worker_id"] == F.col("worker_id"))
    earliest = F.array_min(F.transform(on_worker, lambda s: F.struct(s["put_seq"].alias("put_seq"), s["tier"].alias("tier"))))
    return rows.select(
        "request_id", "pos", "block_hash", "prefix_hash", "worker_id", "ord", "slot", "fleet", "queued_prefill_tokens", "running_decodes", "token_count",
        kind.alias("kind"), F.when(use, F.col("best.cost")).otherwise(F.col("recompute")).alias("cost_us"),
        F.when(use, F.col("best.source")).alias("source_id"), F.when(use, F.col("best.tier")).alias("source_tier"), F.when(use, F.col("best.bytes")).alias("bytes"),
        F.coalesce(by_value(earliest["tier"], CREDIT), F.lit(0.0)).alias("credit"),
    )


def plans(choices: DataFrame, requests: DataFrame) -> DataFrame:
    """One row a request and candidate: counts, estimates and how far they miss the objectives."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    rows = choices.groupBy("request_id", "worker_id", "ord", "slot", "fleet", "queued_prefill_tokens", "running_decodes").agg(
        kind("local").alias("local_hits"), kind("transfer").alias("transfers"), kind("recompute").alias("recomputes"), F.sum("cost_us").alias("cost_us"),
        F.count("*").alias("n_blocks"), F.sum("credit").alias("credit"), F.min_by("prefix_hash", "pos").alias("first_prefix"),
    )
    asked = requests.select("request_id", "request_no", "decode_tokens", "ttft_ms", "tpot_ms")
    rows = rows.join(asked, "request_id")
    rows = rows.withColumn("ttft_us", QUEUED_US * F.col("queued_prefill_tokens") + F.col("cost_us")).withColumn("tpot_us", DECODE_US * F.col("decode_tokens") + RUNNING_US * F.col("running_decodes"))
    late = lambda us, ms: F.greatest(F.col(us) - 1000 * F.col(ms), F.lit(0))
    return rows.withColumn("slo_violation_us", late("ttft_us", "ttft_ms") + late("tpot_us", "tpot_ms"))


def all_plans(spark: SparkSession, sf: str) -> DataFrame:
    choices = block_choices(S.request_blocks(spark, sf), fold_events(S.kv_events(spark, sf)), S.workers(spark, sf))
    return plans(choices, S.requests(spark, sf))


def load() -> Column:
    return F.col("queued_prefill_tokens") + 1000 * F.col("running_decodes")


def block_cost(credit: Column) -> Column:
    """Blocks to prefill, queued ones included and resident ones credited, plus running decodes."""
    blocks = F.col("n_blocks") + F.col("queued_prefill_tokens").cast("double") / BLOCK_TOKENS
    return LOAD_SCALE * F.greatest(blocks - credit, F.lit(0.0)) + F.col("running_decodes").cast("double")


def hashed_slot(key: Column) -> Column:
    """0 for the candidate that a key hashes to."""
    return F.when(stable_hash(key) % F.col("fleet") == F.col("slot"), 0).otherwise(1)


def session() -> Column:
    return F.concat(F.lit("s"), (F.col("request_no") % 7).cast("string"))


def policy_order(name: str) -> list[Column]:
    """The ordering whose first candidate a policy takes; the worker's place breaks ties as the policy does."""
    first, last = F.col("ord").asc(), F.col("ord").desc()
    hits, ttft, viol = F.col("local_hits"), F.col("ttft_us"), F.col("slo_violation_us")
    fits = viol == 0
    orders = {
        "greedy": [(ttft + F.col("tpot_us") + 4 * viol + 1000 * F.col("running_decodes")).asc(), first],
        "least_loaded": [load().asc(), first],
        "prefix_affinity": [hashed_slot(F.coalesce("first_prefix", "request_id")).asc(), first],
        "round_robin": [F.when(F.col("arrival") % F.col("fleet") == F.col("slot"), 0).otherwise(1).asc(), first],
        "slo_aware": [F.when(fits, 0).otherwise(1).asc(), F.when(fits, -hits).otherwise(viol).asc(), F.when(fits, ttft).otherwise(-hits).asc(), F.when(fits, -F.col("ord")).otherwise(F.col("ord")).asc()],
        "session_affinity": [hits.desc(), F.when(hits > 0, 0).otherwise(hashed_slot(session())).asc(), last],
        "dynamo_cost": [block_cost(F.col("credit")).asc(), first],
    }
    return orders[name]


def decide(rows: DataFrame, policy: str) -> DataFrame:
    if policy == "round_robin":
        turns = with_position(rows.select("request_no").distinct(), "request_no", "arrival")
        rows = rows.join(turns, "request_no")
    return first_by(rows, ["request_id"], policy_order(policy))


DECISION = ["request_id", "worker_id", "local_hits", "transfers", "recomputes", "ttft_us", "tpot_us", "slo_violation_us"]

CHOICES_SQL = """SELECT b.request_id, b.pos, w.worker_id, w.ord, w.queued_prefill_tokens, w.running_decodes, any_value(b.block_hash) AS block_hash, any_value(b.prefix_hash) AS prefix_hash, any_value(45 * b.token_count) AS recompute,
  arg_min(struct_pack(c := CASE WHEN r.worker_id = w.worker_id AND r.tier = 'hbm' THEN 5 ELSE
    (CASE r.tier WHEN 'hbm' THEN 20 WHEN 'remote_hbm' THEN 20 WHEN 'cpu_dram' THEN 55 WHEN 'local_ssd' THEN 280 ELSE 1800 END) * greatest(1, CAST(ceil(r.bytes / 1048576.0) AS BIGINT))
    + CASE WHEN r.worker_id = w.worker_id OR coalesce(s.locality_domain = w.locality_domain, false) THEN 0 ELSE 350 END END, s := r.worker_id, t := r.tier),
   struct_pack(c := CASE WHEN r.worker_id = w.worker_id AND r.tier = 'hbm' THEN 5 ELSE
    (CASE r.tier WHEN 'hbm' THEN 20 WHEN 'remote_hbm' THEN 20 WHEN 'cpu_dram' THEN 55 WHEN 'local_ssd' THEN 280 ELSE 1800 END) * greatest(1, CAST(ceil(r.bytes / 1048576.0) AS BIGINT))
    + CASE WHEN r.worker_id = w.worker_id OR coalesce(s.locality_domain = w.locality_domain, false) THEN 0 ELSE 350 END END, s := r.worker_id, t := r.tier)) FILTER (WHERE r.worker_id IS NOT NULL) AS best,
  arg_min(r.tier, r.put_seq) FILTER (WHERE r.worker_id = w.worker_id) AS own_tier
FROM request_blocks b CROSS JOIN cand w LEFT JOIN residency r ON b.tenant_id = r.tenant_id AND b.adapter_id IS NOT DISTINCT FROM r.adapter_id
  AND b.prefix_hash = r.prefix_hash AND b.block_hash = r.block_hash AND b.pos = r.block_index AND b.token_count = r.token_count
LEFT JOIN workers s ON s.worker_id = r.worker_id GROUP BY b.request_id, b.pos, w.worker_id, w.ord, w.queued_prefill_tokens, w.running_decodes"""

PLANS_SQL = """SELECT p.*, q.request_no, 4 * queued_prefill_tokens + cost_us AS ttft_us, 80 * q.decode_tokens + 1500 * running_decodes AS tpot_us,
  greatest(4 * queued_prefill_tokens + cost_us - 1000 * q.ttft_ms, 0) + greatest(80 * q.decode_tokens + 1500 * running_decodes - 1000 * q.tpot_ms, 0) AS slo_violation_us,
  row_number() OVER (PARTITION BY p.request_id ORDER BY ord) - 1 AS slot, count(*) OVER (PARTITION BY p.request_id) AS fleet
FROM (SELECT request_id, worker_id, ord, queued_prefill_tokens, running_decodes, count(*) FILTER (WHERE best.c < recompute AND best.c = 5) AS local_hits,
  count(*) FILTER (WHERE best.c < recompute AND best.c > 5) AS transfers, count(*) FILTER (WHERE best IS NULL OR best.c >= recompute) AS recomputes,
  CAST(sum(CASE WHEN best.c < recompute THEN best.c ELSE recompute END) AS BIGINT) AS cost_us, count(*) AS n_blocks, arg_min(prefix_hash, pos) AS first_prefix,
  sum(CASE own_tier WHEN 'hbm' THEN 1.0::DOUBLE WHEN 'remote_hbm' THEN 0.75 WHEN 'cpu_dram' THEN 0.75 WHEN 'local_ssd' THEN 0.25 WHEN 'object_store' THEN 0.25 ELSE 0.0 END) AS credit
  FROM choices GROUP BY request_id, worker_id, ord, queued_prefill_tokens, running_decodes) p JOIN requests q ON p.request_id = q.request_id"""

PLAN_VIEWS = {
    "cand": "SELECT * FROM workers WHERE role IN ('decode', 'aggregated') OR NOT EXISTS (SELECT 1 FROM workers WHERE role IN ('decode', 'aggregated'))",
    "choices": CHOICES_SQL,
    "plans": PLANS_SQL,
}
HASH = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"
COST = "greatest(n_blocks + queued_prefill_tokens / 64.0::DOUBLE - credit, 0.0::DOUBLE) + running_decodes"
ORDERS_SQL = {
    "greedy": "ttft_us + tpot_us + 4 * slo_violation_us + 1000 * running_decodes, ord",
    "least_loaded": "queued_prefill_tokens + 1000 * running_decodes, ord",
    "prefix_affinity": f"CASE WHEN {HASH.format('first_prefix')} % fleet = slot THEN 0 ELSE 1 END",
    "round_robin": "CASE WHEN (SELECT count(*) FROM requests z WHERE z.request_no < plans.request_no) % fleet = slot THEN 0 ELSE 1 END",
    "slo_aware": "CASE WHEN slo_violation_us = 0 THEN 0 ELSE 1 END, CASE WHEN slo_violation_us = 0 THEN -local_hits ELSE slo_violation_us END, CASE WHEN slo_violation_us = 0 THEN ttft_us ELSE -local_hits END, CASE WHEN slo_violation_us = 0 THEN -ord ELSE ord END",
    "session_affinity": f"local_hits DESC, CASE WHEN local_hits > 0 THEN 0 WHEN {HASH.format('concat(chr(115), CAST(request_no % 7 AS VARCHAR))')} % fleet = slot THEN 0 ELSE 1 END, ord DESC",
    "dynamo_cost": f"{COST}, ord",
}


def plan_sql(body: str, *names: str, **views: str) -> str:
    return S.sql(body, "residency", "request_blocks", "workers", *names, **PLAN_VIEWS, **views)


def decision_view(policy: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {ORDERS_SQL[policy]}) AS rank_no FROM plans) t WHERE rank_no = 1"


@query("candidate_plans", plan_sql("SELECT request_id, worker_id, local_hits, transfers, recomputes, ttft_us, tpot_us, slo_violation_us FROM plans"))
def candidate_plans(spark: SparkSession, sf: str) -> DataFrame:
    return all_plans(spark, sf).select(*DECISION)


def _route(policy: str):  # noqa: ANN202
    @query(f"route_{policy}", plan_sql("SELECT request_id, worker_id, local_hits, transfers, recomputes, ttft_us, tpot_us, slo_violation_us FROM d", d=decision_view(policy)))
    def route(spark: SparkSession, sf: str) -> DataFrame:
        return decide(all_plans(spark, sf), policy).select(*DECISION)

    return route


for _policy in ORDERS_SQL:
    _route(_policy)


def softmax_choice(rows: DataFrame, cost: Column, temperature: float) -> DataFrame:
    """Sample a candidate by softmax of negated costs, scaled by their range; the draw is a hash of the request."""
    from pyspark.sql import Window

    mine = Window.partitionBy("request_id")
    upto = mine.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cost", cost).withColumns({"low": F.min("cost").over(mine), "high": F.max("cost").over(mine)})
    weight = F.when(F.col("high") > F.col("low"), F.exp((F.col("low") - F.col("cost")) / ((F.col("high") - F.col("low")) * temperature))).otherwise(F.when(F.col("slot") == 0, 1.0).otherwise(0.0))
    rows = rows.withColumn("w", weight)
    rows = rows.withColumns({"cdf": F.sum("w").over(upto) / F.sum("w").over(mine), "last": F.max("ord").over(mine)})
    chosen = (uniform(F.col("request_id")) < F.col("cdf")) | (F.col("ord") == F.col("last"))
    return first_by(rows.where(chosen), ["request_id"], [F.col("ord").asc()])


@query("route_dynamo_softmax", plan_sql(f"""SELECT request_id, arg_min(worker_id, ord) AS worker_id FROM (SELECT *, sum(w) OVER (PARTITION BY request_id ORDER BY ord) / sum(w) OVER (PARTITION BY request_id) AS cdf, max(ord) OVER (PARTITION BY request_id) AS last_ord
  FROM (SELECT *, CASE WHEN hi > lo THEN exp((lo - cost) / ((hi - lo) * 0.5)) WHEN slot = 0 THEN 1.0 ELSE 0.0 END AS w FROM
    (SELECT *, min(cost) OVER (PARTITION BY request_id) AS lo, max(cost) OVER (PARTITION BY request_id) AS hi FROM (SELECT *, {COST} AS cost FROM plans) a) b) c) e
WHERE {HASH.format('request_id')} / 4294967296.0::DOUBLE < cdf OR ord = last_ord GROUP BY request_id"""))
def route_dynamo_softmax(spark: SparkSession, sf: str) -> DataFrame:
    return softmax_choice(all_plans(spark, sf), block_cost(F.col("credit")), 0.5).select("request_id", "worker_id")


def actions(choices: DataFrame, decisions: DataFrame, requests: DataFrame, workers: DataFrame) -> DataFrame:
    """The steps of each decision in order: blocks used in place, fetched, computed, and the decode."""
    able = first_by(workers.where(F.col("role").isin(*CAN_PREFILL)).withColumn("all", F.lit(1)), ["all"], [load().asc(), F.col("ord").asc()])
    prefill = able.select(F.col("worker_id").alias("prefill_id"))
    roles = small(workers.select("worker_id", "role"))
    chosen = decisions.select("request_id", "worker_id", "recomputes").join(roles, "worker_id").join(small(prefill), how="left")
    apart = (F.col("role") == "decode") & (F.col("recomputes") > 0) & F.col("prefill_id").isNotNull()
    chosen = chosen.withColumn("mode", F.when(apart, "disaggregated").otherwise("aggregated"))
    blocks = choices.join(chosen.select("request_id", "worker_id", "mode", "prefill_id"), ["request_id", "worker_id"])
    action = F.when(F.col("kind") == "local", "use_local").when(F.col("kind") == "transfer", "fetch").when(F.col("mode") == "disaggregated", "run_prefill").otherwise("recompute")
    stage = F.when(F.col("kind") == "local", 0).when(F.col("kind") == "transfer", 1).otherwise(2)
    where = F.when(F.col("kind") == "transfer", F.col("source_id")).when((F.col("kind") == "recompute") & (F.col("mode") == "disaggregated"), F.col("prefill_id")).otherwise(F.col("worker_id"))
    steps = blocks.select("request_id", stage.alias("stage"), "pos", action.alias("action"), where.alias("at_worker"), "block_hash", F.col("cost_us"), "mode")
    decode = chosen.join(requests.select("request_id", "decode_tokens"), "request_id").select(
        "request_id", F.lit(3).alias("stage"), F.lit(0).cast("long").alias("pos"), F.lit("decode").alias("action"), F.col("worker_id").alias("at_worker"), F.lit(None).cast("string").alias("block_hash"), (DECODE_US * F.col("decode_tokens")).alias("cost_us"), "mode"
    )
    return steps.unionByName(decode)


def greedy_actions(spark: SparkSession, sf: str) -> DataFrame:
    return routed_actions(spark, sf, "greedy")


def routed_actions(spark: SparkSession, sf: str, policy: str) -> DataFrame:
    requests, workers = S.requests(spark, sf), S.workers(spark, sf)
    choices = block_choices(S.request_blocks(spark, sf), fold_events(S.kv_events(spark, sf)), workers)
    return actions(choices, decide(plans(choices, requests), policy), requests, workers)


ACTION_VIEWS = {
    "d": decision_view("greedy"),
    "prefill": "SELECT worker_id AS prefill_id FROM workers WHERE role IN ('prefill', 'aggregated') ORDER BY queued_prefill_tokens + 1000 * running_decodes, ord LIMIT 1",
    "modes": "SELECT d.request_id, d.worker_id, prefill_id, CASE WHEN w.role = 'decode' AND d.recomputes > 0 AND prefill_id IS NOT NULL THEN 'disaggregated' ELSE 'aggregated' END AS mode FROM d JOIN workers w ON w.worker_id = d.worker_id LEFT JOIN prefill ON true",
    "actions": """SELECT c.request_id, CASE WHEN best.c < recompute AND best.c = 5 THEN 0 WHEN best.c < recompute THEN 1 ELSE 2 END AS stage, c.pos,
  CASE WHEN best.c < recompute AND best.c = 5 THEN 'use_local' WHEN best.c < recompute THEN 'fetch' WHEN mode = 'disaggregated' THEN 'run_prefill' ELSE 'recompute' END AS action,
  CASE WHEN best.c < recompute AND best.c > 5 THEN best.s WHEN (best IS NULL OR best.c >= recompute) AND mode = 'disaggregated' THEN prefill_id ELSE c.worker_id END AS at_worker,
  c.block_hash, CAST(CASE WHEN best.c < recompute THEN best.c ELSE recompute END AS BIGINT) AS cost_us, mode FROM choices c JOIN modes m ON c.request_id = m.request_id AND c.worker_id = m.worker_id
UNION ALL SELECT m.request_id, 3, 0, 'decode', m.worker_id, NULL, 80 * decode_tokens, mode FROM modes m JOIN requests q ON q.request_id = m.request_id""",
}


@query("plan_actions", plan_sql("SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY stage, pos) - 1 AS seq, action, at_worker, block_hash, cost_us, mode FROM actions", **ACTION_VIEWS))
def plan_actions(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("request_id").orderBy("stage", "pos")).cast("long") - 1
    return greedy_actions(spark, sf).select("request_id", seq.alias("seq"), "action", "at_worker", "block_hash", "cost_us", "mode")


@query("kv_handoff", plan_sql("SELECT request_id, string_agg(block_hash, ',' ORDER BY pos) AS handed FROM actions WHERE action = 'run_prefill' GROUP BY request_id", **(ACTION_VIEWS | {"d": decision_view("round_robin")})))
def kv_handoff(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks that a separate prefill worker hands to the decode worker, when requests go round."""
    rows = routed_actions(spark, sf, "round_robin").where("action = 'run_prefill'").groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", "block_hash"))).alias("x"))
    return rows.select("request_id", F.array_join(F.col("x.block_hash"), ",").alias("handed"))


@query("fetch_cost_summary", plan_sql("SELECT request_id, CAST(coalesce(sum(cost_us) FILTER (WHERE action = 'fetch'), 0) AS BIGINT) AS total_us, coalesce(min(cost_us) FILTER (WHERE action = 'fetch'), 0) AS first_us FROM actions GROUP BY request_id", **ACTION_VIEWS))
def fetch_cost_summary(spark: SparkSession, sf: str) -> DataFrame:
    cost = F.when(F.col("action") == "fetch", F.col("cost_us"))
    return greedy_actions(spark, sf).groupBy("request_id").agg(F.coalesce(F.sum(cost), F.lit(0)).alias("total_us"), F.coalesce(F.min(cost), F.lit(0)).alias("first_us"))


@query("admission", plan_sql("""SELECT request_id, CASE WHEN slo_violation_us > 2000 THEN 'reject' ELSE 'admit' END AS decision,
  CASE WHEN slo_violation_us > 2000 THEN concat('slo violation ', CAST(slo_violation_us AS VARCHAR), ' us over limit 2000') END AS reason FROM d""", d=decision_view("greedy")))
def admission(spark: SparkSession, sf: str, limit: int | None = 2000) -> DataFrame:
    rows = decide(all_plans(spark, sf), "greedy")
    over = F.lit(False) if limit is None else F.col("slo_violation_us") > limit
    reason = F.concat(F.lit("slo violation "), F.col("slo_violation_us").cast("string"), F.lit(f" us over limit {limit}"))
    return rows.select("request_id", F.when(over, "reject").otherwise("admit").alias("decision"), F.when(over, reason).alias("reason"))


@query("placement_feedback", plan_sql("""SELECT worker_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE put_seq > 1000000000000) AS BIGINT) AS placed FROM (
  SELECT worker_id, tenant_id, adapter_id, prefix_hash, block_hash, block_index, token_count, tier, max(put_seq) AS put_seq FROM (
    SELECT worker_id, tenant_id, adapter_id, prefix_hash, block_hash, block_index, token_count, tier, put_seq FROM residency
    UNION ALL SELECT d.worker_id, b.tenant_id, b.adapter_id, b.prefix_hash, b.block_hash, b.pos, b.token_count, 'hbm', 1000000000000 + b.request_no + 1 FROM request_blocks b JOIN d ON d.request_id = b.request_id) u
  GROUP BY ALL) t GROUP BY worker_id""", d=decision_view("greedy")))
def placement_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions make their blocks resident in their worker's memory: the index after all of them."""
    from cachefold.operators.index import upsert

    held = fold_events(S.kv_events(spark, sf))
    after = upsert(held, placed_blocks(decide(all_plans(spark, sf), "greedy"), S.request_blocks(spark, sf)))
    return after.groupBy("worker_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("put_seq") > 10**12).alias("placed"))


def placed_blocks(decisions: DataFrame, blocks: DataFrame) -> DataFrame:
    rows = blocks.join(decisions.select("request_id", "worker_id"), "request_id")
    return rows.select("worker_id", "tenant_id", "adapter_id", "prefix_hash", "block_hash", F.col("pos").alias("block_index"), "token_count", F.lit("hbm").alias("tier"), (F.lit(10**12) + F.col("request_no") + 1).alias("put_seq"), F.lit(4194304).cast("long").alias("bytes"))


def route_in_epochs(spark: SparkSession, sf: str, policy: str = "greedy", epochs: int = 3) -> DataFrame:
    """Requests arrive in epochs; each epoch is routed against what the earlier ones left resident."""
    held, blocks, requests, workers = fold_events(S.kv_events(spark, sf)), S.request_blocks(spark, sf), S.requests(spark, sf), S.workers(spark, sf)
    from cachefold.operators.index import upsert

    out = None
    for e in range(epochs):
        now = F.col("request_no") % epochs == e
        chosen = decide(plans(block_choices(blocks.where(now), held, workers), requests.where(now)), policy)
        chosen = chosen.select(*DECISION, F.lit(e).alias("epoch"))
        held = upsert(held, placed_blocks(chosen, blocks.where(now)))
        out = chosen if out is None else out.unionByName(chosen)
    return out


@query("route_epochs")
def route_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return route_in_epochs(spark, sf)
