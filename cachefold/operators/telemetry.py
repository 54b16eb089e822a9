"""Telemetry: layer transfers and their overlap, service levels, percentiles, exposition rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachefold.functions.columns import percent
from cachefold.operators.planner import ACTION_VIEWS, DECISION, all_plans, block_choices, decide, decision_view, plan_sql, plans
from cachefold.plans.registry import query
from cachefold.sources import tables as S


@query("layer_offsets", S.sql("SELECT transfer_id, layer_index, CAST(coalesce(sum(layer_bytes) OVER (PARTITION BY transfer_id ORDER BY layer_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset, layer_bytes FROM layer_transfers", "layer_transfers"))
def layer_offsets(spark: SparkSession, sf: str) -> DataFrame:
    before = Window.partitionBy("transfer_id").orderBy("layer_index").rowsBetween(Window.unboundedPreceding, -1)
    return S.layer_transfers(spark, sf).select("transfer_id", "layer_index", F.coalesce(F.sum("layer_bytes").over(before), F.lit(0)).alias("byte_offset"), "layer_bytes")


GATE_SQL = """SELECT *, max(done_us) OVER w AS ready_us, NOT bool_or(failed) OVER w AND max(done_us) OVER w < coalesce(min(done_us) FILTER (WHERE failed) OVER (PARTITION BY transfer_id), 9223372036854775807) AS notified
FROM layer_transfers WINDOW w AS (PARTITION BY transfer_id ORDER BY layer_index)"""


def gated(layers: DataFrame) -> DataFrame:
    """In-order readiness: a layer is ready when it and all before it are done, and told of unless anything failed before."""
    upto = Window.partitionBy("transfer_id").orderBy("layer_index").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("transfer_id")
    rows = layers.withColumns({"ready_us": F.max("done_us").over(upto), "broken": F.bool_or("failed").over(upto), "first_error": F.min(F.when(F.col("failed"), F.col("done_us"))).over(whole)})
    return rows.withColumn("notified", ~F.col("broken") & (F.col("first_error").isNull() | (F.col("ready_us") < F.col("first_error"))))


@query("layer_ready_gate", S.sql("SELECT transfer_id, layer_index, ready_us, notified FROM gate", "layer_transfers", gate=GATE_SQL))
def layer_ready_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gated(S.layer_transfers(spark, sf)).select("transfer_id", "layer_index", "ready_us", "notified")


def transfer_telemetry(layers: DataFrame) -> DataFrame:
    """First and full readiness of each transfer, and how much of it can overlap; a failed transfer gives its error only."""
    ok = layers.groupBy("transfer_id").agg(
        F.bool_or("failed").alias("failed"), F.min(F.when(F.col("layer_index") == 0, F.col("done_us"))).alias("first_us"), F.max("done_us").alias("full_us"),
        F.sum("layer_bytes").alias("bytes"), F.count("*").alias("n_layers"),
    )
    told = lambda c: F.when(~F.col("failed"), c)
    return ok.select("transfer_id", "failed", told(F.col("first_us")).alias("first_us"), told(F.col("full_us")).alias("full_us"), told(F.greatest(F.col("full_us") - F.col("first_us"), F.lit(0))).alias("overlap_us"), told(F.col("bytes")).alias("bytes"), "n_layers")


TELEMETRY_SQL = """SELECT transfer_id, failed, CASE WHEN NOT failed THEN f END AS first_us, CASE WHEN NOT failed THEN m END AS full_us, CASE WHEN NOT failed THEN greatest(m - f, 0) END AS overlap_us,
  CASE WHEN NOT failed THEN b END AS bytes, n_layers FROM (SELECT transfer_id, bool_or(failed) AS failed, min(done_us) FILTER (WHERE layer_index = 0) AS f, max(done_us) AS m, CAST(sum(layer_bytes) AS BIGINT) AS b, count(*) AS n_layers FROM layer_transfers GROUP BY 1) t"""


@query("layer_telemetry", S.sql("SELECT * FROM tele", "layer_transfers", tele=TELEMETRY_SQL))
def layer_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return transfer_telemetry(S.layer_transfers(spark, sf))


def transfer_observation(tele: DataFrame) -> DataFrame:
    """One row over all transfers: mean milliseconds, overlap efficiency, bandwidth, last known queue depth."""
    depth = F.when(F.col("transfer_id") % 3 == 0, F.col("transfer_id") % 23)
    sums = tele.agg(
        F.count_if(~F.col("failed")).alias("n_ok"), F.count_if("failed").alias("n_failed"), F.sum("first_us").alias("first"), F.sum("full_us").alias("full"), F.sum("overlap_us").alias("over"),
        F.sum("bytes").alias("bytes"), F.max_by(depth, F.when(depth.isNotNull(), F.col("transfer_id"))).alias("queue_depth"),
    )
    mean_ms = lambda c: F.when(F.col("n_ok") > 0, F.col(c).cast("double") / F.col("n_ok") / 1000.0)
    return sums.select(
        "n_ok", "n_failed", mean_ms("first").alias("first_layer_ms"), mean_ms("full").alias("full_ms"), percent(F.least("over", "full"), F.col("full")).alias("overlap_pct"),
        F.when(F.col("full") > 0, F.col("bytes").cast("double") * 8.0 / F.col("full")).alias("bandwidth_mbps"), "queue_depth",
    )


OBSERVED_SQL = """SELECT count(*) FILTER (WHERE NOT failed) AS n_ok, count(*) FILTER (WHERE failed) AS n_failed, CAST(sum(first_us) AS DOUBLE) / count(*) FILTER (WHERE NOT failed) / 1000.0::DOUBLE AS first_layer_ms,
  CAST(sum(full_us) AS DOUBLE) / count(*) FILTER (WHERE NOT failed) / 1000.0::DOUBLE AS full_ms, 100.0::DOUBLE * CAST(least(sum(overlap_us), sum(full_us)) AS DOUBLE) / CAST(sum(full_us) AS DOUBLE) AS overlap_pct,
  CAST(sum(bytes) AS DOUBLE) * 8.0::DOUBLE / CAST(sum(full_us) AS DOUBLE) AS bandwidth_mbps, arg_max(transfer_id % 23, transfer_id) FILTER (WHERE transfer_id % 3 = 0) AS queue_depth FROM tele"""


@query("transfer_summary", S.sql("SELECT * REPLACE (round(first_layer_ms, 9) AS first_layer_ms, round(full_ms, 9) AS full_ms, round(overlap_pct, 9) AS overlap_pct, round(bandwidth_mbps, 9) AS bandwidth_mbps) FROM o", "layer_transfers", tele=TELEMETRY_SQL, o=OBSERVED_SQL))
def transfer_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = transfer_observation(transfer_telemetry(S.layer_transfers(spark, sf)))
    return rows.withColumns({c: F.round(c, 9) for c in ("first_layer_ms", "full_ms", "overlap_pct", "bandwidth_mbps")})


@query("byte_slices", S.sql("SELECT object_key, i AS slice_no, i * 4194304 AS byte_offset, least(4194304, size - i * 4194304) AS length FROM (SELECT *, unnest(range((size + 4194303) // 4194304)) AS i FROM objects) t", "objects"))
def byte_slices(spark: SparkSession, sf: str, step: int = 4 << 20) -> DataFrame:
    """Objects cut into slices of ``step`` bytes and a remainder; an empty object has none."""
    rows = S.objects(spark, sf).where("size > 0").select("object_key", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))).alias("slice_no", "byte_offset"))
    return rows.select("object_key", F.col("slice_no").cast("long").alias("slice_no"), "byte_offset", F.least(F.lit(step).cast("long"), F.col("size") - F.col("byte_offset")).alias("length"))


def percentile_rows(values: DataFrame, key: str, value: str, place, shares: tuple[float, ...]) -> DataFrame:  # noqa: ANN001
    """(key, p, value): the values at the 0-based places that ``place`` gives for each share p of the group's ``n``.

    They are found in one histogram: equal values are counted first.
    """
    counts = values.groupBy(key, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy(key))})
    wanted = F.array(*(F.struct(F.lit(p).alias("p"), place(p).alias("at")) for p in shares))
    here = F.filter(wanted, lambda w: (w["at"] < F.col("upto")) & (w["at"] >= F.col("upto") - F.col("c")))
    return rows.select(key, F.explode(here).alias("w"), F.col(value).alias("value")).select(key, "w.p", "value")


PLACES = {  # (Spark place, SQL place) of percentile p among n values
    "a": (lambda p: F.round((F.col("n") - 1) * F.lit(p)).cast("long"), "CAST(round((n - 1) * {p}::DOUBLE) AS BIGINT)"),
    "b": (lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)).cast("long")), "least(n - 1, CAST(floor(n * {p}::DOUBLE) AS BIGINT))"),
    "c": (lambda p: F.rint(F.lit(p) * (F.col("n") - 1)).cast("long"), "CAST(round_even({p}::DOUBLE * (n - 1), 0) AS BIGINT)"),
}


SHARES = (0.5, 0.99, 0.999)


def _percentiles(kind: str):  # noqa: ANN202
    place, text = PLACES[kind]
    one = "SELECT o_orderpriority, {p} AS p, v AS value FROM (SELECT o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY floor(o_totalprice)) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) t WHERE r = {place}"

    @query(f"latency_percentiles_{kind}", " UNION ALL ".join(one.format(p=f"{p}::DOUBLE", place=text.format(p=p)) for p in SHARES))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        values = S.table(spark, sf, "orders").select("o_orderpriority", F.floor("o_totalprice").cast("long").alias("v"))
        return percentile_rows(values, "o_orderpriority", "v", place, SHARES)

    return run


for _kind in PLACES:
    _percentiles(_kind)

TRACE_SQL = {"d": decision_view("greedy")}


def traces(spark: SparkSession, sf: str) -> DataFrame:
    return decide(all_plans(spark, sf), "greedy").select(*DECISION, "ttft_ms", "ord")


@query("engine_distribution", plan_sql("SELECT worker_id, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE local_hits > 0) / count(*), 9) AS local_hit_pct FROM d GROUP BY worker_id", **TRACE_SQL))
def engine_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return traces(spark, sf).groupBy("worker_id").agg(F.count("*").alias("n"), F.round(percent(F.count_if(F.col("local_hits") > 0), F.count("*")), 9).alias("local_hit_pct"))


def cache_rates(rows: DataFrame) -> DataFrame:
    s = rows.agg(F.sum("local_hits").alias("l"), F.sum("transfers").alias("t"), F.sum("recomputes").alias("r"), F.count("*").alias("n_requests"))
    whole = F.col("l") + F.col("t") + F.col("r")
    rate = lambda c: F.round(percent(F.col(c), whole), 9)
    return s.select("n_requests", rate("l").alias("local_pct"), rate("t").alias("remote_pct"), rate("r").alias("recompute_pct"))


RATES_SQL = """SELECT count(*) AS n_requests, round(100.0::DOUBLE * sum(local_hits) / sum(local_hits + transfers + recomputes), 9) AS local_pct,
  round(100.0::DOUBLE * sum(transfers) / sum(local_hits + transfers + recomputes), 9) AS remote_pct, round(100.0::DOUBLE * sum(recomputes) / sum(local_hits + transfers + recomputes), 9) AS recompute_pct FROM d"""


@query("cache_observation", plan_sql(RATES_SQL, **TRACE_SQL))
def cache_observation(spark: SparkSession, sf: str) -> DataFrame:
    return cache_rates(traces(spark, sf))


def goodput(rows: DataFrame, budget_ms: Column) -> DataFrame:
    """Requests inside their first-token budget; the mean budget is an integer, as its sum is divided in integers."""
    s = rows.agg(F.count("*").alias("n"), F.count_if(F.col("ttft_us") <= 1000 * budget_ms).alias("met"), F.sum("ttft_us").alias("us"), F.sum(budget_ms).alias("budget"))
    mean = F.when(F.col("n") > 0, F.floor(F.col("budget") / F.col("n")).cast("long"))
    return s.select("n", "met", F.round(percent(F.col("met"), F.col("n")), 9).alias("goodput_pct"), F.round(F.col("us") / F.col("n") / 1000.0, 9).alias("mean_ttft_ms"), mean.alias("mean_budget_ms"))


GOODPUT_SQL = "SELECT count(*) AS n, count(*) FILTER (WHERE ttft_us <= 1000 * b) AS met, round(100.0::DOUBLE * count(*) FILTER (WHERE ttft_us <= 1000 * b) / count(*), 9) AS goodput_pct, round(CAST(sum(ttft_us) AS DOUBLE) / count(*) / 1000.0::DOUBLE, 9) AS mean_ttft_ms, CAST(sum(b) // count(*) AS BIGINT) AS mean_budget_ms FROM (SELECT *, 2 + ord AS b FROM d) t"


@query("slo_goodput", plan_sql(GOODPUT_SQL, **TRACE_SQL))
def slo_goodput(spark: SparkSession, sf: str) -> DataFrame:
    return goodput(traces(spark, sf), 2 + F.col("ord"))


#: The exposed metrics: name, kind, what it tells, and its SQL over the views ``d`` (decisions), ``f`` (fetches), ``tele`` and ``residency``.
METRICS = (
    ("requests_total", "counter", "Requests routed.", "SELECT count(*) FROM d"),
    ("local_hits_total", "counter", "Blocks used in place.", "SELECT sum(local_hits) FROM d"),
    ("transfer_blocks_total", "counter", "Blocks fetched from elsewhere.", "SELECT sum(transfers) FROM d"),
    ("transfer_requests_total", "counter", "Requests that fetch.", "SELECT count(*) FROM d WHERE transfers > 0"),
    ("transfer_estimated_us_sum", "counter", "Estimated time of all fetches.", "SELECT sum(total_us) FROM f"),
    ("transfer_first_estimated_us_sum", "counter", "Estimated time of first fetches.", "SELECT sum(first_us) FROM f"),
    ("transfer_measured_events_total", "counter", "Measured transfers.", "SELECT count(*) FROM tele WHERE NOT failed"),
    ("transfer_measured_first_layer_events_total", "counter", "Measured transfers with a first layer.", "SELECT count(first_us) FROM tele"),
    ("transfer_measured_bytes_total", "counter", "Bytes of measured transfers.", "SELECT sum(bytes) FROM tele"),
    ("transfer_measured_layers_total", "counter", "Layers of measured transfers.", "SELECT sum(n_layers) FROM tele WHERE NOT failed"),
    ("transfer_measured_first_layer_us_sum", "counter", "Measured time to the first layer.", "SELECT sum(first_us) FROM tele"),
    ("transfer_measured_full_us_sum", "counter", "Measured time of whole transfers.", "SELECT sum(full_us) FROM tele"),
    ("transfer_measured_overlap_us_sum", "counter", "Measured time that can overlap.", "SELECT sum(overlap_us) FROM tele"),
    ("recompute_blocks_total", "counter", "Blocks computed anew.", "SELECT sum(recomputes) FROM d"),
    ("reusable_blocks_total", "counter", "Blocks found for reuse.", "SELECT sum(local_hits + transfers) FROM d"),
    ("slo_served_total", "counter", "Responses measured.", "SELECT count(*) FROM d"),
    ("slo_met_total", "counter", "Responses inside their budget.", "SELECT count(*) FROM d WHERE ttft_us <= 1000 * (2 + ord)"),
    ("slo_ttft_ms_sum", "counter", "Time to first tokens.", "SELECT sum(ttft_us // 1000) FROM d"),
    ("resident_blocks", "gauge", "Blocks resident now.", "SELECT count(*) FROM residency"),
)
FETCH_SQL = "SELECT request_id, CAST(coalesce(sum(cost_us) FILTER (WHERE action = 'fetch'), 0) AS BIGINT) AS total_us, coalesce(min(cost_us) FILTER (WHERE action = 'fetch'), 0) AS first_us FROM actions GROUP BY request_id"


@query("prometheus_rows", plan_sql(
    "SELECT unnest([concat('# HELP cache_', name, ' ', help), concat('# TYPE cache_', name, ' ', kind), concat('cache_', name, ' ', CAST(CAST(coalesce(value, 0) AS BIGINT) AS VARCHAR))]) AS line FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS name, '{k}' AS kind, '{h}' AS help, ({q}) AS value" for n, k, h, q in METRICS) + ") t",
    "layer_transfers", **(ACTION_VIEWS | {"f": FETCH_SQL, "tele": TELEMETRY_SQL})))
def prometheus_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics as exposition lines: three a metric."""
    requests, workers = S.requests(spark, sf), S.workers(spark, sf)
    choices = block_choices(S.request_blocks(spark, sf), S.residency(spark, sf), workers)
    d = decide(plans(choices, requests), "greedy")
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    routed = d.agg(
        F.count("*").alias("requests_total"), some("local_hits").alias("local_hits_total"), some("transfers").alias("transfer_blocks_total"), F.count_if(F.col("transfers") > 0).alias("transfer_requests_total"),
        some("recomputes").alias("recompute_blocks_total"), some(F.col("local_hits") + F.col("transfers")).alias("reusable_blocks_total"), F.count("*").alias("slo_served_total"),
        F.count_if(F.col("ttft_us") <= 1000 * (2 + F.col("ord"))).alias("slo_met_total"), some(F.floor(F.col("ttft_us") / 1000)).alias("slo_ttft_ms_sum"),
    )
    fetched = choices.join(d.select("request_id", "worker_id"), ["request_id", "worker_id"]).where("kind = 'transfer'").groupBy("request_id").agg(F.sum("cost_us").alias("total"), F.min("cost_us").alias("first"))
    fetched = fetched.agg(some("total").alias("transfer_estimated_us_sum"), some("first").alias("transfer_first_estimated_us_sum"))
    told = transfer_telemetry(S.layer_transfers(spark, sf)).agg(
        F.count_if(~F.col("failed")).alias("transfer_measured_events_total"), F.count("first_us").alias("transfer_measured_first_layer_events_total"), some("bytes").alias("transfer_measured_bytes_total"),
        some(F.when(~F.col("failed"), F.col("n_layers"))).alias("transfer_measured_layers_total"), some("first_us").alias("transfer_measured_first_layer_us_sum"), some("full_us").alias("transfer_measured_full_us_sum"), some("overlap_us").alias("transfer_measured_overlap_us_sum"),
    )
    row = routed.join(fetched).join(told).join(S.residency(spark, sf).agg(F.count("*").alias("resident_blocks")))  # one row each
    lines = [F.array(F.lit(f"# HELP cache_{n} {h}"), F.lit(f"# TYPE cache_{n} {k}"), F.concat(F.lit(f"cache_{n} "), F.col(n).cast("string"))) for n, k, h, _ in METRICS]
    return row.select(F.explode(F.flatten(F.array(*lines))).alias("line"))


OBSERVED_BY_TENANT = """SELECT t.tenant_id, CASE WHEN n > 0 THEN 'measured' WHEN pn > 0 THEN 'planned' END AS told_by,
  round(CASE WHEN n > 0 THEN CAST(f AS DOUBLE) / nf / 1000.0::DOUBLE WHEN pn > 0 THEN CAST(pf AS DOUBLE) / pn / 1000.0::DOUBLE END, 9) AS first_layer_ms, round(CASE WHEN n > 0 THEN CAST(u AS DOUBLE) / n / 1000.0::DOUBLE WHEN pn > 0 THEN CAST(pu AS DOUBLE) / pn / 1000.0::DOUBLE END, 9) AS full_ms,
  round(CASE WHEN n > 0 THEN CAST(o AS DOUBLE) / n / 1000.0::DOUBLE WHEN pn > 0 THEN CAST(pu - pf AS DOUBLE) / pn / 1000.0::DOUBLE END, 9) AS overlap_ms, round(CASE WHEN n > 0 THEN CAST(greatest(u - o, 0) AS DOUBLE) / n / 1000.0::DOUBLE WHEN pn > 0 THEN CAST(pf AS DOUBLE) / pn / 1000.0::DOUBLE END, 9) AS exposed_ms,
  round(CASE WHEN n > 0 THEN 100.0::DOUBLE * CAST(least(o, u) AS DOUBLE) / CAST(u AS DOUBLE) WHEN pn > 0 THEN 100.0::DOUBLE * CAST(pu - pf AS DOUBLE) / CAST(pu AS DOUBLE) END, 9) AS overlap_pct, round(CASE WHEN n > 0 THEN CAST(b AS DOUBLE) * 8.0::DOUBLE / CAST(u AS DOUBLE) END, 9) AS bandwidth_mbps
FROM (SELECT DISTINCT tenant_id FROM requests) t
LEFT JOIN (SELECT concat('ten', CAST(transfer_id % 2 AS VARCHAR)) AS tenant_id, count(*) AS n, count(first_us) AS nf, sum(first_us) AS f, sum(full_us) AS u, sum(overlap_us) AS o, sum(bytes) AS b FROM tele WHERE NOT failed GROUP BY 1) m ON m.tenant_id = t.tenant_id
LEFT JOIN (SELECT q.tenant_id, count(*) AS pn, sum(total_us) AS pu, sum(first_us) AS pf FROM f JOIN requests q ON q.request_id = f.request_id WHERE total_us > 0 GROUP BY 1) p ON p.tenant_id = t.tenant_id"""


@query("transfer_observation_by_tenant", plan_sql(OBSERVED_BY_TENANT, "layer_transfers", **(ACTION_VIEWS | {"f": FETCH_SQL, "tele": TELEMETRY_SQL})))
def transfer_observation_by_tenant(spark: SparkSession, sf: str) -> DataFrame:
    """What is known of each tenant's transfers: measured where anything was measured, else as planned."""
    tele = transfer_telemetry(S.layer_transfers(spark, sf)).withColumn("tenant_id", F.concat(F.lit("ten"), (F.col("transfer_id") % 2).cast("string")))
    requests, workers = S.requests(spark, sf), S.workers(spark, sf)
    choices = block_choices(S.request_blocks(spark, sf), S.residency(spark, sf), workers)
    d = decide(plans(choices, requests), "greedy").select("request_id", "worker_id")
    fetched = choices.where("kind = 'transfer'").join(d, ["request_id", "worker_id"]).groupBy("request_id").agg(F.sum("cost_us").alias("total_us"), F.min("cost_us").alias("first_us"))
    return observed(requests.select("tenant_id").distinct(), tele, fetched.join(requests.select("request_id", "tenant_id"), "request_id"))


def observed(tenants: DataFrame, tele: DataFrame, planned: DataFrame) -> DataFrame:
    """Measured transfers (``transfer_telemetry`` with a tenant) before planned ones (tenant_id, total_us, first_us: a row a request that fetches)."""
    m = tele.where("not failed").groupBy("tenant_id").agg(F.count("*").alias("n"), F.count("first_us").alias("nf"), F.sum("first_us").alias("f"), F.sum("full_us").alias("u"), F.sum("overlap_us").alias("o"), F.sum("bytes").alias("b"))
    p = planned.groupBy("tenant_id").agg(F.count("*").alias("pn"), F.sum("total_us").alias("pu"), F.sum("first_us").alias("pf"))
    rows = tenants.join(m, "tenant_id", "left").join(p, "tenant_id", "left")
    c = F.col

    def either(measured: Column | None, plan: Column | None = None) -> Column:
        value = F.when(c("n") > 0, measured)
        return F.round(value if plan is None else value.when(c("pn") > 0, plan), 9)

    ms = lambda a, n: c(a).cast("double") / c(n) / 1000.0
    saved = c("pu") - c("pf")
    return rows.select(
        "tenant_id", F.when(c("n") > 0, "measured").when(c("pn") > 0, "planned").alias("told_by"), either(ms("f", "nf"), ms("pf", "pn")).alias("first_layer_ms"), either(ms("u", "n"), ms("pu", "pn")).alias("full_ms"),
        either(ms("o", "n"), saved.cast("double") / c("pn") / 1000.0).alias("overlap_ms"), either(F.greatest(c("u") - c("o"), F.lit(0)).cast("double") / c("n") / 1000.0, ms("pf", "pn")).alias("exposed_ms"),
        either(percent(F.least("o", "u"), c("u")), percent(saved, c("pu"))).alias("overlap_pct"), either(c("b").cast("double") * 8.0 / c("u")).alias("bandwidth_mbps"),
    )


@query("bench_report", """SELECT o_orderpriority AS backend, n, round(total / n / 1000.0::DOUBLE, 6) AS mean_us, max(v) FILTER (WHERE r = CAST(round((n - 1) * 0.5::DOUBLE) AS BIGINT)) / 1000.0::DOUBLE AS p50_us,
  max(v) FILTER (WHERE r = CAST(round((n - 1) * 0.99::DOUBLE) AS BIGINT)) / 1000.0::DOUBLE AS p99_us, max(v) FILTER (WHERE r = CAST(round((n - 1) * 0.999::DOUBLE) AS BIGINT)) / 1000.0::DOUBLE AS p999_us, round(n / (total / 1000000000.0::DOUBLE), 6) AS per_sec
FROM (SELECT o_orderpriority, v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n, CAST(sum(v) OVER (PARTITION BY o_orderpriority) AS DOUBLE) AS total FROM (SELECT o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders) a) t GROUP BY 1, 2, total, n""")
def bench_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report row of each backend from its samples in nanoseconds: mean, percentiles and rate."""
    samples = S.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("backend"), F.floor("o_totalprice").cast("long").alias("v"))
    places = percentile_rows(samples, "backend", "v", PLACES["a"][0], SHARES).groupBy("backend").agg(*(F.max(F.when(F.col("p") == p, F.col("value") / 1000.0)).alias(n) for p, n in zip(SHARES, ("p50_us", "p99_us", "p999_us"), strict=True)))
    whole = samples.groupBy("backend").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("total"))
    rate = F.round(F.col("n") / (F.col("total") / 1e9), 6)
    return whole.join(places, "backend").select("backend", "n", F.round(F.col("total") / F.col("n") / 1000.0, 6).alias("mean_us"), "p50_us", "p99_us", "p999_us", rate.alias("per_sec"))


@query("state_json", S.sql("""SELECT worker_id, CAST(to_json(struct_pack(worker := worker_id, role := role, blocks := n, bytes := b)) AS VARCHAR) AS state FROM (
  SELECT w.worker_id, w.role, count(r.block_hash) AS n, CAST(coalesce(sum(r.bytes), 0) AS BIGINT) AS b FROM workers w LEFT JOIN residency r ON r.worker_id = w.worker_id GROUP BY 1, 2) t""", "residency", "workers"))
def state_json(spark: SparkSession, sf: str) -> DataFrame:
    held = S.residency(spark, sf).groupBy("worker_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    rows = S.workers(spark, sf).join(held, "worker_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.select("worker_id", F.to_json(F.struct(F.col("worker_id").alias("worker"), "role", zero(F.col("n")).alias("blocks"), zero(F.col("b")).alias("bytes"))).alias("state"))


@query("action_delivery", plan_sql("""SELECT request_id, CASE max(CASE WHEN h % 11 = 0 THEN 2 WHEN h % 5 = 0 THEN 0 ELSE 1 END) WHEN 2 THEN 'failed' WHEN 1 THEN 'sent' ELSE 'disabled' END AS delivery FROM (
  SELECT request_id, unnest(['planned', 'committed']) AS phase, CAST(('0x' || substr(md5(concat(request_id, unnest(['planned', 'committed']))), 1, 8)) AS BIGINT) AS h FROM d) t GROUP BY request_id""", **TRACE_SQL))
def action_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """Each decision is told twice to a sink; the worse delivery counts."""
    from cachefold.functions.columns import stable_hash

    rows = traces(spark, sf).select("request_id", F.explode(F.array(F.lit("planned"), F.lit("committed"))).alias("phase"))
    h = stable_hash(F.concat("request_id", "phase"))
    worst = F.max(F.when(h % 11 == 0, 2).when(h % 5 == 0, 0).otherwise(1)).alias("w")
    return rows.groupBy("request_id").agg(worst).select("request_id", F.when(F.col("w") == 2, "failed").when(F.col("w") == 1, "sent").otherwise("disabled").alias("delivery"))


@query("inflight_load", """SELECT user_id % 8 AS worker_no, CAST(max(n) AS BIGINT) AS peak FROM (SELECT user_id, sum(d) OVER (PARTITION BY user_id % 8 ORDER BY t, d DESC, event_id ROWS UNBOUNDED PRECEDING) AS n
  FROM (SELECT user_id, event_id, event_id AS t, 1 AS d FROM events UNION ALL SELECT user_id, event_id, event_id + 5 + event_id % 30 AS t, -1 AS d FROM events) e) s GROUP BY 1""")
def inflight_load(spark: SparkSession, sf: str) -> DataFrame:
    """The most requests in flight at once on each worker; a start counts before an end of the same tick."""
    e = S.table(spark, sf, "events").select((F.col("user_id") % 8).alias("worker_no"), "event_id")
    edges = e.select("worker_no", F.explode(F.array(F.struct(F.col("event_id").alias("t"), F.lit(1).alias("d")), F.struct((F.col("event_id") + 5 + F.col("event_id") % 30).alias("t"), F.lit(-1).alias("d")))).alias("x"))
    # Steps at one tick are summed first, then runs of ticks, so that no window holds all of a worker's edges.
    ticks = edges.groupBy("worker_no", F.floor(F.col("x.t") / 4096).alias("run"), F.col("x.t").alias("t")).agg(F.sum("x.d").alias("net"), F.sum(F.greatest("x.d", F.lit(0))).alias("starts"))
    runs = ticks.groupBy("worker_no", "run").agg(F.sum("net").alias("sum"))
    earlier = Window.partitionBy("worker_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("worker_no", "run", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    inner = Window.partitionBy("worker_no", "run").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    level = F.col("base") + F.coalesce(F.col("before"), F.lit(0)) + F.col("starts")
    return ticks.withColumn("before", F.sum("net").over(inner)).join(runs, ["worker_no", "run"]).groupBy("worker_no").agg(F.max(level).alias("peak"))


@query("pd_transfer_join", """SELECT coalesce(p.event_id, d.event_id) % 1000 AS bucket, count(*) AS n, count(*) FILTER (WHERE p.event_id IS NOT NULL AND d.event_id IS NOT NULL) AS handed, count(*) FILTER (WHERE d.event_id IS NULL) AS orphan_prefill, count(*) FILTER (WHERE p.event_id IS NULL) AS orphan_decode
FROM (SELECT event_id FROM events WHERE event_id % 3 <> 0) p FULL JOIN (SELECT event_id FROM events WHERE event_id % 4 <> 0) d ON p.event_id = d.event_id GROUP BY 1""")
def pd_transfer_join(spark: SparkSession, sf: str) -> DataFrame:
    """Prefill and decode halves of a request meet on the transfer id; what stays alone failed."""
    e = S.table(spark, sf, "events").select("event_id")
    p, d = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("p")), e.where("event_id % 4 <> 0").select(F.col("event_id").alias("d"))
    rows = p.join(d, F.col("p") == F.col("d"), "full")
    null = lambda c: F.col(c).isNull()
    return rows.groupBy((F.coalesce("p", "d") % 1000).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(~null("p") & ~null("d")).alias("handed"), F.count_if(null("d")).alias("orphan_prefill"), F.count_if(null("p")).alias("orphan_decode"))
