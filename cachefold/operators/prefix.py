"""Prefix tables, contiguous overlap, hot prefixes, sketches and replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachefold.functions.columns import stable_hash
from cachefold.functions.frames import first_by, small
from cachefold.operators.index import fold_events
from cachefold.operators.planner import block_cost, candidates, load
from cachefold.plans.registry import query
from cachefold.sources import tables as S


def prefix_table(events: DataFrame, precise: bool = False) -> DataFrame:
    """(worker_id, tenant_id, adapter_id, block_hash): blocks that instances have told of, whatever their tier."""
    return fold_events(events, precise).select("worker_id", "tenant_id", "adapter_id", "block_hash").distinct()


PREFIX_TABLE_SQL = """SELECT DISTINCT e.worker_id, tenant_id, adapter_id, block_hash FROM kv_events e
LEFT JOIN (SELECT worker_id, max(seq) AS cl FROM kv_events WHERE op = 'all_blocks_cleared' GROUP BY 1) c ON e.worker_id = c.worker_id WHERE op = 'block_stored' AND seq > coalesce(cl, -1)"""
OVERLAP_SQL = """SELECT request_id, worker_id, count(*) AS overlap FROM (SELECT b.request_id, p.worker_id, b.pos, row_number() OVER (PARTITION BY b.request_id, p.worker_id ORDER BY b.pos) - 1 AS r
FROM request_blocks b JOIN prefix_table p ON b.block_hash = p.block_hash AND b.tenant_id = p.tenant_id AND b.adapter_id IS NOT DISTINCT FROM p.adapter_id) t WHERE pos = r GROUP BY 1, 2"""


@query("conductor_table_fold", S.sql("SELECT worker_id, tenant_id, adapter_id, block_hash FROM prefix_table", "kv_events", prefix_table=PREFIX_TABLE_SQL))
def conductor_table_fold(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_table(S.kv_events(spark, sf))


def overlaps(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """(request_id, worker_id, overlap): leading blocks that an instance has without a gap."""
    have = table.withColumnsRenamed({"tenant_id": "t", "adapter_id": "a", "block_hash": "h"})
    on = (F.col("block_hash") == F.col("h")) & (F.col("tenant_id") == F.col("t")) & F.col("adapter_id").eqNullSafe(F.col("a"))
    rows = blocks.join(have, on).select("request_id", "worker_id", "pos")
    place = F.row_number().over(Window.partitionBy("request_id", "worker_id").orderBy("pos")) - 1
    return rows.withColumn("r", place).where("pos = r").groupBy("request_id", "worker_id").agg(F.count("*").alias("overlap"))


@query("prefix_overlap", S.sql("SELECT request_id, worker_id, overlap FROM ovl", "kv_events", "request_blocks", prefix_table=PREFIX_TABLE_SQL, ovl=OVERLAP_SQL))
def prefix_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return overlaps(S.request_blocks(spark, sf), prefix_table(S.kv_events(spark, sf)))


@query("route_conductor", S.sql("""SELECT request_id, worker_id, overlap, cost FROM (SELECT q.request_id, w.worker_id, coalesce(overlap, 0) AS overlap,
  greatest(q.n_blocks + w.queued_prefill_tokens / 64.0::DOUBLE - coalesce(overlap, 0), 0.0::DOUBLE) + w.running_decodes AS cost,
  row_number() OVER (PARTITION BY q.request_id ORDER BY greatest(q.n_blocks + w.queued_prefill_tokens / 64.0::DOUBLE - coalesce(overlap, 0), 0.0::DOUBLE) + w.running_decodes, ord) AS r
  FROM requests q CROSS JOIN workers w LEFT JOIN ovl o ON o.request_id = q.request_id AND o.worker_id = w.worker_id WHERE w.role IN ('decode', 'aggregated')) t WHERE r = 1""",
  "kv_events", "request_blocks", "workers", prefix_table=PREFIX_TABLE_SQL, ovl=OVERLAP_SQL))
def route_conductor(spark: SparkSession, sf: str) -> DataFrame:
    requests = S.requests(spark, sf)
    over = overlaps(S.request_blocks(spark, sf), prefix_table(S.kv_events(spark, sf)))
    return conducted(requests, over, S.workers(spark, sf))


def conducted(requests: DataFrame, over: DataFrame, workers: DataFrame) -> DataFrame:
    """Block cost with contiguous overlap as the credit; the first of the cheapest candidates."""
    rows = requests.select("request_id", "n_blocks").crossJoin(small(candidates(workers))).join(over, ["request_id", "worker_id"], "left")
    rows = rows.withColumn("overlap", F.coalesce("overlap", F.lit(0))).withColumn("cost", block_cost(F.col("overlap").cast("double")))
    return first_by(rows, ["request_id"], [F.col("cost").asc(), F.col("ord").asc()]).select("request_id", "worker_id", "overlap", "cost")


def accesses(blocks: DataFrame) -> DataFrame:
    """One access a request for each scope and prefix that it names."""
    return blocks.select("request_id", "tenant_id", "adapter_id", "prefix_hash").distinct().groupBy("tenant_id", "adapter_id", "prefix_hash").agg(F.count("*").alias("accesses"))


ACCESS_SQL = "SELECT tenant_id, adapter_id, prefix_hash, count(*) AS accesses FROM (SELECT DISTINCT request_id, tenant_id, adapter_id, prefix_hash FROM request_blocks) t GROUP BY ALL"


@query("hot_prefixes", S.sql("SELECT tenant_id, adapter_id, prefix_hash, accesses FROM acc WHERE accesses >= 3", "request_blocks", acc=ACCESS_SQL))
def hot_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return accesses(S.request_blocks(spark, sf)).where("accesses >= 3")


INTERVAL = 500


def halved(count: Column, times: Column) -> Column:
    """``count`` halved and rounded down so many times, in one step."""
    return F.call_function("shiftright", count, F.least(times, F.lit(63)).cast("int"))


@query("hotness_decay", S.sql("""SELECT block_hash, list_reduce(list(coalesce(n, 0) ORDER BY i), lambda a, x: (a + x) // 2, 0::BIGINT) AS hotness FROM (
  SELECT k.block_hash, i, n FROM (SELECT DISTINCT block_hash FROM kv_events WHERE op = 'block_stored') k CROSS JOIN (SELECT unnest(range((SELECT max(seq) // 500 FROM kv_events) + 1)) AS i) g
  LEFT JOIN (SELECT block_hash, seq // 500 AS j, count(*) AS n FROM kv_events WHERE op = 'block_stored' GROUP BY 1, 2) c ON c.block_hash = k.block_hash AND c.j = g.i) t
GROUP BY block_hash HAVING hotness > 0""", "kv_events"))
def hotness_decay(spark: SparkSession, sf: str) -> DataFrame:
    """Access counts that are added and halved (rounding down) once an interval; keys at 0 go."""
    events = S.kv_events(spark, sf)
    last = events.agg(F.floor(F.max("seq") / INTERVAL).alias("last"))
    return decayed(events.where("op = 'block_stored'").groupBy("block_hash", F.floor(F.col("seq") / INTERVAL).alias("i")).agg(F.count("*").alias("n")), last)


RUN = 4096  # periods that are folded in one list; a run of 62 or more halves any count down to 0 or 1
NEVER = 1 << 61  # more than any count


def _state(i: Column, n: Column) -> Column:
    """``i``: the period not yet reached, ``n``: the count at its begin."""
    return F.struct(i.cast("long").alias("i"), n.cast("long").alias("n"))


def _next(most: int):  # noqa: ANN202
    """Go on over a period (i, n): empty ones before it are halved over in one step, counts stop at ``most``."""
    return lambda acc, e: _state(e["i"] + 1, halved(F.least(halved(acc["n"], e["i"] - acc["i"]) + e["n"], F.lit(most)), F.lit(1)))


def _doubled(need: Column, times: Column) -> Column:
    """The least count that is ``need`` or more after so many halvings."""
    fits = need <= halved(F.lit(NEVER), times)
    return F.when(fits, F.call_function("shiftleft", need, F.least(times, F.lit(61)).cast("int"))).otherwise(F.lit(NEVER))


def _back(most: int):  # noqa: ANN202
    """From the count needed behind a period (i, n) to the one needed at its begin."""

    def step(acc: Column, e: Column) -> Column:
        inside = _doubled(acc["n"], acc["i"] - e["i"])
        return _state(e["i"], F.when(inside > most, F.lit(NEVER)).otherwise(F.greatest(inside - e["n"], F.lit(0))))

    return step


def in_last_run(counts: DataFrame, keys: list[str], last: DataFrame, most: int = NEVER - 1) -> DataFrame:
    """(keys, last, m, start): the periods (i, n) of each key in the run of the ``last`` period, and the state at the run's begin.

    counts: (keys, i, n), a row a key and period with additions. A count is halved (rounding down) at the end of each
    period and stops at ``most``. As additions come between two halvings, old ones can decide a rounding however long ago
    they were, so all periods are folded in order, in runs that are folded each by itself: a run leaves ``low``, or one
    more if at least ``need`` enters it. So no list is longer than a run, or than the number of runs.
    """
    runs = counts.groupBy(*keys, F.floor(F.col("i") / RUN).alias("run")).agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("m")).join(F.broadcast(last))
    begin, end, last_run = F.col("run") * RUN, (F.col("run") + 1) * RUN, F.floor(F.col("last") / RUN)
    done = F.col("run") < last_run
    low = F.aggregate("m", _state(begin, F.lit(0)), _next(most), lambda acc: halved(acc["n"], end - acc["i"]))
    need = F.aggregate(F.reverse("m"), _state(end, F.col("low") + 1), _back(most), lambda acc: _doubled(acc["n"], acc["i"] - begin))
    runs = runs.withColumn("low", F.when(done, low)).withColumn("need", F.when(done, need))
    out = runs.groupBy(*keys, "last").agg(
        F.array_sort(F.collect_list(F.when(done, F.struct("run", "low", "need")))).alias("before"), F.any_value(F.when(~done, F.col("m")), F.lit(True)).alias("m")
    )
    # A run without additions leaves 0.
    enters = lambda acc, run: F.when(acc["i"] == run, acc["n"]).otherwise(0)
    over = lambda acc, e: _state(e["run"] + 1, e["low"] + F.when(enters(acc, e["run"]) >= e["need"], 1).otherwise(0))
    start = F.aggregate("before", _state(F.lit(0), F.lit(0)), over, lambda acc: _state(last_run * RUN, enters(acc, last_run)))
    return out.select(*keys, "last", F.coalesce("m", F.array().cast("array<struct<i:bigint,n:bigint>>")).alias("m"), start.alias("start"))


def decayed(counts: DataFrame, last: DataFrame) -> DataFrame:
    """(block_hash, hotness) of the counts n of intervals i up to the ``last``."""
    hotness = F.aggregate("m", F.col("start"), _next(NEVER - 1), lambda acc: halved(acc["n"], F.col("last") + 1 - acc["i"]))
    return in_last_run(counts, ["block_hash"], last).select("block_hash", hotness.alias("hotness")).where("hotness > 0")


#: The size of the store's sketch, and the largest count of a cell.
WIDTH, DEPTH, MOST = 4096, 4, 255


def sketch(adds: DataFrame, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """(row, cell, count) of a saturating 8-bit count-min sketch that halves after every width * depth additions.

    adds: (key, seq) with seq the number of additions before. Cells are pre-counted by epoch and folded in runs of epochs;
    the running epoch is not halved.
    """
    epoch = width * depth
    counted = adds.groupBy("key", F.floor(F.col("seq") / epoch).alias("i")).agg(F.count("*").alias("n"))
    cells = counted.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumn("cell", cell_of(F.col("key"), F.col("row"), width))
    cells = cells.groupBy("row", "cell", "i").agg(F.sum("n").alias("n"))
    last = adds.agg(F.floor((F.max("seq") + 1) / epoch).alias("last"))  # epochs before it are complete
    by_cell = in_last_run(cells, ["row", "cell"], last, MOST)
    # Here ``i`` is the epoch that ``n`` was counted in.
    add = lambda acc, e: _state(e["i"], F.least(halved(acc["n"], e["i"] - acc["i"]) + e["n"], F.lit(MOST)))
    count = F.aggregate("m", F.col("start"), add, lambda acc: halved(acc["n"], F.col("last") - acc["i"]))
    return by_cell.select("row", "cell", count.alias("count"))


def cell_of(key, row, width: int):  # noqa: ANN001, ANN201
    return stable_hash(F.concat(key, F.lit(":"), row.cast("string"))) % width


def sketch_estimates(spark: SparkSession, sf: str, width: int = WIDTH) -> DataFrame:
    from cachefold.functions.frames import with_position

    stored = S.kv_events(spark, sf).where("op = 'block_stored'").select(F.col("block_hash").alias("key"), F.col("seq").alias("at"))
    adds = with_position(stored, "at", "seq").select("key", "seq")
    cells = sketch(adds, width).withColumnsRenamed({"row": "r", "cell": "c"})
    keys = adds.select("key").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 1)))).withColumn("cell", cell_of(F.col("key"), F.col("row"), width))
    return keys.join(cells, (F.col("row") == F.col("r")) & (F.col("cell") == F.col("c"))).groupBy("key").agg(F.min("count").alias("estimate"))


def _sketch(name: str):  # noqa: ANN202
    @query(name, S.sql("""SELECT block_hash AS key, CAST(min(least(255, list_reduce(l[1:-2], lambda a, x: least(255, a + x) // 2, 0::BIGINT) + l[-1])) AS BIGINT) AS estimate FROM (
  SELECT k.block_hash, k.r, list(coalesce(n, 0) ORDER BY e) AS l FROM keys k CROSS JOIN (SELECT unnest(range((SELECT (max(seq) + 1) // 16384 FROM adds) + 1)) AS e) g
  LEFT JOIN (SELECT r, cell, ep, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL) z ON z.r = k.r AND z.cell = k.cell AND z.ep = g.e GROUP BY ALL) t GROUP BY 1""", "kv_events",
  adds="SELECT block_hash, row_number() OVER (ORDER BY seq) - 1 AS seq FROM kv_events WHERE op = 'block_stored'",
  keys="SELECT block_hash, r, CAST(('0x' || substr(md5(concat(block_hash, ':', CAST(r AS VARCHAR))), 1, 8)) AS BIGINT) % 4096 AS cell FROM (SELECT DISTINCT block_hash FROM adds) a, range(4) d(r)",
  cells="SELECT k.r, k.cell, a.seq // 16384 AS ep, CAST(count(*) AS BIGINT) AS n FROM adds a JOIN keys k ON k.block_hash = a.block_hash GROUP BY ALL"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return sketch_estimates(spark, sf)

    return run


# Both names are kept: the first one was once 256 cells wide.
count_min_sketch, count_min_sketch_store = _sketch("count_min_sketch"), _sketch("count_min_sketch_store")


TARGET_REPLICAS, HOT, MOST_ACTIONS = 6, 2, 32


def prefix_holders(acc: DataFrame, resident: DataFrame) -> DataFrame:
    """Hot prefixes with the workers that hold any block of theirs."""
    held = resident.select("worker_id", F.col("tenant_id").alias("t"), F.col("adapter_id").alias("a"), F.col("prefix_hash").alias("p"))
    on = (F.col("prefix_hash") == F.col("p")) & (F.col("tenant_id") == F.col("t")) & F.col("adapter_id").eqNullSafe(F.col("a"))
    return acc.join(held, on).groupBy("tenant_id", "adapter_id", "prefix_hash", "accesses").agg(F.array_sort(F.collect_set("worker_id")).alias("holders"))


HOLDERS_SQL = """SELECT a.tenant_id, a.adapter_id, a.prefix_hash, a.accesses, list(DISTINCT r.worker_id ORDER BY r.worker_id) AS holders FROM acc a JOIN residency r
  ON a.prefix_hash = r.prefix_hash AND a.tenant_id = r.tenant_id AND a.adapter_id IS NOT DISTINCT FROM r.adapter_id GROUP BY ALL"""


@query("prefix_holders", S.sql("SELECT tenant_id, adapter_id, prefix_hash, accesses, array_to_string(holders, ',') AS holders FROM h", "residency", "request_blocks", acc=ACCESS_SQL, h=HOLDERS_SQL))
def prefix_holders_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = prefix_holders(accesses(S.request_blocks(spark, sf)), S.residency(spark, sf))
    return rows.withColumn("holders", F.array_join("holders", ","))


def replications(prefixes: DataFrame, workers: DataFrame, target: int = TARGET_REPLICAS, hot: int = HOT, most: int = MOST_ACTIONS) -> DataFrame:
    """Copies of hot, under-replicated prefixes to the least loaded workers without them; hottest first, ``most`` in all."""
    fleet = small(workers.select("worker_id", load().alias("load")))
    wanted = prefixes.where((F.col("accesses") >= hot) & (F.size("holders") > 0) & (F.size("holders") < target))
    rows = wanted.crossJoin(fleet).withColumn("holds", F.array_contains("holders", F.col("worker_id")))
    keys = ["tenant_id", "adapter_id", "prefix_hash"]
    from_ = F.min(F.when(F.col("holds"), F.struct("load", "worker_id"))).over(Window.partitionBy(*keys))
    rows = rows.withColumn("source", from_["worker_id"]).where("not holds")
    rows = first_by(rows, keys, [F.col("load").asc(), F.col("worker_id").asc()], "r", target).where(F.col("r") <= target - F.size("holders"))
    top = rows.orderBy(F.desc("accesses"), "prefix_hash", "tenant_id", F.col("adapter_id").asc_nulls_last(), "r").limit(most)
    return top.select(*keys, F.coalesce("source", F.element_at("holders", 1)).alias("from_worker"), F.col("worker_id").alias("to_worker"), "accesses")


@query("replication_plan", S.sql("""SELECT tenant_id, adapter_id, prefix_hash, from_worker, to_worker, accesses FROM (
  SELECT h.*, w.worker_id AS to_worker, row_number() OVER (PARTITION BY tenant_id, adapter_id, prefix_hash ORDER BY w.ld, w.worker_id) AS r,
    (SELECT s.worker_id FROM ld s WHERE list_contains(h.holders, s.worker_id) ORDER BY s.ld, s.worker_id LIMIT 1) AS from_worker
  FROM h CROSS JOIN ld w WHERE accesses >= 2 AND len(holders) < 6 AND NOT list_contains(holders, w.worker_id)) t
WHERE r <= 6 - len(holders) ORDER BY accesses DESC, prefix_hash, tenant_id, adapter_id NULLS LAST, r LIMIT 32""", "residency", "request_blocks", "workers", acc=ACCESS_SQL, h=HOLDERS_SQL,
  ld="SELECT worker_id, queued_prefill_tokens + 1000 * running_decodes AS ld FROM workers"))
def replication_plan(spark: SparkSession, sf: str) -> DataFrame:
    return replications(prefix_holders(accesses(S.request_blocks(spark, sf)), S.residency(spark, sf)), S.workers(spark, sf))
