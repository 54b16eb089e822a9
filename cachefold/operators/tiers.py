"""Tiered least-recently-used caches as queries over the access log.

With blocks of one size and all placements on top, fast memory, host memory and disk are one stack: the state is a rank
by recency, and an access is a hit, a promotion or an admission by its depth in the stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cachefold.functions.frames import first_by
from cachefold.plans.registry import query
from cachefold.sources import tables as S

#: Blocks that each tier of a worker holds, from fast to slow.
CAPACITY = {"hbm": 8, "cpu_dram": 16, "local_ssd": 32}
STACK = sum(CAPACITY.values())
RUN = 1024  # positions of the log classified in one row
FAN = 32  # runs merged at once

ACCESSES = "SELECT worker_id, concat(tenant_id, '/', coalesce(adapter_id, ''), '/', block_hash) AS block, seq FROM kv_events WHERE op = 'block_stored'"


def block_accesses(events: DataFrame) -> DataFrame:
    block = F.concat("tenant_id", F.lit("/"), F.coalesce("adapter_id", F.lit("")), F.lit("/"), "block_hash")
    return events.where("op = 'block_stored'").select("worker_id", block.alias("block"), "seq")


def tier_at(depth: Column) -> Column:
    """The tier that holds the block at a depth from 0; null below the last one."""
    out, end = None, 0
    for tier, n in CAPACITY.items():
        end += n
        out = F.when(depth < end, tier) if out is None else out.when(depth < end, tier)
    return out


@query("lru_tier_state", S.sql("""SELECT worker_id, block, CASE WHEN r < 8 THEN 'hbm' WHEN r < 24 THEN 'cpu_dram' ELSE 'local_ssd' END AS tier FROM (
  SELECT worker_id, block, row_number() OVER (PARTITION BY worker_id ORDER BY last DESC) - 1 AS r FROM (SELECT worker_id, block, max(seq) AS last FROM acc GROUP BY 1, 2) a) t WHERE r < 56""", "kv_events", acc=ACCESSES))
def lru_tier_state(spark: SparkSession, sf: str) -> DataFrame:
    last = block_accesses(S.kv_events(spark, sf)).groupBy("worker_id", "block").agg(F.max("seq").alias("last"))
    rows = first_by(last, ["worker_id"], [F.col("last").desc()], "depth", STACK)
    return rows.select("worker_id", "block", tier_at(F.col("depth") - 1).alias("tier"))


def _latest(stacks: Column) -> Column:
    """The first ``STACK`` distinct blocks of an array of stacks, latest first."""
    return F.slice(F.array_distinct(F.flatten(stacks)), 1, STACK)


def stacks_before(runs: DataFrame) -> DataFrame:
    """(worker_id, run, stack): what a worker holds before each of its runs, latest first; runs: (worker_id, run, own).

    ``own`` are the blocks that a run leaves on top. Neighbouring runs are merged ``FAN`` at a time, up to one node a
    worker; on the way down, what comes before a node is its earlier neighbours above what comes before their group.
    """
    levels = [runs.select("worker_id", F.col("run").alias("node"), "own")]
    top = runs.agg(F.max("run")).first()[0] or 0
    while top > 0:
        group = F.floor(F.col("node") / FAN).alias("node")
        nodes = F.array_sort(F.collect_list(F.struct((-F.col("node")).alias("back"), "own")))
        levels.append(levels[-1].groupBy("worker_id", group).agg(nodes.alias("nodes")).withColumn("own", _latest(F.col("nodes.own"))))
        top //= FAN
    before = levels[-1].select("worker_id", "node", F.array().cast("array<string>").alias("stack"))
    for level in reversed(levels[1:]):
        earlier = lambda i: F.concat(F.slice(F.col("nodes.own"), i + 2, F.lit(FAN)), F.array("stack"))
        each = F.transform("nodes", lambda x, i: F.struct((-x["back"]).alias("node"), _latest(earlier(i)).alias("stack")))
        before = level.join(before, ["worker_id", "node"]).select("worker_id", F.explode(each).alias("x")).select("worker_id", "x.node", "x.stack")
    return before.withColumnRenamed("node", "run")


def access_classes(accesses: DataFrame) -> DataFrame:
    """(worker_id, block, seq, access) for every access.

    The log is cut into runs of ``RUN`` positions. A stack holds ``STACK`` blocks at most, so a run is fully known from
    the blocks last used before it, and all runs are classified independently.
    """
    log = F.array_sort(F.collect_list(F.struct("seq", "block"))).alias("log")
    runs = accesses.groupBy("worker_id", F.floor(F.col("seq") / RUN).alias("run")).agg(log)
    own = F.slice(F.array_distinct(F.reverse(F.col("log.block"))), 1, STACK)
    before = stacks_before(runs.select("worker_id", "run", own.alias("own")))

    def step(state: Column, e: Column) -> Column:
        place = F.array_position(state["stack"], e["block"])  # from 1; 0 if it is not there
        access = F.when(place == 0, "admit").when(place <= CAPACITY["hbm"], "hit").otherwise("promote")
        stack = F.slice(F.concat(F.array(e["block"]), F.array_remove(state["stack"], e["block"])), 1, STACK)
        return F.struct(stack.alias("stack"), F.array_append(state["seen"], F.struct(e["block"].alias("block"), e["seq"].alias("seq"), access.alias("access"))).alias("seen"))

    start = F.struct("stack", F.array().cast("array<struct<block:string,seq:bigint,access:string>>").alias("seen"))
    seen = F.aggregate("log", start, step, lambda state: state["seen"])
    return runs.join(before, ["worker_id", "run"]).select("worker_id", F.explode(seen).alias("x")).select("worker_id", "x.*")


@query("lru_access_class", S.sql("""SELECT worker_id, block, seq, CASE WHEN prev IS NULL OR d >= 56 THEN 'admit' WHEN d < 8 THEN 'hit' ELSE 'promote' END AS access FROM (
  SELECT a.worker_id, a.block, a.seq, a.prev, (SELECT count(DISTINCT z.block) FROM acc z WHERE z.worker_id = a.worker_id AND z.seq > a.prev AND z.seq < a.seq) AS d
  FROM (SELECT *, lag(seq) OVER (PARTITION BY worker_id, block ORDER BY seq) AS prev FROM acc) a) t""", "kv_events", acc=ACCESSES))
def lru_access_class(spark: SparkSession, sf: str) -> DataFrame:
    return access_classes(block_accesses(S.kv_events(spark, sf)))


@query("tier_cascade_counts", S.sql("""SELECT worker_id, access, count(*) AS n FROM (SELECT worker_id, CASE WHEN prev IS NULL OR d >= 56 THEN 'admit' WHEN d < 8 THEN 'hit' ELSE 'promote' END AS access FROM (
  SELECT a.worker_id, a.prev, (SELECT count(DISTINCT z.block) FROM acc z WHERE z.worker_id = a.worker_id AND z.seq > a.prev AND z.seq < a.seq) AS d
  FROM (SELECT *, lag(seq) OVER (PARTITION BY worker_id, block ORDER BY seq) AS prev FROM acc) a) t) u GROUP BY 1, 2""", "kv_events", acc=ACCESSES))
def tier_cascade_counts(spark: SparkSession, sf: str) -> DataFrame:
    return access_classes(block_accesses(S.kv_events(spark, sf))).groupBy("worker_id", "access").agg(F.count("*").alias("n"))


@query("rewrite_amplification", S.sql("SELECT worker_id, count(*) AS written, count(DISTINCT block) AS live, round(CAST(count(*) AS DOUBLE) / count(DISTINCT block), 9) AS amplification FROM acc GROUP BY 1", "kv_events", acc=ACCESSES))
def rewrite_amplification(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks written over blocks live, by worker."""
    rows = block_accesses(S.kv_events(spark, sf)).groupBy("worker_id", "block").agg(F.count("*").alias("n")).groupBy("worker_id").agg(F.sum("n").alias("written"), F.count("*").alias("live"))
    return rows.withColumn("amplification", F.round(F.col("written").cast("double") / F.col("live"), 9))
