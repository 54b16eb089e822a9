"""Continuous forms of the event fold and of roll-ups.

The fold keeps the latest position of every key and operation, a maximum that a streaming aggregation maintains in its
state store. Each batch writes what changed under its own number, so a repeated batch replaces itself and nothing that a
reader sees is rewritten; the residency table is the batch fold of all that was written, so stream and batch agree.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachefold.operators.index import KEY, _wire_sql, engine_defaults, event_rows, fold_events, wire_batches
from cachefold.operators.prefix import INTERVAL, decayed
from cachefold.plans.registry import ORACLES, query
from cachefold.sources import tables as S

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; local sessions without one get a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="cachefold-stream-"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def latest_positions(events: DataFrame) -> DataFrame:
    """The event log reduced to the last of each key and operation: what a fold needs of it."""
    last = F.max(F.struct("seq", "bytes")).alias("last")
    return events.groupBy("worker_id", *KEY, "tier", "op").agg(last).select("worker_id", *KEY, "tier", "op", "last.seq", "last.bytes")


def run_updates(changed: DataFrame, out: str, checkpoint: str) -> None:
    """Write the rows of a streaming aggregation that changed in each batch, a folder a batch."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream = changed.writeStream.outputMode("update").foreachBatch(write)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_residency_stream(spark: SparkSession, events: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Fold a stream of events (the columns of ``kv_events``); the table as of the last batch."""
    run_updates(latest_positions(events), out, checkpoint)
    return fold_events(spark.read.parquet(out).drop("batch"))


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A glob for the one name: a stream's plain path has to be a folder, and a table may be a single file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{name}.parque[t]")


@query("stream_residency", S.sql("SELECT worker_id, tenant_id, adapter_id, prefix_hash, block_hash, block_index, token_count, tier, put_seq, bytes FROM residency", "residency"))
def stream_residency(spark: SparkSession, sf: str) -> DataFrame:
    out, checkpoint = shared_folder(spark, "residency"), shared_folder(spark, "residency-state")
    return run_residency_stream(spark, S.kv_events_of(read_stream(spark, sf, "events")), out, checkpoint)


@query("stream_event_rollup", "SELECT date_trunc('hour', ts) AS hour, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_event_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts by type, kept up to date by a streaming aggregation."""
    out, checkpoint = shared_folder(spark, "rollup"), shared_folder(spark, "rollup-state")
    rows = read_stream(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    rows = rows.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    run_updates(rows.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total"), out, checkpoint)
    # The last batch that told of a row has its value.
    last = spark.read.parquet(out).groupBy("hour", "event_type").agg(F.max(F.struct("batch", "n", "total")).alias("x"))
    return last.select("hour", "event_type", "x.n", F.round("x.total", 6).alias("total"))


@query("stream_kv_event_rows", _wire_sql(typed=True))
def stream_kv_event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """JSON batches that arrive as lines of text, parsed as they come; a batch has its number in front."""
    lines, out, checkpoint = (shared_folder(spark, label) for label in ("lines", "event-rows", "event-rows-state"))
    wire_batches(S.table(spark, sf, "events"), typed=True).select(F.concat_ws("\t", F.col("batch_no").cast("string"), "body")).write.text(lines)
    parts = F.split("value", "\t", 2)
    bodies = spark.readStream.option("maxFilesPerTrigger", 4).text(lines).select(parts[0].cast("long").alias("batch_no"), parts[1].alias("body"))
    rows = event_rows(bodies, engine_defaults(S.workers(spark, sf)))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query("stream_hotness", ORACLES["hotness_decay"])
def stream_hotness(spark: SparkSession, sf: str) -> DataFrame:
    """``hotness_decay`` kept up to date: the stream counts accesses by interval, and reading folds the intervals."""
    out, checkpoint = shared_folder(spark, "hotness"), shared_folder(spark, "hotness-state")
    events = S.kv_events_of(read_stream(spark, sf, "events"))
    stored = F.col("op") == "block_stored"
    counts = events.groupBy(F.when(stored, F.col("block_hash")).alias("block_hash"), F.floor(F.col("seq") / INTERVAL).alias("i")).agg(F.count("*").alias("n"))
    run_updates(counts, out, checkpoint)
    now = spark.read.parquet(out).groupBy("block_hash", "i").agg(F.max(F.struct("batch", "n")).alias("x")).select("block_hash", "i", "x.n")
    return decayed(now.where("block_hash is not null"), now.agg(F.max("i").alias("last")))
