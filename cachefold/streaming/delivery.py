"""Delivery of routing decisions to a sink, batch by batch.

Each decision is told twice, as planned and as committed, as a JSON row. A batch that the sink takes is sent; one that it
rejects has failed, and the stream goes on (``fail_open``) or stops there, to be sent again when it is restarted. Without
a sink nothing is sent. A repeated batch comes with the same number, so sinks can replace what they had of it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachefold.operators.planner import plan_sql
from cachefold.operators.telemetry import TRACE_SQL, traces
from cachefold.plans.registry import query
from cachefold.streaming.fold import shared_folder

Sink = Callable[[DataFrame, int], None]
VERSION = 1  # of the events' form
PHASES = ("planned", "committed")
RANK = {"disabled": 0, "sent": 1, "failed": 2}  # of a request's deliveries, the highest counts


def decision_events(decisions: DataFrame) -> DataFrame:
    """(request_id, phase, body): two events a decision, all its columns in the body."""
    body = F.struct(F.lit(VERSION).alias("schema_version"), "phase", F.struct(*decisions.columns).alias("route"))
    rows = decisions.withColumn("phase", F.explode(F.array(*map(F.lit, PHASES))))
    return rows.select("request_id", "phase", F.to_json(body).alias("body"))


def json_sink(folder: str) -> Sink:
    """Writes the bodies as JSON lines, a folder a batch."""
    return lambda rows, batch: rows.select("body").write.mode("overwrite").text(f"{folder}/batch={batch}")


def deliver(events: DataFrame, sink: Sink | None, out: str, checkpoint: str, fail_open: bool = True) -> DataFrame:
    """Tell the sink of a stream of events; (request_id, told, delivery) of all requests so far."""

    def tell(rows: DataFrame, batch: int) -> None:
        status = "disabled" if sink is None else "sent"
        if sink is not None:
            try:
                sink(rows, batch)
            except Exception:
                if not fail_open:
                    raise
                logging.getLogger(__name__).warning("the sink rejected batch %d", batch, exc_info=True)
                status = "failed"
        rows.select("request_id", "phase", F.lit(RANK[status]).alias("rank")).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream = events.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
    told = events.sparkSession.read.schema("request_id string, phase string, rank int, batch int").parquet(out)
    named = F.element_at(F.array(*map(F.lit, RANK)), F.max("rank") + 1)
    return told.groupBy("request_id").agg(F.count("*").alias("told"), named.alias("delivery"))


@query("action_publish", plan_sql("SELECT request_id, CAST(2 AS BIGINT) AS told, 'sent' AS delivery, 1 AS schema_version, worker_id FROM d", **TRACE_SQL))
def action_publish(spark: SparkSession, sf: str) -> DataFrame:
    """All decisions of the trace, delivered as JSON; with what a reader of the sink finds in the committed event."""
    events, out, checkpoint, folder = (shared_folder(spark, label) for label in ("events", "delivered", "delivered-state", "sink"))
    decision_events(traces(spark, sf)).write.parquet(events)
    stream = spark.readStream.schema("request_id string, phase string, body string").option("maxFilesPerTrigger", 4).parquet(events)
    status = deliver(stream, json_sink(folder), out, checkpoint)
    form = "schema_version int, phase string, route struct<request_id:string,worker_id:string>"
    read = spark.read.schema("value string").text(f"{folder}/*").select(F.from_json("value", form).alias("e")).where("e.phase = 'committed'")
    return status.join(read.select("e.route.request_id", "e.schema_version", "e.route.worker_id"), "request_id")
