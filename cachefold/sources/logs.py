"""Framed logs, versioned snapshots, idempotent actions, bounds of byte moves."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachefold.plans.registry import query
from cachefold.sources import tables as S


def frame(payload: bytes) -> bytes:
    """Length, crc32 and payload; both numbers are 32 bits, little-endian."""
    return struct.pack("<II", len(payload), zlib.crc32(payload)) + payload


def frames_in(data: bytes) -> Iterator[bytes]:
    """The payloads of a log up to its first torn or corrupt frame."""
    at = 0
    while at + 8 <= len(data):
        size, crc = struct.unpack_from("<II", data, at)
        payload = data[at + 8 : at + 8 + size]
        if len(payload) < size or zlib.crc32(payload) != crc:
            return
        yield payload
        at += 8 + size


def decoded(logs: DataFrame, name: str, content: str) -> DataFrame:
    """(name, seq, payload) of every log in a binary column, e.g. of the ``binaryFile`` source; one row a log."""
    kind = logs.schema[name].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, i, p.decode()) for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if data for i, p in enumerate(frames_in(data))]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.types[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], [name, "seq", "payload"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(name, kind), T.StructField("seq", T.LongType()), T.StructField("payload", T.StringType())])
    return logs.select(name, content).mapInArrow(run, schema)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """All logs below ``path``; each is read whole, as its frames can only be found from its start."""
    return decoded(spark.read.format("binaryFile").load(path).select("path", "content"), "path", "content")


@query("wal_frames", """SELECT log, seq, payload FROM (SELECT event_id // 100 AS log, event_id % 100 AS seq, concat(event_type, '@', CAST(event_id AS VARCHAR)) AS payload,
  min(CASE WHEN event_id % 37 = 5 THEN event_id % 100 END) OVER (PARTITION BY event_id // 100) AS bad FROM events) t WHERE bad IS NULL OR seq < bad""")
def wal_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Logs of a hundred frames, some with a wrong checksum, written natively and decoded up to the first bad one."""
    e = S.table(spark, sf, "events")
    payload = F.concat("event_type", F.lit("@"), F.col("event_id").cast("string")).cast("binary")
    little = lambda c: F.reverse(F.array(*(F.substring(F.lpad(F.hex(c), 8, "0"), i, 2) for i in (1, 3, 5, 7))))
    crc = F.crc32("payload") + F.when(F.col("event_id") % 37 == 5, 1).otherwise(0)
    rows = e.select("event_id", payload.alias("payload"))
    text = F.concat(F.array_join(little(F.length("payload").cast("long")), ""), F.array_join(little(F.pmod(crc, F.lit(1 << 32))), ""), F.hex("payload"))
    rows = rows.select(F.floor(F.col("event_id") / 100).alias("log"), F.struct("event_id", text.alias("frame")).alias("x"))
    logs = rows.groupBy("log").agg(F.array_sort(F.collect_list("x")).alias("x")).select("log", F.unhex(F.array_join(F.col("x.frame"), "")).alias("content"))
    return decoded(logs, "log", "content")


def save_snapshot(df: DataFrame, base: str, version: int) -> None:
    """A complete version first, then the pointer to it: readers never see half a snapshot."""
    df.write.mode("overwrite").parquet(f"{base}/v={version}")
    df.sparkSession.range(1).select(F.lit(str(version)).alias("value")).coalesce(1).write.mode("append").text(f"{base}/current")


def load_snapshot(spark: SparkSession, base: str) -> DataFrame:
    """The newest version that a pointer names."""
    version = spark.read.text(f"{base}/current").agg(F.max(F.col("value").cast("long"))).first()[0]
    return spark.read.parquet(f"{base}/v={version}")


@query("snapshot_round_trip", S.sql("SELECT worker_id, block_hash, tier, put_seq FROM residency", "residency"))
def snapshot_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    from cachefold.streaming.fold import shared_folder

    base, held = shared_folder(spark, "snapshot"), S.residency(spark, sf)
    save_snapshot(held.limit(1), base, 1)
    save_snapshot(held, base, 2)
    return load_snapshot(spark, base).select("worker_id", "block_hash", "tier", "put_seq")


@query("action_dedup", "SELECT epoch, kind, target, CAST(count(*) AS BIGINT) AS delivered FROM (SELECT event_id // 200 AS epoch, event_type AS kind, concat('w', CAST(user_id % 8 AS VARCHAR)) AS target FROM events) t GROUP BY ALL")
def action_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Actions delivered at least once are applied once: one row an epoch, kind and target."""
    e = S.table(spark, sf, "events")
    rows = e.select(F.floor(F.col("event_id") / 200).alias("epoch"), F.col("event_type").alias("kind"), F.concat(F.lit("w"), (F.col("user_id") % 8).cast("string")).alias("target"))
    return rows.groupBy("epoch", "kind", "target").agg(F.count("*").alias("delivered"))


@query("transfer_bounds", S.sql("SELECT transfer_id, layer_index, byte_offset + layer_bytes <= 8388608 AS inside FROM (SELECT *, CAST(coalesce(sum(layer_bytes) OVER (PARTITION BY transfer_id ORDER BY layer_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM layer_transfers) t", "layer_transfers"))
def transfer_bounds(spark: SparkSession, sf: str, segment: int = 8 << 20) -> DataFrame:
    """Whether each layer's byte range lies inside its segment."""
    from cachefold.operators.telemetry import layer_offsets

    return layer_offsets(spark, sf).select("transfer_id", "layer_index", (F.col("byte_offset") + F.col("layer_bytes") <= segment).alias("inside"))
