"""Object-store metadata: readable replicas, leases, eviction, allocation candidates, log recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachefold.functions.columns import percent, small_float_down, small_float_up, small_float_value
from cachefold.functions.frames import BROADCAST_ROWS, first_by, running_before
from cachefold.plans.registry import query
from cachefold.sources import tables as S

NOW, TTL, LEASE_TTL = S.NOW, 700, 5
#: Eviction starts at this share of capacity and stops at this share of that.
HIGH, KEEP = 0.95, 0.9


def segments(objects: DataFrame) -> DataFrame:
    """Segments with what they hold: capacity, allocated bytes, owner and last heartbeat, derived from their objects."""
    number = F.regexp_extract("segment_name", "[0-9]+", 0).cast("long")
    rows = objects.groupBy("segment_name").agg(F.sum("size").alias("allocated"), F.count("*").alias("n_objects"))
    return rows.select("segment_name", F.floor(F.col("allocated") * 100 / 97).cast("long").alias("capacity"), "allocated", "n_objects", F.concat(F.lit("c"), (number % 5).cast("string")).alias("client_id"), ((number * 53) % 1500).alias("last_beat"))


SEGMENTS = """SELECT segment_name, CAST(floor(allocated * 100 / 97.0) AS BIGINT) AS capacity, allocated, n_objects, concat('c', CAST(CAST(regexp_extract(segment_name, '[0-9]+', 0) AS BIGINT) % 5 AS VARCHAR)) AS client_id,
  (CAST(regexp_extract(segment_name, '[0-9]+', 0) AS BIGINT) * 53) % 1500 AS last_beat FROM (SELECT segment_name, CAST(sum(size) AS BIGINT) AS allocated, count(*) AS n_objects FROM objects GROUP BY 1) t"""


def alive(last: Column, now: int = NOW, ttl: int = TTL) -> Column:
    return F.lit(ttl == 0) | (F.greatest(F.lit(now) - last, F.lit(0)) <= ttl)


@query("segment_health", S.sql("SELECT segment_name, capacity, allocated, n_objects, round(100.0::DOUBLE * allocated / capacity, 6) AS used_pct, greatest(1500 - last_beat, 0) <= 700 AS alive FROM seg", "objects", seg=SEGMENTS))
def segment_health(spark: SparkSession, sf: str) -> DataFrame:
    rows = segments(S.objects(spark, sf))
    return rows.select("segment_name", "capacity", "allocated", "n_objects", F.round(percent(F.col("allocated"), F.col("capacity")), 6).alias("used_pct"), alive(F.col("last_beat")).alias("alive"))


@query("client_segments", S.sql("SELECT client_id, string_agg(segment_name, ',' ORDER BY segment_name) AS segments, CAST(sum(capacity) AS BIGINT) AS capacity, bool_and(greatest(1500 - last_beat, 0) <= 700) AS all_alive FROM seg GROUP BY 1", "objects", seg=SEGMENTS))
def client_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = segments(S.objects(spark, sf))
    return rows.groupBy("client_id").agg(F.array_join(F.array_sort(F.collect_list("segment_name")), ",").alias("segments"), F.sum("capacity").alias("capacity"), F.bool_and(alive(F.col("last_beat"))).alias("all_alive"))


READS = "SELECT concat(object_key, CASE WHEN last_access % 10 = 0 THEN 'x' ELSE '' END) AS wanted, concat('ten', CAST(lease_until % 3 AS VARCHAR)) AS tenant FROM objects"


def reads(objects: DataFrame) -> DataFrame:
    return objects.select(F.concat("object_key", F.when(F.col("last_access") % 10 == 0, "x").otherwise("")).alias("wanted"), F.concat(F.lit("ten"), (F.col("lease_until") % 3).cast("string")).alias("tenant"))


def readable(asked: DataFrame, objects: DataFrame) -> DataFrame:
    """The outcome of each read: errors in the order not found, unsafe reuse, not ready; a dead segment is not ready."""
    seg = segments(objects).select(F.col("segment_name").alias("s"), alive(F.col("last_beat")).alias("up"))
    held = objects.select("object_key", "tenant_id", "complete", "segment_name").join(seg, F.col("segment_name") == F.col("s"))
    rows = asked.join(held, F.col("wanted") == F.col("object_key"), "left")
    error = F.when(F.col("object_key").isNull(), "not_found").when(F.col("tenant") != F.col("tenant_id"), "unsafe_reuse").when(~(F.col("complete") & F.col("up")), "not_ready")
    return rows.select("wanted", F.coalesce(error, F.lit("ok")).alias("outcome"), F.when(error.isNull(), F.col("segment_name")).alias("segment_name"))


READABLE = """SELECT wanted, CASE WHEN o.object_key IS NULL THEN 'not_found' WHEN tenant <> tenant_id THEN 'unsafe_reuse' WHEN NOT (complete AND greatest(1500 - last_beat, 0) <= 700) THEN 'not_ready' ELSE 'ok' END AS outcome, o.segment_name AS sn
FROM reads LEFT JOIN objects o ON wanted = object_key LEFT JOIN seg ON seg.segment_name = o.segment_name"""


@query("readable_replicas", S.sql("SELECT wanted, outcome, CASE WHEN outcome = 'ok' THEN sn END AS segment_name FROM rd", "objects", seg=SEGMENTS, reads=READS, rd=READABLE))
def readable_replicas(spark: SparkSession, sf: str) -> DataFrame:
    objects = S.objects(spark, sf)
    return readable(reads(objects), objects)


@query("exist_batch", S.sql("SELECT wanted, coalesce(complete, false) AS found FROM reads LEFT JOIN objects ON wanted = object_key", "objects", reads=READS))
def exist_batch(spark: SparkSession, sf: str) -> DataFrame:
    objects = S.objects(spark, sf)
    return reads(objects).join(objects, F.col("wanted") == F.col("object_key"), "left").select("wanted", F.coalesce("complete", F.lit(False)).alias("found"))


@query("regex_objects", S.sql("SELECT object_key, size FROM objects WHERE regexp_matches(object_key, '^qc/Brand#1[0-9]*/.*7$') AND tenant_id = 'ten1'", "objects"))
def regex_objects(spark: SparkSession, sf: str, pattern: str = "^qc/Brand#1[0-9]*/.*7$", tenant: str = "ten1") -> DataFrame:
    """Objects whose key matches; those of other tenants are left out silently."""
    return S.objects(spark, sf).where(F.col("object_key").rlike(pattern) & (F.col("tenant_id") == tenant)).select("object_key", "size")


def evicted(objects: DataFrame, seg: DataFrame, stop: Column) -> DataFrame:
    """Victims among the objects of all segments, in one order, while ``stop`` does not hold.

    ``stop`` is on the ``capacity`` and ``allocated`` bytes of all segments together, and the bytes ``freed`` so far.
    """
    able = objects.where(f"not hard_pinned and lease_until <= {NOW}").withColumn("soft", F.col("soft_pinned").cast("int"))
    whole = seg.agg(F.sum("capacity").alias("capacity"), F.sum("allocated").alias("allocated"))  # one row
    rows = running_before(able, ["soft"], "last_access", ["object_key"], "size", "freed").join(F.broadcast(whole))
    return rows.where(~stop).select("segment_name", "object_key", "size")


EVICT_SQL = "SELECT o.segment_name, object_key, size, coalesce(sum(size) OVER (ORDER BY CAST(soft_pinned AS INT), last_access, object_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM objects o WHERE NOT hard_pinned AND lease_until <= 1500"
WHOLE_SQL = "SELECT CAST(sum(capacity) AS BIGINT) AS capacity, CAST(sum(allocated) AS BIGINT) AS allocated FROM seg"


@query("watermark_eviction", S.sql("SELECT segment_name, object_key, size FROM v, w WHERE allocated >= 0.95::DOUBLE * capacity AND allocated - freed > floor(0.95::DOUBLE * 0.9::DOUBLE * capacity)", "objects", seg=SEGMENTS, v=EVICT_SQL, w=WHOLE_SQL))
def watermark_eviction(spark: SparkSession, sf: str) -> DataFrame:
    objects = S.objects(spark, sf)
    below = F.col("allocated") < F.lit(HIGH) * F.col("capacity")
    return evicted(objects, segments(objects), below | (F.col("allocated") - F.col("freed") <= F.floor(F.lit(HIGH) * F.lit(KEEP) * F.col("capacity"))))


@query("evict_to_fit", S.sql("SELECT segment_name, object_key, size FROM v, w WHERE capacity - (allocated - freed) < capacity * 8 // 100", "objects", seg=SEGMENTS, v=EVICT_SQL, w=WHOLE_SQL))
def evict_to_fit(spark: SparkSession, sf: str, needed: int | None = None) -> DataFrame:
    """Victims until ``needed`` bytes are free; by default 8 % of the capacity."""
    objects = S.objects(spark, sf)
    want = F.floor(F.col("capacity") * 8 / 100) if needed is None else F.lit(needed)
    return evicted(objects, segments(objects), F.col("capacity") - (F.col("allocated") - F.col("freed")) >= want)


@query("lease_blocked_removes", S.sql("SELECT object_key, CASE WHEN forced THEN 'removed' WHEN lease > 1500 THEN 'leased' ELSE 'removed' END AS outcome FROM (SELECT object_key, greatest(lease_until, CASE WHEN last_access % 4 = 0 THEN last_access + 5 ELSE 0 END) AS lease, last_access % 9 = 0 AS forced FROM objects) t", "objects"))
def lease_blocked_removes(spark: SparkSession, sf: str) -> DataFrame:
    """A read grants a lease; a remove waits for it unless forced."""
    o = S.objects(spark, sf)
    lease = F.greatest("lease_until", F.when(F.col("last_access") % 4 == 0, F.col("last_access") + LEASE_TTL).otherwise(0))
    return o.select("object_key", F.when(F.col("last_access") % 9 == 0, "removed").when(lease > NOW, "leased").otherwise("removed").alias("outcome"))


@query("upsert_classify", S.sql("SELECT wanted, CASE WHEN object_key IS NULL THEN 'put' WHEN lease_until > 1500 THEN 'not_ready' WHEN size = new_size THEN 'reuse' ELSE 'reallocate' END AS action FROM (SELECT concat(object_key, CASE WHEN last_access % 10 = 0 THEN 'x' ELSE '' END) AS wanted, CASE WHEN last_access % 2 = 0 THEN size ELSE size + 1 END AS new_size FROM objects) w LEFT JOIN objects o ON w.wanted = o.object_key", "objects"))
def upsert_classify(spark: SparkSession, sf: str) -> DataFrame:
    o = S.objects(spark, sf)
    wanted = o.select(F.concat("object_key", F.when(F.col("last_access") % 10 == 0, "x").otherwise("")).alias("wanted"), F.when(F.col("last_access") % 2 == 0, F.col("size")).otherwise(F.col("size") + 1).alias("new_size"))
    rows = wanted.join(o, F.col("wanted") == F.col("object_key"), "left")
    action = F.when(F.col("object_key").isNull(), "put").when(F.col("lease_until") > NOW, "not_ready").when(F.col("size") == F.col("new_size"), "reuse").otherwise("reallocate")
    return rows.select("wanted", action.alias("action"))


OPLOG = "SELECT seq, CASE op WHEN 'block_stored' THEN 'put_committed' WHEN 'block_removed' THEN 'removed' ELSE 'segment_unmounted' END AS kind, worker_id AS segment_name, concat(worker_id, '/', block_hash) AS object_key, bytes FROM kv_events"


def oplog(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("op") == "block_stored", "put_committed").when(F.col("op") == "block_removed", "removed").otherwise("segment_unmounted")
    return S.kv_events(spark, sf).select("seq", kind.alias("kind"), F.col("worker_id").alias("segment_name"), F.concat("worker_id", F.lit("/"), "block_hash").alias("object_key"), "bytes")


def recovered(log: DataFrame) -> DataFrame:
    """Objects after a replay: the last record of a key decides, and unmounting a segment drops what it held before."""
    keyed = log.where("kind <> 'segment_unmounted'").groupBy("segment_name", "object_key").agg(F.max(F.struct("seq", "kind", "bytes")).alias("x"))
    gone = log.where("kind = 'segment_unmounted'").groupBy("segment_name").agg(F.max("seq").alias("gone"))
    rows = keyed.where("x.kind = 'put_committed'").join(gone, "segment_name", "left").where(F.col("x.seq") > F.coalesce("gone", F.lit(-1)))
    return rows.select("object_key", "segment_name", F.col("x.seq").alias("seq"), F.col("x.bytes").alias("bytes"))


@query("oplog_recover", S.sql("""SELECT object_key, k.segment_name, seq, bytes FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_key ORDER BY seq DESC) AS r FROM oplog WHERE kind <> 'segment_unmounted') a WHERE r = 1 AND kind = 'put_committed') k
LEFT JOIN (SELECT segment_name, max(seq) AS gone FROM oplog WHERE kind = 'segment_unmounted' GROUP BY 1) g ON g.segment_name = k.segment_name WHERE seq > coalesce(gone, -1)""", "kv_events", oplog=OPLOG))
def oplog_recover(spark: SparkSession, sf: str) -> DataFrame:
    return recovered(oplog(spark, sf))


@query("put_lifecycle", S.sql("""SELECT object_key, CASE last_op WHEN 'start' THEN 'initialized' WHEN 'end' THEN 'complete' ELSE 'gone' END AS state, n_ends > 1 AS already_exists FROM (
  SELECT block_hash AS object_key, arg_max(CASE op WHEN 'block_stored' THEN CASE WHEN seq % 3 = 0 THEN 'start' ELSE 'end' END ELSE 'revoke' END, seq) AS last_op, count(*) FILTER (WHERE op = 'block_stored' AND seq % 3 <> 0) AS n_ends FROM kv_events WHERE op <> 'all_blocks_cleared' GROUP BY 1) t""", "kv_events"))
def put_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Two-phase puts: the last of start, end and revoke decides; a second end says that the object exists."""
    rows = S.kv_events(spark, sf).where("op <> 'all_blocks_cleared'")
    op = F.when(F.col("op") == "block_stored", F.when(F.col("seq") % 3 == 0, "start").otherwise("end")).otherwise("revoke")
    rows = rows.groupBy(F.col("block_hash").alias("object_key")).agg(F.max_by(op, "seq").alias("last"), F.count_if(op == "end").alias("ends"))
    return rows.select("object_key", F.when(F.col("last") == "start", "initialized").when(F.col("last") == "end", "complete").otherwise("gone").alias("state"), (F.col("ends") > 1).alias("already_exists"))


@query("batch_put_atomicity", """SELECT o_orderkey // 100 AS batch, bool_and(o_totalprice < 450000) AS committed, min(o_orderkey) FILTER (WHERE NOT (o_totalprice < 450000)) AS first_error, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def batch_put_atomicity(spark: SparkSession, sf: str) -> DataFrame:
    """A batch is put as a whole or not at all; its first failing member is told."""
    ok = F.col("o_totalprice") < 450000
    rows = S.table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 100).alias("batch"))
    return rows.agg(F.bool_and(ok).alias("committed"), F.min(F.when(~ok, F.col("o_orderkey"))).alias("first_error"), F.count("*").alias("n"))


WAL = "SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'tombstone' ELSE 'commit' END AS kind, concat('k', CAST(user_id AS VARCHAR)) AS key, CAST(length(props) AS BIGINT) AS length, event_id % 997 = 996 AND event_id > (SELECT max(event_id) * 4 // 5 FROM events) AS torn FROM events"


@query("wal_recover", """WITH wal AS (""" + WAL + """), good AS (SELECT * FROM wal WHERE seq < coalesce((SELECT min(seq) FROM wal WHERE torn), 9223372036854775807))
SELECT key, seq, length FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM good) t WHERE r = 1 AND kind = 'commit' AND seq % 13 <> 0""")
def wal_recover(spark: SparkSession, sf: str) -> DataFrame:
    """A write-ahead log up to its first bad record: last record of a key, tombstones out, files checked for length."""
    e = S.table(spark, sf, "events")
    end = e.agg(F.floor(F.max("event_id") * 4 / 5).alias("tail"))
    rows = e.join(end).select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "tombstone").otherwise("commit").alias("kind"), F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.char_length("props").cast("long").alias("length"), ((F.col("event_id") % 997 == 996) & (F.col("event_id") > F.col("tail"))).alias("torn"))
    files = e.where("event_id % 13 <> 0").select(F.col("event_id").alias("seq"), F.char_length("props").cast("long").alias("length"))
    return recovered_files(rows, files)


def recovered_files(wal: DataFrame, files: DataFrame) -> DataFrame:
    bad = wal.where("torn").agg(F.min("seq").alias("bad"))
    good = wal.join(bad).where(F.col("bad").isNull() | (F.col("seq") < F.col("bad")))
    last = good.groupBy("key").agg(F.max(F.struct("seq", "kind", "length")).alias("x")).where("x.kind = 'commit'").select("key", "x.seq", "x.length")
    return last.join(files, ["seq", "length"]).select("key", "seq", "length")


@query("wal_file_states", """WITH wal AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'tombstone' ELSE 'commit' END AS kind, concat('k', CAST(user_id AS VARCHAR)) AS key, CAST(length(props) AS BIGINT) AS length, md5(props) AS checksum FROM events),
files AS (SELECT event_id AS seq, CAST(length(c) AS BIGINT) AS length, md5(c) AS checksum FROM (SELECT event_id, CASE event_id % 11 WHEN 3 THEN left(props, 3) WHEN 4 THEN concat(left(props, length(props) - 1), '?') ELSE props END AS c FROM events WHERE event_id % 11 <> 5) t)
SELECT w.key, w.seq, CASE WHEN f.seq IS NULL THEN 'missing' WHEN f.length <> w.length THEN 'truncated' WHEN f.checksum <> w.checksum THEN 'corrupt' ELSE 'live' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY key, seq % 50 ORDER BY seq DESC) AS r FROM wal) w LEFT JOIN files f ON f.seq = w.seq WHERE r = 1 AND kind = 'commit'""")
def wal_file_states(spark: SparkSession, sf: str) -> DataFrame:
    """The last committed record of each key and slot with the state of its file; all but the live ones are dropped."""
    e = S.table(spark, sf, "events")
    sums = lambda c: [F.char_length(c).cast("long").alias("length"), F.md5(c.cast("binary")).alias("checksum")]
    kind = F.when(F.col("event_type") == "error", "tombstone").otherwise("commit")
    wal = e.select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), (F.col("event_id") % 50).alias("slot"), F.col("event_id").alias("seq"), kind.alias("kind"), *sums(F.col("props")))
    rest = F.col("event_id") % 11
    content = F.when(rest == 3, F.left("props", F.lit(3))).when(rest == 4, F.concat(F.left("props", F.char_length("props") - 1), F.lit("?"))).otherwise(F.col("props"))
    files = e.where(rest != 5).withColumn("c", content).select(F.col("event_id").alias("seq"), *sums(F.col("c")))
    return file_states(wal, files, ["key", "slot"]).select("key", "seq", "state")


def file_states(wal: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, state) of the last record of each key, if it is a commit: live, missing, truncated or corrupt."""
    last = wal.groupBy(*keys).agg(F.max(F.struct("seq", "kind", "length", "checksum")).alias("x")).where("x.kind = 'commit'").select(*keys, "x.seq", "x.length", "x.checksum")
    found = files.select("seq", F.col("length").alias("f_length"), F.col("checksum").alias("f_checksum"))
    state = F.when(F.col("f_length").isNull(), "missing").when(F.col("f_length") != F.col("length"), "truncated").when(F.col("f_checksum") != F.col("checksum"), "corrupt").otherwise("live")
    return last.join(found, "seq", "left").select(*keys, "seq", state.alias("state"))


REPLICAS = "SELECT p_partkey // 3 AS object_no, p_partkey AS replica_id, CASE WHEN p_partkey % 5 = 0 THEN 'disk' ELSE 'memory' END AS kind, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS segment_name, p_partkey % 4 <> 0 AS complete FROM part"


def replicas(spark: SparkSession, sf: str) -> DataFrame:
    """(object_no, replica_id, kind, segment_name, complete): up to three an object, those on disk without a segment."""
    key, disk = F.col("p_partkey"), F.col("p_partkey") % 5 == 0
    return S.table(spark, sf, "part").select(F.floor(key / 3).alias("object_no"), key.alias("replica_id"), F.when(disk, "disk").otherwise("memory").alias("kind"), F.when(~disk, F.col("p_brand")).alias("segment_name"), (key % 4 != 0).alias("complete"))


@query("replica_reads", S.sql("""SELECT object_no, asked_by, CASE WHEN n = 0 THEN 'not_found' WHEN asked_by <> concat('ten', CAST(object_no % 3 AS VARCHAR)) THEN 'unsafe_reuse' WHEN ok IS NULL THEN 'not_ready' ELSE 'ok' END AS outcome,
  CASE WHEN n > 0 AND asked_by = concat('ten', CAST(object_no % 3 AS VARCHAR)) THEN ok END AS readable
FROM (SELECT q.object_no, q.asked_by, count(r.replica_id) AS n, string_agg(CAST(r.replica_id AS VARCHAR), ',' ORDER BY r.replica_id) FILTER (WHERE complete AND (kind = 'disk' OR greatest(1500 - last_beat, 0) <= 700)) AS ok
  FROM (SELECT p_partkey // 2 AS object_no, concat('ten', CAST(p_partkey % 7 % 3 AS VARCHAR)) AS asked_by FROM part GROUP BY ALL) q LEFT JOIN replicas r ON r.object_no = q.object_no LEFT JOIN seg ON seg.segment_name = r.segment_name GROUP BY 1, 2) t""", "objects", seg=SEGMENTS, replicas=REPLICAS))
def replica_reads(spark: SparkSession, sf: str) -> DataFrame:
    asked = S.table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 2).alias("object_no"), F.concat(F.lit("ten"), (F.col("p_partkey") % 7 % 3).cast("string")).alias("asked_by")).distinct()
    return read_replicas(asked, replicas(spark, sf), segments(S.objects(spark, sf)), F.concat(F.lit("ten"), (F.col("object_no") % 3).cast("string")))


def read_replicas(asked: DataFrame, replicas: DataFrame, segments: DataFrame, owner: Column) -> DataFrame:
    """Each read's outcome and the replicas that may be read: complete, and on disk or in a segment that is alive.

    Errors come in the order not found, unsafe reuse (another ``owner``), not ready.
    """
    up = segments.select(F.col("segment_name").alias("s"), alive(F.col("last_beat")).alias("up"))
    held = replicas.join(up, F.col("segment_name") == F.col("s"), "left")
    good = F.col("complete") & ((F.col("kind") == "disk") | F.coalesce("up", F.lit(False)))
    held = held.groupBy("object_no").agg(F.array_sort(F.collect_list(F.when(good, F.col("replica_id")))).alias("ids"))
    rows = asked.join(held, "object_no", "left")
    error = F.when(F.col("ids").isNull(), "not_found").when(F.col("asked_by") != owner, "unsafe_reuse").when(F.size("ids") == 0, "not_ready")
    return rows.select("object_no", "asked_by", F.coalesce(error, F.lit("ok")).alias("outcome"), F.when(error.isNull(), F.array_join(F.col("ids").cast("array<string>"), ",")).alias("readable"))


SEGMENT_LOG = """SELECT event_id AS seq, concat('seg', CAST(user_id AS VARCHAR)) AS segment_name, concat('c', CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 2 AS VARCHAR)) AS client_id,
  CASE event_type WHEN 'click' THEN 'mount' WHEN 'signup' THEN 'remount' WHEN 'purchase' THEN 'unmount' ELSE 'heartbeat' END AS op FROM events"""


def segment_log(spark: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("event_type") == "click", "mount").when(F.col("event_type") == "signup", "remount").when(F.col("event_type") == "purchase", "unmount").otherwise("heartbeat")
    client = F.concat(F.lit("c"), (F.regexp_extract("props", "[0-9]+", 0).cast("long") % 2).cast("string"))
    return S.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("seg"), F.col("user_id").cast("string")).alias("segment_name"), client.alias("client_id"), op.alias("op"))


@query("segment_lifecycle", """WITH log AS (""" + SEGMENT_LOG + """), spans AS (SELECT *, count(*) FILTER (WHERE op IN ('mount', 'remount')) OVER (PARTITION BY segment_name ORDER BY seq) AS span FROM log),
owned AS (SELECT *, first_value(client_id) OVER (PARTITION BY segment_name, span ORDER BY seq) AS owner FROM spans),
done AS (SELECT *, min(seq) FILTER (WHERE op = 'unmount' AND span > 0 AND client_id = owner) OVER (PARTITION BY segment_name, span) AS ended FROM owned)
SELECT segment_name, CASE WHEN max(span) > 0 AND arg_max(ended, seq) IS NULL THEN arg_max(owner, seq) END AS owner,
  CASE WHEN max(span) > 0 AND arg_max(ended, seq) IS NULL THEN max(seq) FILTER (WHERE op IN ('mount', 'remount') OR op = 'heartbeat' AND span > 0 AND client_id = owner) END AS last_beat,
  count(*) FILTER (WHERE op = 'unmount' AND seq = ended) AS unmounted, count(*) FILTER (WHERE op = 'unmount' AND (ended IS NULL OR seq <> ended)) AS refused FROM (SELECT segment_name, seq, op, client_id, span, owner, ended FROM done) d GROUP BY 1""".replace("arg_max(ended, seq)", "arg_max_null(ended, seq)"))
def segment_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycles(segment_log(spark, sf))


def lifecycles(log: DataFrame) -> DataFrame:
    """(segment_name, owner, last_beat, unmounted, refused) after a log of (seq, segment_name, client_id, op).

    A mount or remount makes its client the owner; only the owner unmounts (others are refused, as is whoever finds it
    unmounted) and keeps a segment alive. So a log falls into spans, one a mount, that can be told apart by a count.
    """
    mounts = F.col("op").isin("mount", "remount")
    upto = Window.partitionBy("segment_name").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    span, inside = Window.partitionBy("segment_name", "span"), Window.partitionBy("segment_name", "span").orderBy("seq")
    rows = log.withColumn("span", F.sum(mounts.cast("long")).over(upto)).withColumn("owner", F.first("client_id").over(inside))
    mine = (F.col("span") > 0) & (F.col("client_id") == F.col("owner"))
    rows = rows.withColumn("ended", F.min(F.when((F.col("op") == "unmount") & mine, F.col("seq"))).over(span))
    beat = F.max(F.when(mounts | ((F.col("op") == "heartbeat") & mine), F.col("seq")))
    refused = (F.col("op") == "unmount") & (F.col("ended").isNull() | (F.col("seq") != F.col("ended")))
    out = rows.groupBy("segment_name").agg(F.max(F.struct("seq", "span", "owner", "ended")).alias("x"), beat.alias("beat"), F.count_if((F.col("op") == "unmount") & (F.col("seq") == F.col("ended"))).alias("unmounted"), F.count_if(refused).alias("refused"))
    up = (F.col("x.span") > 0) & F.col("x.ended").isNull()
    return out.select("segment_name", F.when(up, F.col("x.owner")).alias("owner"), F.when(up, F.col("beat")).alias("last_beat"), "unmounted", "refused")


RANGES = "SELECT p_brand AS segment_name, p_partkey AS id, (p_partkey * 7919) % 2000 * 4096 AS byte_offset, CAST(p_size AS BIGINT) * 4096 AS size FROM part"


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "part").select(F.col("p_brand").alias("segment_name"), F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7919) % 2000 * 4096).alias("byte_offset"), (F.col("p_size").cast("long") * 4096).alias("size"))


@query("snapshot_overlap_check", "WITH r AS (" + RANGES + """) SELECT segment_name, id FROM (SELECT *, max(byte_offset + size) OVER (PARTITION BY segment_name ORDER BY byte_offset, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken FROM r) t WHERE byte_offset < taken""")
def snapshot_overlap_check(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of a snapshot that begin inside one before them in their segment."""
    before = Window.partitionBy("segment_name").orderBy("byte_offset", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges(spark, sf).withColumn("taken", F.max(F.col("byte_offset") + F.col("size")).over(before))
    return rows.where("byte_offset < taken").select("segment_name", "id")


@query("free_gaps", "WITH r AS (" + RANGES + """) SELECT segment_name, taken AS gap_start, byte_offset - taken AS gap_size FROM (SELECT *, coalesce(max(byte_offset + size) OVER (PARTITION BY segment_name ORDER BY byte_offset, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM r) t WHERE byte_offset > taken""")
def free_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Free bytes between the allocated ranges of each segment."""
    before = Window.partitionBy("segment_name").orderBy("byte_offset", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges(spark, sf).withColumn("taken", F.coalesce(F.max(F.col("byte_offset") + F.col("size")).over(before), F.lit(0)))
    return rows.where("byte_offset > taken").select("segment_name", F.col("taken").alias("gap_start"), (F.col("byte_offset") - F.col("taken")).alias("gap_size"))


BINS = """SELECT s, CASE WHEN s < 8 THEN s ELSE (h - 2) * 8 + ((s >> (h - 3)) & 7) + CASE WHEN s & ((1::BIGINT << (h - 3)) - 1) <> 0 THEN 1 ELSE 0 END END AS up, CASE WHEN s < 8 THEN s ELSE (h - 2) * 8 + ((s >> (h - 3)) & 7) END AS down
FROM (SELECT s, CASE WHEN s < 8 THEN 3 ELSE CAST(length(ltrim(bin(s), '0')) - 1 AS INT) END AS h FROM (SELECT DISTINCT CAST(l_orderkey * l_partkey + l_linenumber AS BIGINT) AS s FROM lineitem) a) t"""


@query("small_float_bins", "WITH b AS (" + BINS + ") SELECT s, CAST(up AS BIGINT) AS up, CAST(down AS BIGINT) AS down, CAST(CASE WHEN down < 8 THEN down ELSE (8 + (down & 7))::BIGINT << CAST(down // 8 - 1 AS INT) END AS BIGINT) AS low FROM b")
def small_float_bins(spark: SparkSession, sf: str) -> DataFrame:
    size = (F.col("l_orderkey") * F.col("l_partkey") + F.col("l_linenumber")).cast("long")
    rows = S.table(spark, sf, "lineitem").select(size.alias("s")).distinct()
    rows = rows.select("s", small_float_up(F.col("s")).alias("up"), small_float_down(F.col("s")).alias("down"))
    return rows.select("s", "up", "down", small_float_value(F.col("down")).alias("low"))


def placements(asked: DataFrame, held: DataFrame, copies: int = 2, by: str = "free_ratio_first") -> DataFrame:
    """Where ``copies`` replicas of an object go: segments that fit, the preferred one first, then by free share or as mounted.

    The segments are ranked once; few of them go to the objects as one array, many meet them in a join.
    """
    seg = held.select(F.col("segment_name").alias("s"), "capacity", (F.col("capacity") - F.col("allocated")).alias("free"))
    seg = seg.join(F.broadcast(seg.agg(F.max("s").alias("preferred"))))
    order = [F.when(F.col("s") == F.col("preferred"), 0).otherwise(1).alias("other"), *([(-F.col("free").cast("double") / F.col("capacity")).alias("share")] if by == "free_ratio_first" else []), F.col("s")]
    asked = asked.select("object_key", "size", F.col("segment_name").alias("excluded"))
    if len(seg.take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS:
        fleet = seg.agg(F.array_sort(F.collect_list(F.struct(*order, "free"))).alias("fleet"))
        fit = F.filter("fleet", lambda x: (x["free"] >= F.col("size")) & (x["s"] != F.col("excluded")))
        rows = asked.join(F.broadcast(fleet)).select("object_key", F.slice(fit, 1, copies).alias("x"))
    else:
        fits = asked.join(seg, (F.col("free") >= F.col("size")) & (F.col("s") != F.col("excluded")))
        chosen = first_by(fits, ["object_key"], order, "r", copies).groupBy("object_key").agg(F.array_sort(F.collect_list(F.struct("r", "s"))).alias("x"))
        rows = asked.select("object_key").join(chosen, "object_key", "left")
    return rows.select("object_key", F.when(F.size("x") > 0, F.array_join(F.col("x.s"), ",")).alias("placed"), F.when(F.coalesce(F.size("x"), F.lit(0)) < copies, "no_available_segment").otherwise("ok").alias("outcome"))


def _placement(name: str, by: str):  # noqa: ANN202
    share = "s.free * 1.0::DOUBLE / s.capacity DESC, " if by == "free_ratio_first" else ""

    @query(name, S.sql(f"""SELECT object_key, nullif(concat_ws(',', p[1], p[2]), '') AS placed, CASE WHEN len(p) < 2 THEN 'no_available_segment' ELSE 'ok' END AS outcome FROM (
  SELECT q.object_key, coalesce(list(s.segment_name ORDER BY CASE WHEN s.segment_name = s.preferred THEN 0 ELSE 1 END, {share}s.segment_name) FILTER (WHERE s.segment_name IS NOT NULL), []) AS p
  FROM objects q LEFT JOIN s ON s.free >= q.size AND s.segment_name <> q.segment_name GROUP BY 1) t""", "objects", seg=SEGMENTS,
      s="SELECT segment_name, capacity, capacity - allocated AS free, (SELECT max(segment_name) FROM seg) AS preferred FROM seg"))
    def run(spark: SparkSession, sf: str, copies: int = 2) -> DataFrame:
        """A placement of every object."""
        objects = S.objects(spark, sf)
        return placements(objects, segments(objects), copies, by)

    return run


# Two names of the first strategy are kept: the first one once placed one object in twenty only.
segment_candidates = _placement("segment_candidates", "free_ratio_first")
segment_placement = _placement("segment_placement", "free_ratio_first")
segment_placement_as_mounted = _placement("segment_placement_as_mounted", "mount_order")


NICS = "SELECT s.s_suppkey AS location, n.n_nationkey AS nic, (s.s_suppkey * 31 + n.n_nationkey * 17) % 4 AS distance FROM supplier s JOIN nation n ON n.n_regionkey = s.s_suppkey % 5"


def nics(spark: SparkSession, sf: str) -> DataFrame:
    s, n = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("location")), S.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nic"), "n_regionkey")
    return s.join(n, F.col("n_regionkey") == F.col("location") % 5).select("location", "nic", ((F.col("location") * 31 + F.col("nic") * 17) % 4).alias("distance"))


@query("nic_affinity_rank", "WITH a AS (" + NICS + ") SELECT location, string_agg(CAST(nic AS VARCHAR), ',' ORDER BY distance, nic) AS ranked, min(distance) <= 1 AS direct FROM a GROUP BY 1")
def nic_affinity_rank(spark: SparkSession, sf: str, most: int = 1) -> DataFrame:
    """Network cards of each location from near to far, and whether the nearest allows direct access."""
    rows = nics(spark, sf).groupBy("location").agg(F.array_sort(F.collect_list(F.struct("distance", "nic"))).alias("x"), F.min("distance").alias("d"))
    return rows.select("location", F.array_join(F.transform("x", lambda y: y["nic"].cast("string")), ",").alias("ranked"), (F.col("d") <= most).alias("direct"))


@query("transport_select", """SELECT s_suppkey, arg_min(kind, rank) AS transport FROM (SELECT s_suppkey, unnest(['nvlink', 'rdma', 'shm', 'tcp']) AS kind, unnest([0, 1, 2, 3]) AS rank FROM supplier) t WHERE kind = 'tcp' OR (s_suppkey * 7 + rank * 3) % 4 = 0 GROUP BY 1""")
def transport_select(spark: SparkSession, sf: str) -> DataFrame:
    """The fastest installed transport; the plain one is always there."""
    kinds = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind")) for i, k in enumerate(["nvlink", "rdma", "shm", "tcp"])))
    rows = S.table(spark, sf, "supplier").select("s_suppkey", F.explode(kinds).alias("x"))
    rows = rows.where((F.col("x.kind") == "tcp") | ((F.col("s_suppkey") * 7 + F.col("x.rank") * 3) % 4 == 0))
    return rows.groupBy("s_suppkey").agg(F.min("x").alias("x")).select("s_suppkey", F.col("x.kind").alias("transport"))


@query("first_memory_replica", "SELECT p_size AS object_no, arg_min(p_brand, p_partkey) AS segment_name, min(p_partkey) AS replica_id FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1")
def first_memory_replica(spark: SparkSession, sf: str) -> DataFrame:
    """The replica that a read takes: of those in memory, the one of smallest id."""
    rows = S.table(spark, sf, "part").where("p_partkey % 3 <> 0").groupBy(F.col("p_size").alias("object_no")).agg(F.min(F.struct("p_partkey", "p_brand")).alias("x"))
    return rows.select("object_no", F.col("x.p_brand").alias("segment_name"), F.col("x.p_partkey").alias("replica_id"))


@query("manifest_gate", S.sql("SELECT r.request_id, greatest(CASE WHEN m.prefix_hash IS NULL THEN 0 ELSE (n_blocks * 64 - 1) // 16 * 16 END - decode_tokens, 0) AS matched_tokens FROM requests r LEFT JOIN (SELECT DISTINCT block_hash AS prefix_hash FROM kv_events WHERE tier = 'local_ssd' AND op = 'block_stored') m ON m.prefix_hash = concat('b', CAST(first_k AS VARCHAR))", "requests", "kv_events"))
def manifest_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens that a saved prefix spares: none without its manifest; never all of the prompt, less what is computed."""
    saved = S.kv_events(spark, sf).where("tier = 'local_ssd' and op = 'block_stored'").select(F.col("block_hash").alias("saved")).distinct()
    rows = S.requests(spark, sf).join(saved, F.concat(F.lit("b"), F.col("first_k").cast("string")) == F.col("saved"), "left")
    aligned = F.when(F.col("saved").isNotNull(), F.floor((F.col("n_blocks") * 64 - 1) / 16) * 16).otherwise(0)
    return rows.select("request_id", F.greatest(aligned - F.col("decode_tokens"), F.lit(0)).alias("matched_tokens"))
