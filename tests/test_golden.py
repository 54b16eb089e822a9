"""Worked examples with known answers."""

from __future__ import annotations

import hashlib
import json
import random

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cachefold.functions import columns as C
from cachefold.functions.frames import with_position
from cachefold.operators import blocks, cosched, identity, index, planner, prefix, store, telemetry, tiers
from cachefold.sources import tables as S
from cachefold.streaming import delivery

WORKERS = "worker_id string, ord long, role string, locality_domain string, hbm_capacity_bytes long, hbm_used_bytes long, queued_prefill_tokens long, running_decodes long"
RESIDENT = "worker_id string, tenant_id string, adapter_id string, prefix_hash string, block_hash string, block_index long, token_count long, tier string, put_seq long, bytes long"
BLOCKS = "request_id string, request_no long, tenant_id string, adapter_id string, pos long, block_hash string, prefix_hash string, token_count long"
REQUESTS = "request_id string, request_no long, tenant_id string, adapter_id string, n_blocks long, decode_tokens long, ttft_ms long, tpot_ms long"


def fleet(spark, *rows):
    return spark.createDataFrame([(w, i, role, dom, 100, used, queued, running) for i, (w, role, dom, used, queued, running) in enumerate(rows)], WORKERS)


def chain(spark, n, tokens=64):
    rows = [("r", 0, "t", None, i, f"b{i}", "root" if i == 0 else f"b{i - 1}", tokens) for i in range(n)]
    return spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([("r", 0, "t", None, n, 10, 800, 80)], REQUESTS)


def held(spark, *rows):
    return spark.createDataFrame([(w, "t", None, "root" if i == 0 else f"b{i - 1}", f"b{i}", i, tokens, tier, seq, size) for seq, (w, i, tier, tokens, size) in enumerate(rows)], RESIDENT)


def test_worked_block_costs(spark):
    workers = fleet(spark, *((w, "aggregated", "d", 0, 0, n) for w, n in (("w1", 10), ("w2", 5), ("w3", 9))))
    blocks, requests = chain(spark, 10)
    resident = held(spark, *((w, i, "hbm", 64, 1 << 20) for w, n in (("w1", 2), ("w2", 5), ("w3", 8)) for i in range(n)))
    rows = planner.plans(planner.block_choices(blocks, resident, workers), requests).withColumn("cost", planner.block_cost(F.col("credit")))
    assert {r.worker_id: r.cost for r in rows.collect()} == {"w1": 18.0, "w2": 10.0, "w3": 11.0}
    best = planner.decide(rows, "dynamo_cost").first()
    assert (best.worker_id, best.local_hits) == ("w2", 5)


def test_tiers_earn_less_credit(spark):
    workers = fleet(spark, ("a", "aggregated", "d", 0, 0, 0), ("b", "aggregated", "d", 0, 0, 0))
    blocks, requests = chain(spark, 4)
    resident = held(spark, *((w, i, t, 64, 1 << 20) for w, t in (("a", "hbm"), ("b", "local_ssd")) for i in range(4)))
    rows = planner.plans(planner.block_choices(blocks, resident, workers), requests).withColumn("cost", planner.block_cost(F.col("credit")))
    assert {r.worker_id: r.cost for r in rows.collect()} == {"a": 0.0, "b": 3.0}


def test_recompute_beats_a_dear_transfer(spark):
    workers = fleet(spark, ("w0", "aggregated", "d", 0, 0, 0))
    blocks, requests = chain(spark, 1, tokens=1)
    row = planner.plans(planner.block_choices(blocks, held(spark, ("w9", 0, "object_store", 1, 64 << 20)), workers), requests).first()
    assert (row.local_hits, row.transfers, row.recomputes) == (0, 0, 1)


def test_all_workers_are_candidates_if_none_decodes(spark):
    rows = planner.candidates(fleet(spark, ("a", "prefill", "d", 0, 0, 0), ("b", "prefill", "d", 0, 0, 0))).collect()
    assert sorted((r.worker_id, r.slot, r.fleet) for r in rows) == [("a", 0, 2), ("b", 1, 2)]


def test_contiguous_overlap(spark):
    blocks, _ = chain(spark, 4)
    table = spark.createDataFrame([("g0", "t", None, f"b{i}") for i in range(3)] + [("g1", "t", None, "b0"), ("g2", "t", None, "b1")], "worker_id string, tenant_id string, adapter_id string, block_hash string")
    assert {(r.worker_id, r.overlap) for r in prefix.overlaps(blocks, table).collect()} == {("g0", 3), ("g1", 1)}


def test_conductor_spills_to_an_idle_worker(spark):
    workers = fleet(spark, ("g0", "aggregated", "d", 0, 0, 100), ("g1", "aggregated", "d", 0, 0, 0))
    _, requests = chain(spark, 2)
    over = spark.createDataFrame([("r", "g0", 2)], "request_id string, worker_id string, overlap long")
    assert prefix.conducted(requests, over, workers).first().worker_id == "g1"


def test_violation_classes(spark):
    scope = "m string, t string, a string, n string"
    rows = spark.createDataFrame([("m", "t", "lora", "one"), ("m", "t", "lora", "two"), ("m", "t", None, "two"), ("x", "t", None, "one")], scope)
    names = dict(zip("mtan", identity.SCOPE, strict=True))
    a = rows.select(*(F.lit(v).alias(f"a_{names[k]}") for k, v in zip("mtan", ("m", "t", "lora", "one"), strict=True)), *(F.col(k).alias(f"b_{names[k]}") for k in "mtan"))
    assert [r[0] for r in a.select(identity.violation("a_", "b_")).collect()] == [None, "cross_tenant", "cross_adapter", "cross_model"]


def test_replication(spark):
    workers = fleet(spark, *((w, "aggregated", "d", 0, load, 0) for w, load in (("w1", 9), ("w2", 5), ("w3", 1), ("w4", 2))))
    hot = spark.createDataFrame([("t", None, "p", 9, ["w1"]), ("t", None, "cold", 1, ["w1"]), ("t", None, "full", 9, ["w1", "w2", "w3"])], "tenant_id string, adapter_id string, prefix_hash string, accesses long, holders array<string>")
    rows = prefix.replications(hot, workers, target=3, hot=3).collect()
    assert sorted((r.from_worker, r.to_worker) for r in rows) == [("w1", "w3"), ("w1", "w4")]
    assert [r.to_worker for r in prefix.replications(hot, workers, target=3, hot=3, most=1).collect()] == ["w3"]


def test_sketch_saturates_and_halves(spark):
    adds = spark.createDataFrame([("k", i) for i in range(500)], "key string, seq long")
    assert {r["count"] for r in prefix.sketch(adds, width=4096, depth=4).collect()} == {255}
    adds = spark.createDataFrame([("k", i) for i in range(40)], "key string, seq long")
    # 8 additions an epoch: after five complete epochs the running one is empty.
    c = 0
    for _ in range(5):
        c = min(255, c + 8) // 2
    assert {r["count"] for r in prefix.sketch(adds, width=4, depth=2).collect()} == {c}


def test_telemetry_example(spark):
    layers = spark.createDataFrame([(0, 0, 500, 1000, False), (0, 1, 500, 4000, False)], "transfer_id long, layer_index long, layer_bytes long, done_us long, failed boolean")
    row = telemetry.transfer_observation(telemetry.transfer_telemetry(layers)).first()
    assert (row.first_layer_ms, row.full_ms, row.overlap_pct, row.bandwidth_mbps) == (1.0, 4.0, 75.0, 2.0)


def test_gate_stops_at_the_first_error(spark):
    layers = spark.createDataFrame([(0, 0, 1, 10, False), (0, 1, 1, 30, False), (0, 2, 1, 20, True), (0, 3, 1, 5, False)], "transfer_id long, layer_index long, layer_bytes long, done_us long, failed boolean")
    rows = telemetry.gated(layers).orderBy("layer_index").collect()
    assert [(r.ready_us, r.notified) for r in rows] == [(10, True), (30, False), (30, False), (30, False)]


def test_watermark_eviction_example(spark):
    rows = [(f"k{i}", "s", 10, False, False, i, 0) for i in range(10)]
    objects = spark.createDataFrame(rows, "object_key string, segment_name string, size long, soft_pinned boolean, hard_pinned boolean, last_access long, lease_until long")
    seg = spark.createDataFrame([("s", 100, 100)], "segment_name string, capacity long, allocated long")
    gone = store.evicted(objects, seg, F.col("allocated") - F.col("freed") <= F.floor(F.lit(store.HIGH) * store.KEEP * F.col("capacity")))
    assert sorted(r.object_key for r in gone.collect()) == ["k0", "k1"]


def test_small_float_bins_round_both_ways(spark):
    sizes = [0, 1, 7, 8, 9, 15, 16, 17, 31, 1000, 4096, 2**31, 2**40 + 1]
    df = spark.createDataFrame([(s,) for s in sizes], "s long")
    df = df.select("s", C.small_float_value(C.small_float_up(F.col("s"))).alias("up"), C.small_float_value(C.small_float_down(F.col("s"))).alias("down"))
    for r in df.collect():
        assert r.down <= r.s <= r.up and (r.up - r.down) * 8 <= max(r.s, 1) * 2


def snapshot(spark, **given):
    names = ["ttft_ms", "budget_ms", "goodput_pct", "remote_pct", "first_layer_ms", "full_ms", "overlap_pct", "queue_depth", "hbm_pct"]
    healthy = {"ttft_ms": 100.0, "budget_ms": 800.0, "goodput_pct": 99.0, "remote_pct": 1.0, "first_layer_ms": 5.0, "full_ms": 10.0, "overlap_pct": 90.0, "queue_depth": 0.0, "hbm_pct": 10.0}
    return spark.createDataFrame([tuple((healthy | given)[n] for n in names)], ", ".join(f"{n} double" for n in names))


@pytest.mark.parametrize(
    ("given", "kinds"),
    [
        ({}, []),
        ({"ttft_ms": 900.0}, ["adjust_pd_ratio"]),
        ({"ttft_ms": None, "goodput_pct": None}, []),
        ({"remote_pct": 30.0}, ["replicate_hot_prefix"]),
        ({"hbm_pct": 95.0}, ["demote_prefix"]),
        ({"first_layer_ms": 25.0, "full_ms": 25.0}, ["tune_transfer_depth"]),
        ({"goodput_pct": 80.0, "queue_depth": 16.0, "hbm_pct": 95.0}, ["adjust_pd_ratio", "demote_prefix", "tune_transfer_depth", "admission_reject"]),
    ],
)
def test_rules(spark, given, kinds):
    workers = fleet(spark, ("p", "prefill", "d", 50, 10, 0), ("d", "decode", "d", 60, 0, 1))
    hot = spark.createDataFrame([("t", None, "x", 9, ["p"])], "tenant_id string, adapter_id string, prefix_hash string, accesses long, holders array<string>")
    rows = cosched.rule_actions(snapshot(spark, **given), hot, workers).orderBy("seq").collect()
    assert [r.kind for r in rows] == kinds
    if "replicate_hot_prefix" in kinds:
        assert (rows[0].target, rows[0].source, rows[0].prefix) == ("d", "p", "x")


def test_fold_of_an_empty_log_is_empty(spark):
    events = spark.createDataFrame([], "seq long, op string, " + RESIDENT.replace(", put_seq long", ""))
    assert index.fold_events(events).count() == 0


def test_removals_and_clears(spark):
    def event(seq, op, worker="w", block="b0", tier="hbm"):
        return (seq, op, worker, "t", None, "root", block, 0, 64, tier, 1)

    log = [event(0, "block_stored"), event(1, "block_stored", tier="cpu_dram"), event(2, "block_removed"), event(3, "block_stored", block="b1"), event(4, "block_stored", worker="v"), event(5, "all_blocks_cleared", worker="v"), event(6, "block_stored")]
    events = spark.createDataFrame(log, "seq long, op string, " + RESIDENT.replace(", put_seq long", ""))
    assert sorted((r.worker_id, r.block_hash, r.put_seq) for r in index.fold_events(events).collect()) == [("w", "b0", 6), ("w", "b1", 3)]
    assert index.fold_events(events, precise=False).count() == 3


def test_access_classes_match_a_plain_cascade(spark, monkeypatch):
    monkeypatch.setattr(tiers, "RUN", 37)
    monkeypatch.setattr(tiers, "FAN", 3)  # three levels of runs
    rng = random.Random(3)
    log = [(f"w{rng.randrange(2)}", f"b{int(rng.paretovariate(0.7)) % 90}", i) for i in range(900)]
    stacks: dict[str, list[str]] = {}
    expected = []
    for w, b, i in log:
        tiers_of = stacks.setdefault(w, [])
        at = tiers_of.index(b) if b in tiers_of else None
        expected.append((w, b, i, "admit" if at is None else "hit" if at < 8 else "promote"))
        if at is not None:
            tiers_of.pop(at)
        tiers_of.insert(0, b)
        del tiers_of[56:]
    df = spark.createDataFrame(pd.DataFrame(log, columns=["worker_id", "block", "seq"]))
    assert sorted(map(tuple, tiers.access_classes(df).collect())) == sorted(expected)


def test_positions_do_not_depend_on_runs(spark):
    df = spark.createDataFrame([(k,) for k in (5, 70, 3, 900, 64, 65)], "k long")
    assert {r.k: r.place for r in with_position(df, "k", "place", width=64).collect()} == {3: 0, 5: 1, 64: 2, 65: 3, 70: 4, 900: 5}


def test_torn_and_corrupt_logs(spark, tmp_path):
    from cachefold.sources.logs import frame, read_frames

    whole = frame(b'{"op":"a"}') + frame(b'{"op":"b"}')
    flipped = bytearray(whole)
    flipped[10] ^= 1
    for name, data in (("whole", whole), ("torn", whole[:-3]), ("flipped", bytes(flipped)), ("empty", b"")):
        (tmp_path / name).write_bytes(data)
    rows = read_frames(spark, str(tmp_path)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.seq) for r in rows) == [("torn", 0), ("whole", 0), ("whole", 1)]


def test_every_object_is_placed(spark, sf, monkeypatch):
    objects = S.objects(spark, sf)
    placed = {r.object_key: (r.placed, r.outcome) for r in store.segment_placement(spark, sf).collect()}
    assert set(placed) == {r.object_key for r in objects.collect()}
    monkeypatch.setattr(store, "BROADCAST_ROWS", 0)
    assert {r.object_key: (r.placed, r.outcome) for r in store.segment_placement(spark, sf).collect()} == placed


def test_placement_order(spark):
    held = spark.createDataFrame([("a", 100, 50), ("b", 100, 10), ("c", 100, 95), ("d", 100, 90)], "segment_name string, capacity long, allocated long")
    asked = spark.createDataFrame([("k1", 5, "a"), ("k2", 8, "b"), ("k3", 20, "b"), ("k4", 99, "a")], "object_key string, size long, segment_name string")
    rows = {r.object_key: (r.placed, r.outcome) for r in store.placements(asked, held).collect()}
    assert rows == {"k1": ("d,b", "ok"), "k2": ("d,a", "ok"), "k3": ("a", "no_available_segment"), "k4": (None, "no_available_segment")}


def test_audit_among_all_others(spark):
    rows = [(2, "x", "t"), (4, "x", "t"), (6, "y", "t"), (8, "y", "u"), (1, "z", "t"), (3, "z", "u"), (5, "z", "u"), (7, "w", "t"), (9, None, "t"), (11, None, "t")]
    blocks = spark.createDataFrame([(d, h, "m", "k", None, t) for d, h, t in rows], "doc_id long, block_hash string, model_id string, tokenizer_id string, adapter_id string, tenant_id string")
    got = {r.doc_id: r.outcome for r in identity.audited_by_others(blocks).collect()}
    assert got == {2: "safe", 4: "safe", 6: "cross_tenant", 8: "cross_tenant", 1: "cross_tenant", 3: "safe", 5: "safe", 7: "absent", 9: "absent", 11: "absent"}


def test_every_document_asks(spark, sf):
    assert {r.doc_id for r in identity.guarded_get_all(spark, sf).collect()} == {r.doc_id for r in S.docs(spark, sf).collect()}


def test_sketch_of_the_store_ages_as_slowly(spark):
    # 2,000 additions: 16,384 an epoch keep all of them, 1,024 halve the first ones.
    adds = spark.range(2000).selectExpr("concat('k', id % 20) as key", "id as seq")
    assert {r["count"] for r in prefix.sketch(adds).collect()} == {100}
    assert min(r["count"] for r in prefix.sketch(adds, 256).collect()) < 100
    assert prefix.WIDTH * prefix.DEPTH == 16384


def test_sketch_halves_over_empty_epochs(spark):
    keys = ["k"] * 30 + ["o"] * 12 + ["k"] * 3 + ["o"] * 7
    adds = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, seq long")
    cells = {r.key: r.c for r in adds.select("key").distinct().select("key", prefix.cell_of(F.col("key"), F.lit(0), 8).alias("c")).collect()}
    want = dict.fromkeys(cells.values(), 0)
    for at, k in enumerate(keys, 1):
        want[cells[k]] += 1
        if at % 8 == 0:
            want = {c: n // 2 for c, n in want.items()}
    assert {r.cell: r["count"] for r in prefix.sketch(adds, 8, 1).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_periods_fold_like_a_plain_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix, "RUN", 64)
    draw, last = random.Random(seed), 400
    shares = {"steady": 1.0, "often": 0.9, "rare": 0.02, "early": 1.0, "late": 1.0}
    allowed = {"early": range(70), "late": range(380, last + 1)}
    size = lambda k, i: (2 if i == 3 else 1) if k == "steady" else draw.choice((1, 1, 1, 2, 600))
    rows = [(k, i, size(k, i)) for k, share in shares.items() for i in allowed.get(k, range(last + 1)) if draw.random() < share]
    counts, at = spark.createDataFrame(rows, "block_hash string, i long, n long"), spark.range(1).select(F.lit(last).cast("long").alias("last"))

    def plain(key: str, most: int, to: int) -> int:
        c = 0
        for i in range(to):
            c = min(most, c + sum(n for k, p, n in rows if k == key and p == i)) // 2
        return c

    want = {k: plain(k, 1 << 60, last + 1) for k in shares}
    assert want["steady"] == 1 and {r.block_hash: r.hotness for r in prefix.decayed(counts, at).collect()} == {k: c for k, c in want.items() if c}
    held = {r.block_hash: (r.start.i, r.start.n) for r in prefix.in_last_run(counts, ["block_hash"], at, 255).collect()}
    assert held == {k: (384, plain(k, 255, 384)) for k in shares}


def test_hotness_of_a_steady_key_outlives_60_intervals(spark):
    rows = [("steady", 0, 9)] + [("steady", i, 1) for i in range(1, 100)] + [("gap", 0, 1000), ("gap", 5, 3), ("gone", 3, 100), ("new", 99, 7)]
    got = {r.block_hash: r.hotness for r in prefix.decayed(spark.createDataFrame(rows, "block_hash string, i long, n long"), spark.sql("select 99L as last")).collect()}
    want = {}
    for key in ("steady", "gap", "gone", "new"):
        c = 0
        for i in range(100):
            c = (c + sum(n for k, at, n in rows if k == key and at == i)) // 2
        want[key] = c
    assert want["steady"] == 1 and got == {k: c for k, c in want.items() if c}


def test_hotness_query_keeps_steady_keys(spark, monkeypatch):
    # One early burst, then one access an interval for 80 intervals.
    seqs = [0, 1, 2] + [500 * i for i in range(1, 80)]
    events = spark.createDataFrame([("k", "block_stored", s) for s in seqs], "block_hash string, op string, seq long")
    monkeypatch.setattr(prefix.S, "kv_events", lambda spark, sf: events)
    assert [(r.block_hash, r.hotness) for r in prefix.hotness_decay(spark, "").collect()] == [("k", 1)]


def test_hotness_query_rounds_down(spark, monkeypatch):
    # One access in each of 30 intervals, no burst: each is halved to 0.
    events = spark.createDataFrame([("k", "block_stored", 500 * i) for i in range(30)], "block_hash string, op string, seq long")
    monkeypatch.setattr(prefix.S, "kv_events", lambda spark, sf: events)
    assert prefix.hotness_decay(spark, "").collect() == []


def test_text_blocks_read_long_texts_whole(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(20_001))
    texts = spark.createDataFrame([(1, text), (2, ""), (3, "é" * 257)], "k long, text string")
    got = {(r.k, r.pos): r for r in blocks.text_blocks(texts, ["k"], "text", whole=True).collect()}
    assert len(got) == 79 + 1 + 2 and got[1, 78].token_count == 9
    assert got[1, 78].block_hash == hashlib.md5(text.encode()).hexdigest() and got[1, 78].prefix_hash == got[1, 77].block_hash
    for r in blocks.text_blocks(texts, ["k"], "text").collect():
        assert got[r.k, r.pos] == r


LOG = "seq long, op string, " + RESIDENT.replace(", put_seq long", "")


def test_the_last_store_s_bytes_count(spark):
    log = [(i, "block_stored", "w", "t", None, "root", "b0", 0, 64, "hbm", size) for i, size in enumerate([7, 100, 40])]
    assert [(r.put_seq, r.bytes) for r in index.fold_events(spark.createDataFrame(log, LOG)).collect()] == [(2, 40)]


def test_event_batches(spark):
    engines = spark.createDataFrame([("e", "m", "k", "t0")], "engine_id string, default_model string, default_tokenizer string, default_tenant string")
    bodies = [
        (0, '{"engine_id":"e","ts_ms":9,"events":[{"type":"block_stored","block_hashes":["h0","h1"],"block_size":3,"medium":"gpu","lora_name":"l"},{"type":"all_blocks_cleared"}]}'),
        (1, '{"engine_id":"e","tenant_id":"t1","adapter_id":"a","bytes_per_block":5,"events":[{"type":"block_stored","block_hashes":["h2"],"parent_block_hash":"h1","block_size":3,"medium":"tape","lora_name":"l"},{"type":"block_stored","block_hashes":["h3"],"block_size":1,"bytes_per_block":6},{"type":"block_removed","block_hashes":["h0"]},{"type":"other"}]}'),
        (2, '{"engine_id":"nobody","events":[{"type":"all_blocks_cleared"}]}'), (3, "no json"), (4, '{"engine_id":"e","events":[]}'), (5, None),
    ]
    rows = index.event_rows(spark.createDataFrame(bodies, "batch_no long, body string"), engines).orderBy("batch_no", "event_no", "block_index").collect()
    told = [(r.batch_no, r.event_no, r.op, r.tenant_id, r.adapter_id, r.prefix_hash, r.block_hash, r.block_index, r.token_count, r.tier, r.bytes, r.ts_ms) for r in rows]
    assert told == [
        (0, 0, "block_stored", "t0", "l", "root", "h0", 0, 3, "hbm", 4 << 20, 9), (0, 0, "block_stored", "t0", "l", "h0", "h1", 1, 3, "hbm", 4 << 20, 9), (0, 1, "all_blocks_cleared", "t0", None, None, None, None, None, None, None, 9),
        (1, 0, "block_stored", "t1", "a", "h1", "h2", 0, 3, "hbm", 5, 0), (1, 1, "block_stored", "t1", "a", "root", "h3", 0, 1, "hbm", 6, 0), (1, 2, "block_removed", "t1", "a", None, "h0", None, None, None, None, 0),
    ]


def test_eviction_takes_the_oldest_of_all_segments(spark):
    rows = [(f"k{i}", f"s{i % 2}", 10, i == 0, i == 3, 70 * i, 2000 * (i == 4)) for i in range(8)]
    objects = spark.createDataFrame(rows, "object_key string, segment_name string, size long, soft_pinned boolean, hard_pinned boolean, last_access long, lease_until long")
    seg = spark.createDataFrame([("s0", 60, 40), ("s1", 40, 40)], "segment_name string, capacity long, allocated long")
    free = lambda n: F.col("capacity") - (F.col("allocated") - F.col("freed")) >= n
    assert [sorted(r.object_key for r in store.evicted(objects, seg, free(n)).collect()) for n in (20, 45, 1000)] == [[], ["k1", "k2", "k5"], ["k0", "k1", "k2", "k5", "k6", "k7"]]


def test_segments_belong_to_who_mounted_them_last(spark):
    log = [("a", "c0", "heartbeat"), ("a", "c0", "mount"), ("a", "c1", "unmount"), ("a", "c1", "remount"), ("a", "c0", "unmount"), ("a", "c0", "heartbeat"), ("a", "c1", "heartbeat"), ("b", "c0", "mount"), ("b", "c0", "unmount"), ("b", "c0", "unmount"), ("b", "c0", "heartbeat"), ("c", "c0", "unmount")]
    rows = store.lifecycles(spark.createDataFrame([(i, *r) for i, r in enumerate(log)], "seq long, segment_name string, client_id string, op string")).collect()
    assert sorted(map(tuple, rows)) == [("a", "c1", 6, 0, 2), ("b", None, None, 1, 1), ("c", None, None, 0, 1)]


def test_replicas_that_may_be_read(spark):
    replicas = spark.createDataFrame([(1, 1, "memory", "up", True), (1, 2, "memory", "down", True), (1, 3, "disk", None, True), (2, 4, "memory", "down", True), (2, 5, "disk", None, False), (3, 6, "memory", "gone", True)], "object_no long, replica_id long, kind string, segment_name string, complete boolean")
    seg = spark.createDataFrame([("up", store.NOW - store.TTL), ("down", store.NOW - store.TTL - 1)], "segment_name string, last_beat long")
    asked = spark.createDataFrame([(i, t) for i in (1, 2, 3, 4) for t in ("t", "u")], "object_no long, asked_by string")
    got = {(r.object_no, r.asked_by): (r.outcome, r.readable) for r in store.read_replicas(asked, replicas, seg, F.lit("t")).collect()}
    assert got == {(1, "t"): ("ok", "1,3"), (1, "u"): ("unsafe_reuse", None), (2, "t"): ("not_ready", None), (2, "u"): ("unsafe_reuse", None), (3, "t"): ("not_ready", None), (3, "u"): ("unsafe_reuse", None), (4, "t"): ("not_found", None), (4, "u"): ("not_found", None)}


def test_measured_transfers_come_before_planned_ones(spark):
    tele = spark.createDataFrame([("a", False, 1000, 4000, 3000, 1000), ("a", True, None, None, None, None), ("b", True, None, None, None, None)], "tenant_id string, failed boolean, first_us long, full_us long, overlap_us long, bytes long")
    planned = spark.createDataFrame([("a", 9, 9), ("b", 1200, 300)], "tenant_id string, total_us long, first_us long")
    rows = telemetry.observed(spark.createDataFrame([("a",), ("b",), ("c",)], "tenant_id string"), tele, planned).orderBy("tenant_id").collect()
    assert list(map(tuple, rows)) == [("a", "measured", 1.0, 4.0, 3.0, 1.0, 75.0, 2.0), ("b", "planned", 0.3, 1.2, 0.9, 0.3, 75.0, None), ("c", None, None, None, None, None, None, None)]


def test_violation_pairs_are_counted_without_pairs(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, f"h{rng.randrange(6)}", rng.choice("mn"), rng.choice("kl"), rng.choice(["a", None]), rng.choice("tu")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, block_hash string, model_id string, tokenizer_id string, adapter_id string, tenant_id string")
    monkeypatch.setattr(identity.S, "docs", lambda spark, sf: docs)
    want: dict = {}
    for x in rows:
        for y in rows:
            if x[0] != y[0] and x[1] == y[1]:
                kind = next((k for k, a, b in zip(("cross_model", "cross_tokenizer", "cross_adapter", "cross_tenant"), x[2:], y[2:], strict=True) if a != b), "match")
                want[kind] = want.get(kind, 0) + 1
    assert {r.violation: r.n_pairs for r in identity.reuse_violation_pairs(spark, "").collect()} == want


def test_epochs_replay_one_after_the_other(spark, sf):
    """Each epoch by itself, against a table that the decisions before it were put into by hand."""
    held = index.fold_events(S.kv_events(spark, sf)).toPandas()
    blocks, requests, workers = S.request_blocks(spark, sf), S.requests(spark, sf), S.workers(spark, sf)
    want = {}
    for e in range(3):
        now = F.col("request_no") % 3 == e
        resident = spark.createDataFrame(list(held.astype(object).where(held.notna(), None).itertuples(index=False, name=None)), RESIDENT)
        rows = planner.decide(planner.plans(planner.block_choices(blocks.where(now), resident, workers), requests.where(now)), "greedy").collect()
        chosen = {r.request_id: r for r in rows}
        want |= {i: (r.worker_id, r.local_hits, r.transfers, r.recomputes, e) for i, r in chosen.items()}
        puts = [{"worker_id": chosen[b.request_id].worker_id, "tenant_id": b.tenant_id, "adapter_id": b.adapter_id, "prefix_hash": b.prefix_hash, "block_hash": b.block_hash, "block_index": b.pos, "token_count": b.token_count, "tier": "hbm", "put_seq": 10**12 + b.request_no + 1, "bytes": 4194304} for b in blocks.where(now).collect()]
        held = pd.concat([held, pd.DataFrame(puts)]).sort_values("put_seq").drop_duplicates(["worker_id", "tenant_id", "adapter_id", "prefix_hash", "block_hash", "block_index", "token_count", "tier"], keep="last")[held.columns]
    got = {r.request_id: (r.worker_id, r.local_hits, r.transfers, r.recomputes, r.epoch) for r in planner.route_in_epochs(spark, sf).collect()}
    assert got == want


def test_rejected_batches_fail_open_or_stop_the_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i}", "w", i) for i in range(6)], "request_id string, worker_id string, ord long")
    events = delivery.decision_events(rows)
    # The planned events come in the first batch, the committed ones in the second.
    for phase in delivery.PHASES:
        events.where(f"phase = '{phase}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got: dict[int, list[str]] = {}

    def picky(batch_rows, batch):
        if batch == 1:
            raise OSError("no")
        got[batch] = [r.body for r in batch_rows.collect()]

    def run(name, sink, **how):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return {(r.told, r.delivery) for r in delivery.deliver(stream, sink, str(tmp_path / name), str(tmp_path / f"{name}-state"), **how).collect()}

    assert run("none", None) == {(2, "disabled")}
    assert run("open", picky) == {(2, "failed")} and list(got) == [0]
    body = sorted(map(json.loads, got[0]), key=lambda e: e["route"]["ord"])[0]
    assert (body["schema_version"], body["route"]) == (1, {"request_id": "r0", "worker_id": "w", "ord": 0}) and body["phase"] in delivery.PHASES
    with pytest.raises(StreamingQueryException):
        run("shut", picky, fail_open=False)
    assert run("shut", lambda batch_rows, batch: None, fail_open=False) == {(2, "sent")}
