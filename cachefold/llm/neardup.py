"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its distinct k-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased). Equal sets form
one class first, so exact copies never meet in a bucket. Each class gets a signature from two permutations: ``sigma``
puts a shingle into one of 2**20 slots (as a hash does; shingles that share a slot only add candidates), and ``pi``,
circularly shifted by 0, 1, 2, ..., gives all the coordinates. Bands of four coordinates are buckets.

Within buckets, classes are first compared with a few leaders of their bucket, links are merged into components, and
only buckets that still hold several components go on: there, every remaining pair of different components that share
a bucket is compared by whole signatures, in blocks, inside tasks; pairs with ``LEAST_EQUAL`` of 96 equal coordinates
(at 0.8, fewer have a probability below 1e-10) are compared by their sets at once, and only links come out. Links are
confirmed on whole sets: 100 * |a & b| >= 80 * |a | b|. So a bucket with one giant near-copy group costs a few
comparisons a member. The rows of buckets, leaders and classes that hold more than a ten-thousandth of all rows are
dealt over many tasks.

A very long text is read in pieces; what is held of it is its words' hashes and its set (16 bytes a word).

Defined cases: a null or word-less text has an empty set, links with nothing and is its own component. With fewer words
than ``k``, the whole sequence is the one shingle. Rows that repeat a doc_id are treated as further documents of that
id. Rows with a null doc_id link with nothing, have a null component and are not kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, hot_of, join_spread, materialize, mix64, scratch, word_hashes, word_hashes_of_long
from .components import connected_components, merged

SLOTS = 1 << 20  # the universe that the permutations act on
ROWS, BANDS = 4, 24  # a pair at 0.8 is missed with probability (1 - 0.8**4)**24 < 4e-6
SEED = 20
CHUNK = 1 << 20  # bytes of text hashed at once
BLOCK = 256  # classes in a block of the last comparison
LEAST_EQUAL = 50  # equal coordinates of a pair worth its whole sets
PAIRS_AT_ONCE = 1 << 13
SIMILAR = 80  # per cent

_pi: dict[int, np.ndarray] = {}


def _windows() -> np.ndarray:
    """``pi`` unrolled: row s holds the values that slot s has under all circular shifts."""
    if SEED not in _pi:
        pi = np.random.RandomState(SEED).permutation(SLOTS).astype(np.uint32)
        _pi[SEED] = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: ROWS * BANDS]]), ROWS * BANDS)
    return _pi[SEED]


def coordinates(shingles: np.ndarray) -> np.ndarray:
    """The signature of a set: the least value under each circular shift."""
    slots = (mix64(shingles ^ np.uint64(SEED)) % np.uint64(SLOTS)).astype(np.int64)
    least = np.full(ROWS * BANDS, SLOTS, dtype=np.uint32)
    for at in range(0, len(slots), 8192):  # bounds the memory of very long texts
        np.minimum(least, _windows()[slots[at : at + 8192]].min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """The bucket numbers of a signature: one a band."""
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) ^ least.reshape(BANDS, ROWS)[:, r].astype(np.uint64))
    return keys.view(np.int64)


def _set_of(words: np.ndarray, joined: np.ndarray, k: int) -> np.ndarray:
    if len(words) >= k:
        return np.unique(joined)
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    one = np.full(1, len(words), dtype=np.uint64)
    for w in words:
        one = mix64(one * np.uint64(0x9E3779B97F4A7C15) ^ w)
    return one


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    joined = np.full(max(0, len(words) - k + 1), k, dtype=np.uint64)
    for j in range(k):
        joined = mix64(joined * np.uint64(0x9E3779B97F4A7C15) ^ words[j : j + len(joined)])
    return joined


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text."""
    chunk: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if chunk and size + len(data) > CHUNK:
            yield from _sets_of_chunk(chunk, k)
            chunk, size = [], 0
        if len(data) > CHUNK:
            words = word_hashes_of_long(data, CHUNK)
            yield _set_of(words, _shingles(words, k), k)
        else:
            chunk.append(data)
            size += len(data) + 1
    yield from _sets_of_chunk(chunk, k)


def _sets_of_chunk(chunk: list[bytes], k: int) -> Iterator[np.ndarray]:
    if not chunk:
        return
    words, owner = word_hashes(chunk)
    bounds = np.searchsorted(owner, np.arange(len(chunk) + 1))
    joined = _shingles(words, k)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield _set_of(words[a:b], joined[a : max(a, b - k + 1)], k)


def _features(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands); set_key is a 128-bit digest of the set, null if it is empty."""
    import hashlib

    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            size, keys, bands = [], [], []
            for s in shingle_sets(texts, k):
                size.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(coordinates(s)) if len(s) else None)
            columns = [ids, pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(rep, n, items, sig): the sets of the classes in ``ids`` (rep, n), sorted 64-bit hashes as bytes, and their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sigs, begin, size = [], [], 0, 0
            for i, s in enumerate(shingle_sets(batch.column(1).to_pylist(), k)):
                items.append(s.tobytes())
                sigs.append(coordinates(s).tobytes())
                size += len(items[-1])
                if size > CHUNK << 4 or i + 1 == batch.num_rows:
                    rows = batch.slice(begin, len(items))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(items, pa.binary()), pa.array(sigs, pa.binary())], ["rep", "n", "items", "sig"])
                    items, sigs, begin, size = [], [], i + 1, 0

    # Texts are dealt by id at any size, as the list of ids grows with them.
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ids.hint("merge"), "rep")
    found = texts.select("rep", "text", "n").mapInArrow(run, "rep long, n long, items binary, sig binary")
    # A doc_id may be repeated with another text: each of its sets is kept, once.
    return found.where(F.length("items") == F.col("n") * 8).dropDuplicates(["rep", "items"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= SIMILAR * union, on sorted sets."""
    least = min(len(a), len(b))
    if least * 100 < SIMILAR * max(len(a), len(b)):
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(long, short)
    both = int(np.count_nonzero(long[np.minimum(at, len(long) - 1)] == short))
    return 100 * both >= SIMILAR * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v), u < v, for those of the pairs (rep, lead) whose whole sets are similar enough; a lead may have very many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = [similar(np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)) for i in range(batch.num_rows)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialize(pairs, "pairs")
    both = pairs.join(sets.select("rep", F.col("items").alias("a")), "rep")
    both = join_spread(both, sets.select(F.col("rep").alias("lead"), F.col("items").alias("b")), "lead", hot_keys(pairs, "lead"), ["rep"])
    return both.select(F.least("rep", "lead").alias("u"), F.greatest("rep", "lead").alias("v"), "a", "b").mapInArrow(run, "u long, v long")


def _leader_pairs(members: DataFrame, hot: DataFrame | None, turn: int) -> DataFrame:
    """(rep, lead): each member with one leader of its bucket, another in each turn; pairs of one component are left out."""
    order = F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), F.col("rep"), F.col("n"), F.col("label"))
    leaders = members.groupBy("bucket").agg(F.min(order).alias("x"))
    leaders = leaders.select("bucket", F.col("x.rep").alias("lead"), F.col("x.n").alias("lead_n"), F.col("x.label").alias("lead_label"))
    pairs = join_spread(members, leaders, "bucket", hot, ["rep"]).where("rep <> lead and label <> lead_label")
    return pairs.where(F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * SIMILAR).select("rep", "lead").distinct()


def _with_label(rows: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    found = labels.select(F.col("u").alias(key), F.col("component").alias(name))
    return rows.join(found, key, "left").withColumn(name, F.coalesce(name, key))


def _open_buckets(members: DataFrame, labels: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Members of the buckets that still hold several components, with their components."""
    marked = _with_label(members.drop("label"), labels, "rep", "label")
    several = marked.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("bucket")
    return join_spread(marked, several, "bucket", hot, ["rep"])


def _remaining_links(members: DataFrame, sets: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(u, v): links between different components in the buckets left open, as many as join them.

    Each bucket has a main component, its most frequent one; what is compared are the members outside it with all
    members. Both sides are dealt into hashed blocks, and each pair of blocks is one group of work, so a bucket of n
    members with s outside gives about n * ceil(s / BLOCK) + s * ceil(n / BLOCK) rows. A task reads its groups one behind
    the other. A pair is compared in the first bucket that it shares only.
    """
    count = members.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    count = count.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("n_all"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    count = count.select("bucket", F.col("main.label").alias("main"), blocks(F.col("n_all")).alias("nb"), blocks(F.col("n_all") - F.col("main.c")).alias("sb"))
    dealt = materialize(join_spread(members, count, "bucket", hot, ["rep"]).withColumn("outside", F.col("label") != F.col("main")), "dealt")
    place = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["bucket", "band", "rep", "n", "label", "outside"]
    one = dealt.where("outside").select(*kept, place("sb", 1).alias("i"), every("nb").alias("j"), F.lit(True).alias("asks"))
    all_ = dealt.select(*kept, every("sb").alias("i"), place("nb", 2).alias("j"), F.lit(False).alias("asks"))
    work = one.unionByName(all_).join(sets, ["rep", "n"]).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return work.select("bucket", "i", "j", "band", "rep", "n", "label", "outside", "asks", "sig", "items").mapInArrow(_links_in_groups, "u long, v long")


def _links_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in each group of rows equal in their first three columns, which come one behind the other."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        key = np.stack([rows[c].to_numpy() for c in range(3)])
        begin = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        whole = int(begin[-1]) if len(begin) else 0  # the last group may go on
        if whole:
            yield _links(rows.slice(0, whole), np.concatenate([[0], begin]))
        held = rows.slice(whole)
    if held is not None:
        yield _links(held, np.array([0, held.num_rows]))


def _links(rows: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
    rep, n, label, outside, asks, band = (rows[c].to_numpy() for c in ("rep", "n", "label", "outside", "asks", "band"))
    sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint32).reshape(len(rep), BANDS, ROWS)
    items = rows["items"].combine_chunks()
    us, vs = [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        left, right = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])
        if not len(left) or not len(right):
            continue
        up: dict[int, int] = {}  # components that this group has joined

        def top(x: int, up: dict[int, int] = up) -> int:
            while x in up:
                x = up[x]
            return x

        step = max(1, PAIRS_AT_ONCE // len(right))
        for at in range(0, len(left), step):
            x, y = left[at : at + step, None], right[None, :]
            near = (label[x] != label[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * SIMILAR)
            near &= ~outside[y] | (rep[y] > rep[x])  # two members outside meet twice
            i, j = np.nonzero(near)
            i, j = left[at + i], right[j]
            equal = sig[i] == sig[j]
            score = equal.sum(axis=(1, 2))
            good = (score >= LEAST_EQUAL) & (equal.all(axis=2).argmax(axis=1) == band[a])
            best_first = np.flatnonzero(good)[np.argsort(-score[good], kind="stable")]
            for p, q in zip(i[best_first].tolist(), j[best_first].tolist(), strict=True):
                s, t = top(int(label[p])), top(int(label[q]))
                if s != t and similar(np.frombuffer(items[p].as_buffer(), np.uint64), np.frombuffer(items[q].as_buffer(), np.uint64)):
                    up[max(s, t)] = min(s, t)
                    us.append(min(rep[p], rep[q]))
                    vs.append(max(rep[p], rep[q]))
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _labels(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(u, component) for every class representative ``u`` that is not the smallest of its component."""
    # A repeated doc_id may stand for several sets: one node, which links over any of them.
    spread = classes.select("rep", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = materialize(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    hot = hot_of(shared, "bucket")
    members = materialize(join_spread(spread, shared.select("bucket"), "bucket", hot, ["rep"]).withColumn("label", F.col("rep")), "members")
    sets = materialize(_sets(docs, members.select("rep", "n").distinct(), k), "sets")

    labels = connected_components(_confirmed(_leader_pairs(members, hot, 0), sets))
    for turn in range(1, 4):
        members = materialize(_open_buckets(members, labels, hot), "open")
        if members.isEmpty():
            break
        more = _confirmed(_leader_pairs(members, hot, turn), sets) if turn < 3 else _remaining_links(members, sets, hot)
        more = materialize(more, "linked")
        if not more.isEmpty():
            labels = merged(labels, more)
    return labels


def near_duplicates(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...).

    ``component_id`` is the smallest doc_id reachable over links, the own one included; ``kept`` marks the row that has it.
    """
    docs = docs.select("doc_id", "text")
    features = materialize(_features(docs, k), "features")
    known = features.where("set_key is not null and doc_id is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes")
    with scratch(docs.sparkSession):
        labels = materialize(_labels(docs, classes, k), "components", keep=True)

    placed = _with_label(classes.select("set_key", "rep"), labels, "rep", "component").select("set_key", "component")
    copies = hot_of(classes.select("set_key", F.col("copies").alias("n")), "set_key")
    rows = features.select("doc_id", "n_shingles", "set_key")
    one = "set_key is not null and doc_id is not null"
    out = join_spread(rows.where(one), placed, "set_key", copies, ["doc_id", F.spark_partition_id()]).select("doc_id", "n_shingles", "component")
    out = out.unionByName(rows.where(f"not ({one})").select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))
