"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of ``WIDTH`` bytes run over the whole text every ``STRIDE`` bytes; their largest
responses in overlapping chunks of ``2 * HALF`` positions (half a chunk apart) feed a hidden layer; each hidden unit's
largest value over all chunks is kept, and these are combined into one probability. Every byte of every text is read; a
text is padded with zeros, so its score does not depend on the texts beside it.

Training takes a bounded sample of labelled rows on the driver and is deterministic: of each class the ``SAMPLE``
different (doc_id, text) pairs of smallest hash, whole texts of ``LONGEST`` characters at most. Scoring is one pass of
``mapInArrow`` with the broadcast weights (20 KB).

Defined cases: null and empty texts are scored as one chunk of padding; a very long text is read in pieces of ``_PIECE``
half chunks; without labelled rows every score is 0.5; null labels are not learnt from; with several labels for one id
each is an example. Repeated rows count once in the sample; null ids need no rule. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 1500  # rows of each class, and
LONGEST = 1 << 16  # characters of a row: the bounds on what is fitted
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 4, 32, 16
HALF = 32  # filter positions in half a chunk
EPOCHS, DOCS_A_STEP, RATE, SEED = 14, 48, 4e-3, 1
THRESHOLD = 0.3
_BYTES_A_HALF = HALF * STRIDE
_ROW = _BYTES_A_HALF + WIDTH - STRIDE
_BATCH = 1 << 20  # bytes scored at once
_PIECE = _BATCH // _BYTES_A_HALF

Weights = dict[str, np.ndarray]


def start_weights() -> Weights:
    rng = np.random.RandomState(SEED)
    draw = lambda *shape: (rng.randn(*shape) / np.sqrt(shape[0])).astype(np.float32)
    embed = rng.randn(256, EMBED).astype(np.float32)
    embed[0] = 0
    zero = lambda n: np.zeros(n, np.float32)
    return {"e": embed, "w1": draw(WIDTH * EMBED, FILTERS), "b1": zero(FILTERS), "w2": draw(FILTERS, HIDDEN), "b2": zero(HIDDEN), "w3": draw(HIDDEN, 1), "b3": zero(1)}


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes under each half chunk, a row each with the few bytes that its last position reads on; and the halves of each text.

    Each text is padded with zeros to whole halves and to one chunk at least.
    """
    halves = np.array([max(2, -(-len(t) // _BYTES_A_HALF)) for t in texts])
    out = np.zeros((halves.sum(), _ROW), np.uint8)
    at = 0
    for t, n in zip(texts, halves, strict=True):
        flat = np.zeros(n * _BYTES_A_HALF + _ROW, np.uint8)
        flat[: len(t)] = np.frombuffer(t, np.uint8)
        out[at : at + n] = np.lib.stride_tricks.as_strided(flat, (n, _ROW), (_BYTES_A_HALF, 1))
        at += n
    return out, halves


def _windows(rows: np.ndarray, w: Weights) -> np.ndarray:
    """The embedded windows under all filter positions of the halves."""
    emb = w["e"][rows]
    return np.lib.stride_tricks.as_strided(emb, (len(rows), HALF, WIDTH * EMBED), (_ROW * EMBED * 4, STRIDE * EMBED * 4, 4)).reshape(-1, WIDTH * EMBED)


def _half_maxima(rows: np.ndarray, w: Weights) -> np.ndarray:
    """Largest filter response of each half chunk, in pieces that stay in the processor's cache."""
    out = np.empty((len(rows), FILTERS), np.float32)
    step = 64
    for h in range(0, len(out), step):
        z = _windows(rows[h : h + step], w) @ w["w1"]
        out[h : h + step] = z.reshape(-1, HALF, FILTERS).max(axis=1)
    return np.maximum(out + w["b1"], 0)


def _document_layer(half: np.ndarray, halves: np.ndarray, w: Weights) -> tuple[np.ndarray, ...]:
    ends = np.cumsum(halves)
    inner = np.ones(len(half), bool)
    inner[ends - 1] = False  # a chunk is a half and the next one of the same text
    first = np.flatnonzero(inner)
    chunk = np.maximum(half[first], half[first + 1])
    hidden = np.maximum(chunk @ w["w2"] + w["b2"], 0)
    begin = np.concatenate([[0], np.cumsum(halves - 1)[:-1]])
    return first, chunk, hidden, begin, np.maximum.reduceat(hidden, begin, axis=0)


def _probability(top: np.ndarray, w: Weights) -> np.ndarray:
    return 1 / (1 + np.exp(-(top @ w["w3"] + w["b3"])[:, 0].astype(np.float64)))


def probabilities(texts: list[bytes], w: Weights) -> np.ndarray:
    data, halves = _laid_out(texts)
    return _probability(_document_layer(_half_maxima(data, w), halves, w)[-1], w)


def probability_of_long(text: bytes, w: Weights) -> float:
    """The same for one text, read in pieces that share half a chunk."""
    top = np.zeros((1, HIDDEN), np.float32)
    last = max(2, -(-len(text) // _BYTES_A_HALF))
    for at in range(0, last - 1, _PIECE):
        n = min(_PIECE + 1, last - at)
        part = text[at * _BYTES_A_HALF : (at + n) * _BYTES_A_HALF + _ROW]
        rows = _laid_out([part])[0][:n]
        top = np.maximum(top, _document_layer(_half_maxima(rows, w), np.array([n]), w)[-1])
    return float(_probability(top, w)[0])


def _gradients(texts: list[bytes], labels: np.ndarray, w: Weights) -> Weights:
    data, halves = _laid_out(texts)
    windows = _windows(data, w)
    z = (windows @ w["w1"]).reshape(-1, HALF, FILTERS)
    where = z.argmax(axis=1)
    half = np.maximum(np.take_along_axis(z, where[:, None], axis=1)[:, 0] + w["b1"], 0)
    first, chunk, hidden, begin, top = _document_layer(half, halves, w)
    g = ((_probability(top, w) - labels) / len(texts)).astype(np.float32)[:, None]
    out = {"w3": top.T @ g, "b3": g.sum(axis=0)}
    to_top = (g @ w["w3"].T) * (top > 0)
    d_hidden = np.zeros_like(hidden)
    stop = np.append(begin[1:], len(hidden))
    for doc, (a, b) in enumerate(zip(begin, stop, strict=True)):
        d_hidden[a + hidden[a:b].argmax(axis=0), np.arange(HIDDEN)] = to_top[doc]
    out |= {"w2": chunk.T @ d_hidden, "b2": d_hidden.sum(axis=0)}
    d_chunk = (d_hidden @ w["w2"].T) * (chunk > 0)
    d_half = np.zeros_like(half)
    second = half[first + 1] > half[first]
    d_half[first] = np.where(second, 0, d_chunk)
    d_half[first + 1] += np.where(second, d_chunk, 0)
    out["b1"], out["w1"] = d_half.sum(axis=0), np.zeros_like(w["w1"])
    h, f = np.nonzero(d_half)
    value, position = d_half[h, f], h * HALF + where[h, f]
    under = windows[position] * value[:, None]
    order = f.argsort(kind="stable")
    begins = np.flatnonzero(np.diff(f[order], prepend=-1))
    if len(begins):
        out["w1"][:, f[order][begins]] = np.add.reduceat(under[order], begins, axis=0).T
    to_bytes = (w["w1"].T[f] * value[:, None]).reshape(-1, EMBED)
    used = data[h[:, None], where[h, f][:, None] * STRIDE + np.arange(WIDTH)].ravel()
    out["e"] = np.stack([np.bincount(used, to_bytes[:, d], 256) for d in range(EMBED)], axis=1).astype(np.float32)
    out["e"][0] = 0
    return out


def train(texts: list[bytes], labels: list[int]) -> Weights:
    """Adam on shuffled documents; the same rows in the same order give the same weights."""
    w, y = start_weights(), np.array(labels, np.float32)
    w["b3"][:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    rng, step = np.random.RandomState(SEED), 0
    steps = EPOCHS * -(-len(texts) // DOCS_A_STEP)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), DOCS_A_STEP):
            rows, step = order[at : at + DOCS_A_STEP], step + 1
            for k, g in _gradients([texts[i] for i in rows], y[rows], w).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                rate = RATE * (1 - step / (steps + 1))
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return w


def smallest_hashes(rows: DataFrame, group: str, on: list[str], count: int) -> DataFrame:
    """Of each group the ``count`` different rows of smallest hash of ``on``; a limit that Spark applies before the shuffle, too."""
    h = F.xxhash64(*on, F.lit(1))
    order = Window.partitionBy(group).orderBy("h", *on)
    return rows.dropDuplicates([group, *on]).withColumn("h", h).withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column) -> tuple[list[bytes], list[int]]:
    """``SAMPLE`` labelled rows of each class at most, in a fixed order."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("label")).where(~held_out)
    some = smallest_hashes(known, "label", ["doc_id"], SAMPLE).select("doc_id", "label")
    # Two numbers for 2 * SAMPLE rows at most, however many labels and documents there are: small enough to broadcast.
    rows = docs.where(F.char_length("text") <= LONGEST).select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = smallest_hashes(rows, "label", ["doc_id", "text"], SAMPLE)  # an id may be repeated with many texts
    rows = rows.select("h", "doc_id", "label", "text").collect()  # 2 * SAMPLE rows of LONGEST characters at most
    rows.sort(key=lambda r: (r["h"], r["doc_id"], r["label"], r["text"]))
    return [r["text"].encode("utf-8", "surrogatepass") for r in rows], [r["label"] for r in rows]


def score(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text, ...), learnt from ``labels``."""
    texts, marks = training_rows(docs, labels, held_out)
    model = docs.sparkSession.sparkContext.broadcast(train(texts, marks) if texts else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = scores(batch.column(2), model.value)
            columns = [batch.column(0), batch.column(1), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    schema = docs.select("doc_id").schema.add("held_out", "boolean").add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(run, schema)


def scores(texts: pa.Array, w: Weights | None) -> np.ndarray:
    """Probabilities of a column of texts, short ones together."""
    out = np.full(len(texts), 0.5)
    some: list[tuple[int, bytes]] = []

    def settle() -> None:
        if some:
            out[[i for i, _ in some]] = probabilities([t for _, t in some], w)
            some.clear()

    size = 0
    for i, text in enumerate(texts if w is not None else ()):
        data = (text.as_py() or "").encode("utf-8", "surrogatepass")
        if len(data) > _BATCH:
            out[i] = probability_of_long(data, w)
            continue
        some.append((i, data))
        size += len(data)
        if size >= _BATCH:
            settle()
            size = 0
    settle()
    return out
