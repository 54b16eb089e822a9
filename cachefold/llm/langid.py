"""Language identification with string kernels: blended-spectrum presence kernels, Nystroem landmarks, ridge regression.

The kernel of two texts is the number of byte n-grams (1 to 4 long, hashed to 2**16 slots, presence only) that both
have, divided by the root of the product of how many each has. Landmarks are a bounded, hashed sample of the training
rows. Kernel ridge regression runs one-versus-rest in the Nystroem feature space of the landmarks; as that function is
linear in the presence vector up to its norm, landmarks and coefficients are folded into one slots x languages matrix,
and texts are scored in batches: presence matrix times folded matrix.

What is fitted is bounded, and every language takes part: ``SAMPLE`` different rows a language (those of smallest hash
of id and text), fewer if all together would pass ``ROWS``; ``LANDMARKS`` of them, fewer if all would pass ``MARKS``;
texts of ``LONGEST`` characters at most, or so many that all together stay below ``CHARACTERS``. The fit reads its rows
``AT_ONCE`` at a time. On the driver that is 64 KB a landmark, 256 KB a language for the folded matrix (25 MB for 100
languages, which is also what is broadcast), and the texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Without any labelled training row, every
text is ``und``. Very long texts are read in pieces. Repeated rows count once in the sample; null ids and extra columns
need no rule; with one language only, that one is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name

SLOTS = 1 << 16
ORDERS = (1, 2, 3, 4)
LANDMARKS, MARKS = 48, 1536  # a language, and in all
SAMPLE, ROWS = 250, 12_000  # training rows a language, and in all
LONGEST, CHARACTERS = 1 << 16, 1 << 26  # of a training text, and of all
AT_ONCE = 128
RIDGE = 1e-2
UNKNOWN = "und"
BATCH = 32
PIECE = 1 << 20
_ODD = (np.uint32(1), np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def mark(text: str, row: np.ndarray) -> None:
    """Set the slots of the text's n-grams in ``row``; ASCII capitals count as small letters."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    for at in range(0, max(len(data), 1), PIECE):
        part = data[at : at + PIECE + max(ORDERS) - 1].astype(np.uint32)
        code = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(part) < n:
                break
            code = (code[: len(part) - n + 1] * np.uint32(0x01000193)) ^ (part[n - 1 :] * _ODD[n]) ^ np.uint32(n)
            if n in ORDERS:
                row[(code * np.uint32(0x9E3779B1)) >> np.uint32(16)] = 1


def presence(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), SLOTS), dtype=np.uint8)
    for t, row in zip(texts, out, strict=True):
        mark(t, row)
    return out


def _kernels(texts: list[str], land: np.ndarray) -> np.ndarray:
    """Kernels of texts and landmarks (presence rows of bytes), a few of each at a time."""
    x = presence(texts).astype(np.float32)
    out = np.empty((len(texts), len(land)), np.float64)
    for at in range(0, len(land), AT_ONCE):
        part = land[at : at + AT_ONCE].astype(np.float32)
        out[:, at : at + AT_ONCE] = x @ part.T / np.sqrt(np.maximum(part.sum(axis=1), 1))
    return out / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """The languages in order, and the folded matrix (slots x languages)."""
    names = sorted(set(langs))
    column = {a: i for i, a in enumerate(names)}
    y = np.array([column[a] for a in langs])
    each = max(1, min(LANDMARKS, MARKS // len(names)))
    place = np.array([np.count_nonzero(y[:i] == a) for i, a in enumerate(y)])
    marks = np.flatnonzero(place < each)[:MARKS]
    land = presence([texts[i] for i in marks])
    values, vectors = np.linalg.eigh(np.concatenate([_kernels([texts[i] for i in marks[at : at + AT_ONCE]], land) for at in range(0, len(marks), AT_ONCE)]))
    keep = values > 1e-8
    root = vectors[:, keep] / np.sqrt(values[keep])  # K(landmarks)**-1/2
    weight = len(langs) / (len(names) * np.bincount(y))[y]  # languages count alike
    left, right = np.zeros((keep.sum(),) * 2), np.zeros((keep.sum(), len(names)))
    for at in range(0, len(texts), AT_ONCE):
        phi = _kernels(texts[at : at + AT_ONCE], land) @ root
        mine, w = y[at : at + AT_ONCE], weight[at : at + AT_ONCE]
        left += (phi * w[:, None]).T @ phi
        np.add.at(right.T, mine, phi * w[:, None])
    beta = np.linalg.solve(left + RIDGE * len(langs) * np.eye(len(left)) * 1e-2, right)
    coefficients = root @ beta
    folded = np.zeros((SLOTS, len(names)), np.float32)
    for at in range(0, len(land), AT_ONCE):
        part = land[at : at + AT_ONCE].astype(np.float32)
        folded += (part / np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1))).T @ coefficients[at : at + AT_ONCE].astype(np.float32)
    return names, folded


def training_rows(docs: DataFrame, held_out: Column) -> tuple[list[str], list[str]]:
    """(texts, langs) of the rows that are learnt from, in a fixed order."""
    known = docs.where("text is not null and lang is not null").where(~held_out)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return [], []
    each = max(1, min(SAMPLE, ROWS // len(counts)))
    longest = max(1, min(LONGEST, CHARACTERS // (each * len(counts))))
    h = F.xxhash64("doc_id", "text", F.lit(6))
    # Twice as many rows as are wanted, about, so that few are sorted for the smallest hashes.
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * each / n)))), F.col("lang"))
    some = known.where(F.char_length("text") <= longest).select("text", "lang", h.alias("h")).where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < share)
    order = Window.partitionBy("lang").orderBy("h", "text")
    some = some.dropDuplicates(["lang", "h", "text"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
    rows = sorted(some.select("h", "text", "lang").collect(), key=lambda r: (r["h"], r["lang"], r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def scorer(names: list[str], folded: np.ndarray):  # noqa: ANN201
    def run(texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if names else []
        for at in range(0, len(some), BATCH):
            rows = some[at : at + BATCH]
            x = presence([texts[i] for i in rows]).astype(np.float32)
            y = (x @ folded) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
            for i, best, value in zip(rows, y.argmax(axis=1), y.max(axis=1), strict=True):
                lang[i], score[i] = names[best], float(min(1.0, max(0.0, value)))
        return lang, score

    return run


def predictor(docs: DataFrame, held_out: Column):  # noqa: ANN201
    """A function from a text column to a struct (lang_pred string, score double), learnt from the rows not held out."""
    texts, langs = training_rows(docs, held_out)
    found = fit(texts, langs) if texts else ([], np.zeros((SLOTS, 0), np.float32))
    model = docs.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = scorer(*model.value)
        for batch in batches:
            lang, value = score([None if t is None else t for t in batch])
            yield pd.DataFrame({"lang_pred": lang, "score": value})

    return run


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, lang, ...) with ``lang_pred`` string and ``score`` double behind them.

    Input columns of these two names are replaced. Only rows that are not held out are learnt from.
    """
    found = free_name(docs.columns, "found")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    told = docs.withColumn(found, predictor(docs, held_out)(F.col("text")))
    return told.select(*kept, F.col(f"{found}.lang_pred"), F.col(f"{found}.score"))
