"""What several training-data operators share: the shared folder, tables written there, hashing in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or (local tests only) a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if sc.applicationId not in _own_folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_folder[sc.applicationId] = tempfile.mkdtemp(prefix="cachefold-")
    return _own_folder[sc.applicationId]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/cachefold/{label}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`new_folder` named, wherever Spark keeps it; nothing happens if it is gone."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside are deleted at the end, but for those told to stay (``keep``)."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop_folder(spark, path)


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


HOT_SHARE = 10_000  # a key is hot with more than one in so many of all rows, so at most so many keys are
HOT_LEAST = 256  # rows that a hot key has at least


def hot_of(counts: DataFrame, key: str) -> DataFrame | None:
    """(key, salts): the keys that hold more than 1 / ``HOT_SHARE`` of all rows, so at most ``HOT_SHARE`` keys; None if there are none.

    counts: (key, n), a row a key. ``salts`` is into how many pieces of about that share a key's rows have to be dealt.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(HOT_LEAST, -(-total // HOT_SHARE))
    hot = counts.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("salts"))
    return None if hot.isEmpty() else materialize(hot, "hot")


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """``hot_of`` the counted rows."""
    return hot_of(materialize(rows.groupBy(key).agg(F.count("*").alias("n")), "counts"), key)


def join_spread(rows: DataFrame, told: DataFrame, key: str, hot: DataFrame | None, by: list[str | Column], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``told`` (few rows a key) by ``key``.

    The rows of the ``hot`` keys are dealt over many tasks by a hash of ``by``, and what is told of them is repeated there.
    """
    if hot is None:
        return rows.join(told, key, how)
    hot = F.broadcast(hot)  # HOT_SHARE rows at most
    salt = F.pmod(F.xxhash64(*by), F.coalesce("salts", F.lit(1))).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    dealt = rows.join(hot, key, "left").withColumn("salt", salt).drop("salts")
    return dealt.join(told.join(hot, key, "left").withColumn("salt", each).drop("salts"), [key, "salt"], how).drop("salt")


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as it takes to differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


# --- hashing in numpy; all arithmetic wraps modulo 2**64 -------------------------------------------------------------

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


# A random 64-bit value a byte; capital ASCII letters share the value of the small ones.
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_BYTE = mix64(_FOLD * np.uint64(0x100000001B3))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Tables of the base's powers and of its inverse's, at least ``n`` long."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 20)
        _tables[:] = []
        for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            steps = np.full(size, np.uint64(base), dtype=np.uint64)
            steps[0] = 1
            _tables.append(np.multiply.accumulate(steps))
    return _tables


def _raw_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(polynomial, begin, end) of the words of bytes that begin and end with white space.

    A prefix-sum polynomial over the bytes gives every word's value without a Python loop over words.
    """
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts], starts, ends


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) of all texts, and the text number of each word."""
    value, starts, ends = _raw_words(np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8))
    begin = np.cumsum([1, *(len(t) + 1 for t in texts[:-1])]) if texts else np.zeros(0, dtype=np.int64)
    return mix64(value ^ (ends - starts).astype(np.uint64)), np.searchsorted(begin, starts, side="right") - 1


def word_hashes_of_long(text: bytes, piece: int = 1 << 20) -> np.ndarray:
    """The same hashes for one text, read in pieces; a word that a piece's end cuts is put together from its parts."""
    found, value, length = [], 0, 0  # of the word that reached the last piece's end
    for at in range(0, len(text), piece):
        buf = np.frombuffer(b"\n" + text[at : at + piece] + b"\n", dtype=np.uint8)
        words, starts, ends = _raw_words(buf)
        sizes = (ends - starts).astype(np.uint64)
        if length and not (len(starts) and starts[0] == 1):
            found.append(mix64(np.array([value ^ length], dtype=np.uint64)))
            value = length = 0
        if length:
            value = (value + pow(int(_BASE), length, 1 << 64) * int(words[0])) % (1 << 64)
            length += int(sizes[0])
            open_still = len(starts) == 1 and ends[0] == len(buf) - 1
            words, sizes, starts, ends = words[1:], sizes[1:], starts[1:], ends[1:]
            if open_still:
                continue
            found.append(mix64(np.array([value ^ length], dtype=np.uint64)))
            value = length = 0
        if len(ends) and ends[-1] == len(buf) - 1:
            value, length = int(words[-1]), int(sizes[-1])
            words, sizes = words[:-1], sizes[:-1]
        found.append(mix64(words ^ sizes))
    if length:
        found.append(mix64(np.array([value ^ length], dtype=np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
