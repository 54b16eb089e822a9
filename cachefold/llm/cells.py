"""Vectors dealt into the cells of a kd-tree, and searches of query blocks in cells.

The tree is built on the driver from a bounded, hashed sample (``SAMPLE`` numbers), so it has ``MOST_CELLS`` leaves at
most, whatever the input. Every vector goes to one cell, and a cell of many vectors is cut into parts of about
``PART_NUMBERS`` numbers. A search works on groups (cell, part, query block): a part's vectors meet at most about
``QUERY_BLOCK`` of the queries that visit the cell, and the part is repeated for each such block. So a group's memory is
bounded, however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 1 << 20  # numbers of all sampled vectors together
CELL = 512
MOST_CELLS = 2048
PART_NUMBERS = 1 << 21  # 16 MB of doubles
QUERY_BLOCK = 4096
LEAF = 32
ROUND = 1024  # queries searched together in a cell


class Tree:
    """A complete binary tree of splits; ``low`` and ``high`` are the boxes of its leaves."""

    def __init__(self, points: np.ndarray, cells: int) -> None:
        depth = max(0, int(np.ceil(np.log2(max(1, min(cells, MOST_CELLS, len(points) // 4))))))
        width = points.shape[1]
        self.depth, self.axis, self.at = depth, np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        low, high = np.full((2 ** (depth + 1) - 1, width), -np.inf), np.full((2 ** (depth + 1) - 1, width), np.inf)
        rows = {0: np.arange(len(points))}
        for node in range(2**depth - 1):
            here = rows.pop(node)
            axis = int(points[here].var(axis=0).argmax()) if len(here) else 0
            cut = float(np.median(points[here, axis])) if len(here) else 0.0
            self.axis[node], self.at[node] = axis, cut
            for side, child in enumerate((2 * node + 1, 2 * node + 2)):
                low[child], high[child] = low[node], high[node]
                (high if side == 0 else low)[child, axis] = cut
                rows[child] = here[(points[here, axis] > cut) == bool(side)]
        self.low, self.high = low[2**depth - 1 :], high[2**depth - 1 :]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - (2**self.depth - 1)

    def gaps(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each leaf's box."""
        out = np.zeros((len(points), len(self.low)))
        for d in range(points.shape[1]):
            x = points[:, d, None]
            out += np.maximum(np.maximum(self.low[:, d] - x, x - self.high[:, d]), 0) ** 2
        return out


def leaves(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree over ``points``: median splits of the widest axis."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        axis = int(np.ptp(points[rows], axis=0).argmax())
        half = len(rows) // 2
        order = rows[np.argpartition(points[rows, axis], half)]
        todo += [order[:half], order[half:]]
    return done


def rounds(order: np.ndarray, still: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, int]]:
    """(query numbers, leaf): in each round every query takes its next leaf in ``order`` (queries x leaves), and the
    queries that take the same leaf come together. A query ends at the first leaf that ``still(queries, leaves)`` denies.
    """
    left = np.arange(len(order))
    for turn in range(order.shape[1]):
        left = left[still(left, order[left, turn])]
        if not len(left):
            return
        leaf = order[left, turn]
        by_leaf = leaf.argsort(kind="stable")
        for mine in np.split(left[by_leaf], np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
            yield mine, int(order[mine[0], turn])


def k_best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores of each query number, in order; ties to smaller ids."""
    best_first = np.lexsort((ids, -score, q))
    q = q[best_first]
    return best_first[np.arange(len(q)) - np.searchsorted(q, q) < k]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An array column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def usable(vectors: DataFrame, valid: Callable[[Column], Column], value: Callable[[Column], Column]) -> tuple[DataFrame, int, int]:
    """(vec_id, v) of the vectors that take part, one row an id; how many, and how long they are.

    A vector is left out if it is null, empty, has null or non-finite components, fails ``valid``, or has another length
    than most vectors have (the smaller length, if two are equally common). Of rows with one id, the smallest stays.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0").where(F.forall("v", finite)).where(valid(F.col("v")))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return rows.where("false"), 0, 0
    return rows.where(F.size("v") == common["dim"]).select("vec_id", F.transform("v", value).alias("v")), common["count"], common["dim"]


def copies_limited(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 smallest ids: no others can be among the k best of any query, ties going to small ids.

    The limit is applied inside each task before the shuffle, too.
    """
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")


def sample(rows: DataFrame, count: int, dim: int) -> np.ndarray:
    """About ``SAMPLE`` numbers in whole vectors at most, by a hash of the id."""
    part = F.pmod(F.xxhash64(F.col("vec_id"), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    got = rows.where(part < min(1.0, SAMPLE / dim / max(count, 1))).orderBy("vec_id").select("v").toArrow()
    return matrix(got["v"]).reshape(-1, dim)


def parts_of(points: DataFrame, dim: int) -> DataFrame:
    """(cell, part, vec_id, v) from (cell, vec_id, v): large cells cut by a hash of the id."""
    rows = max(1, PART_NUMBERS // dim)
    counts = points.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))  # MOST_CELLS rows at most
    cut = points.join(F.broadcast(counts), "cell")
    return cut.select("cell", F.pmod(F.xxhash64(F.col("vec_id"), F.lit(6)), F.col("parts")).cast("int").alias("part"), "vec_id", "v")


def search(points: DataFrame, visits: DataFrame, kernel: Callable, kind: str = "double") -> DataFrame:
    """(query_id, vec_id, score) with scores of type ``kind``, by ``kernel(ids, vectors, query_ids, query_vectors, bounds)`` for every part.

    points: (cell, part, vec_id, v); visits: (cell, query_id, q, bound). The kernel returns three arrays.
    """
    schema, score_type = f"query_id long, vec_id long, score {kind}", pa.float64() if kind == "double" else pa.int64()
    blocks = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))  # MOST_CELLS rows at most
    parts = points.groupBy("cell").agg((F.max("part") + 1).alias("parts"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = points.join(F.broadcast(blocks), "cell").select("cell", "part", each("blocks").alias("block"), "vec_id", "v")
    asked = visits.join(F.broadcast(blocks.join(parts, "cell")), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int"))
    asked = asked.select("cell", each("parts").alias("part"), "block", "query_id", "q", "bound")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            got = kernel(
                left["vec_id"].to_numpy(), matrix(left["v"]), right["query_id"].to_numpy(), matrix(right["q"]), right["bound"].to_numpy()
            )
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], score_type)})

    keys = ["cell", "part", "block"]
    return dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, schema)


def visits_of(queries: DataFrame, choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(cell, query_id, q, bound) for the cells that ``choose(vectors, bounds)`` marks, a boolean queries x cells matrix."""
    schema = "cell int, query_id long, q array<double>, bound double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                who, cell = np.nonzero(choose(matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)))
                for b in range(0, max(len(who), 1), 4096):
                    rows = part.take(pa.array(who[b : b + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[b : b + 4096], pa.int32()), *rows.columns], ["cell", "query_id", "q", "bound"])

    return queries.select("query_id", "q", "bound").mapInArrow(run, schema)


def best(hits: DataFrame, k: int) -> DataFrame:
    """Ranked k best hits of each query: larger scores first, ties to smaller ids."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)
