"""Exact top-k inner products by block-at-a-time pruning.

Every component is a term with the weight floor(256 * x). Documents are dealt into ranges that lie close together (the
cells of a kd-tree over a bounded sample), and inside them into blocks of ``BLOCK``; ranges and blocks keep the largest
and the smallest weight of each term. A block's bound for a query is the sum over terms of the larger of query weight
times maximum and query weight times minimum. A query visits the range of the highest bound first; its k-th score there
says which ranges may still hold better ones. Within a range, blocks are taken in falling order of bounds and scored
through their forward index (a dense matrix) until a bound falls below the k-th score. No candidate is lost.

Sums are exact for all finite components: in doubles while they stay below 2**53, else modulo 2**64 where a bound on the
rounding shows that they fit a long, else in unbounded integers. A score beyond a long is the nearest long.

Defined cases: vectors null, empty, of another length than most, or with null or non-finite components take no part, nor
do null ids. Of rows that repeat an id, one takes part. Ties go to smaller ids. Fewer candidates than ``k`` are all
returned. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import CELL, ROUND, Tree, best, copies_limited, k_best, leaves, matrix, parts_of, rounds, sample, search, usable, visits_of
from .common import materialize

BLOCK = 32
SCALE = 256
NONE = np.iinfo(np.int64).min  # less than any score
LEAST, MOST = NONE + 1, np.iinfo(np.int64).max
EPS = 2.0**-52


def weights(x: np.ndarray) -> np.ndarray:
    """floor(256 * x); beyond the range of doubles infinite, and then only good for bounds."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * x)


def _whole(x: float) -> int:
    """floor(256 * x) as an unbounded integer."""
    return SCALE * int(x) if abs(x) >= 2.0**53 else int(np.floor(SCALE * x))


def _modular(w: np.ndarray) -> np.ndarray:
    """Weights modulo 2**64, as longs; multiples of 2**64 (all doubles from 2**117 on) are 0."""
    big = np.abs(w) >= 2.0**63
    out = np.where(big, 0.0, w).astype(np.int64)
    for at in zip(*np.nonzero(big & (np.abs(w) < 2.0**117)), strict=True):
        out[at] = np.uint64(int(w[at]) % (1 << 64)).astype(np.int64)
    return out


class Weighted:
    """Rows of vectors with their weights, and which rows have weights too large for sums in doubles."""

    def __init__(self, x: np.ndarray, w: np.ndarray | None = None, great: np.ndarray | None = None) -> None:
        self.x, self.w = x, weights(x) if w is None else w
        limit = np.sqrt(2.0**53 / max(x.shape[-1], 1))
        self.great = ~(np.abs(self.w).max(axis=1, initial=0) < limit) if great is None else great

    def take(self, rows: np.ndarray | slice) -> Weighted:
        return Weighted(self.x[rows], self.w[rows], self.great[rows])


def products(a: Weighted, b: Weighted) -> np.ndarray:
    """Exact inner products of the weights of all rows of ``a`` and ``b``, held inside a long."""
    if not a.great.any() and not b.great.any():
        return (a.w @ b.w.T).astype(np.int64)
    out = np.zeros((len(a.w), len(b.w)), np.int64)
    small_a, small_b, great_a, great_b = (np.flatnonzero(m) for m in (~a.great, ~b.great, a.great, b.great))
    out[np.ix_(small_a, small_b)] = (a.w[small_a] @ b.w[small_b].T).astype(np.int64)
    for rows, columns in ((great_a, np.arange(len(b.w))), (small_a, great_b)):
        if len(rows) and len(columns):
            out[np.ix_(rows, columns)] = _great_products(a.x[rows], a.w[rows], b.x[columns], b.w[columns])
    return out


def _great_products(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        about = wa @ wb.T
        off = (np.abs(wa) @ np.abs(wb).T) * (4 * a.shape[1] * EPS)
        fits = np.abs(about) + off < 2.0**63
        beyond = np.abs(about) - off >= 2.0**63
        out = np.where(beyond, np.where(about > 0, MOST, LEAST), 0)
    # A sum that fits a long is exact modulo 2**64, whatever overflows on the way.
    i, j = np.nonzero(fits)
    ma, mb = _modular(wa), _modular(wb)
    for at in range(0, len(i), 4096):
        p, q = i[at : at + 4096], j[at : at + 4096]
        out[p, q] = (ma[p] * mb[q]).sum(axis=1)
    for p, q in zip(*np.nonzero(~fits & ~beyond), strict=True):
        out[p, q] = min(MOST, max(LEAST, sum(_whole(x) * _whole(y) for x, y in zip(a[p].tolist(), b[q].tolist(), strict=True))))
    return np.maximum(out, LEAST)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds, as doubles, of the scores of each query in each block; ``high`` and ``low`` are components."""
    q, most, least = weights(queries), weights(high), weights(low)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        out = up @ most.T + down @ least.T
        out += (up @ np.abs(most).T - down @ np.abs(least).T) * (8 * q.shape[1] * EPS)
    return np.maximum(np.where(np.isnan(out), np.inf, out), -(2.0**63))  # scores are held inside a long, too


def _kernel(k: int):  # noqa: ANN202
    def run(ids, vectors, query_ids, queries, least):  # noqa: ANN001, ANN202
        blocks, rows, asked = leaves(vectors, BLOCK), Weighted(vectors), Weighted(queries)
        high = np.stack([vectors[b].max(axis=0) for b in blocks])
        low = np.stack([vectors[b].min(axis=0) for b in blocks])
        out: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(queries), ROUND):
            part = slice(at, at + ROUND)
            upper = bounds(queries[part], high, low)
            who, row, score = _search_range(ids, rows, blocks, upper, query_ids[part], asked.take(part), least[part].copy(), k)
            out[0].append(query_ids[part][who])
            out[1].append(ids[row])
            out[2].append(score)
        return [np.concatenate(x) for x in out]

    return run


def _search_range(ids, vectors, blocks, upper, query_ids, queries, kth, k):  # noqa: ANN001, ANN202
    """(query number, row, score) of the k best rows of a range for each query that reach its bound ``kth``.

    Each query takes the blocks in falling order of their bounds until one falls below its k-th score; the queries that
    take the same block in a round are scored by one matrix product.
    """
    top = np.full((len(query_ids), k), NONE)
    found = [(np.zeros(0, np.int64),) * 3]
    for mine, block in rounds((-upper).argsort(axis=1, kind="stable"), lambda q, block: upper[q, block] >= kth[q]):
        rows = blocks[block]
        score = products(queries.take(mine), vectors.take(rows))
        score[ids[rows] == query_ids[mine, None]] = NONE
        top[mine] = np.partition(np.concatenate([top[mine], score], axis=1), -k, axis=1)[:, -k:]
        least = top[mine].min(axis=1)
        kth[mine] = np.where(least > NONE, np.maximum(kth[mine], below(least)), kth[mine])
        q, p = np.nonzero((score > NONE) & (score >= kth[mine, None]))
        found.append((mine[q], rows[p], score[q, p]))
    q, p, score = (np.concatenate(x) for x in zip(*found, strict=True))
    near = score >= kth[q]
    q, p, score = q[near], p[near], score[near]
    first = k_best(q, ids[p], score, k)
    return q[first], p[first], score[first]


def below(score: np.ndarray) -> np.ndarray:
    """Doubles that rounding does not lift over the integer scores."""
    return score - np.abs(score.astype(np.float64)) * 1e-15


def ends_of(points: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, largest, smallest): the range of each component in each cell that holds vectors.

    Each task gives one row a cell, and these are merged by cell: ``MOST_CELLS`` rows of 2 * ``dim`` numbers reach the driver.
    """
    schema = "cell int, high array<double>, low array<double>"

    def made(found: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        numbers = [pa.array([found[c][i] for c in found], pa.list_(pa.float64())) for i in range(2)]
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *numbers], ["cell", "high", "low"])

    def widen(found: dict, cell: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        order = cell.argsort(kind="stable")
        begin = np.flatnonzero(np.diff(cell[order], prepend=-1))
        if len(begin):
            tops, bottoms = np.maximum.reduceat(high[order], begin), np.minimum.reduceat(low[order], begin)
            for c, top, bottom in zip(cell[order][begin].tolist(), tops, bottoms, strict=True):
                old = found.get(c, (top, bottom))
                found[c] = (np.maximum(top, old[0]), np.minimum(bottom, old[1]))

    def by_task(batches):  # noqa: ANN001, ANN202
        found: dict = {}
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1))
                widen(found, batch.column(0).to_numpy(), v, v)
        yield made(found)

    def by_cell(table: pa.Table) -> pa.Table:
        found: dict = {}
        widen(found, table["cell"].to_numpy(), matrix(table["high"]), matrix(table["low"]))
        return pa.Table.from_batches([made(found)])

    ends = points.select("cell", "v").mapInArrow(by_task, schema).groupBy("cell").applyInArrow(by_cell, schema).orderBy("cell").toArrow()
    return ends["cell"].to_numpy(), matrix(ends["high"]).reshape(-1, dim), matrix(ends["low"]).reshape(-1, dim)


def top_products(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``vectors`` (vec_id, embedding, ...); ``is_query`` is a condition on vec_id."""
    rows, count, dim = usable(vectors, lambda v: F.lit(True), lambda x: x)
    if not count:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    rows = materialize(rows, "vectors")
    context = rows.sparkSession.sparkContext
    tree = context.broadcast(Tree(sample(rows, count, dim), -(-count // CELL)))

    def range_of(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            if batch.num_rows:
                cell = tree.value.cell(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], ["cell", "vec_id", "v"])

    points = copies_limited(rows, k).mapInArrow(range_of, "cell int, vec_id long, v array<double>")
    points = materialize(parts_of(points, dim), "ranges")
    ends = context.broadcast((len(tree.value.low), *ends_of(points, dim)))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.lit(float("-inf")).alias("bound"))

    def upper(q: np.ndarray) -> np.ndarray:
        n, cells, most, least = ends.value
        out = np.full((len(q), n), -np.inf)
        out[:, cells] = bounds(q, most, least)
        return out

    def first_range(q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return np.arange(ends.value[0]) == upper(q).argmax(axis=1)[:, None]

    def others(q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        u = upper(q)
        return (u > -np.inf) & (u >= bound[:, None]) & (np.arange(u.shape[1]) != u.argmax(axis=1)[:, None])

    kernel = _kernel(k)
    first = materialize(search(points, visits_of(queries, first_range), kernel, "long"), "hits")
    # Several parts of a cell may give hits: the k-th of all is the bound.
    kth = best(first, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    kth = kth.where(F.col("n") >= k).select("query_id", (F.col("least") - F.abs(F.col("least").cast("double")) * 1e-15).alias("b"))
    queries = queries.drop("bound").join(kth, "query_id", "left").select("query_id", "q", F.coalesce("b", F.lit(float("-inf"))).alias("bound"))
    more = search(points, visits_of(queries, others), kernel, "long")
    return best(first.unionByName(more), k).select("query_id", "rank", "vec_id", "score")
