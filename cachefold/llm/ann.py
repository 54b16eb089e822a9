"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Unit vectors are projected on ``PROJECTED`` Gaussian directions (2-stable: a squared projected distance is the squared
distance times a chi-square variable). The projections are indexed by a kd-tree, its upper levels over cells, its lower
ones inside. A query takes its projected neighbours in rising order, leaf by leaf, and verifies them in full dimension,
until the chi-square test holds: nothing as near as its k-th best would, with probability ``SURE``, be projected as far
as what is left. Queries start in their own cell; the bound found there says which other cells the test still leaves.

Defined cases: vectors null, zero, of another length than most, or with null or non-finite components take no part, nor
do null ids. Of rows that repeat an id, one takes part. Equal vectors tie to smaller ids. Fewer candidates than ``k``
are all returned. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import CELL, ROUND, Tree, best, copies_limited, k_best, leaves, parts_of, rounds, sample, search, usable, visits_of
from .common import materialize

PROJECTED = 8
SURE = 0.99
SEED = 5
ROUNDING = 1e-12  # of squared distances


def chi_square_quantile(p: float, freedom: int) -> float:
    """For even degrees of freedom, where the distribution function is a finite sum."""
    if freedom % 2:
        raise ValueError("degrees of freedom must be even")
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        term, total = 1.0, 0.0
        for i in range(freedom // 2):
            total += term
            term *= mid / 2 / (i + 1)
        low, high = (mid, high) if 1 - np.exp(-mid / 2) * total < p else (low, mid)
    return high


def directions(dim: int) -> np.ndarray:
    return np.random.RandomState(SEED).randn(dim, PROJECTED)


def units(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _kernel(k: int, limit: float, dim: int):  # noqa: ANN202
    def run(ids, vectors, query_ids, queries, bounds):  # noqa: ANN001, ANN202
        away = directions(dim)
        unit, asked = units(vectors), units(queries)
        points, targets = unit @ away, asked @ away
        groups = leaves(points)
        low = np.stack([points[g].min(axis=0) for g in groups])
        high = np.stack([points[g].max(axis=0) for g in groups])
        out: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(asked), ROUND):
            part = slice(at, at + ROUND)
            who, row, score = _search_cell(ids, unit, groups, low, high, query_ids[part], asked[part], targets[part], bounds[part].copy(), k, limit)
            out[0].append(query_ids[part][who])
            out[1].append(ids[row])
            out[2].append(np.clip(score, -1.0, 1.0))
        return [np.concatenate(x) for x in out]

    return run


def _search_cell(ids, unit, groups, low, high, query_ids, asked, targets, kth, k, limit):  # noqa: ANN001, ANN202
    """(query number, row, score) of the k best rows of a cell for each query that are as near as its bound ``kth``.

    In each round every query that the test still leaves takes its next leaf, nearest first; the queries that take the
    same leaf are verified by one matrix product.
    """
    gap = np.zeros((len(asked), len(groups)))
    for d in range(targets.shape[1]):
        y = targets[:, d, None]
        gap += np.maximum(np.maximum(low[:, d] - y, y - high[:, d]), 0) ** 2
    top = np.full((len(asked), k), -np.inf)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    # A query ends where the test holds for all leaves that are left.
    for mine, leaf in rounds(gap.argsort(axis=1, kind="stable"), lambda q, leaf: gap[q, leaf] <= limit * kth[q]):
        rows = groups[leaf]
        score = asked[mine] @ unit[rows].T
        score[ids[rows] == query_ids[mine, None]] = -np.inf
        top[mine] = np.partition(np.concatenate([top[mine], score], axis=1), -k, axis=1)[:, -k:]
        kth[mine] = np.minimum(kth[mine], np.maximum(2 - 2 * top[mine].min(axis=1), 0.0) + ROUNDING)
        q, p = np.nonzero(np.isfinite(score) & (2 - 2 * score <= kth[mine, None] + ROUNDING))
        found.append((mine[q], rows[p]))
    q, p = (np.concatenate(x) for x in zip(*found, strict=True))
    # The same sum for every row, so that equal vectors tie exactly.
    score = np.concatenate([np.zeros(0), *((unit[p[i : i + 8192]] * asked[q[i : i + 8192]]).sum(axis=1) for i in range(0, len(p), 8192))])
    near = 2 - 2 * score <= kth[q] + ROUNDING
    q, p, score = q[near], p[near], score[near]
    first = k_best(q, ids[p], score, k)
    return q[first], p[first], score[first]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``vectors`` (vec_id, embedding, ...); ``is_query`` is a condition on vec_id."""
    nonzero = lambda v: F.exists(v, lambda x: x != 0)
    rows, count, dim = usable(vectors, nonzero, lambda x: x)
    if not count:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    rows = materialize(rows, "vectors")
    spark, limit = rows.sparkSession, chi_square_quantile(SURE, PROJECTED)
    tree = spark.sparkContext.broadcast(Tree(units(sample(rows, count, dim)) @ directions(dim), -(-count // CELL)))

    def cell_of(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        from .cells import matrix

        for batch in batches:
            if batch.num_rows:
                cell = tree.value.cell(units(matrix(batch.column(1))) @ directions(dim))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], ["cell", "vec_id", "v"])

    points = copies_limited(rows, k).mapInArrow(cell_of, "cell int, vec_id long, v array<double>")
    points = materialize(parts_of(points, dim), "cells")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.lit(float("inf")).alias("bound"))

    def own(q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return np.arange(len(tree.value.low)) == tree.value.cell(units(q) @ directions(dim))[:, None]

    def others(q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return (tree.value.gaps(units(q) @ directions(dim)) <= limit * bound[:, None]) & ~own(q, bound)

    kernel = _kernel(k, limit, dim)
    first = materialize(search(points, visits_of(queries, own), kernel), "hits")
    # The squared distance of the k-th hit bounds that of the k-th neighbour.
    kth = best(first, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    bound = F.when(F.col("n") >= k, F.greatest(2 - 2 * F.col("least"), F.lit(0.0)) + 1e-12).otherwise(float("inf"))
    queries = queries.drop("bound").join(kth.select("query_id", bound.alias("b")), "query_id", "left")
    queries = queries.select("query_id", "q", F.coalesce("b", F.lit(float("inf"))).alias("bound"))
    more = search(points, visits_of(queries, others), kernel)
    return best(first.unionByName(more), k).select("query_id", "rank", "vec_id", "score")
