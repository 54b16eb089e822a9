from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cachefold.llm import ann, cells, topk

SCHEMA = "vec_id long, embedding array<float>, cell string, v string"
def EVEN():  # noqa: N802
    return F.col("vec_id") % 5 == 0



def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], SCHEMA)


def clustered(n, dim=16, seed=0):
    rng = np.random.RandomState(seed)
    centres = rng.randn(8, dim)
    return [(i, [float(np.float32(x)) for x in centres[i % 8] + 0.4 * rng.randn(dim)]) for i in range(n)]


ODD_ROWS = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [1.0, None] + [1.0] * 14), (1005, [math.inf] + [0.0] * 15), (1006, [1.0, 2.0]), (None, [1.0] * 16)]


def brute(rows, score, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for a, i in enumerate(ids):
        if i % 5 == 0:
            s = score(x[a], x)
            order = [b for b in np.lexsort((ids, -s)) if ids[b] != i][:k]
            out[i] = [(int(ids[b]), s[b]) for b in order]
    return out


def cosine(q, x):
    return (x * q).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (q * q).sum())


def product(q, x):
    return (np.floor(256 * x) * np.floor(256 * q)).sum(axis=1).astype(np.int64)


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 40)
    rows = clustered(600)
    got: dict[int, list] = {}
    for r in ann.nearest(frame(spark, rows + ODD_ROWS), EVEN()).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute(rows, cosine)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {(q, i): s for q in want for i, s in zip([i for i, _ in rows], cosine(np.array(dict(rows)[q]), np.array([v for _, v in rows])), strict=True)}
    assert all(abs(s - exact[q, i]) < 1e-12 for q in got for i, s in got[q])


def test_ties_copies_and_few_candidates(spark):
    one, other = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(i, one) for i in range(10, 40)] + [(0, one), (0, one), (41, other)]
    got = ann.nearest(frame(spark, rows), F.col("vec_id").isin(0, 12, 41)).orderBy("query_id", "rank").collect()
    by = {q: [r.vec_id for r in got if r.query_id == q] for q in (0, 12, 41)}
    assert by == {0: [10, 11, 12, 13, 14], 12: [0, 10, 11, 13, 14], 41: [0, 10, 11, 12, 13]}
    few = ann.nearest(frame(spark, [(0, one), (5, other), (7, one)]), EVEN()).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 7), (0, 5), (5, 0), (5, 7)]


@pytest.mark.parametrize("run", [ann.nearest, topk.top_products])
def test_nothing_usable(spark, run):
    assert run(frame(spark, []), EVEN()).collect() == []
    assert run(frame(spark, [(0, None), (5, [float("nan")])]), EVEN()).collect() == []


def test_exact_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL", 40)
    monkeypatch.setattr(cells, "QUERY_BLOCK", 9)
    rows = clustered(600, seed=3) + [(700 + i, [0.5] * 16) for i in range(12)] + [(720, [0.0] * 16), (725, [-3.0] * 16)]
    got: dict[int, list] = {}
    for r in topk.top_products(frame(spark, rows + [x for x in ODD_ROWS if x[0] != 1002]), EVEN()).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, product)
    assert got == {q: [(i, int(s)) for i, s in v] for q, v in want.items()}


def test_large_weights_stay_exact(spark):
    rows = [(i, [float(np.float32(1e5 + i * 7.25)), float(np.float32(-9e4 + i))]) for i in range(30)]
    got = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), EVEN()).orderBy("query_id", "rank").collect()
    w = {i: [int(math.floor(256 * x)) for x in v] for i, v in rows}
    for r in got:
        assert r.score == sum(a * b for a, b in zip(w[r.query_id], w[r.vec_id], strict=True))


def ranked(rows, k=5):
    """Brute force in unbounded integers; scores beyond a long are the nearest long."""
    from fractions import Fraction

    w = {i: [math.floor(256 * Fraction(x)) for x in v] for i, v in rows}
    held = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    out = {}
    for q in w:
        if q % 5 == 0:
            scores = sorted((-held(sum(a * b for a, b in zip(w[q], w[i], strict=True))), i) for i in w if i != q)[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def top_of(spark, rows):
    got: dict[int, list] = {}
    for r in topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), EVEN()).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_large_components_take_part(spark):
    rows = [(0, [1.0, 0.5]), (1, [2e6, 0.0]), (2, [1.0, 1.0]), (3, [0.1, 0.1])]
    got = top_of(spark, rows)
    assert got == ranked(rows) and got[0][0] == (1, 2**9 * 256 * 10**6)


@pytest.mark.parametrize("part", [1 << 21, 40])
def test_all_finite_components_are_exact(spark, monkeypatch, part):
    monkeypatch.setattr(topk, "CELL", 25)
    monkeypatch.setattr(cells, "PART_NUMBERS", part)
    rng = np.random.RandomState(8)
    rows = [(i, [float(x) for x in rng.randn(4) * 10.0 ** rng.choice([0, 0, 3, 7, 9, 12, 18, 40, 160, 307], size=4)]) for i in range(120)]
    rows += [(200 + i, [0.1 * i, -0.2, 0.3, 0.4]) for i in range(20)] + [(225, [1e16, -1e16, 1.0, 0.0]), (226, [1e16, 1e16, 3.0, 0.0]), (230, [1e308, -1e308, 1.7e308, -1e300])]
    assert top_of(spark, rows) == ranked(rows)


def test_recall_on_the_table(spark, sf):
    """At least 0.9 of the 5 nearest of the registered query's answers, by brute force over ``embeddings``."""
    from cachefold.llm import queries as Q

    table = Q.table(spark, sf, "embeddings").toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding).astype(np.float64)
    got = Q.op5_ann(spark, sf).toPandas().groupby("query_id").vec_id.apply(set)
    hits = asked = 0
    for a in np.flatnonzero(ids % 50 == 0):
        score = cosine(x[a], x)
        order = [b for b in np.lexsort((ids, -score)) if b != a][:5]
        hits, asked = hits + len(got[ids[a]] & set(ids[order])), asked + 5
    assert asked and hits >= 0.9 * asked


def test_chi_square_quantile():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
    assert abs(ann.chi_square_quantile(0.5, 2) - 2 * math.log(2)) < 1e-9
