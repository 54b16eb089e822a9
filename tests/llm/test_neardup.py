from __future__ import annotations

import random
import re

import pytest

from cachefold.llm import common, neardup
from cachefold.llm.components import connected_components

SCHEMA = "doc_id long, text string, n_shingles string, bucket string"


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(zip(*(words[i:] for i in range(k)), strict=False))


def brute(rows, k):
    """Components by all pairs."""
    sets = [(i, shingles(t, k)) for i, t, *_ in rows]
    ids = sorted({i for i, _ in sets})
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def drifting(rng, n, words, step):
    """A chain of texts: each changes a few words of the one before, so its ends have little in common."""
    text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        for at in rng.sample(range(words), step):
            text[at] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_matches_all_pairs(spark, k):
    rng = random.Random(k)
    texts = [None, "", " \t\n", "one", "One", "two words", "TWO  words", "a b c d e", "a b c d e"]
    texts += drifting(rng, 40, 60, 2) + drifting(rng, 25, 150, 3) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) for _ in range(20)]
    texts += ["copy " * 3000, "copy " * 3000, "x" * 200_000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "extra", "clash") for i, t in zip(ids, texts, strict=True)]
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), k).collect()}
    want = brute(rows, k)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert all(got[i].n_shingles == len(shingles(t, k)) for i, t, *_ in rows)


def test_repeated_and_null_ids(spark):
    rows = [(5, "a b c d", "", ""), (5, "a b c d", "", ""), (3, "a b c d", "", ""), (None, "a b c d", "", ""), (9, None, "", ""), (7, "q r s t", "", ""), (7, "m n o p", "", ""), (2, "m n o p", "", "")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (None, None, False), (9, 9, True), (7, 2, False), (7, 7, True), (2, 2, True)], key=str) or (7, 2, False) in got


def test_last_stage_alone_finds_all_links(spark, monkeypatch):
    """Without leaders, the comparison in blocks has to find every candidate link by itself."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "_leader_pairs", lambda members, hot, turn: members.select("rep", members.rep.alias("lead")).where("false"))
    rows = [(i, t, "", "") for i, t in enumerate(drifting(random.Random(9), 50, 60, 2))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert got == brute(rows, 2)


@pytest.mark.parametrize("leaders", [True, False])
def test_hot_buckets_are_dealt(spark, monkeypatch, leaders):
    """One large group of near copies, one of exact ones, and a template whose users do not link, with every key hot."""
    monkeypatch.setattr(common, "HOT_LEAST", 4)
    monkeypatch.setattr(common, "HOT_SHARE", 3000)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    if not leaders:
        monkeypatch.setattr(neardup, "_leader_pairs", lambda members, hot, turn: members.select("rep", members.rep.alias("lead")).where("false"))
    rng = random.Random(12)
    base, template = ([f"{x}{rng.randrange(10**6)}" for _ in range(120)] for x in "bt")
    texts = []
    for i in range(60):
        near = list(base)
        near[rng.randrange(120)] = f"n{i}"
        texts += [" ".join(near), " ".join(template + [f"o{rng.randrange(10**6)}" for _ in range(45)]), " ".join(base[:50])]
    rows = [(i, t, "", "") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), 2).collect()}
    assert got == brute(rows, 2)


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aB \n\té") for _ in range(n)) for n in (0, 1, 50, 64, 65, 400, 1000)] + ["x" * 500, " " * 300]
    whole = [s.tolist() for s in neardup.shingle_sets(texts, 3)]
    monkeypatch.setattr(neardup, "CHUNK", 64)
    assert [s.tolist() for s in neardup.shingle_sets(texts, 3)] == whole


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA), 5).collect() == []


def test_components_of_paths_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, j) for j in range(101, 140)] + [(7, 7), (100, 101), (140, 139), (200, 201), (201, 200)]
    got = {r.u: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, **{j: 100 for j in range(101, 141)}, 201: 200}


def test_components_of_lone_pairs(spark):
    links = spark.createDataFrame([(1, 9), (7, 3)], "u long, v long")
    assert {(r.u, r.component) for r in connected_components(links).collect()} == {(9, 1), (7, 3)}
