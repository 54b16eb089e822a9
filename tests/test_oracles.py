"""Every registered query of the library against its SQL, row by row."""

from __future__ import annotations

import os

import duckdb
import pytest

from cachefold.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    told = duck.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert plain(map(tuple, df.select(*columns).collect())) == plain(told)


def test_each_query_without_sql_is_known():
    assert set(QUERIES) - set(ORACLES) == {"route_epochs"}


def test_epoch_routing_covers_all_requests(spark, sf):
    rows = QUERIES["route_epochs"](spark, sf).collect()
    assert len({r.request_id for r in rows}) == len(rows) == 15
    assert {r.epoch for r in rows} == {0, 1, 2}
