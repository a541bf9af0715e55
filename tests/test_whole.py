"""Queries that meet a table with itself, against their SQL on larger tables, and what they reach."""

import glob
import os

import duckdb
import pytest
from conftest import rows_of

from tramline import plans

SF = "/root/testdata/sf0.01"
NAMES = ["count_within", "coverage_score", "coverage_summary", "ext_distance", "feed_km", "fill_span", "knn_weights", "near_points", "point_in_polygon", "retime_nearest"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_whole_queries_equal_their_sql(name, spark, db):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), db.execute(plans.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(want)
    clean = lambda d: d[cols].astype(object).where(d[cols].notna(), None)
    assert rows_of(clean(got)) == rows_of(clean(want))


def test_whole_queries_reach_every_id(spark, db):
    one = lambda sql: db.execute(sql).fetchall()[0][0]
    run = lambda name: plans.QUERIES[name](spark, SF).toPandas()
    zones = one("select count(*) from supplier")
    assert run("fill_span").trip.max() >= 140
    assert run("feed_km").journeys.sum() == one("select count(distinct (user_id // 2, cast(ts as date))) from events")
    assert set(run("point_in_polygon").name) == set(range(zones)) and len(run("near_points")) == len(run("count_within")) == zones
    assert len(run("ext_distance")) == one("select count(*) from supplier join nation on s_nationkey = n_nationkey where n_regionkey <> 0")
    assert run("coverage_score").score.min() > 0
    assert run("retime_nearest").template.mod(2).sum() > 0 and run("knn_weights").station.nunique() > 12
