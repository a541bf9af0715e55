"""Searches by distance at all latitudes: tables of so many suppliers that their lattice passes 60 degrees and the pole."""

import math

import duckdb
import pytest
from conftest import rows_of

from tramline import plans
from tramline.operators import spatial

SF = "/root/testdata/sf0.001"
NAMES = ["candidate_pairs", "clusters", "count_within", "near_pairs", "near_points", "site_factors"]


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """A folder whose suppliers lie about 51.4, 60, 90 and 111 degrees."""
    con, at = duckdb.connect(), tmp_path_factory.mktemp("far")
    con.execute(f"copy (select k as s_suppkey, 'S' || k as s_name, (k * 7 % 25)::int as s_nationkey, (k * 31 % 9973) / 7.0::double as s_acctbal from (select unnest(range(60) || range(8560, 8640) || range(38300, 38900) || range(59940, 60000)) as k)) to '{at}/supplier.parquet' (format parquet)")
    for t in ("supplier", "nation", "region"):
        if t != "supplier":
            con.execute(f"copy (select * from '{SF}/{t}.parquet') to '{at}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql_at_all_latitudes(name, spark, far):
    got, want = plans.QUERIES[name](spark, far[0]).toPandas(), far[1].execute(plans.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(want)
    clean = lambda d: d[cols].astype(object).where(d[cols].notna(), None)
    assert rows_of(clean(got)) == rows_of(clean(want))


@pytest.mark.parametrize("km", [0.0, 3.0, 400.0])
def test_near_pairs_over_the_whole_earth(spark, km):
    pole = [(i, i * 7.3 - 180, s * (90 - i * 0.004)) for i in range(50) for s in (1, -1)]
    globe = [(100 + i, i * 37.7 % 360 - 180, i * 23.3 % 180 - 90) for i in range(300)]
    rows = [*pole, *globe, (900, None, 1.0), (901, 1.0, None), (902, math.nan, 1.0), (903, 1.0, math.inf), (904, 0.0, 90.0), (905, 10.0, 60.0), (906, 10.05, 60.0), (907, 10.0, -89.0)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double")
    got = sorted((r.a_id, r.b_id) for r in spatial.near_pairs(df, df, km).collect())
    fine = [r for r in rows if all(v is not None and math.isfinite(v) for v in r)]
    flat = lambda p, q: 111.32 * math.hypot((p[1] - q[1]) * math.cos(math.radians((p[2] + q[2]) / 2)), p[2] - q[2])
    assert got == sorted((p[0], q[0]) for p in fine for q in fine if flat(p, q) <= km)
