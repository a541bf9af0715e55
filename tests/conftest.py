import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tramline.session import local_session

    return local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.driver.memory": "3g"})


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows_of(df):
    return sorted(map(repr, df.itertuples(index=False, name=None)))


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL on the smallest tables."""

    def check(fn, sql):
        got, want = fn(spark, SF).toPandas(), duck.execute(sql).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        clean = lambda d: d[cols].astype(object).where(d[cols].notna(), None)
        assert rows_of(clean(got)) == rows_of(clean(want))
        return got

    return check
