"""Where plan modules register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, and views that stand for the domain's own tables (see `proxies`)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        from tramline.plans import proxies

        if name in proxies.VIEWS:
            return proxies.VIEWS[name](self)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers fn(tables) -> DataFrame; sql may use the named views' CTEs."""

    def take(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        from tramline.plans import proxies

        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = proxies.with_views(views.split(), sql)
        return fn

    return take
