"""Views of the driver's tables that have the shapes of the domain's tables, as DataFrames and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.functions.clock import period

#: Pairs with fewer minutes than this are unreachable in the skims.
FEWEST = 10


def _minute(ts: str):
    return F.hour(ts) * 60 + F.minute(ts) + F.second(ts).cast("int") / F.lit(60.0)


def calls(t) -> DataFrame:
    """Ordered calls: trip, seq, stop, minute, day, ts."""
    w = Window.partitionBy("trip", "day").orderBy("ts")
    e = t.events.select(F.col("user_id").alias("trip"), F.to_date("ts").alias("day"), F.col("event_type").alias("stop"), "ts", _minute("ts").alias("minute"), "event_id", "value")
    return e.withColumn("seq", F.row_number().over(w))


def minutes(t) -> DataFrame:
    """Per-minute journey rows of origin-destination pairs."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        (F.col("o_custkey") % 50).alias("from_id"), (F.col("l_suppkey") % 40).alias("to_id"), F.col("l_quantity").alias("total_time"),
        F.round(F.col("l_discount") * 100, 0).alias("wait"), (F.col("l_quantity") / 2).alias("ride"), (F.col("l_linenumber") % 3).alias("n_rides"),
        F.concat("l_returnflag", "l_linestatus").alias("route"), F.col("l_linestatus").alias("status"), F.round(F.col("l_tax") * 100, 0).alias("walk"),
    )


def _skim(status: str):
    def view(t) -> DataFrame:
        g = minutes(t).filter(F.col("status") == status).groupBy("from_id", "to_id")
        g = g.agg(F.percentile("total_time", F.lit(0.5)).alias("p50"), F.count("*").alias("n"), F.min("route").alias("top_routes"), F.avg("ride").alias("ride"), F.avg("walk").alias("walk"), F.avg("wait").alias("wait"))
        return g.withColumn("unreachable", F.col("n") < FEWEST)

    return view


def zones(t) -> DataFrame:
    """Points on a lattice, one a supplier: id, lon, lat."""
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("id"), (F.lit(-2.6) + (k % 10) * F.lit(0.01)).alias("lon"), (F.lit(51.4) + F.floor(k / 10) * F.lit(0.01)).alias("lat"), F.col("s_nationkey").alias("name"))


def flows(t) -> DataFrame:
    """o, d, trips between nations."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("o"), (F.col("o_custkey") % 25).cast("int").alias("d")).agg(F.count("*").alias("trips"))


def residents(t) -> DataFrame:
    return t.customer.groupBy((F.col("c_custkey") % 50).alias("zone")).agg(F.count("*").alias("residents"))


def jobs(t) -> DataFrame:
    return t.supplier.groupBy((F.col("s_suppkey") % 40).alias("zone")).agg((F.count("*") * 10).alias("jobs"))


def probe(t) -> DataFrame:
    """Speeds of vehicles on segments: leg, vehicle, segment, kmh, period, hour."""
    e = t.events.withColumn("minute", _minute("ts"))
    return e.select(F.col("event_id").alias("leg"), F.col("user_id").alias("vehicle"), F.concat_ws("-", "event_type", (F.col("event_id") % 20).cast("string")).alias("segment"), F.col("event_type").alias("road_class"), (F.col("value") + 1).alias("kmh"), period(F.col("minute")).alias("period"), F.hour("ts").alias("hour"), "ts")


def prices(t) -> DataFrame:
    """Cost lines: item, kind, qty, unit (null at every seventh size)."""
    return t.part.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("kind"), F.col("p_size").cast("double").alias("qty"), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("unit"))


VIEWS = {f.__name__: f for f in (calls, minutes, zones, flows, residents, jobs, probe, prices)} | {"skim_a": _skim("F"), "skim_b": _skim("O")}

_MINUTE = "cast(hour(ts) * 60 + minute(ts) as double) + floor(date_part('second', ts)) / cast(60 as double)"
_PERIOD = "case when {m} >= 420 and {m} < 600 then 'AM' when {m} >= 600 and {m} < 960 then 'IP' when {m} >= 960 and {m} < 1140 then 'PM' else 'OP' end"


def period_sql(m: str) -> str:
    return _PERIOD.format(m=m)


CTES = {
    "calls": f"calls as (select user_id as trip, cast(ts as date) as day, event_type as stop, ts, {_MINUTE} as minute, event_id, value, row_number() over (partition by user_id, cast(ts as date) order by ts) as seq from events)",
    "minutes": "minutes as (select o_custkey % 50 as from_id, l_suppkey % 40 as to_id, l_quantity as total_time, round(l_discount * 100) as wait, l_quantity / 2 as ride, l_linenumber % 3 as n_rides, l_returnflag || l_linestatus as route, l_linestatus as status, round(l_tax * 100) as walk from lineitem join orders on l_orderkey = o_orderkey)",
    "skim_a": f"skim_a as (select from_id, to_id, quantile_cont(total_time, 0.5) as p50, count(*) as n, min(route) as top_routes, avg(ride) as ride, avg(walk) as walk, avg(wait) as wait, count(*) < {FEWEST} as unreachable from minutes where status = 'F' group by all)",
    "skim_b": f"skim_b as (select from_id, to_id, quantile_cont(total_time, 0.5) as p50, count(*) as n, min(route) as top_routes, avg(ride) as ride, avg(walk) as walk, avg(wait) as wait, count(*) < {FEWEST} as unreachable from minutes where status = 'O' group by all)",
    "zones": "zones as (select s_suppkey as id, cast(-2.6 as double) + (s_suppkey % 10) * cast(0.01 as double) as lon, cast(51.4 as double) + floor(s_suppkey / 10) * cast(0.01 as double) as lat, s_nationkey as name from supplier)",
    "flows": "flows as (select c_nationkey as o, cast(o_custkey % 25 as int) as d, count(*) as trips from orders join customer on o_custkey = c_custkey group by all)",
    "residents": "residents as (select c_custkey % 50 as zone, count(*) as residents from customer group by all)",
    "jobs": "jobs as (select s_suppkey % 40 as zone, count(*) * 10 as jobs from supplier group by all)",
    "probe": f"probe0 as (select *, {_MINUTE} as m from events), probe as (select event_id as leg, user_id as vehicle, event_type || '-' || (event_id % 20) as segment, event_type as road_class, value + 1 as kmh, {period_sql('m')} as period, hour(ts) as hour, ts from probe0)",
    "prices": "prices as (select p_partkey as item, p_type as kind, cast(p_size as double) as qty, case when p_size % 7 <> 0 then p_retailprice end as unit from part)",
}
NEEDS = {"skim_a": ["minutes"], "skim_b": ["minutes"]}


def with_views(names: list[str], sql: str) -> str:
    every: list[str] = []
    for n in names:
        every += [x for x in [*NEEDS.get(n, []), n] if x not in every]
    head = ", ".join(CTES[n] for n in every)
    sql = sql.strip()
    if not head:
        return sql
    if sql.lower().startswith("with recursive "):
        return f"with recursive {head}, {sql[15:]}"
    return f"with {head}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {head} {sql}"
