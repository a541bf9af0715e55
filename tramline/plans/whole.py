"""Queries that meet a table with itself or a role in it: coverage, nearest targets, points in areas, distances, edits of timetables.

Where a query needs two sides, the searched one is the zones of nations in region 0.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import costs, demand
from tramline.operators import spatial as op
from tramline.operators import timetable as tt
from tramline.plans.areas import _KM
from tramline.plans.registry import query
from tramline.plans.tidy import tidy

_HOME = "home as (select zones.* from zones join nation on zones.name = n_nationkey where n_regionkey = 0)"
_FLAT = "cast(111.32 as double) * sqrt(pow((a.lon - b.lon) * cos(radians(a.lat)), 2) + pow(a.lat - b.lat, 2))"


def _home(t):
    return t.zones.join(t.nation.filter("n_regionkey = 0").select(F.col("n_nationkey").alias("name")), "name", "left_semi")


@query("fill_span", """
with s as (select distinct trip, stop, cast(floor(minute / 30) * 30 as double) as start from calls where minute between 420 and 1100), d as (select trip, stop, start, start - lag(start) over (partition by trip, stop order by start) as h from s),
  g as (select trip, stop, min(start) as f, max(start) as l, quantile_cont(h, 0.5) as hw from d group by trip, stop)
select trip, stop, round(f - i * hw, 6) as start from g, range(1, 200) r(i) where hw > 0 and i <= floor((f - 300) / hw + 1e-9) union all select trip, stop, round(l + i * hw, 6) from g, range(1, 200) r(i) where hw > 0 and i <= ceil((1380 - l) / hw - 1e-9) - 1
""", "calls")
def fill_span(t):
    s = t.calls.filter("minute between 420 and 1100").select("trip", "stop", (F.floor(F.col("minute") / 30) * 30.0).alias("start")).distinct()
    return tidy(tt.fill_span(s, ["trip", "stop"], "start", 300.0, 1380.0))


_COVER = """
  base as (select zone as oa, residents, zone * 3 % 11 as jobs from residents), rc as (select o_custkey % 50 as oa, l_suppkey as cluster_id, min(round(l_discount * 100)) as walk_min from lineitem join orders on l_orderkey = o_orderkey group by all),
  lv as (select s_suppkey as cluster_id, (s_suppkey % 9) + cast(1 as double) as dph, s_suppkey % 3 + 1 as directions from supplier),
  m as (select *, 60 / dph as h, walk_min * 80 as d from rc join lv using (cluster_id)),
  m2 as (select *, case when h < 5 then 1 when h < 10 then 2 when h < 20 then 3 when h < 40 then 4 when h < 60 then 5 end as cat, case when d <= 300 then 0 when d <= 500 then 1 when d <= 750 then 2 when d <= 1000 then 3 end as band from m),
  g as (select oa, min(['A', 'B', 'C', 'D'][greatest(cat - 2, 0) + band + 1]) as class, sum(exp(walk_min / cast(-10 as double)) * least(dph, 12)) as score, bool_or(dph >= 6) as f10, min(walk_min) filter (dph >= 6) as w10, bool_or(dph >= 4) as f15, min(walk_min) filter (dph >= 4) as w15 from m2 group by oa),
  cov as (select base.*, coalesce(class, 'none') as class, coalesce(score, 0) as score, coalesce(f10, false) as frequent_10, w10 as walk_10, coalesce(f15, false) as frequent_15, w15 as walk_15 from base left join g using (oa))
"""


def _coverage(t):
    base = t.residents.select(F.col("zone").alias("oa"), "residents", (F.col("zone") * 3 % 11).alias("jobs"))
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    reach = rows.groupBy((F.col("o_custkey") % 50).alias("oa"), F.col("l_suppkey").alias("cluster_id")).agg(F.min(F.round(F.col("l_discount") * 100, 0)).alias("walk_min"))
    level = t.supplier.select(F.col("s_suppkey").alias("cluster_id"), ((F.col("s_suppkey") % 9) + 1.0).alias("dph_one_way"), (F.col("s_suppkey") % 3 + 1).alias("directions"))
    return op.coverage_score(base, reach, level, F.exp(F.col("walk_min") / -10.0), "oa", [10.0, 15.0])


@query("coverage_score", f"with {_COVER} select oa, residents, jobs, class, round(score, 6) as score, frequent_10, walk_10, frequent_15, walk_15 from cov", "residents")
def coverage_score(t):
    return tidy(_coverage(t))


@query("coverage_summary", f"""
with {_COVER} select class, count(*) as zones, sum(residents)::bigint as residents, sum(jobs)::bigint as jobs, round(sum(score * residents) / sum(residents), 6) as mean_score, sum(case when frequent_10 then residents else 0 end)::bigint as served_frequent_10, sum(case when frequent_15 then residents else 0 end)::bigint as served_frequent_15 from cov group by class
""", "residents")
def coverage_summary(t):
    return tidy(op.coverage_summary(_coverage(t), "class", ["frequent_10", "frequent_15"]))


@query("ext_distance", f"with {_HOME} select a.id, round(min({_FLAT}), 6) as km from zones a, home b where a.id not in (select id from home) group by a.id", "zones")
def ext_distance(t):
    home = _home(t)
    return tidy(demand.external_distance(t.zones.join(home.select("id"), "id", "left_anti"), home, "id"))


@query("feed_km", """
with c as (select c.trip, c.day, c.seq, z.lon, z.lat, c.trip % 3 as mode, c.trip // 2 as journey from calls c join zones z on z.id = c.event_id % (select count(*) from supplier)), o as (select journey, day, min(trip) as trip from c group by all), k as (select c.* from c join o using (journey, day, trip)),
  s as (select *, lag(lon) over (partition by trip, day order by seq) as lon0, lag(lat) over (partition by trip, day order by seq) as lat0 from k)
select mode, round(coalesce(sum(2 * cast(6371.0088 as double) * asin(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))), 0), 5) as km, count(distinct (trip, day)) as journeys from s group by mode
""", "calls zones")
def feed_km(t):
    c = t.calls.crossJoin(F.broadcast(t.supplier.agg(F.count("*").alias("n")))).withColumn("id", F.col("event_id") % F.col("n"))
    c = c.join(t.zones.select("id", "lon", "lat"), "id")
    c = c.withColumns({"mode": F.col("trip") % 3, "journey": F.struct("day", F.floor(F.col("trip") / 2).alias("pair")), "run": F.struct("day", "trip")})
    return tidy(costs.feed_km(c.select("run", "journey", "seq", "mode", "lon", "lat"), "run", "journey", "seq", "mode"), 5)


@query("near_points", f"with {_HOME} select a.id, count(b.id) > 0 as near from zones a left join home b on {_KM} <= cast(0.9 as double) group by a.id", "zones")
def near_points(t):
    return op.near_flag(t.zones, _home(t), 0.9, "id").select("id", "near")


@query("count_within", f"select a.id, count(b.id) as n_near from zones a left join zones b on {_KM} <= cast(1.5 as double) group by a.id", "zones")
def count_within(t):
    return op.count_within(t.zones, t.zones, 1.5, "id").select("id", "n_near")


@query("point_in_polygon", """
with v as (select id as poly, lon - cast(0.013 as double) as x0, lat - cast(0.007 as double) as y0, lon + cast(0.021 as double) as x1, lat + cast(0.016 as double) as y1 from zones)
select z.id, v.poly as name from zones z join v on z.lon > x0 and z.lon < x1 and z.lat > y0 and z.lat < y1 and (z.lon - x0) / (x1 - x0) + (z.lat - y0) / (y1 - y0) < 1
""", "zones")
def point_in_polygon(t):
    pt = lambda x, y: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    ring = F.array(pt(-0.013, -0.007), pt(0.021, -0.007), pt(-0.013, 0.016))
    return op.in_polygon(t.zones, t.zones.select(F.col("id").alias("name"), ring.alias("ring")), "id", "name")


@query("knn_weights", f"""
with d as (select a.id, b.id as station, s_acctbal as flow, {_FLAT} as km from zones a, zones b join supplier on b.id = s_suppkey where s_acctbal > 0),
  r as (select *, row_number() over (partition by id order by km, station) as k from d), w as (select *, flow / pow(km + 1, 2) as w from r where k <= 3)
select id, station, round(km, 6) as km, round(w / sum(w) over (partition by id), 6) as weight from w
""", "zones")
def knn_weights(t):
    flow = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("flow"))
    s = t.zones.join(flow, "id").select(F.col("id").alias("station"), "lon", "lat", "flow")
    return tidy(demand.station_weights(t.zones, s, "id"))


@query("retime_nearest", """
with tp as (select stop, minute as t0, min(trip) as trip from calls group by all), w as (select distinct stop, cast(h * 60 as double) as want from calls, range(24) r(h)),
  j as (select w.stop, want, trip, t0, row_number() over (partition by w.stop, want order by abs(t0 - want), t0) as k from w join tp using (stop))
select stop, want, trip::bigint as template, round(want - t0, 6) as shift from j where k = 1
""", "calls")
def retime_nearest(t):
    wanted = t.calls.select("stop").distinct().withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23)))).select("stop", (F.col("h") * 60.0).alias("want"))
    return tidy(tt.retime_nearest(wanted, t.calls, ["stop"], "want", "minute", "trip"))
