"""Queries on demand, cost and capacity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import costs, demand
from tramline.operators import timetable as tt
from tramline.plans.registry import query
from tramline.plans.tidy import tidy

_NATION = "par as (select n_nationkey as zone, n_regionkey as parent from nation), ins as (select n_nationkey as zone from nation where n_nationkey < 12)"
_BASE = f"{_NATION}, bm as (select case when o < 12 then o else po.parent end as o_zone, case when o < 12 then 'zone' else 'parent' end as o_level, pd.parent as d_parent, case when o < 12 and d < 12 then null when o < 12 then 'out' when d < 12 then 'in' else 'both' end as external, cast(sum(trips) as double) as trips from flows join par po on po.zone = o join par pd on pd.zone = d group by all)"


def _base(t):
    nation = t.nation.select(F.col("n_nationkey").alias("zone"), F.col("n_regionkey").alias("parent"))
    return demand.base_matrix(t.flows, nation.filter("zone < 12").select("zone"), nation)


@query("base_matrix", f"with {_BASE} select o_zone::bigint as o_zone, o_level, d_parent::bigint as d_parent, external, trips from bm", "flows")
def base_matrix(t):
    return tidy(_base(t))


def _zone_jobs(t):
    j = t.supplier.groupBy("s_nationkey").agg((F.count("*") * 10).alias("jobs"))
    return t.nation.join(j, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_regionkey").alias("d_parent"), F.col("n_nationkey").alias("zone"), F.coalesce("jobs", F.lit(0)).alias("jobs"))


_ZJ = "zj as (select n_regionkey as d_parent, n_nationkey as zone, coalesce(jobs, 0) as jobs from nation left join (select s_nationkey, count(*) * 10 as jobs from supplier group by 1) on n_nationkey = s_nationkey)"
_SPLIT = f"{_BASE}, {_ZJ}, sh as (select d_parent, zone as d_zone, jobs / cast(sum(jobs) over (partition by d_parent) as double) as share from zj where jobs > 0), sp as (select o_zone, o_level, external, d_zone, trips * share as trips from bm join sh using (d_parent))"


@query("dest_split", f"with {_SPLIT} select o_zone::bigint as o_zone, o_level, external, d_zone::bigint as d_zone, round(trips, 6) as trips from sp", "flows")
def dest_split(t):
    return tidy(demand.split_destinations(_base(t), _zone_jobs(t)).select("o_zone", "o_level", "external", "d_zone", "trips"))


@query("conservation", f"with {_SPLIT} select (select round(sum(trips), 4) from bm) as before, (select round(sum(trips), 4) from sp) as after, abs((select sum(trips) from bm) - (select sum(trips) from sp)) <= 1e-4 as conserved", "flows")
def conservation(t):
    b = _base(t)
    return tidy(demand.conserved(b, demand.split_destinations(b, _zone_jobs(t)), 1e-4), 4)


@query("ext_factor", f"""
with {_BASE}, {_ZJ}, w as (select d_parent, sum(jobs) * cast(0.8 as double) as want from zj group by 1), g as (select d_parent, sum(trips) as got from bm where external = 'out' group by 1), b as (select *, want / got as own from g left join w using (d_parent)), p as (select sum(want) / sum(got) filter (want is not null) as pool from b)
select d_parent::bigint as d_parent, round(case when own <= cast(0.16 as double) then own else pool end, 6) as factor, case when own <= cast(0.16 as double) then 'own' else 'pooled' end as basis from b, p
""", "flows")
def ext_factor(t):
    return tidy(demand.external_factors(_base(t).filter("external = 'out'"), _zone_jobs(t), 0.2, 0.16))


_CARS = "cars as (select c_nationkey as o, o_custkey % 25 as d, o_orderpriority as p, n_regionkey as dp from orders join customer on o_custkey = c_custkey join nation on n_nationkey = o_custkey % 25)"


@query("ca_share_fallback", f"""
with {_CARS}, h as (select o, d, dp, case when p in ('1-URGENT', '2-HIGH') then cast(1 as double) else 0 end as h from cars), a as (select o, d, dp, avg(h) as s, count(*) as n from h group by all), b as (select o, dp, avg(h) as s, count(*) as n from h group by all), c as (select o, avg(h) as s from h group by o)
select a.o::bigint as o, a.d::bigint as d, a.dp::bigint as dp, round(case when a.n >= 28 then a.s when b.n >= 130 then b.s else c.s end, 6) as share, case when a.n >= 28 then 1 when b.n >= 130 then 2 else 3 end::bigint as level from a join b on a.o = b.o and a.dp = b.dp join c on c.o = a.o
""")
def ca_share_fallback(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("d", F.col("o_custkey") % 25)
    rows = rows.join(t.nation, F.col("n_nationkey") == F.col("d")).select(F.col("c_nationkey").alias("o"), "d", F.col("n_regionkey").alias("dp"), F.col("o_orderpriority").alias("p"))
    hit = F.col("p").isin("1-URGENT", "2-HIGH")
    # The two thresholds differ here, so each level is asked for with its own.
    own = demand.fallback_share(rows, [["o", "d", "dp"], ["o", "dp"], ["o"]], hit, 28)
    mid = demand.fallback_share(rows, [["o", "d", "dp"], ["o", "dp"], ["o"]], hit, 130)
    j = own.join(mid.select("o", "d", "dp", F.col("share").alias("s2"), F.col("level").alias("l2")), ["o", "d", "dp"])
    return tidy(j.select("o", "d", "dp", F.when(F.col("level") == 1, F.col("share")).otherwise(F.col("s2")).alias("share"), F.when(F.col("level") == 1, 1).otherwise(F.greatest(F.col("l2"), F.lit(2))).alias("level")))


@query("segment_split", """
with s as (select c_nationkey as o, round(avg(case when c_acctbal > 4000 then cast(1 as double) else 0 end), 6) as share from customer group by 1)
select o::bigint as o, d::bigint as d, 'CA' as segment, round(trips * share, 6) as trips from flows join s using (o) union all select o, d, 'NCA', round(trips * (1 - share), 6) from flows join s using (o)
""", "flows")
def segment_split(t):
    s = t.customer.groupBy(F.col("c_nationkey").alias("o")).agg(F.round(F.avg((F.col("c_acctbal") > 4000).cast("double")), 6).alias("share"))
    return tidy(demand.segment_split(t.flows, s, ["o"]))


@query("reconcile", """
with b as (select c_nationkey as o, cast(o_custkey % 25 as int) as d, count(*) as trips from orders join customer on o_custkey = c_custkey where o_orderstatus <> 'P' group by all)
select sum(coalesce(x.trips, 0))::bigint as total_a, sum(coalesce(y.trips, 0))::bigint as total_b, max(abs(coalesce(x.trips, 0) - coalesce(y.trips, 0)))::bigint as worst from flows x full join b y on x.o = y.o and x.d = y.d
""", "flows")
def reconcile(t):
    rows = t.orders.filter("o_orderstatus <> 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    b = rows.groupBy(F.col("c_nationkey").alias("o"), (F.col("o_custkey") % 25).cast("int").alias("d")).agg(F.count("*").alias("trips"))
    return tidy(demand.reconcile(t.flows, b, ["o", "d"]))


@query("gateway_flow", """
select case when d % 9 = 2 then 'in' else 'out' end as dir, (case when d % 9 = 2 then d else o end)::bigint as gateway, (case when d % 9 = 2 then o else d end)::bigint as station, sum(trips)::bigint as j from flows where (o % 9 = 2) <> (d % 9 = 2) group by all
""", "flows")
def gateway_flow(t):
    g = t.nation.filter("n_nationkey % 9 = 2").select(F.col("n_nationkey").alias("station"))
    return tidy(demand.gateway_flows(t.flows.withColumnRenamed("trips", "j"), g))


@query("rail_share", """
with f as (select o as zone, case when d % 2 = 0 then 'in' else 'out' end as dir, cast(o * 3 as double) as km, trips // 3 as train, trips as n from flows), b as (select *, (km >= 5)::int + (km >= 15)::int + (km >= 50)::int as band from f),
  own as (select zone, dir, band, sum(train) as t, sum(n) as n from b group by all), p as (select dir, band, sum(train) / cast(sum(n) as double) as p from b group by all)
select zone::bigint as zone, dir, band::bigint as band, round(case when own.n >= 290 then t / cast(own.n as double) else p end, 6) as share, case when own.n >= 290 then 'own' else 'band' end as basis from own join p using (dir, band)
""", "flows")
def rail_share(t):
    f = t.flows.select(F.col("o").alias("zone"), F.when(F.col("d") % 2 == 0, "in").otherwise("out").alias("dir"), (F.col("o") * 3.0).alias("km"), F.floor(F.col("trips") / 3).alias("train"), F.col("trips").alias("n"))
    return tidy(demand.rail_share(f, 290))


@query("gateway_demand", """
with g as (select case when d % 2 = 0 then 'in' else 'out' end as dir, o % 5 as gateway, d as zone, sum(trips) as c from flows group by all), j as (select dir, gateway, sum(c) * 30 as j, sum(c) as n from g group by all),
  s as (select dir, gateway, zone, (zone % 7 + 1) * exp(-(cast(zone as double)) / 5) as w from g), k as (select j.dir, j.gateway, g.zone, j * cast(0.0027397 as double) * c / cast(n as double) as trips, 'pattern' as basis from j join g using (dir, gateway) where n >= 1450
    union all select j.dir, j.gateway, s.zone, j * cast(0.0027397 as double) * w / sum(w) over (partition by s.dir, s.gateway), 'gravity' from j join s using (dir, gateway) where n < 1450)
select dir, gateway::bigint as gateway, zone::bigint as zone, round(trips, 6) as trips, basis from k
""", "flows")
def gateway_demand(t):
    g = t.flows.groupBy(F.when(F.col("d") % 2 == 0, "in").otherwise("out").alias("dir"), (F.col("o") % 5).alias("gateway"), F.col("d").alias("zone")).agg(F.sum("trips").alias("commuters"))
    j = g.groupBy("dir", "gateway").agg((F.sum("commuters") * 30).alias("j"))
    size = g.select("dir", "gateway", "zone", (F.col("zone") % 7 + 1).alias("size"), F.col("zone").cast("double").alias("km"))
    return tidy(demand.gateway_demand(j, g, size, 0.0027397, 1450.0))


def _lines(t):
    p = t.prices
    return p.select("item", "kind", "qty", (F.col("unit") * 0.8).alias("low"), F.col("unit").alias("central"), (F.col("unit") * 1.5).alias("high"), F.when(F.col("item") % 400 == 13, "upper").alias("bound"))


_LINES = "ln as (select item, kind, qty * unit * cast(0.8 as double) as l, qty * unit as c, qty * unit * cast(1.5 as double) as h, coalesce(item % 400 = 13, false) as up from prices)"


@query("cost_lines", f"with {_LINES} select item, round(case when not up then l * cast(1.21 as double) end, 4) as cost_low, round(case when not up then c * cast(1.21 as double) end, 4) as cost_central, round(h * cast(1.21 as double), 4) as cost_high from ln", "prices")
def cost_lines(t):
    return tidy(costs.cost_lines(_lines(t), 1.1, 0.1).select("item", "cost_low", "cost_central", "cost_high"), 4)


@query("cost_totals", f"with {_LINES} select kind, round(case when not bool_or(up) then sum(l) end, 4) as low, round(case when not bool_or(up) then sum(c) end, 4) as central, round(case when not bool_or(up) then sum(h) end, 4) as high, count(*) as lines, count(*) filter (h is null) as not_costed from ln group by kind", "prices")
def cost_totals(t):
    # An upper bound alone fills high only; so its group has no totals.
    return tidy(costs.cost_totals(costs.cost_lines(_lines(t)), ["kind"]), 4)


_LEGS = "lg as (select s_nationkey as line, s_suppkey as k, (s_suppkey % 5 + 1) * cast(500 as double) as m, case when s_suppkey % 3 = 0 then 0 else (s_suppkey % 5 + 1) * cast(500 as double) * case when s_suppkey % 2 = 0 then 1 else cast(0.5 as double) end end as tn from supplier)"


@query("tunnel_runs", f"""
with {_LEGS}, a as (select *, tn > 0 as i, tn > 0 and not coalesce(lag(tn) over (partition by line order by k) > 0, false) as new, lag(k) over (partition by line order by k) is null as first, lead(k) over (partition by line order by k) is null as last, tn >= cast(0.999 as double) * m as whole from lg), b as (select *, sum(new::int) over (partition by line order by k rows unbounded preceding) as run from a)
select line::bigint as line, run::bigint as run, sum(tn) / 1000 as km, (2 - max((first and whole)::int) - max((last and whole)::int))::bigint as portals from b where i group by line, run
""")
def tunnel_runs(t):
    k = F.col("s_suppkey")
    m = (k % 5 + 1) * 500.0
    legs = t.supplier.select(F.col("s_nationkey").alias("line"), k.alias("k"), m.alias("m"), F.when(k % 3 == 0, 0.0).otherwise(m * F.when(k % 2 == 0, 1.0).otherwise(0.5)).alias("tn"))
    return tidy(costs.tunnel_runs(legs, "line", "k", "m", "tn"))


@query("fleet", "with f as (select p_type as mode, ceil((p_size * 3) / cast(p_partkey % 9 + 5 as double) - 1e-9)::bigint as v from part) select mode, sum(v)::bigint as in_service, sum(v)::bigint + ceil(sum(v) * cast(0.1 as double) - 1e-9)::bigint as with_spares from f group by mode")
def fleet(t):
    v = t.part.select(F.col("p_type").alias("mode"), costs.fleet(F.col("p_size") * 3.0, F.col("p_partkey") % 9 + 5).alias("v"))
    return tidy(costs.with_spares(v, "mode", "v", 0.1))


@query("once_per_build", "select p_partkey as item, case when row_number() over (partition by p_brand, p_size order by p_partkey) = 1 then p_size else 0 end::bigint as qty from part")
def once_per_build(t):
    p = t.part.select(F.col("p_partkey").alias("item"), "p_brand", "p_size", F.col("p_size").alias("qty"))
    return tidy(costs.once_per_build(p, ["p_brand", "p_size"], ["item"], "qty").select("item", "qty"))


_USE = "legs as (select *, lead(stop) over (partition by trip, day order by seq) as nxt, lead(minute) over (partition by trip, day order by seq) as nm from calls), use as (select stop as f, nxt as t, cast(floor(minute / 60) as int) % 24 as hour, count(*) as trains from legs where nxt is not null and nxt <> stop group by all), rt as (select stop as f, nxt as t, quantile_cont(nm - minute, 0.5) as r from legs where nxt is not null and nxt <> stop group by all)"
_LIMIT = f"{_USE}, b as (select f, t, max(trains) as busy from use group by all), m as (select a.f, a.t, (a.r + coalesce(z.r, a.r)) / 2 as r from rt a left join rt z on z.f = a.t and z.t = a.f), lim as (select b.f, b.t, greatest(case when b.f = 'click' then 20 when b.f < b.t then floor(60 / (2 * (r + 1) + 2) + 1e-9)::bigint else 12 end, busy + 1) as lim from b join m using (f, t))"


def _limits(t):
    calls = t.calls.withColumns({"dep_s": F.col("minute") * 60, "arr": F.col("minute")})
    trip = ["trip", "day"]
    use = tt.section_use(calls, trip, "seq", "stop", "dep_s")
    runs = tt.section_run_times(calls, trip, "seq", "stop", "minute", "arr")
    pairs = use.select("from", "to").distinct()
    over = pairs.filter(F.col("from") == "click").withColumn("limit", F.lit(20))
    tracks = pairs.withColumn("tracks", F.when(F.col("from") < F.col("to"), 1).otherwise(2))
    return use, costs.capacity_limits(use, runs, over, tracks, 1.0, 1.0, 12, 1)


@query("block_limits", f'with {_LIMIT} select f as "from", t as "to", lim::bigint as "limit" from lim', "calls")
def block_limits(t):
    return tidy(_limits(t)[1])


@query("capacity_check", f'with {_LIMIT} select u.f as "from", u.t as "to", u.hour::bigint as hour, u.trains * 2 as trains, lim::bigint as "limit", u.trains * 2 > lim as over from use u join lim on lim.f = u.f and lim.t = u.t', "calls")
def capacity_check(t):
    use, limits = _limits(t)
    return tidy(costs.capacity_check(use, use, limits))
