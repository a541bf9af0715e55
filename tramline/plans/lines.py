"""Queries on what schemes are made of: works and builds priced by quantity, price years, attendance, new lines' calls, copied journeys, walking curves."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.functions import curves
from tramline.operators import costs, demand, rail, scenario
from tramline.plans.registry import query
from tramline.plans.tidy import tidy

D = "cast({} as double)".format
_KINDS = ["electrify", "track", "loops", "junctions", "platforms"]


@query("works_lines", f"""
with w as (select p_brand as works, {_KINDS}[p_partkey % 5 + 1] as kind, case when p_size % 2 = 0 then 'simple' else 'complex' end as complexity, p_size % 3 + 1 as tracks, p_retailprice / 100 as km, p_size % 4 as n from part)
select works, case kind when 'electrify' then 'electrification_' || complexity when 'track' then 'track_doubling' when 'loops' then 'passing_loop' when 'junctions' then 'grade_separated_junction' else 'bay_platform' end as item,
  round(sum(case kind when 'electrify' then tracks * km when 'track' then (tracks - 1) * km when 'platforms' then n else 1 end), 6) as qty from w group by all
""")
def works_lines(t):
    size = F.col("p_size")
    w = t.part.select(F.col("p_brand").alias("works"), F.get(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 5).cast("int")).alias("kind"), F.when(size % 2 == 0, "simple").otherwise("complex").alias("complexity"), F.lit(1).alias("was"), (size % 3 + 1).alias("tracks"), (F.col("p_retailprice") / 100).alias("length_km"), (size % 4).alias("n"))
    return tidy(rail.works_lines(w))


@query("discounts", """
with a as (select c_nationkey as zone, avg(case when c_acctbal > 0 then 1 else 0 end) as h, avg(case when c_acctbal > 4000 then 1 else 0 end) as s from customer group by 1) select zone, round(1 - h, 6) as low, round(1 - (h + s) / 2, 6) as central, round(1 - s, 6) as high from a
""")
def discounts(t):
    share = lambda least: F.avg(F.when(F.col("c_acctbal") > least, 1.0).otherwise(0.0))
    a = t.customer.groupBy(F.col("c_nationkey").alias("zone")).agg(share(0).alias("h"), share(4000).alias("s"))
    return tidy(a.select("zone", *[c.alias(n) for n, c in demand.discount(F.col("h"), F.col("s")).items()]))


@query("price_rebase", f"""
with y as (select year(o_orderdate) as y, avg(o_totalprice) as v, sum(o_totalprice) / count(distinct o_custkey) as d from orders group by 1), i as (select * from y where y >= 1996), f as (select (select v from i where y = 1998) as v1, (select v from i where y = 1996) as v0, (select d from y where y = 1996) as d0)
select o_orderkey as item, round(case when year(o_orderdate) >= 1996 then v1 / i.v else d0 / y.d * pow({D(1.02)}, 1996 - year(o_orderdate)) * v1 / v0 end, 6) as factor from orders left join i on i.y = year(o_orderdate) join y on y.y = year(o_orderdate) cross join f
""")
def price_rebase(t):
    year = F.year("o_orderdate").alias("year")
    by = t.orders.groupBy(year)
    index = by.agg(F.avg("o_totalprice").alias("value")).filter("year >= 1996")
    deflator = by.agg((F.sum("o_totalprice") / F.countDistinct("o_custkey")).alias("value")).filter("year <= 1996")
    return tidy(costs.rebased(t.orders.select(F.col("o_orderkey").alias("item"), year), index, deflator, 1998, 0.02).select("item", "factor"))


@query("capital_lines", f"""
with w as (select s_nationkey as line, 'way_' || ['tunnel', 'street', 'segregated'][s_suppkey % 3 + 1] as item, sum(s_suppkey % 200 * {D(10)}) / 1000 as qty from supplier group by all), r as (select s_nationkey as line, sum(s_suppkey % 50 / {D(10)}) as km, sum(2 - s_suppkey % 2)::double as portals from supplier where s_suppkey % 3 = 0 group by 1),
  v as (select c_nationkey as line, c_mktsegment as mode, count(*)::double as n from customer group by all),
  u as (select * from w union all select line, 'tunnel_km', km from r union all select line, 'tunnel_machines', case when km > 0 then 2 else 0 end from r union all select line, 'tunnel_portals', portals from r
    union all select s_nationkey, 'station_' || case when s_suppkey % 4 = 0 then 'underground' else 'surface' end, count(*) from supplier group by all union all select line, 'vehicle_' || mode, n from v union all select line, 'depot_' || mode, 1 from v where n > 0)
select line, item, round(qty, 6) as qty from u where qty <> 0
""")
def capital_lines(t):
    k, line = F.col("s_suppkey"), F.col("s_nationkey").alias("line")
    s = t.supplier
    way = s.select(line, F.get(F.array(F.lit("tunnel"), F.lit("street"), F.lit("segregated")), (k % 3).cast("int")).alias("type"), (k % 200 * 10.0).alias("m"))
    runs = s.filter("s_suppkey % 3 = 0").select(line, (k % 50 / F.lit(10.0)).alias("km"), (2 - k % 2).alias("portals"))
    stations = s.select(line, F.when(k % 4 == 0, "underground").otherwise("surface").alias("kind"), F.lit(1).alias("n"))
    vehicles = t.customer.select(F.col("c_nationkey").alias("line"), F.col("c_mktsegment").alias("mode"), F.lit(1).alias("n"))
    return tidy(costs.capital_lines(way, runs, stations, vehicles))


@query("line_calls", f"""
with s as (select s_nationkey as line, row_number() over (partition by s_nationkey order by s_suppkey) as i, count(*) over (partition by s_nationkey) as k, s_suppkey as stop, 1 + s_suppkey % 7 as run, s_suppkey % 2 * {D(0.5)} as dwell from supplier),
  b as (select line, 0 as dir, i as seq, k, stop, coalesce(lag(run) over (partition by line order by i), 0) as run, dwell from s union all select line, 1, k - i + 1, k, stop, case when i = k then 0 else run end, dwell from s),
  o as (select *, case when seq in (1, k) then 0 else dwell end as stay from b), p as (select *, sum(run + stay) over (partition by line, dir order by seq) as off from o),
  h as (select n_nationkey as line, 10 + n_nationkey % 5 * 5 as hw from nation), d as (select line, dir, n, 420 + fmod(hw / {D(3)} + hw * 1000 - 420, hw) + n * hw as start from h, (values (0), (1)) x(dir), range(0, 20) r(n) where 420 + fmod(hw / {D(3)} + hw * 1000 - 420, hw) + n * hw < 600 - 1e-9)
select p.line || ':' || p.dir || ':' || n as trip, seq, stop, round(start + off - stay, 4) as arr, round(start + off, 4) as dep from p join d using (line, dir)
""")
def line_calls(t):
    """A line a nation: its suppliers in a row, served both ways every 10 to 30 minutes of the morning."""
    k, line = F.col("s_suppkey"), F.col("s_nationkey").alias("line")
    last = F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).isNull()
    stops = t.supplier.select(line, k.alias("seq"), k.alias("stop"), F.when(~last, (1 + k % 7).cast("double")).alias("run_min"), (k % 2 * 30.0).alias("dwell_s"))
    hw = (10 + F.col("n_nationkey") % 5 * 5).cast("double")
    slots = t.nation.select(F.col("n_nationkey").alias("line"), F.explode(F.array(F.lit(0), F.lit(1))).alias("dir"), F.lit(420.0).alias("lo"), F.lit(600.0).alias("hi"), hw.alias("headway"), (hw / 3).alias("phase"))
    return tidy(scenario.timetable_of(stops, slots).select("trip", "seq", "stop", "arr", "dep"), 4)


@query("copied_use", """
with c as (select trip || ':' || cast(day as varchar) as rid, trip, seq, stop, floor(minute * 60) as s from calls), k as (select rid, min(seq) as cut from c where stop = 'click' group by 1),
  x as (select c.*, cut, s + trip % 60 * 60 as d from c left join k using (rid) where cut is null or trip % 3 = 2 or (trip % 3 = 0 and seq <= cut) or (trip % 3 = 1 and seq >= cut)), l as (select rid, stop as f, lead(stop) over (partition by rid order by seq) as g, d from x)
select f as "from", g as "to", cast(floor(d / 3600) % 24 as bigint) as hour, count(*) as trains from l where g is not null and f <> g group by all
""", "calls")
def copied_use(t):
    """Every journey copied, up to an hour later, a third of them up to and a third from their first `click`."""
    rid = F.concat_ws(":", F.col("trip").cast("string"), F.col("day").cast("string"))
    c = t.calls.select(rid.alias("rid"), "trip", "seq", F.col("stop").alias("tpl"), F.floor(F.col("minute") * 60).alias("dep_s"))
    passes = F.max((F.col("tpl") == "click").cast("int")) == 1
    copies = c.groupBy(F.col("rid").alias("journey"), "trip").agg(passes.alias("passes")).select("journey", (F.col("trip") % 60 * 60).alias("shift_s"), F.when(F.col("passes") & (F.col("trip") % 3 < 2), "click").alias("trim_at"), F.when(F.col("trip") % 3 == 0, "before").otherwise("after").alias("keep"))
    return tidy(costs.copied_use(c, copies, "rid", "seq", "tpl", "dep_s"))


_WALKED = """walked as (select ['bus', 'rail', 'metro'][l_suppkey % 3 + 1] as mode, (l_quantity + l_suppkey % 3 * 7) * (l_linenumber + 2) as metres from lineitem), seen as (select mode, avg(metres) as m, quantile_cont(metres, 0.85) as p from walked group by 1),
  every as (select * from seen union all select 'tram', (select m from seen where mode = 'bus') * cast(0.7 as double) + (select m from seen where mode = 'rail') * cast(0.3 as double), (select p from seen where mode = 'bus') * cast(0.7 as double) + (select p from seen where mode = 'rail') * cast(0.3 as double)
    union all select 'ferry', m, p from seen where mode = 'bus')"""


def _walked(t):
    k = F.col("l_suppkey") % 3
    return t.lineitem.select(F.get(F.array(F.lit("bus"), F.lit("rail"), F.lit("metro")), k.cast("int")).alias("mode"), ((F.col("l_quantity") + k * 7) * (F.col("l_linenumber") + 2)).alias("metres"))


@query("decay_curves", f"with {_WALKED} select mode, round(m, 3) as mean_m, round(p, 3) as p85_m, {D(0.15)} as left_at_p85 from every")
def decay_curves(t):
    """Curves by mode: their own mean and what they leave at the 85th percentile, which are what was observed."""
    c = curves.decay_curves(_walked(t), {"tram": 0.3})
    a, b = F.col("a_m"), F.col("b_m")
    mean = (1 + F.exp(-a / b)) * b * F.log1p(F.exp(a / b))
    return tidy(c.select("mode", F.round(mean, 3).alias("mean_m"), F.round("p85_m", 3).alias("p85_m"), F.round((1 + F.exp(-a / b)) / (1 + F.exp((F.col("p85_m") - a) / b)), 6).alias("left_at_p85")))


_TIMES = [("exact", "m / cast(75 as double)"), ("truncated", "floor(m / cast(75 as double))"), ("rounded", "round_even(m / cast(75 as double), 0)")]


@query("whole_minutes", "with x as (select l_quantity * l_linenumber * 7 as m, l_extendedprice as w from lineitem), y as (" + " union all ".join(f"select '{n}' as minutes, {e} as t, w from x" for n, e in _TIMES) + f""")
select minutes, round(sum(w * (1 + exp({D(-600)} / 150)) / (1 + exp((t * 75 - 600) / {D(150)}))) / sum(w), 6) as weight, round(sum(case when t <= 480 / {D(75)} then w else 0 end) / sum(w), 6) as within from y group by 1
""")
def whole_minutes(t):
    x = t.lineitem.select((F.col("l_quantity") * F.col("l_linenumber") * 7).alias("metres"), F.col("l_extendedprice").alias("w"))
    return tidy(curves.whole_minutes(x, 600.0, 150.0, 4.5, 480.0).select("minutes", "weight", "within"))
