"""Queries on fits and hold-outs: the sums of a step, levels and delays that come back, roads left out, medians without a fold, deals in halves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import congestion, fits, roads
from tramline.plans.registry import query
from tramline.plans.tidy import tidy

D = "cast({} as double)".format

#: A segment a line: its supplier's road, the flag's area, the supplier's nation as authority.
_HOURS = f"""
  hours as (select l_suppkey as road, l_returnflag as area, s_nationkey as authority, sum(l_quantity / {D(1000)} * l_extendedprice) as lw, sum(l_extendedprice * l_quantity / {D(1000)} / (20 + l_linenumber * 10) * ({D(0.3)} / case when l_returnflag = 'A' then {D(0.8)} else {D(0.9)} end + {D(0.7)})) as run_h,
    sum(l_extendedprice * {D(0.3)} * case when l_linenumber % 3 = 0 then {D(6)} else 0 end / 3600) as wait_h from lineitem join supplier on s_suppkey = l_suppkey group by all)
"""
_LEVEL = {"A": 0.45, "N": 0.62, "R": 0.78}
_LEVEL_SQL = "case area when 'A' then cast(0.45 as double) when 'N' then cast(0.62 as double) else cast(0.78 as double) end"


def _hours(t):
    seg = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(
        F.col("l_suppkey").alias("road"), F.col("l_returnflag").alias("area"), F.col("s_nationkey").cast("string").alias("authority"), F.col("l_quantity").cast("double").alias("length_m"),
        F.col("l_extendedprice").alias("w"), (20.0 + F.col("l_linenumber") * 10).alias("ff_kmh"), F.when(F.col("l_linenumber") % 3 == 0, 6.0).otherwise(0.0).alias("late"),
    )
    return fits.road_hours(seg, {"AM": 0.3, "IP": 0.7}, {"AM": F.when(F.col("area") == "A", 0.8).otherwise(0.9)}, {"AM": F.col("late")})


def _made(hours):
    """Speeds that the known levels make."""
    level = F.when(F.col("area") == "A", _LEVEL["A"]).when(F.col("area") == "N", _LEVEL["N"]).otherwise(_LEVEL["R"])
    return hours.groupBy("road").agg((F.sum("lw") / F.sum(F.col("run_h") / level + F.col("wait_h"))).alias("kmh"))


@query("level_step", f"""
with {_HOURS}, t as (select road, sum(lw) / sum(run_h + wait_h) as s, sum(run_h + wait_h) as t from hours group by road),
  v as (select road, 'area:' || area as n, sum(run_h) / max(t) as x from hours join t using (road) group by all union all select road, 'authority:' || authority, sum(run_h) / max(t) from hours join t using (road) group by all
    union all select road, '', ln(s / (20 + s_suppkey % 31)) from t join supplier on s_suppkey = road)
select a.n as i, b.n as j, round(sum(a.x * b.x), 6) as jj from v a join v b on a.road = b.road and a.n <= b.n group by all
""")
def level_step(t):
    """The normal sums of a Gauss-Newton step of the level fit, from level 1."""
    hours = _hours(t).withColumn("case", F.lit(""))
    kmh = t.supplier.select(F.col("s_suppkey").alias("road"), (20.0 + F.col("s_suppkey") % 31).alias("kmh"))
    names = [F.concat(F.lit("area:"), "area"), F.concat(F.lit("authority:"), "authority")]
    at = hours.select("case", F.explode(F.array(*names)).alias("name")).distinct().withColumn("x", F.lit(0.0))
    return tidy(fits.level_sums(fits.level_rows(hours, kmh, at, None, None)).select("i", "j", "jj"))


@query("level_fit", f"with {_HOURS} select road, round(sum(lw) / sum(run_h / {_LEVEL_SQL} + wait_h), 4) as kmh, round(min({_LEVEL_SQL}), 4) as lowest from hours group by road")
def level_fit(t):
    """Speeds of roads by fitted levels, and each road's lowest level: the levels that made the targets are found again."""
    hours = _hours(t)
    fit = fits.fit_levels(hours, _made(hours), authority=False)
    level = t.spark.createDataFrame([(a, float(v)) for a, v in fit.area[""].items()], "area string, level double")
    lowest = hours.join(level, "area").groupBy("road").agg(F.min("level").alias("lowest"))
    return tidy(fit.roads.select("road", F.col("modelled").alias("kmh")).join(lowest, "road"), 4)


@query("roads_left_out", f"""
with {_HOURS} select road, cast(road % 4 as varchar) as fold, round(sum(lw) / sum(run_h / {_LEVEL_SQL} + wait_h), 4) as predicted from hours group by road
""")
def roads_left_out(t):
    """Roads in four folds, each predicted by the levels of the other three."""
    hours = _hours(t)
    kmh = _made(hours)
    return tidy(fits.hold_out_levels(hours, kmh, kmh.select("road", (F.col("road") % 4).alias("fold"))).select("road", "fold", "predicted"), 4)


@query("delay_fit", f"select l_suppkey as link_id, round(sum(l_quantity) + 21 * count(*) filter (l_returnflag = 'A') + 9 * count(*) filter (l_returnflag = 'N'), 4) as model_s from lineitem group by l_suppkey")
def delay_fit(t):
    """Seconds on links by fitted delays a signal: the delays that made the observed ones come back."""
    n = lambda f: F.sum((F.col("l_returnflag") == f).cast("int"))
    links = t.lineitem.groupBy(F.col("l_suppkey").alias("link_id")).agg(F.sum("l_quantity").cast("double").alias("run_s"), n("A").alias("s_centre"), n("N").alias("s_urban"), n("R").alias("s_rural"))
    links = links.withColumn("obs_s", F.col("run_s") + 21 * F.col("s_centre") + 9 * F.col("s_urban"))
    d = fits.fit_delays(links, ["centre", "urban", "rural"])
    return tidy(links.select("link_id", sum((F.col(f"s_{a}") * F.lit(v) for a, v in d.items()), F.col("run_s")).alias("model_s")), 4)


@query("road_class_segments", """
with s as (select s_nationkey as ref, s_suppkey as u, row_number() over (partition by s_nationkey order by s_suppkey) as i, s_acctbal from supplier), e as (select a.ref, a.u, b.u as v, 10 + a.i % 7 * 10 as m from s a join s b on a.ref = b.ref and b.i = a.i + 1),
  x as (select s.ref, s.u, coalesce(sum(m) over (partition by s.ref order by s.u rows between unbounded preceding and 1 preceding), 0) as off, i, s_acctbal from s left join e using (ref, u)),
  p as (select ref, u, off, case when s_acctbal > 4000 then 'srn' else 'local_a' end as cls from x where i % 5 = 2),
  d as (select x.ref, x.u, p.u as seed, p.cls, abs(x.off - p.off) as m, row_number() over (partition by x.ref, x.u order by abs(x.off - p.off), p.u) as k from x join p using (ref)),
  g as (select e.ref, e.u, e.v, a.m as ma, a.seed as sa, a.cls as ca, b.m as mb, b.seed as sb, b.cls as cb from e left join d a on a.ref = e.ref and a.u = e.u and a.k = 1 left join d b on b.ref = e.ref and b.u = e.v and b.k = 1)
select ref, u, v, case when ma <= mb then ca else cb end as cls, case when ma is null then 'osm_fallback' when least(ma, mb) <= 25 then 'count_point' else 'propagated' end as basis, case when ma <= mb then sa else sb end as point, cast(least(ma, mb) as double) as along_m from g
""")
def road_class_segments(t):
    """A road a nation, its suppliers in a row; every fifth is a count point."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    lon = (F.col("s_suppkey") % 3600) * 0.05 - 90
    s = t.supplier.select(F.col("s_nationkey").alias("ref"), F.col("s_suppkey").alias("u"), F.row_number().over(w).alias("i"), F.lead("s_suppkey").over(w).alias("v"), lon.alias("lon_u"), (F.floor(F.col("s_suppkey") / 3600) * 0.05).alias("lat_u"), "s_acctbal")
    there = s.select(F.col("u").alias("v"), F.col("lon_u").alias("lon_v"), F.col("lat_u").alias("lat_v"))
    seg = s.filter("v is not null").join(there, "v").withColumn("length_m", 10.0 + F.col("i") % 7 * 10)
    cls = F.when(F.col("s_acctbal") > 4000, "srn").otherwise("local_a")
    points = s.filter("i % 5 = 2").select(F.col("u").alias("point"), "ref", cls.alias("cls"), F.col("lon_u").alias("lon"), F.col("lat_u").alias("lat"), F.lit(0.05).alias("link_km"))
    return roads.classified(seg, points, 5.0).select("ref", "u", "v", "cls", "basis", "point", "along_m")


_CELLS = """cell as (select l_orderkey as id, l_linenumber as line, l_returnflag as road_class, l_linestatus as area, l_suppkey % 4 as fold, l_quantity + 5 as bus, l_quantity / 2 + l_linenumber * 3 + 4 as speed from lineitem)"""


@query("bus_hold_out", f"""
with {_CELLS}, f as (select distinct fold from cell), k as (select f.fold, road_class, area, quantile_cont(bus / {D('speed')}, 0.5) as kappa from f join cell c on c.fold <> f.fold group by all),
  a as (select f.fold, quantile_cont(bus / {D('speed')}, 0.5) as kappa from f join cell c on c.fold <> f.fold group by all)
select id, line, round(speed * coalesce(k.kappa, a.kappa), 6) as pred, round(speed * coalesce(k.kappa, a.kappa) / bus - 1, 6) + 0 as error from cell c left join k on k.fold = c.fold and k.road_class = c.road_class and k.area = c.area join a on a.fold = c.fold
""")
def bus_hold_out(t):
    c = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("road_class"), F.col("l_linestatus").alias("area"), (F.col("l_suppkey") % 4).alias("fold"), (F.col("l_quantity") + 5).alias("bus"), (F.col("l_quantity") / 2 + F.col("l_linenumber") * 3 + 4).alias("speed"))
    return tidy(congestion.bus_hold_out(c, ["road_class", "area"], "fold", "bus", "speed").select("id", "line", "pred", "error"))


@query("balanced_halves", f"""
with l as (select id as link_id, case when name % 3 = 0 then 'centre' when name % 3 = 1 then 'urban' else 'rural' end as area, cast(floor(lon * {D(69.4)} / 2) as bigint) as b1, cast(floor(lat * {D(111.3)} / 2) as bigint) as b2 from zones),
  b as (select area, b1, b2, count(*) as n from l group by all)
select area, count(*) as links, (select count(*) from b where b.area = l.area) as blocks, true as balanced from l group by area
""", "zones")
def balanced_halves(t):
    """Links dealt in halves by blocks of ground: links and blocks by area, and whether the halves differ by no more than a block."""
    area = F.when(F.col("name") % 3 == 0, "centre").when(F.col("name") % 3 == 1, "urban").otherwise("rural")
    links = t.zones.select(F.col("id").alias("link_id"), area.alias("area"), "lon", "lat")
    halves = congestion.balanced_halves(links, 2.0, 7).join(links, "link_id")
    at = lambda c, per: F.floor(F.col(c) * per / 2.0).alias(f"b{c}")
    blocks = halves.groupBy("area", "half", at("lon", 69.4), at("lat", 111.3)).agg(F.count("*").alias("n"))
    more = F.abs(F.sum(F.when(F.col("half") == "calibration", F.col("n")).otherwise(-F.col("n"))))
    return blocks.groupBy("area").agg(F.sum("n").alias("links"), F.countDistinct("blon", "blat").alias("blocks"), (more <= F.max("n")).alias("balanced"))


@query("sensor_sites", """
with s as (select event_id as site, 'M' || (user_id % 9 + 1) || '/' || event_id as name, user_id % 9 + 1 as road, event_id % 5 as k, ['Northbound', 'Eastbound', 'Southbound', 'Westbound', 'Clockwise'][event_id % 5 + 1] as direction, event_type from events)
select site, name, 'M' || road || case when k = 3 then '(M)' else '' end as road, case when event_type = 'view' then 'midas' else 'tmu' end as kind, direction, (k * 90)::int as bearing from s where direction <> 'Clockwise' and event_type in ('view', 'click') and (event_type <> 'view' or k <> 3)
union all select site, name, 'M' || road, 'midas', direction, (k * 90)::int from s where event_type = 'view' and k = 3
""")
def sensor_sites(t):
    from tramline.operators import scope

    k, road = F.col("event_id") % 5, F.concat(F.lit("M"), (F.col("user_id") % 9 + 1).cast("string"))
    direction = F.get(F.array(*map(F.lit, ("Northbound", "Eastbound", "Southbound", "Westbound", "Clockwise"))), k.cast("int"))
    name = F.concat(road, F.lit("/"), F.col("event_id").cast("string"))
    on = F.concat(F.lit("TMU Site on "), road, F.when(k == 3, "(M)").otherwise(""))
    text = F.when(F.col("event_type") == "view", F.concat(F.lit("MIDAS site at "), name)).when(F.col("event_type") == "click", F.concat(on, F.lit(" between J2 and J3"))).otherwise(F.concat(on, F.lit(" J2 exit")))
    s = t.events.select(F.col("event_id").alias("site"), name.alias("name"), F.concat_ws("; ", text, direction).alias("description"), F.lit("Active").alias("status"), F.lit(-2.5).alias("lon"), F.lit(51.5).alias("lat"))
    return scope.sensor_sites(s, (-3.0, 51.0, -2.0, 52.0)).select("site", "name", "road", "kind", "direction", "bearing")


@query("signal_delays", f"""
with d as (select n_regionkey as period, ['centre', 'urban', 'rural'][n_nationkey % 3 + 1] as area, max(n_nationkey)::double as s from nation where n_regionkey < 3 group by all), p as (select unnest([0, 1, 2, 3]) as period),
  g as (select p_partkey as id, period, case p_size % 4 when 0 then 'centre' when 1 then 'urban' else 'rural' end as area, p_partkey % 6 = 0 as sig from part cross join p)
select id, g.period::varchar as period, case when sig then coalesce((select s from d where d.period = case when g.period = 3 then 1 else g.period end and d.area = g.area), (select s from d where d.period = case when g.period = 3 then 1 else g.period end and d.area = 'urban'), 0) else {D(0)} end as delay_s from g
""")
def signal_delays(t):
    from tramline.operators import scope

    three = F.array(F.lit("centre"), F.lit("urban"), F.lit("rural"))
    delays = t.nation.filter("n_regionkey < 3").groupBy(F.col("n_regionkey").cast("string").alias("period"), F.get(three, F.col("n_nationkey") % 3).alias("area")).agg(F.max("n_nationkey").cast("double").alias("delay_s"))
    kind = F.when(F.col("p_size") % 4 == 0, "centre").when(F.col("p_size") % 4 == 1, "urban").when(F.col("p_size") % 4 == 2, "buffer").otherwise("rural")
    seg = t.part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("v"), kind.alias("area_type"))
    return scope.signal_delays(seg, seg.filter("id % 6 = 0").select(F.col("v").alias("node")), delays, ["0", "1", "2", "3"], "1").select("id", "period", "delay_s")


_BOXES = "bx as (select id, name, lon - (2 + id % 5) * cast(0.001 as double) as x0, lon + (3 + id % 3) * cast(0.001 as double) as x1, lat - (1 + id % 4) * cast(0.001 as double) as y0, lat + (2 + id % 7) * cast(0.001 as double) as y1 from zones)"


def _boxes(t):
    k, m = F.col("id"), F.lit(0.001)
    x0, x1, y0, y1 = F.col("lon") - (2 + k % 5) * m, F.col("lon") + (3 + k % 3) * m, F.col("lat") - (1 + k % 4) * m, F.col("lat") + (2 + k % 7) * m
    at = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return t.zones.withColumn("ring", F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1)))


@query("central_zones", f"""
with recursive {_BOXES}, d as (select bx.* from bx join supplier on s_suppkey = id where name % 4 <> 1 and s_acctbal >= 1500), i as (select id, round(x0 * 10000000) as x0, round(x1 * 10000000) as x1, round(y0 * 10000000) as y0, round(y1 * 10000000) as y1 from d),
  e as (select a.id as a, b.id as b from i a join i b on a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1), r as (select a as id, a as low from e union select r.id, e.b from r join e on e.a = r.low), c as (select id, min(low) as cluster from r group by id)
select id as zone, cluster from c where cluster in (select cluster from c group by 1 having count(*) >= 3)
""", "zones")
def central_zones(t):
    from tramline.operators import scope

    z = _boxes(t).join(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("jobs")), "id")
    return scope.central_zones(z.select(F.col("id").alias("zone"), "ring", "jobs", F.lit(1.5).alias("km2"), (F.col("name") % 4 != 1).alias("urban")), 1000.0, 3)


@query("built_up_scope", f"""
with recursive {_BOXES}, i as (select id, round(x0 * 10000000) as x0, round(x1 * 10000000) as x1, round(y0 * 10000000) as y0, round(y1 * 10000000) as y1 from bx),
  e as (select a.id as a, b.id as b from i a join i b on a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1), r as (select a as id, a as low from e union select r.id, e.b from r join e on e.a = r.low), c as (select id, min(low) as low from r group by id),
  m as (select bx.* from bx join c using (id) where low = (select low from c where id = 0)), z as (select c_custkey as zone, ['core', 'ring', 'far'][c_nationkey % 3 + 1] as district, ['centre', 'urban', 'rural'][c_custkey % 3 + 1] as area_type, {D(-2.61)} + c_custkey % 97 * {D(0.00113)} as lon, {D(51.39)} + c_custkey % 89 * {D(0.00107)} as lat from customer)
select zone, district, area_type, area_type <> 'rural' and (district = 'core' or exists (select 1 from m where z.lon > x0 and z.lon < x1 and z.lat > y0 and z.lat < y1)) as in_scope from z where district <> 'far'
""", "zones")
def built_up_scope(t):
    from tramline.operators import scope

    three = lambda c, *names: F.get(F.array(*map(F.lit, names)), (F.col(c) % 3).cast("int"))
    k = F.col("c_custkey")
    z = t.customer.select(k.alias("zone"), three("c_nationkey", "core", "ring", "far").alias("district"), three("c_custkey", "centre", "urban", "rural").alias("area_type"), (F.lit(-2.61) + k % 97 * F.lit(0.00113)).alias("lon"), (F.lit(51.39) + k % 89 * F.lit(0.00107)).alias("lat"))
    return scope.built_up_scope(_boxes(t).select("id", "ring"), z, 0, "core", ["ring"])
