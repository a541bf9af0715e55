"""Queries on feeds, rail, works, calibration and the functions that the other plans use inside others."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import clock, curves, geo
from tramline.operators import calibration, costs, demand, rail, scenario, skims, spatial
from tramline.operators import timetable as tt
from tramline.plans.registry import query
from tramline.plans.tidy import tidy
from tramline.sources import feeds, registry

D = "cast({} as double)".format
_TYPES = [0, 5, 950, 1, 420, 2, 150, 4, 1010, 1200, 250, 3, 11, 702]
_CLASS = ["tram", "tram", "tram", "metro", "metro", "rail", "rail", "ferry", "ferry", "ferry", "coach", "bus", "bus", "bus"]


@query("mode_class", f"select p_partkey as route, case when p_partkey % 37 = 0 then 'brt' else {_CLASS}[p_partkey % 14 + 1] end as mode from part")
def mode_class(t):
    k = F.col("p_partkey")
    kind = F.get(F.array(*map(F.lit, _TYPES)), (k % 14).cast("int")).cast("string")
    return t.part.select(k.alias("route"), tt.mode_class(kind, k % 37 == 0).alias("mode"))


@query("exclude_variants", "select o_orderkey as trip, o_custkey as pattern from orders where o_custkey not in (select o_custkey from orders where o_orderkey % 97 = 0)")
def exclude_variants(t):
    trips = t.orders.select(F.col("o_orderkey").alias("trip"), F.col("o_custkey").alias("pattern"))
    return tt.exclude_variants(trips, trips.filter("trip % 97 = 0"), "trip", "pattern")


@query("split_restricted", """
with p as (select l_orderkey as trip, l_linenumber as seq, l_returnflag <> 'A' as may_on, l_returnflag <> 'R' as may_off, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as i, count(*) over (partition by l_orderkey) as n from lineitem),
  k as (select *, case when i = 1 then (case when may_on then 'free' end) when i = n then (case when may_off then 'free' end) when may_on and may_off then 'free' when may_on then 'opens' when may_off then 'closes' end as kind from p),
  o as (select distinct trip, 0 as o from k union all select trip, i from k where kind = 'opens'), e as (select distinct trip, n + 1 as e from k union all select trip, i from k where kind = 'closes'),
  c as (select o.trip, o, e from o join e on e.trip = o.trip and o.o < e.e), b as (select c.trip, count(*) as both from c join (select distinct trip, n from k) z on z.trip = c.trip where o > 0 and e <= n group by all),
  m as (select c.trip, c.o, c.e, count(*) as calls from c join k on k.trip = c.trip and ((kind = 'free' and i > o and i < e) or i = o or i = e) left join b on b.trip = c.trip where coalesce(b.both, 0) <= 30 or c.o = 0 or c.e > k.n group by all)
select trip, count(*) as copies, cast(sum(calls) as bigint) as calls from m where calls > 1 group by trip
""".replace(" both ", " pairs ").replace("b.both", "b.pairs"))
def split_restricted(t):
    from pyspark.sql.window import Window

    flag, w = F.col("l_returnflag"), Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    calls = t.lineitem.select(F.col("l_orderkey").cast("string").alias("trip_id"), F.row_number().over(w).cast("string").alias("stop_sequence"), F.when(flag == "A", "1").alias("pickup_type"), F.when(flag == "R", "1").otherwise("0").alias("drop_off_type"))
    got = feeds.legal_copies(calls).filter(F.size("copies") > 0)
    return tidy(got.select(F.col("trip_id").cast("long").alias("trip"), F.size("copies").alias("copies"), F.aggregate("copies", F.lit(0), lambda a, c: a + F.size(c)).alias("calls")))


@query("snapshot_stale", """
with r as (select event_id, user_id as vehicle, epoch(time_bucket(interval 1 hour, ts)) + 3600 as sent, epoch(ts) - (event_id % 5) * 1200 as seen from events), s as (select sent, coalesce(lag(sent) over (order by sent), sent - 600) as cut from (select distinct sent from r))
select event_id, seen < cut as stale from r join s using (sent)
""")
def snapshot_stale(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    sent = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 3600) * 3600 + 3600)
    rows = e.select("event_id", sent.alias("sent"), (F.col("ts") - F.make_interval(secs=(F.col("event_id") % 5) * 1200)).alias("seen"))
    return tt.flagged_stale(rows, tt.previous_snapshots(rows, "sent", 600.0), "sent", "seen").select("event_id", "stale")


_POINTS = "pt as (select trip, day, seq, stop as tpl, case when trip % 9 = 0 then 'road_bus' when trip % 9 = 1 then 'cancelled' end as exclusion, stop in ('click', 'view') and value < 60 as inside from calls)"


@query("sections_from_points", f"""
with {_POINTS}, t as (select * from pt where coalesce(exclusion, '') not like 'road%' and coalesce(exclusion, '') not like 'water%'), w as (select *, lead(tpl) over (partition by trip, day order by seq) as nxt, min(case when inside then seq end) over (partition by trip, day) - 1 as lo, max(case when inside then seq end) over (partition by trip, day) + 1 as hi from t)
select tpl as "from", nxt as "to", count(*) as trains from w where seq >= lo and seq < hi and nxt <> tpl group by all
""", "calls")
def sections_from_points(t):
    c = t.calls
    rid = F.concat_ws(":", F.col("trip").cast("string"), F.col("day").cast("string"))
    why = F.when(F.col("trip") % 9 == 0, "road_bus").when(F.col("trip") % 9 == 1, "cancelled")
    return rail.sections_from_points(c.select(rid.alias("rid"), "seq", F.col("stop").alias("tpl"), why.alias("exclusion"), (F.col("stop").isin("click", "view") & (F.col("value") < 60)).alias("inside")))


@query("presence", """
with a as (select n_nationkey as place from nation where n_nationkey % 3 <> 0), s as (select distinct s_nationkey as place from supplier where s_suppkey % 2 = 0 or s_nationkey < 9), n as (select n_nationkey as place from nation where n_nationkey % 7 = 1)
select place, 'unserved_expected' as finding from a where place not in (select place from s) and place not in (select place from n) union all select place, 'served_but_not_open' from n where place in (select place from s) union all select place, 'served_not_active' from s where place not in (select place from a)
""")
def presence(t):
    n = t.nation.select(F.col("n_nationkey").alias("place"))
    s = t.supplier.filter("s_suppkey % 2 = 0 or s_nationkey < 9").select(F.col("s_nationkey").alias("place"))
    return rail.presence(n.filter("place % 3 <> 0"), s, n.filter("place % 7 = 1"))


@query("cancellations", """
with c as (select l_orderkey as rid, o_orderstatus = 'P' as whole, l_returnflag = 'R' as cancelled, l_linenumber < 6 as pub, l_suppkey % 3 = 0 as inside from lineitem join orders on l_orderkey = o_orderkey), k as (select * from c where pub and inside)
select count(distinct rid) filter (where whole) as journeys_cancelled, count(*) filter (where whole) as calls_on_cancelled_journeys, count(*) filter (where not whole and cancelled) as calls_cancelled_on_running_journeys, count(*) filter (where whole or cancelled) as calls_cancelled from k
""")
def cancellations(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rail.cancellations(j.select(F.col("l_orderkey").alias("rid"), (F.col("o_orderstatus") == "P").alias("whole"), (F.col("l_returnflag") == "R").alias("cancelled"), (F.col("l_linenumber") < 6).alias("public"), (F.col("l_suppkey") % 3 == 0).alias("inside")))


@query("leg_rule", f"""
with l as (select p_partkey as leg, p_size % 2 = 0 as existing, p_partkey % 9 as trains, case when p_partkey % 4 > 0 then {D('p_size')} * 3 end as med, case when p_partkey % 10 > 0 then {D('p_size')} * 2 end as prof, p_partkey % 3 as j from part)
select leg, round(case when existing and trains >= 5 and med is not null then med else prof * {D(1.15)} + j * 20 end, 6) as run_s, case when existing and trains >= 5 and med is not null then 'working times' when prof is not null then 'speed profile' end as rule from l
""")
def leg_rule(t):
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    run, rule = rail.leg_times(F.col("p_size") % 2 == 0, k % 9, F.when(k % 4 > 0, size * 3), F.when(k % 10 > 0, size * 2), k % 3, 0.15, 20.0)
    return tidy(t.part.select(k.alias("leg"), run.alias("run_s"), rule.alias("rule")))


_TRACK = "sec as (select distinct p_partkey % 40 as a, p_partkey % 40 + 1 as b, 1 + (p_partkey % 40) % 2 as tracks from part), w as (select number, a, b, tracks from (values (1, 4, 5, 2), (2, 8, 9, 3), (3, 21, 20, 2), (4, 4, 5, 4)) v(number, a, b, tracks))"
_WORKS = [(1, 4, 5, 2), (2, 8, 9, 3), (3, 21, 20, 2), (4, 4, 5, 4)]


def _tracks(t):
    k = F.col("p_partkey") % 40
    sections = t.part.select(k.alias("from"), (k + 1).alias("to"), (1 + k % 2).cast("int").alias("tracks")).distinct()
    return rail.works_on_track(sections, t.spark.createDataFrame(_WORKS, "number int, from long, to long, tracks int"))


@query("works_on_track", f"with {_TRACK} select a as \"from\", b as \"to\", greatest(tracks, coalesce((select max(tracks) from w where (w.a = sec.a and w.b = sec.b) or (w.a = sec.b and w.b = sec.a)), 0)) as tracks from sec")
def works_on_track(t):
    return tidy(_tracks(t))


@query("single_track_blocks", f"""
with {_TRACK}, x as (select a, b, greatest(tracks, coalesce((select max(tracks) from w where (w.a = sec.a and w.b = sec.b) or (w.a = sec.b and w.b = sec.a)), 0)) as tracks from sec), d as (select distinct p_partkey % 40 as a from part where p_partkey % 40 % 2 = 0 or p_partkey % 40 % 5 = 1),
  p as (select a // 10 as block, a as seq, a as point from d), s as (select block, seq, point as f, lead(point) over (partition by block order by seq) as g from p), j as (select s.*, coalesce(x.tracks, 1) < 2 as single from s left join x on x.a = f and x.b = g where g is not null),
  c as (select *, case when single and (not coalesce(lag(single) over (partition by block order by seq), false) or f in (6, 26)) then 1 else 0 end as new from j), r as (select *, sum(new) over (partition by block order by seq) as part from c)
select block, cast(part as bigint) as part, string_agg(cast(f as varchar), ',' order by seq) || ',' || max_by(cast(g as varchar), seq) as points from r where single group by block, part
""")
def single_track_blocks(t):
    k = F.col("p_partkey") % 40
    points = t.part.select(k.alias("point")).distinct().filter("point % 2 = 0 or point % 5 = 1").select(F.floor(F.col("point") / 10).alias("block"), F.col("point").alias("seq"), "point")
    loops = t.spark.createDataFrame([(6,), (26,)], "point long")
    return tidy(rail.single_track_blocks(points, _tracks(t), loops).withColumn("points", F.array_join(F.transform("points", lambda x: x.cast("string")), ",")))


_LEGS = "lg as (select s_nationkey as line, s_suppkey as f, s_suppkey + 1 as g, {0} as street, case when s_suppkey % 3 = 0 then {1} else 0 end as tunnel from supplier)".format(D("100 + s_suppkey % 50"), D("s_suppkey % 200"))


def _legs(t):
    k = F.col("s_suppkey")
    types = F.create_map(F.lit("at_grade_street"), (100 + k % 50).cast("double"), F.lit("tunnel"), F.when(k % 3 == 0, (k % 200).cast("double")).otherwise(0.0))
    return t.supplier.select(F.col("s_nationkey").alias("line"), k.alias("from"), (k + 1).alias("to"), types.alias("types_m")), t.supplier.select(F.col("s_nationkey").alias("line"), k.alias("stop"), (k % 4 == 0).alias("existing"))


@query("service_km", f"with {_LEGS} select line::bigint as line, 'at_grade_street' as type, round(sum(street) / 1000, 6) as km from lg group by line union all select line, 'tunnel', round(sum(tunnel) / 1000, 6) from lg group by line")
def service_km(t):
    return tidy(rail.service_quantities(*_legs(t))[0])


@query("new_stops", f"with {_LEGS}, d as (select distinct line, unnest([f, g]) as stop from lg where tunnel > {D(0.5)} * (street + tunnel)) select s_nationkey::bigint as line, s_suppkey as stop, d.stop is not null as underground from supplier left join d on d.line = s_nationkey and d.stop = s_suppkey where s_suppkey % 4 <> 0")
def new_stops(t):
    return tidy(rail.service_quantities(*_legs(t))[1])


_HOL = "(month({0}) = 8 or (month({0}) = 12 and day({0}) >= 18) or (month({0}) = 1 and day({0}) <= 4) or (month({0}) = 7 and day({0}) >= 22) or (month({0}) = 9 and day({0}) <= 3))"


@query("day_types", f"""
with d as (select distinct cast(o_orderdate as date) as day from orders)
select cast(day as varchar) as day, case when isodow(day) >= 6 then 'weekend' when isodow(day) in (2, 3, 4) and month(day) <> 8 and day not in (date '1996-05-01', date '1997-05-06') and ((day between date '1996-01-08' and date '1996-07-19') or (day between date '1997-04-01' and date '1998-08-20')) then 'neutral' else 'weekday_other' end as day_type, {_HOL.format('day')} as holiday from d
""")
def day_types(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("day")).distinct()
    terms = t.spark.sql("select date '1996-01-08' as first, date '1996-07-19' as last union all select date '1997-04-01', date '1998-08-20'")
    bank = t.spark.sql("select date '1996-05-01' as day union all select date '1997-05-06'")
    out = calibration.day_types(days, terms, bank).withColumn("holiday", calibration.in_holidays(F.col("day")))
    return out.withColumn("day", F.col("day").cast("string"))


_PLATE = """
with x as (select user_id % 25 as link_id, ts - interval 1 hour as t, event_id % 6 as matches, value + 1 as journey_s from events), k as (select *, hour(t) as h, isodow(t) as w from x where not {0} and matches > 0),
  o as (select *, case when w >= 6 then 'WE' when w in (2, 3, 4) then (case when h >= 7 and h < 10 then 'AM' when h >= 10 and h < 16 then 'IP' when h >= 16 and h < 19 then 'PM' else 'OP' end) end as own from k),
  p as (select *, own as period from o where own is not null union all select *, 'AMPH' from o where own = 'AM' and h = 8 union all select *, 'PMPH' from o where own = 'PM' and h = 17)
select link_id, period, round(sum(journey_s * matches) / sum(matches), 6) as obs_s, count(*) as hours from p group by all
""".format(_HOL.format("t"))


@query("plate_observations", _PLATE)
def plate_observations(t):
    rows = t.events.select((F.col("user_id") % 25).alias("link_id"), "ts", (F.col("event_id") % 6).alias("matches"), (F.col("value") + 1).alias("journey_s"))
    return tidy(calibration.plate_observations(rows))


_LINKS = """pa as (select distinct l_suppkey as link_id, l_partkey as u, l_partkey + 1 as v from lineitem), sp as (select p_partkey as u, p_partkey + 1 as v, {0} as speed_kmh, {1} as length_m from part where p_partkey % 37 <> 5),
  sg as (select p_partkey as u, p_partkey + 1 as v, case when p_size % 5 = 0 then null else ['centre', 'urban', 'rural'][p_size % 3 + 1] end as area, p_size % 7 = 0 as srn, p_partkey % 6 = 0 as signal from part),
  ls as (select pa.*, speed_kmh, length_m, area, coalesce(srn, false) as srn, coalesce(signal, false) as signal, length_m / (speed_kmh / {2}) as t from pa left join sp using (u, v) left join sg using (u, v))""".format(D("p_size + 10"), D("p_retailprice"), D(3.6))


def _links(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    paths = t.lineitem.select(F.col("l_suppkey").alias("link_id"), F.col("l_partkey").alias("u"), (F.col("l_partkey") + 1).alias("v")).distinct()
    speeds = t.part.filter("p_partkey % 37 <> 5").select(k.alias("u"), (k + 1).alias("v"), (size + 10).cast("double").alias("speed_kmh"), F.col("p_retailprice").alias("length_m"))
    area = F.when(size % 5 != 0, F.get(F.array(F.lit("centre"), F.lit("urban"), F.lit("rural")), size % 3))
    return paths, speeds, t.part.select(k.alias("u"), (k + 1).alias("v"), area.alias("area"), (size % 7 == 0).alias("srn"), (k % 6 == 0).alias("signal"))


@query("link_times", f"with {_LINKS} select link_id, round(coalesce(sum(t), 0) + sum(case when signal then case area when 'centre' then 20 when 'urban' then 12 when 'rural' then 12 else 12 end else 0 end), 6) as model_s from ls group by link_id having avg(case when t is null then 1 else 0 end) < {D(0.05)}")
def link_times(t):
    return tidy(calibration.link_times(*_links(t), {"centre": 20.0, "urban": 12.0}))


@query("link_area", f"with {_LINKS}, g as (select link_id, coalesce(area, 'rural') as area, sum(coalesce(length_m, 0)) as m from ls group by all) select link_id, area from (select *, row_number() over (partition by link_id order by m desc, area) as k from g) where k = 1")
def link_area(t):
    paths, speeds, segments = _links(t)
    return calibration.link_area(paths.join(speeds.select("u", "v", "length_m"), ["u", "v"], "left").fillna(0.0, ["length_m"]), segments)


_COMP = f"""{_LINKS}, cm as (select link_id, coalesce(sum(t) filter (where area = 'centre' and not srn), 0) as t_centre, count(*) filter (where area = 'centre' and not srn and signal) as s_centre, coalesce(sum(t) filter (where area = 'urban' and not srn), 0) as t_urban, count(*) filter (where area = 'urban' and not srn and signal) as s_urban,
  coalesce(sum(t) filter (where srn or area is null or area not in ('centre', 'urban')), 0) as t_other from ls group by link_id having avg(case when t is null then 1 else 0 end) < {D(0.05)})"""


@query("link_components", f"with {_COMP} select link_id, round(t_centre, 6) as t_centre, s_centre, round(t_urban, 6) as t_urban, s_urban, round(t_other, 6) as t_other from cm")
def link_components(t):
    return tidy(calibration.link_components(*_links(t), ["centre", "urban"]))


@query("layer_times", f"with {_COMP} select link_id, round(t_other + t_centre / {D(0.8)} + s_centre * 15 + t_urban / {D(0.9)}, 6) as model_s from cm")
def layer_times(t):
    return tidy(calibration.layer_times(calibration.link_components(*_links(t), ["centre", "urban"]), {"centre": 0.8, "urban": 0.9}, {"centre": 15.0}))


@query("road_ladders", f"""
with s as (select p_partkey as id, {D('p_size')} * 4 as m, ['TM', 'TA', 'PM', 'PA', 'MB'][p_partkey % 5 + 1] as cat, case when p_partkey % 9 = 0 then 'b_road' end as known, ['trunk_link', 'primary', 'service', 'motorway', 'residential'][p_partkey % 7 % 5 + 1] as hw, case p_partkey % 3 when 0 then 'A38' when 1 then 'B4' end as ref,
  case when p_partkey % 8 > 0 then 'z' end as zone, p_partkey % 4 = 0 as central, p_partkey % 3 = 0 as urban, case when p_partkey % 6 = 0 then {D(50)} end as lim from part), a as (select *, case when zone is null then 'buffer' when central then 'centre' when urban then 'urban' else 'rural' end as area from s)
select id, case when m <= 100 and cat in ('TM', 'TA') then 'srn' when m <= 100 and cat in ('PM', 'PA') then 'local_a' when known is not null then known when hw in ('motorway', 'trunk_link') then 'srn' when ref like 'A%' then 'local_a' when ref like 'B%' then 'b_road' else 'minor' end as road_class, area,
  coalesce(lim, case when hw = 'service' then 20 when area in ('centre', 'urban') and id % 10 = 0 then 32 when area in ('centre', 'urban') then 48 when hw in ('trunk_link', 'primary', 'motorway') then 96 else 80 end)::double as free from a
""")
def road_ladders(t):
    k = F.col("p_partkey")
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    hw = pick(["trunk_link", "primary", "service", "motorway", "residential"], k % 7 % 5)
    ref = F.when(k % 3 == 0, "A38").when(k % 3 == 1, "B4")
    cls = calibration.road_class(F.col("p_size") * 4.0, pick(["TM", "TA", "PM", "PA", "MB"], k % 5), F.when(k % 9 == 0, "b_road"), hw, ref, 100.0)
    area = calibration.area_type(F.when(k % 8 > 0, "z"), k % 4 == 0, k % 3 == 0)
    return t.part.select(k.alias("id"), cls.alias("road_class"), area.alias("area"), calibration.free_flow_ladder(F.when(k % 6 == 0, 50.0), area, hw, k % 10 == 0, 20, 32, 48, 96, 80).alias("free"))


@query("heading", f"select id, case when (lon + {D(0.001)} - {D(-2.55)}) * (lon + {D(0.001)} - {D(-2.55)}) * {D(0.39)} + (lat - {D(51.42)}) * (lat - {D(51.42)}) < (lon - {D(-2.55)}) * (lon - {D(-2.55)}) * {D(0.39)} + (lat - {D(51.42)}) * (lat - {D(51.42)}) then 'inbound' else 'outbound' end as direction from zones", "zones")
def heading(t):
    lon, lat = F.col("lon"), F.col("lat")
    return t.zones.select("id", calibration.heading(lon, lat, lon + 0.001, lat, F.lit(-2.55), F.lit(51.42)).alias("direction"))


@query("speed_targets", f"select p_partkey as id, round(p_size * {D(1.609344)}, 6) as kmh from part where p_partkey % 5 > 0")
def speed_targets(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_size").cast("string")).otherwise("c").alias("mph"))
    return tidy(calibration.targets(rows).select("id", "kmh"))


@query("profile_shares", "with p as (select (dayofweek(ts) + 6) % 7 as dow, hour, cast(count(*) as double) as i from probe group by all) select dow, hour, round(i / (select sum(i) from p), 9) as share from p", "probe")
def profile_shares(t):
    p = t.probe.groupBy(F.weekday("ts").alias("dow"), "hour").agg(F.count("*").cast("double").alias("index"))
    return tidy(calibration.profile_shares(p).select("dow", "hour", "share"), 9)


@query("clip_share", f"select s_nationkey::bigint as lad, round(sum(s_acctbal) / 1000, 6) as km_total, round(sum(s_acctbal) filter (where lon between {D(-2.58)} and {D(-2.54)} and lat between 51 and 52) / 1000, 6) as km_inside from zones join supplier on s_suppkey = id group by 1", "zones")
def clip_share(t):
    s = t.zones.join(t.supplier, F.col("id") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("lad"), F.col("s_acctbal").alias("length_m"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return tidy(calibration.clip_share(s, ["lad"], (-2.58, 51.0, -2.54, 52.0)))


_HOLD = f"""
with c as (select leg, road_class, period, leg % 4 as fold, kmh as bus_kmh, kmh * {D(1.2)} + hour as car_kmh, 1 / kmh as bus_h, 1 / (kmh * {D(1.2)} + hour) as car_h from probe),
  f as (select fold, road_class, period, (select sum(car_h) from c x where x.road_class = g.road_class and x.period = g.period and x.fold <> g.fold) / (select sum(bus_h) from c x where x.road_class = g.road_class and x.period = g.period and x.fold <> g.fold) as fine, (select count(*) from c x where x.road_class = g.road_class and x.period = g.period and x.fold <> g.fold) as n,
    (select sum(car_h) from c x where x.period = g.period and x.fold <> g.fold) / (select sum(bus_h) from c x where x.period = g.period and x.fold <> g.fold) as coarse from (select distinct fold, road_class, period from c) g)
select leg, n < 190 as fallback, round(case when n >= 190 then fine else coarse end, 6) as ratio, round(abs(car_kmh * case when n >= 190 then fine else coarse end - bus_kmh) / bus_kmh, 6) as err from c join f using (fold, road_class, period)
"""


@query("ratio_hold_out", _HOLD, "probe")
def ratio_hold_out(t):
    car = F.col("kmh") * 1.2 + F.col("hour")
    c = t.probe.select("leg", "road_class", "period", (F.col("leg") % 4).alias("fold"), F.col("kmh").alias("bus_kmh"), car.alias("car_kmh"), (1 / F.col("kmh")).alias("bus_h"), (1 / car).alias("car_h"))
    return tidy(calibration.ratio_hold_out(c, ["road_class", "period"], "fold", "period", 190).select("leg", "fallback", "ratio", "err"))


@query("country_default", "select p_partkey as id, coalesce(case when p_partkey % 3 = 0 then 'E0200' end, case when p_partkey % 5 = 1 then 'S92000003' when p_partkey % 5 = 2 then 'N92000002' end) as zone from part")
def country_default(t):
    k = F.col("p_partkey")
    code = F.get(F.array(*map(F.lit, ["E1", "S2", "N3", "W4", "E5"])), (k % 5).cast("int"))
    return t.part.select(k.alias("id"), demand.country_default(F.when(k % 3 == 0, "E0200"), code).alias("zone"))


@query("fixed_place_flows", "select o_custkey as o, o_orderkey % 500 as d, o_totalprice as n from orders where o_orderkey % 4 = 3 and (o_custkey % 10 = 0 and o_custkey < 300 or o_orderkey % 500 % 10 = 0 and o_orderkey % 500 < 300)")
def fixed_place_flows(t):
    rows = t.orders.select(F.col("o_custkey").alias("o"), (F.col("o_orderkey") % 500).alias("d"), (F.col("o_orderkey") % 4).alias("place"), F.col("o_totalprice").alias("n"))
    return demand.fixed_place_flows(rows, t.spark.range(0, 300, 10).select(F.col("id").alias("code")))


@query("no_fixed_place", f"select c_nationkey::bigint as zone, round(sum(c_acctbal * (1 - {D(0.25)})), 4) as nofixed from customer group by 1")
def no_fixed_place(t):
    return tidy(demand.no_fixed_place(t.customer.select(F.col("c_custkey").alias("code"), F.col("c_acctbal").alias("nofixed_offshore")), t.customer.select(F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("zone")), 0.25), 4)


@query("jobs_by_parent", "select n_regionkey::bigint as parent, count(*) as jobs from supplier join nation on s_nationkey = n_nationkey where n_regionkey <> 3 group by 1")
def jobs_by_parent(t):
    n = t.nation.select(F.col("n_nationkey").alias("zone"), F.col("n_regionkey").alias("parent"))
    return tidy(demand.jobs_by_parent(t.supplier.select(F.col("s_nationkey").alias("zone"), F.lit(1).alias("jobs")), n, n.filter("parent <> 3")))


@query("unlocated_share", "select cast(sum(trips) as bigint) as journeys, round(cast(coalesce(sum(trips) filter (where d = 24), 0) as double) / sum(trips), 6) as share, count(distinct d) filter (where d = 24) as unlocated from flows", "flows")
def unlocated_share(t):
    return tidy(demand.unlocated_share(t.flows.select(F.col("d").alias("station"), F.col("trips").alias("j")), t.spark.range(24).select(F.col("id").alias("station")), 0.2))


@query("demand_correct", f"""
with m as (select o, d, {D('trips')} as trips from flows), a as (select o, sum(trips) as s from m group by 1), u as (select m.o, m.d, trips * (1 + coalesce(case when m.o % 3 = 0 then {D('m.o')} end / a.s, 0)) as trips from m join a using (o)), b as (select d, sum(trips) as s from u group by 1)
select u.o::bigint as o, u.d::bigint as d, round(trips * case when u.d % 4 > 0 then (u.d * 50) * {D(0.8)} / b.s else 1 end, 6) as trips from u join b using (d)
""", "flows")
def demand_correct(t):
    m = t.flows.select(F.col("o").alias("o_zone"), F.col("d").alias("d_zone"), F.col("trips").cast("double").alias("trips"))
    w = t.nation.filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("o_zone"), F.col("n_nationkey").cast("double").alias("workers"))
    j = t.nation.filter("n_nationkey % 4 > 0").select(F.col("n_nationkey").alias("d_zone"), (F.col("n_nationkey") * 50).alias("jobs"))
    return tidy(demand.correct(m, w, j, 0.2).select(F.col("o_zone").alias("o"), F.col("d_zone").alias("d"), "trips"))


@query("masked_skim", f"select from_id, to_id, case when unreachable then null else ride end as gc_min, case when not unreachable and n % 10 / {D(10)} >= {D(0.5)} then wait end as gc_ride_min from skim_a", "skim_a")
def masked_skim(t):
    s = t.skim_a.withColumns({"gc_min": F.col("ride"), "gc_ride_min": F.col("wait"), "ride_share": F.col("n") % 10 / F.lit(10.0)})
    return skims.masked(s).select("from_id", "to_id", "gc_min", "gc_ride_min")


@query("metric_changes", "with a as (select l_returnflag as m, avg(l_discount) as v from lineitem group by 1), b as (select l_returnflag as m, avg(l_tax) as v from lineitem where l_returnflag <> 'N' group by 1) select m as metric, round(b.v - a.v, 4) as change from a join b using (m)")
def metric_changes(t):
    g = lambda df, c: df.groupBy(F.col("l_returnflag").alias("metric")).agg(F.avg(c).alias("value"))
    return skims.metric_changes(g(t.lineitem, "l_discount"), g(t.lineitem.filter("l_returnflag <> 'N'"), "l_tax"))


@query("top_overlap", f"with a as (select p_partkey from part order by p_retailprice desc, p_partkey limit 40), b as (select p_partkey from part order by p_size desc, p_partkey limit 40) select count(*) as shared, round(count(*) / {D(40)}, 6) as share from (select * from a intersect select * from b)")
def top_overlap(t):
    return tidy(skims.top_overlap(t.part, "p_partkey", "p_retailprice", "p_size", 40))


_PAIRS = f"pr as (select distinct p_partkey % 50 as a, p_partkey % 50 + 1 + p_partkey % 4 as b from part), wk as (select distinct p_partkey % 50 as f, p_partkey % 50 + 1 + p_partkey % 4 as g, {D('(p_partkey % 50) % 9')} as m from part where p_partkey % 50 % 7 <> 3 union select distinct p_partkey % 50 + 1 + p_partkey % 4, p_partkey % 50, {D('(p_partkey % 50) % 13')} from part where p_partkey % 50 % 5 <> 2)"


@query("walkable_pairs", f"with {_PAIRS} select pr.a, pr.b, case when x.m is null then y.m when y.m is null then x.m else greatest(x.m, y.m) end as walk_min from pr left join wk x on x.f = pr.a and x.g = pr.b left join wk y on y.f = pr.b and y.g = pr.a where coalesce(greatest(coalesce(x.m, y.m), coalesce(y.m, x.m)), 99) > 6")
def walkable_pairs(t):
    k = F.col("p_partkey")
    a, b = k % 50, k % 50 + 1 + k % 4
    pairs = t.part.select(a.alias("a"), b.alias("b")).distinct()
    there = t.part.filter("p_partkey % 50 % 7 <> 3").select(a.alias("from"), b.alias("to"), (k % 50 % 9).cast("double").alias("minutes"))
    back = t.part.filter("p_partkey % 50 % 5 <> 2").select(b.alias("from"), a.alias("to"), (k % 50 % 13).cast("double").alias("minutes"))
    return spatial.walkable(pairs, there.union(back), 6.0)[1]


@query("touching_components", """
with recursive b as (select id, lon - (2 + id % 5) * cast(0.001 as double) as x0, lon + (3 + id % 3) * cast(0.001 as double) as x1, lat - (1 + id % 4) * cast(0.001 as double) as y0, lat + (2 + id % 7) * cast(0.001 as double) as y1 from zones),
  i as (select id, round(x0 * 10000000) as x0, round(x1 * 10000000) as x1, round(y0 * 10000000) as y0, round(y1 * 10000000) as y1 from b), e as (select a.id as a, b.id as b from i a join i b on a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1), r as (select a as id, a as low from e union select r.id, e.b from r join e on e.a = r.low)
select id, min(low) as component from r group by id
""", "zones")
def touching_components(t):
    k, m = F.col("id"), F.lit(0.001)
    x0, x1, y0, y1 = F.col("lon") - (2 + k % 5) * m, F.col("lon") + (3 + k % 3) * m, F.col("lat") - (1 + k % 4) * m, F.col("lat") + (2 + k % 7) * m
    at = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return spatial.touching_components(t.zones.select("id", F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1)).alias("ring")))


@query("clock_12h", f"select l_orderkey as id, l_linenumber::bigint as line, l_suppkey as k, ceil(({D('l_quantity')} * 25 - l_suppkey % 720) / 720) * 720 + l_suppkey % 720 as at from lineitem")
def clock_12h(t):
    return tidy(t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("k"), tt.at_or_after(F.col("l_quantity") * 25, (F.col("l_suppkey") % 720).cast("double")).cast("double").alias("at")))


@query("clock_text", "select p_partkey as id, printf('%02d:%02d:%02d', p_size // 2 + 3, p_partkey % 60, p_size) as shown, round((p_size // 2 + 3) * 60 + p_partkey % 60 + p_size / cast(60 as double), 6) as minutes from part")
def clock_text(t):
    h, m, s = F.floor(F.col("p_size") / 2).cast("int") + 3, (F.col("p_partkey") % 60).cast("int"), F.col("p_size")
    text = F.format_string("%02d:%02d:%02d", h, m, s)
    back = clock.minutes(text)
    return tidy(t.part.select(F.col("p_partkey").alias("id"), clock.hhmmss(back).alias("shown"), back.alias("minutes")))


@query("boxes", f"select id, lon between {D(-2.57)} and {D(-2.53)} and lat between {D(51.4)} and {D(51.45)} as inside, round(least((lon + {D(2.7)}) * {D(69.4)}, ({D(-2.4)} - lon) * {D(69.4)}, (lat - {D(51.3)}) * {D(111.3)}, ({D(51.6)} - lat) * {D(111.3)}), 6) as edge_km, round(abs(mod(mod({D('id * 37 - 90')} + 180, 360) + 360, 360) - 180), 6) as turn from zones", "zones")
def boxes(t):
    lon, lat = F.col("lon"), F.col("lat")
    return tidy(t.zones.select("id", geo.in_box(lon, lat, (-2.57, 51.4, -2.53, 51.45)).alias("inside"), geo.edge_km(lon, lat, (-2.7, 51.3, -2.4, 51.6)).alias("edge_km"), geo.angle_between((F.col("id") * 37).cast("double"), F.lit(90.0)).alias("turn")))


@query("run_seconds", f"select p_partkey as id, round(case when p_retailprice >= (({D('p_size')} + 5) / {D(3.6)}) * (({D('p_size')} + 5) / {D(3.6)}) then p_retailprice / (({D('p_size')} + 5) / {D(3.6)}) + ({D('p_size')} + 5) / {D(3.6)} else 2 * sqrt(p_retailprice) end, 6) as s from part")
def run_seconds(t):
    return tidy(t.part.select(F.col("p_partkey").alias("id"), curves.run_seconds(F.col("p_retailprice"), (F.col("p_size") + 5.0) / 3.6, F.lit(1.0)).alias("s")))


@query("road_speeds", f"select p_partkey as id, round(case p_partkey % 3 when 0 then p_size * {D(1.609344)} when 1 then p_size else null end, 6) as kmh from part")
def road_speeds(t):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.col("p_size").cast("string"), F.lit(" mph"))).when(k == 1, F.col("p_size").cast("string"))
    return tidy(t.part.select(F.col("p_partkey").alias("id"), curves.road_speed_kmh(text).alias("kmh")))


@query("journeys", "select trip as journey, stop as route, min(minute) as start, count(*) as n from calls group by all", "calls")
def journeys(t):
    c = t.calls.select(F.col("stop").alias("route"), F.col("trip").cast("string").alias("journey"), F.concat_ws(":", "trip", "event_id").alias("trip"), F.col("minute").alias("dep"), "stop")
    return scenario.journeys(c).select(F.col("journey").cast("long").alias("journey"), "route", "start", F.size("trips").cast("long").alias("n"))


@query("remove_journeys", "select trip, cast(day as varchar) as day, seq, stop from calls where trip % 7 <> 2", "calls")
def remove_journeys(t):
    return tidy(scenario.remove_journeys(t.calls.select("trip", F.col("day").cast("string").alias("day"), "seq", "stop"), t.calls.filter("trip % 7 = 2").select("trip")))


@query("old_phase", f"""
with s as (select distinct trip, stop, minute as start from calls), g as (select *, start - lag(start) over (partition by trip, stop order by start) as gap from s), f as (select trip, stop, min(start) as first, quantile_cont(gap, {D(0.5)}) as old from g group by all)
select trip, stop, round(first, 6) as first, round(old, 6) as old, coalesce(abs(old / 15 - round(old / 15)) < {D(1e-6)} and round(old / 15) >= 1, false) as keeps from f
""", "calls")
def old_phase(t):
    return tidy(scenario.old_phase(t.calls.select("trip", "stop", F.col("minute").alias("start")), ["trip", "stop"], F.lit(15.0)))


@query("scenario_use", "with l as (select s_nationkey as line, s_suppkey as f, s_suppkey + 1 as g, s_suppkey * 7 % 200 as off from supplier), h as (select s_nationkey as line, s_suppkey % 24 as hour, count(*) as trips from supplier group by all) select f as \"from\", g as \"to\", (hour + off // 60) % 24 as hour, cast(sum(trips) as bigint) as trains from l join h using (line) group by all")
def scenario_use(t):
    k, line = F.col("s_suppkey"), F.col("s_nationkey").alias("line")
    trips = t.supplier.groupBy(line, (k % 24).alias("hour")).agg(F.count("*").alias("trips"))
    return tidy(costs.scenario_use(t.supplier.select(line, k.alias("from"), (k + 1).alias("to"), (k * 7 % 200).alias("offset_min")), trips))


@query("latest_per_bucket", "select user_id as vehicle_ref, time_bucket(interval 30 minute, ts) as bucket, max_by(event_id, ts) as event_id from events group by all")
def latest_per_bucket(t):
    from tramline.streaming.vehicles import latest_per_bucket as op

    rows = t.events.select(F.lit("o").alias("operator_ref"), F.col("user_id").alias("vehicle_ref"), F.col("ts").cast("timestamp").alias("recorded_at"), "event_id")
    return op(rows, 1800).select("vehicle_ref", F.col("bucket.start").cast("timestamp_ntz").alias("bucket"), "event_id")


@query("registry_upsert", "select s_suppkey as feed, case when s_suppkey % 3 = 0 then 'new' else s_name end as digest from supplier where s_acctbal >= 2000 union all select s_suppkey, 'new' from supplier where s_acctbal < 2000 and s_suppkey % 3 = 0")
def registry_upsert(t):
    s = t.supplier.select(F.col("s_suppkey").alias("feed"), F.col("s_name").alias("digest"))
    return registry.upsert(t.supplier.filter("s_acctbal >= 2000").select(F.col("s_suppkey").alias("feed"), F.col("s_name").alias("digest")), s.filter("feed % 3 = 0").withColumn("digest", F.lit("new")), "feed")


@query("registry_drift", "select s_suppkey as feed, s_name as digest from supplier where s_suppkey % 3 = 0")
def registry_drift(t):
    s = t.supplier.select(F.col("s_suppkey").alias("feed"), F.col("s_name").alias("digest"))
    return registry.drifted(s, s.filter("feed % 3 = 0").withColumn("digest", F.lit("new")), "feed", "digest")
