"""Queries on road speeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.config import PERIODS
from tramline.operators import congestion as op
from tramline.operators import roads
from tramline.plans.registry import query
from tramline.plans.tidy import tidy


@query("harmonic_cells", "select segment, period, count(*) as n, round(count(*) / sum(1 / kmh), 6) as kmh from probe where kmh > 0 group by all having count(*) >= 5", "probe")
def harmonic_cells(t):
    return tidy(op.harmonic_cells(t.probe, ["segment", "period"], min_obs=5))


@query("allday_speed", "select segment, round(sum(hour + 1) / sum((hour + 1) / kmh), 6) as speed, sum(hour + 1)::bigint as volume from probe where kmh > 0 group by all", "probe")
def allday_speed(t):
    return tidy(op.flow_weighted_speed(t.probe.withColumn("v", F.col("hour") + 1), ["segment"], "kmh", "v"))


@query("leg_filters", """
with l as (select leg, cast(leg % 900 as double) as dist_m, cast(leg % 120 as double) as dt_s, (leg % 10) / cast(10 as double) as c, cast(leg % 70 as double) as s from probe), v as (select *, dist_m / nullif(dt_s, 0) * cast(3.6 as double) as v from l),
  r as (select case when c < cast(0.3 as double) then 'confidence' when dt_s <= 0 or dt_s > 90 then 'gap' when dist_m <= 0 then 'no distance' when v < 5 and s <= 30 then 'dwell' when v > 130 then 'too fast' end as reason from v)
select coalesce(reason, 'kept') as reason, count(*) as n from r group by 1
""", "probe")
def leg_filters(t):
    k = F.col("leg")
    legs = t.probe.select("leg", (k % 900).cast("double").alias("dist_m"), (k % 120).cast("double").alias("dt_s"), ((k % 10) / F.lit(10.0)).alias("confidence"), (k % 70).cast("double").alias("stop_m"))
    return op.leg_filters(legs).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("traversals", "with g as (select leg, i, (leg * 7 + i) % 97 as u, (leg * 7 + i + 1) % 97 as v, kmh from probe, range(0, 4) r(i) where i < leg % 5) select leg, u::bigint as u, v::bigint as v, kmh from g", "probe")
def traversals(t):
    nodes = F.transform(F.sequence(F.lit(0), (F.col("leg") % 5).cast("int")), lambda i: ((F.col("leg") * 7 + i) % 97).cast("long"))
    return op.explode_legs(t.probe.select("leg", "kmh", nodes.alias("nodes"))).select("leg", "u", "v", "kmh")


@query("bus_shape", """
with c as (select segment, road_class, period, count(*) as n, count(*) / sum(1 / kmh) as kmh from probe where kmh > 0 group by all having count(*) >= 10), b as (select segment, kmh as b from c where period = 'IP'),
  r as (select road_class, period, quantile_cont(kmh / b, 0.5) as m, count(*) as n from c join b using (segment) group by all), nat as (select * from (values ('AM', cast(0.8 as double)), ('IP', 1.0), ('PM', 0.75), ('OP', 1.1)) v(period, ratio)), g as (select distinct road_class from c)
select road_class, period, round(case when coalesce(n >= 20, false) then m else ratio end, 6) as ratio, case when coalesce(n >= 20, false) then 'own' else 'national' end as basis from g cross join nat left join r using (road_class, period)
""", "probe")
def bus_shape(t):
    cells = op.harmonic_cells(t.probe, ["segment", "road_class", "period"], min_obs=10)
    nat = t.spark.createDataFrame([("AM", 0.8), ("IP", 1.0), ("PM", 0.75), ("OP", 1.1)], "period string, ratio double")
    return tidy(op.bus_shape(cells, ["road_class"], nat))


@query("bus_ratio", "select road_class, period, round(sum(60 / kmh) / sum(hour + cast(1 as double)), 6) as ratio, count(*) as n from probe group by all", "probe")
def bus_ratio(t):
    rows = t.probe.withColumns({"a": F.lit(60.0) / F.col("kmh"), "b": F.col("hour") + F.lit(1.0)})
    return tidy(op.ratio_of_sums(rows, ["road_class", "period"], "a", "b"))


@query("spacing_ratio", """
with f as (select segment, road_class, period, count(*) / sum(1 / kmh) as f from probe group by all), k as (select segment, road_class, period, count(*) / sum(1 / kmh) as k from probe where leg % 3 = 0 group by all), r as (select road_class, k / f as r from f join k using (segment, road_class, period))
select road_class, round(quantile_cont(r, 0.5), 6) as median, round(quantile_cont(r, 0.1), 6) as p10, round(quantile_cont(r, 0.9), 6) as p90, count(*) as cells from r group by all
""", "probe")
def spacing_ratio(t):
    return tidy(op.spacing_ratio(t.probe, t.probe.filter("leg % 3 = 0"), ["segment", "road_class", "period"], ["road_class"]))


@query("period_weights", """
with p as (select (dayofweek(ts) + 6) % 7 as dow, hour, count(*) as share from probe group by all), k as (select case when dow >= 5 then 'WE' when hour >= 7 and hour < 10 then 'AM' when hour >= 10 and hour < 16 then 'IP' when hour >= 16 and hour < 19 then 'PM' else 'OP' end as period, share from p)
select period, round(sum(share) / (select cast(sum(share) as double) from p), 6) as weight from k group by 1
""", "probe")
def period_weights(t):
    p = t.probe.groupBy(F.weekday("ts").alias("dow"), "hour").agg(F.count("*").alias("share"))
    return tidy(op.period_weights(p, PERIODS))


@query("assembled_speed", """
with p as (select p_partkey as id, cast(p_size as double) as free, (p_partkey % 15) / cast(10 as double) as f, cast((p_partkey % 4) * 5 as double) as d from part), v as (select *, least(greatest(free * f, 3), free * cast(1.2 as double)) * cast(0.9 as double) as v from p)
select id, round(greatest(case when d > 0 then 400 / (400 / (v / cast(3.6 as double)) + d) * cast(3.6 as double) else v end, 1), 6) as kmh from v
""")
def assembled_speed(t):
    k = F.col("p_partkey")
    return tidy(t.part.select(k.alias("id"), op.assembled_speed(F.col("p_size").cast("double"), (k % 15) / F.lit(10.0), F.lit(0.9), F.lit(400.0), ((k % 4) * 5).cast("double")).alias("kmh")))


@query("profile_fit", """
with r as (select cast(p_size * 2 + p_partkey % 7 as double) as t, cast(p_size as double) as p, cast(p_partkey % 9 as double) as j, cast(p_partkey % 3 + 1 as double) as w from part), s as (select sum(w * p * p) as pp, sum(w * p * j) as pj, sum(w * j * j) as jj, sum(w * p * t) as pt, sum(w * j * t) as jt from r),
  d as (select *, pp * jj - pj * pj as det from s), f as (select (pt * jj - jt * pj) / det as k, (jt * pp - pt * pj) / det as b, pt / pp as k1 from d)
select round(case when b >= 0 then k else k1 end, 6) as k, round(greatest(b, 0), 6) as b from f
""")
def profile_fit(t):
    p = F.col("p_partkey")
    rows = t.part.select((F.col("p_size") * 2 + p % 7).cast("double").alias("t"), F.col("p_size").cast("double").alias("profile"), (p % 9).cast("double").alias("junctions"), (p % 3 + 1).cast("double").alias("w"))
    k, b = op.profile_fit(rows)
    return tidy(t.spark.createDataFrame([(float(k), float(b))], "k double, b double"))


@query("national_fallback", "with m as (select segment, quantile_cont(kmh, 0.5) as m, count(*) as n from probe group by 1) select segment, round(case when n >= 105 then m else (select quantile_cont(kmh, 0.5) from probe) end, 6) as value, case when n >= 105 then 'own' else 'all' end as basis from m", "probe")
def national_fallback(t):
    return tidy(op.national_fallback(t.probe, ["segment"], "kmh", 105))


@query("directed_ways", "with w as (select p_partkey as id, ['yes', 'no', '-1', null][p_partkey % 4 + 1] as o, p_partkey % 10 = 0 as ring from part), d as (select id, case when o = '-1' then [false] when o = 'yes' or (ring and coalesce(o, 'no') <> 'no') then [true] when ring and o is null then [true, false] else [true, false] end as d from w) select id, unnest(d) as forward from d")
def directed_ways(t):
    w = t.part.select(F.col("p_partkey").alias("id"), F.get(F.array(F.lit("yes"), F.lit("no"), F.lit("-1"), F.lit(None)), (F.col("p_partkey") % 4).cast("int")).alias("oneway"), F.when(F.col("p_partkey") % 10 == 0, "roundabout").alias("junction"))
    return op.directed(w).select("id", "forward")


def _crc(text: str) -> str:
    """CRC-32 of a text's characters (ASCII), which SQL has no function for: its eight shifts folded over the bytes."""
    shifts = "list_reduce(list_prepend(xor(a, ch), range(8)::ubigint[]), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end)"
    return f"xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::ubigint)), lambda a, ch: {shifts}))"


@query("spatial_folds", f"with b as (select id, cast(floor(lon * cast(69.4 as double) / 2) as bigint) || ':' || cast(floor(lat * cast(111.3 as double) / 2) as bigint) || ':0' as k from zones) select id, cast({_crc('k')} % 5 as int) as fold from b", "zones")
def spatial_folds(t):
    return t.zones.select("id", op.folds(F.col("lon"), F.col("lat"), 2.0, 5).alias("fold"))


@query("noise_floor", f"""
with s as (select *, cast({_crc('cast(leg as varchar)')} % 2 as int) as side from probe where kmh > 0),
  h as (select road_class, period, count(*) as n, count(*) filter (where side = 0) / sum(1 / kmh) filter (where side = 0) as h0, count(*) filter (where side = 1) / sum(1 / kmh) filter (where side = 1) as h1 from s group by all)
select road_class, period, n, round(abs(h0 - h1) / ((h0 + h1) / 2), 6) as disagreement from h where n >= 20 and h0 is not null and h1 is not null
""", "probe")
def noise_floor(t):
    return tidy(op.noise_floor(t.probe, ["road_class", "period"], "leg"))


_ROADS = "c as (select p_partkey // 90 as ref, p_partkey as u, p_partkey + 1 + p_partkey % 3 as v, p_retailprice - 800 as length_m, p_size + cast(20 as double) as obs, p_size % 17 + cast(22 as double) as pred from part where p_partkey % 11 <> 10)"


@query("corridors", f"""
with recursive {_ROADS}, u as (select ref, u as a, v as b from c union select ref, v, u from c), r as (select ref, a as id, a as low from u union select r.ref, r.id, u.b from r join u on u.ref = r.ref and u.a = r.low),
  m as (select ref, id, min(low) as corridor from r group by all), g as (select c.ref, corridor, sum(length_m) as length_m, sum(length_m / obs) as o, sum(length_m / pred) as p from c join m on m.ref = c.ref and m.id = c.u group by all)
select ref, corridor, round(length_m, 6) as length_m, round(length_m / o, 6) as obs, round(length_m / p, 6) as pred from g where length_m >= 700
""")
def corridors(t):
    k = F.col("p_partkey")
    c = t.part.filter("p_partkey % 11 <> 10").select(F.floor(k / 90).alias("ref"), k.alias("u"), (k + 1 + k % 3).alias("v"), (F.col("p_retailprice") - 800).alias("length_m"), (F.col("p_size") + 20.0).alias("obs"), (F.col("p_size") % 17 + 22.0).alias("pred"))
    return tidy(op.corridors(c, ["ref"], 700.0))


@query("road_class_propagate", """
with e as (select id % 5 as ref, id as u, id + 5 as v, id % 7 * 10 + cast(10 as double) as m from zones), n as (select ref, u as node from e union select ref, v from e),
  p as (select n.ref, node, coalesce(sum(m), 0) as at from n left join e on e.ref = n.ref and e.u < n.node group by all), s as (select s_suppkey % 5 as ref, s_suppkey as node, case when s_acctbal > 6000 then 'A' else 'B' end as cls from supplier where s_acctbal > 3000),
  d as (select p.ref, p.node, abs(p.at - q.at) as dist, s.cls, row_number() over (partition by p.ref, p.node order by abs(p.at - q.at), s.node) as k from p join s on s.ref = p.ref join p q on q.ref = s.ref and q.node = s.node)
select cast(p.ref as varchar) as ref, p.node, dist as dist_m, cls from p left join d on d.ref = p.ref and d.node = p.node and k = 1
""", "zones")
def road_class_propagate(t):
    e = t.zones.select((F.col("id") % 5).cast("string").alias("ref"), F.col("id").alias("u"), (F.col("id") + 5).alias("v"), (F.col("id") % 7 * 10 + 10.0).alias("length_m"))
    s = t.supplier.filter("s_acctbal > 3000").select((F.col("s_suppkey") % 5).cast("string").alias("ref"), F.col("s_suppkey").alias("node"), F.when(F.col("s_acctbal") > 6000, "A").otherwise("B").alias("cls"))
    return roads.propagate_class(e, s)
