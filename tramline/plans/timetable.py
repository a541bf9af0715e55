"""Queries over calls: service levels, sequences, rolling clocks, capacity, scenario edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.operators import timetable as op
from tramline.plans.proxies import period_sql
from tramline.plans.registry import query
from tramline.plans.tidy import tidy

TRIP = ["trip", "day"]
DEP = "dep as (select * from (select *, lead(stop) over (partition by trip, day order by seq) as next_stop from calls) where next_stop is not null)"
OCT = "cast(length(next_stop) % 8 as bigint)"


def _dep(t) -> DataFrame:
    return op.departures(t.calls, TRIP).withColumn("direction", F.length("next_stop") % 8)


_LEVELS = """
  select {keys}, period, count(*) / (({hi} - {lo}) / cast(60 as double)) as dph, ({hi} - {lo}) / count(*) as mean_h,
    greatest(coalesce(max(gap), 0), min(minute) - {lo}, {hi} - max(minute)) as max_h
  from (select *, {period} as period, minute - lag(minute) over (partition by {keys}, {period} order by minute) as gap from dep) where period <> 'OP' group by {keys}, period
"""


def _levels(keys: str) -> str:
    lo = "case period when 'AM' then cast(420 as double) when 'IP' then cast(600 as double) else cast(960 as double) end"
    hi = "case period when 'AM' then cast(600 as double) when 'IP' then cast(960 as double) else cast(1140 as double) end"
    return _LEVELS.format(keys=keys, period=period_sql("minute"), lo=f"({lo})", hi=f"({hi})")


@query("stop_service", f"with {DEP} select stop, next_stop, period, round(dph, 6) as departures_per_hour, round(mean_h, 6) as mean_headway_min, round(max_h, 6) as max_headway_min from ({_levels('stop, next_stop')})", "calls")
def stop_service(t):
    return tidy(op.service_levels(_dep(t), ["stop", "next_stop"]))


_SIDES = f"""
  oct as (select stop, {period_sql('minute')} as period, {OCT} as direction, count(*) as n from dep group by all),
  sh as (select *, n / cast(sum(n) over (partition by stop, period) as double) as s from oct),
  ok as (select * from sh where s >= 0.1),
  sd as (select a.stop, a.period, count(distinct a.direction) as directions, max(case when least(abs(a.direction - b.direction), 8 - abs(a.direction - b.direction)) >= 2 then 2 else 1 end) as sides
    from ok a join ok b on a.stop = b.stop and a.period = b.period group by all),
  lv as ({_levels('stop')}),
  cs as (select stop, period, directions, sides, dph, dph / sides as one_way from lv join sd using (stop, period))
"""


@query("cluster_service", f"with {DEP}, {_SIDES} select stop, period, directions::bigint as directions, sides::bigint as sides, round(one_way, 6) as dph_one_way, round(60 / one_way, 6) as headway_min from cs", "calls")
def cluster_service(t):
    out = op.cluster_service(_dep(t), ["stop"], "direction")
    return tidy(out.select("stop", "period", "directions", "sides", "dph_one_way", "headway_min"))


@query("headline_service", f"with {DEP}, {_SIDES} select stop, round(least(coalesce(max(one_way) filter (period = 'AM'), 0), coalesce(max(one_way) filter (period = 'IP'), 0)), 6) as dph_one_way, max(directions)::bigint as directions, 'HEADLINE' as period from cs where period in ('AM', 'IP') group by stop", "calls")
def headline_service(t):
    return tidy(op.headline(op.cluster_service(_dep(t), ["stop"], "direction"), ["stop"], ["AM", "IP"]))


def _calendar(t):
    c = t.customer
    return c.select(
        F.col("c_custkey").cast("string").alias("service_id"), *[((F.col("c_custkey") + i) % 3 == 0).cast("int").cast("string").alias(d) for i, d in enumerate(["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"])],
        F.lit("20240101").alias("start_date"), F.when(F.col("c_nationkey") < 12, "20240331").otherwise("20241231").alias("end_date"),
    )


@query("active_services", """
with base as (select cast(c_custkey as varchar) as service_id from customer where (c_custkey + 2) % 3 = 0 and c_nationkey >= 12),
  ex as (select cast(s_suppkey as varchar) as service_id, case when s_nationkey % 2 = 0 then '2' else '1' end as kind from supplier)
select service_id from base where service_id not in (select service_id from ex where kind = '2') union select service_id from ex where kind = '1'
""")
def active_services(t):
    dates = t.supplier.select(F.col("s_suppkey").cast("string").alias("service_id"), F.lit("20240612").alias("date"), F.when(F.col("s_nationkey") % 2 == 0, "2").otherwise("1").alias("exception_type"))
    return op.active_services(_calendar(t), dates, "20240612")


@query("sequence_pattern", "select trip, cast(day as varchar) as day, md5(string_agg(stop || '@' || cast(floor(minute) as int), ',' order by seq)) as pattern from calls group by trip, day", "calls")
def sequence_pattern(t):
    token = F.concat("stop", F.lit("@"), F.floor("minute").cast("int").cast("string"))
    return op.sequence_key(t.calls, TRIP, "seq", token).withColumn("day", F.col("day").cast("string"))


@query("dedupe_trips", """
with p as (select trip, day, string_agg(stop, ',' order by seq) as stops from calls group by all)
select min(trip)::bigint as trip, md5(stops) as pattern, count(*)::bigint as copies from p group by stops
""", "calls")
def dedupe_trips(t):
    from pyspark.sql.window import Window

    keyed = op.sequence_key(t.calls, TRIP, "seq", F.col("stop")).withColumn("copies", F.count("*").over(Window.partitionBy("pattern")))
    return op.dedupe_trips(keyed, "pattern", [F.asc("trip"), F.asc("day")]).select("trip", "pattern", "copies")


@query("clip_trips", """
with f as (select trip, day, max(case when stop = 'click' then 1 else 0 end) as has, count(*) filter (stop <> 'error') as n from calls group by all)
select c.trip, cast(c.day as varchar) as day, c.seq::bigint as seq, c.stop from calls c join f using (trip, day) where has = 1 and n >= 2 and stop <> 'error'
""", "calls")
def clip_trips(t):
    out = op.clip_trips(t.calls, TRIP, F.col("stop") == "click", F.col("stop") != "error")
    return out.select("trip", F.col("day").cast("string").alias("day"), F.col("seq").cast("long").alias("seq"), "stop")


@query("same_start_groups", """
with e as (select trip, day, arg_min(stop, seq) as f, arg_max(stop, seq) as l from calls group by all)
select cast(day as varchar) as day, f as first_stop, count(*) as trips, count(distinct l) as ends from e group by all having count(distinct l) > 1
""", "calls")
def same_start_groups(t):
    out = op.same_start_groups(t.calls.withColumn("minute", F.lit(0.0)), ["day"], ["trip"])
    return out.select(F.col("day").cast("string").alias("day"), "first_stop", "trips", "ends")


@query("route_loss", """
with a as (select stop, count(*) as before, count(*) filter (value < 100) as after from calls group by stop)
select stop, before, after, round((before - after) / cast(before as double), 6) as lost, (before - after) > 0.1 * before as flagged from a
""", "calls")
def route_loss(t):
    g = t.calls.groupBy("stop").agg(F.count("*").alias("before"), F.sum((F.col("value") < 100).cast("long")).alias("after"))
    return tidy(g.withColumns({"lost": (F.col("before") - F.col("after")) / F.col("before"), "flagged": F.col("before") - F.col("after") > 0.1 * F.col("before")}))


@query("trips_per_route", "select stop, count(distinct trip) as trips from calls group by stop", "calls")
def trips_per_route(t):
    return t.calls.groupBy("stop").agg(F.countDistinct("trip").alias("trips"))


@query("variant_resolve", """
with v as (select distinct trip, stop from calls), s as (select distinct trip, stop from calls where value > 150),
  j as (select v.trip, v.stop, s.stop is not null as seen from v left join s using (trip, stop))
select trip, stop, case when seen then 'keep' when bool_or(seen) over (partition by trip) then 'drop' else 'unresolved' end as decision from j
""", "calls")
def variant_resolve(t):
    v = t.calls.select("trip", "stop").distinct()
    return op.variant_resolve(v, t.calls.filter("value > 150"), ["trip"], "stop")


@query("midnight_roll", """
with w as (select *, lag(v) over (partition by trip order by ts) as p from (select *, cast((event_id * 37) % 1440 as double) as v from calls))
select trip, event_id, round(v + 1440 * sum(case when p > v then 1 else 0 end) over (partition by trip order by ts rows unbounded preceding), 6) as rolled from w
""", "calls")
def midnight_roll(t):
    rows = t.calls.withColumn("v", ((F.col("event_id") * 37) % 1440).cast("double"))
    return tidy(op.roll_midnight(rows, ["trip"], "ts", "v", "rolled").select("trip", "event_id", "rolled"))


@query("merge_consecutive", """
with a as (select *, lag(stop) over (partition by trip, day order by seq) as p from calls), b as (select *, sum(case when p is null or p <> stop then 1 else 0 end) over (partition by trip, day order by seq rows unbounded preceding) as run from a)
select trip, cast(day as varchar) as day, run::bigint as seq, any_value(stop) as stop, round(min(minute), 6) as arr, round(max(minute), 6) as dep, count(*) as n from b group by trip, day, run
""", "calls")
def merge_consecutive(t):
    rows = t.calls.withColumns({"arr": F.col("minute"), "dep": F.col("minute")})
    out = op.merge_consecutive(rows, TRIP, "seq", "stop", "arr", "dep").withColumn("day", F.col("day").cast("string"))
    return tidy(out)


_USE = "legs as (select *, lead(stop) over (partition by trip, day order by seq) as nxt, lead(minute) over (partition by trip, day order by seq) as nm from calls), use as (select stop as \"from\", nxt as \"to\", cast(floor(minute / 60) as int) % 24 as hour, count(*) as trains from legs where nxt is not null and nxt <> stop group by all)"


def _use(t) -> DataFrame:
    return op.section_use(t.calls.withColumn("dep_s", F.col("minute") * 60), TRIP, "seq", "stop", "dep_s")


@query("base_use", f'with {_USE} select "from", "to", hour::bigint as hour, trains from use', "calls")
def base_use(t):
    return tidy(_use(t))


@query("section_run_times", f'with {_USE} select stop as "from", nxt as "to", round(quantile_cont(nm - minute, 0.5), 6) as median_min, count(*) as n from legs where nxt is not null and nxt <> stop group by all', "calls")
def section_run_times(t):
    rows = t.calls.withColumn("arr", F.col("minute"))
    return tidy(op.section_run_times(rows, TRIP, "seq", "stop", "minute", "arr"))


@query("busiest_hour", f"""
with {_USE}, p as (select *, {period_sql('hour * 60')} as period from use), r as (select *, row_number() over (partition by "from", "to", period order by trains desc, hour) as k from p)
select "from", "to", period, hour::bigint as hour, trains from r where k = 1
""", "calls")
def busiest_hour(t):
    return tidy(op.busiest_hour(_use(t)))


@query("dominant_pattern", """
with s as (select trip, day, string_agg(stop, '|' order by stop) as pattern from (select distinct trip, day, stop from calls) group by all),
  n as (select day, pattern, count(*) as trips from s group by all), r as (select *, row_number() over (partition by day order by trips desc, pattern) as k from n)
select cast(day as varchar) as day, pattern, trips from r where k = 1
""", "calls")
def dominant_pattern(t):
    out = op.dominant_pattern(t.calls, TRIP, ["day"])
    return out.withColumn("day", F.col("day").cast("string"))


@query("truncate_trips", """
with c as (select trip, day, min(seq) as cut from calls where stop = 'purchase' group by all), k as (select calls.*, count(*) over (partition by trip, day) as n from calls left join c using (trip, day) where cut is null or seq <= cut)
select trip, cast(day as varchar) as day, row_number() over (partition by trip, day order by seq) as seq, stop from k where n >= 2
""", "calls")
def truncate_trips(t):
    out = op.truncate(t.calls, TRIP, "seq", "stop", "purchase")
    return tidy(out.select("trip", F.col("day").cast("string").alias("day"), "seq", "stop"))


_TIMED = "timed as (select *, minute as arr, minute + (event_id % 3) as dep from calls)"


def _timed(t) -> DataFrame:
    return t.calls.withColumns({"arr": F.col("minute"), "dep": F.col("minute") + (F.col("event_id") % 3)})


@query("remove_calls", f"""
with {_TIMED}, m as (select *, row_number() over (partition by trip, day order by seq) = 1 as first, lead(seq) over (partition by trip, day order by seq) is null as last from timed),
  c as (select *, stop = 'signup' and not first and not last as cut from m), s as (select *, coalesce(sum(case when cut then dep - arr else 0 end) over (partition by trip, day order by seq rows between unbounded preceding and 1 preceding), 0) as saved from c)
select trip, cast(day as varchar) as day, row_number() over (partition by trip, day order by seq) as seq, stop, round(arr - saved, 6) as arr, round(dep - saved, 6) as dep from s where not cut
""", "calls")
def remove_calls(t):
    from pyspark.sql.window import Window

    w = Window.partitionBy(*TRIP).orderBy("seq")
    ends = (F.row_number().over(w) == 1) | F.lead("seq").over(w).isNull()
    rows = _timed(t).withColumn("place", F.when((F.col("stop") == "signup") & ~ends, "gone").otherwise(F.col("stop")))
    out = op.remove_calls(rows, TRIP, "seq", "place", ["gone"], "arr", "dep")
    return tidy(out.select("trip", F.col("day").cast("string").alias("day"), "seq", "stop", "arr", "dep"))


@query("extend_trips", f"""
with {_TIMED}, e as (select trip, day, max(seq) as lo, min(seq) as fo, arg_max(stop, seq) as ls, arg_min(stop, seq) as fs, arg_max(arr, seq) as la, arg_min(dep, seq) as fd from timed group by all),
  u as (select t.trip, t.day, seq, stop, arr, case when seq = lo and ls = 'click' then arr + 2 else dep end as dep from timed t join e using (trip, day)
    union all select trip, day, lo + 1, 'new', la + 7, la + 7 from e where ls = 'click' union all select trip, day, fo - 1, 'new', fd - 7, fd - 7 from e where fs = 'click')
select trip, cast(day as varchar) as day, row_number() over (partition by trip, day order by seq) as seq, stop, round(arr, 6) as arr, round(dep, 6) as dep from u
""", "calls")
def extend_trips(t):
    out = op.extend_to(_timed(t), TRIP, "seq", "stop", "arr", "dep", "click", "new", 5.0, 2.0)
    return tidy(out.select("trip", F.col("day").cast("string").alias("day"), "seq", "stop", "arr", "dep"))


@query("working_times", f"with {_TIMED}, l as (select stop, dep, lead(stop) over (partition by trip, day order by seq) as nxt, lead(arr) over (partition by trip, day order by seq) as na from timed) select stop as \"from\", nxt as \"to\", round(quantile_cont(na - dep, 0.5), 6) as run, count(*) as n from l where nxt is not null group by all", "calls")
def working_times(t):
    rows = _timed(t).withColumn("operator", F.col("trip") % 4)
    return tidy(op.working_times(rows, TRIP, "seq", "stop", "arr", "dep", "operator")["run"])


@query("trace_sessions", """
with g as (select trip, ts, epoch_us(ts) - lag(epoch_us(ts)) over (partition by trip order by ts) as gap from calls), s as (select trip, sum(case when gap > 7200000000 then 1 else 0 end) over (partition by trip order by ts rows unbounded preceding) as trace from g)
select trip, trace::bigint as trace, count(*) as n from s group by all
""", "calls")
def trace_sessions(t):
    return tidy(op.trace_sessions(t.calls, ["trip"], "ts", 7200.0).groupBy("trip", "trace").agg(F.count("*").alias("n")))


@query("trace_chunks", """
with i as (select trip, event_id, row_number() over (partition by trip order by ts) - 1 as i, count(*) over (partition by trip) as n from calls)
select trip, (i // 9)::bigint as chunk, event_id from i where not (i % 9 = 0 and i > 0 and i = n - 1) union all select trip, (i // 9 - 1)::bigint, event_id from i where i % 9 = 0 and i > 0
""", "calls")
def trace_chunks(t):
    return tidy(op.chunks_with_overlap(t.calls, ["trip"], "ts", 10).select("trip", "chunk", "event_id"))


@query("thin_snapshots", "with b as (select trip, event_id, floor(epoch(ts) / 21600)::bigint as bucket, row_number() over (partition by trip, floor(epoch(ts) / 21600) order by ts desc, event_id desc) as k from calls) select trip, bucket, event_id from b where k = 1", "calls")
def thin_snapshots(t):
    return tidy(op.thin_snapshots(t.calls, ["trip"], "ts", 21600, "event_id").select("trip", "bucket", "event_id"))


@query("vehicle_dedupe", """
with r as (select *, (event_id * 7919) % 10007 as recorded from calls), k as (select *, max(recorded) over (partition by trip order by ts, recorded rows between unbounded preceding and 1 preceding) as top from r)
select trip, event_id, recorded::bigint as recorded from k where top is null or recorded > top
""", "calls")
def vehicle_dedupe(t):
    rows = t.calls.withColumn("recorded", (F.col("event_id") * 7919) % 10007)
    return tidy(op.newer_only(rows, ["trip"], ["ts"], "recorded").select("trip", "event_id", "recorded"))


@query("gap_minutes", """
with g as (select stop, day, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by stop, day order by ts)) / cast(1000000 as double) as gap from calls)
select stop, cast(day as varchar) as day, count(*) as n, round(sum(case when gap > 1800 then gap / 60 else 0 end), 6) as gap_min from g group by all
""", "calls")
def gap_minutes(t):
    return tidy(op.gap_minutes(t.calls, ["stop", "day"], "ts", 1800.0).withColumn("day", F.col("day").cast("string")))
