"""Queries over skims: summaries, costs, offsets, accessibility, who gains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import stats
from tramline.functions.curves import interpolate
from tramline.config import WAIT_CURVE
from tramline.operators import skims as op
from tramline.plans.registry import query
from tramline.plans.tidy import tidy

SLOTS = 40


@query("skim_summary", f"""
with s as (select from_id, to_id, avg(total_time) as total, min(total_time) as best, count(*) as n, list_sort(list(total_time)) as l, avg(wait) as wait, avg(n_rides) as rides,
  avg(ride) filter (n_rides >= 1) as r_ride, avg(case when n_rides >= 1 then cast(1 as double) else 0 end) as ride_share from minutes group by all)
select from_id, to_id, round(total, 6) as total, best, l[cast(ceil(0.25 * {SLOTS}) as int)] as p25, l[cast(ceil(0.5 * {SLOTS}) as int)] as p50, l[cast(ceil(0.75 * {SLOTS}) as int)] as p75,
  round(wait, 6) as wait, round(rides, 6) as rides, round(r_ride, 6) as r_ride, round(ride_share, 6) as ride_share, round(n / cast({SLOTS} as double), 6) as reach_share, n / cast({SLOTS} as double) < 0.5 as unreachable from s
""", "minutes")
def skim_summary(t):
    cols = ["from_id", "to_id", "total", "best", "p25", "p50", "p75", "wait", "rides", "r_ride", "ride_share", "reach_share", "unreachable"]
    return tidy(op.skim_summary(t.minutes, SLOTS, routes=False).select(*cols))


@query("nearest_rank", """
select from_id, list_sort(list(total_time))[cast(ceil(0.9 * 1300) as int)] as p90 from minutes group by from_id
""", "minutes")
def nearest_rank(t):
    return t.minutes.groupBy("from_id").agg(stats.nearest_rank("total_time", 0.9, F.lit(1300)).alias("p90"))


@query("top3_routes", """
with n as (select from_id, route, count(*) as n from minutes where n_rides >= 1 group by all), r as (select *, row_number() over (partition by from_id order by n desc, route) as k from n)
select from_id, string_agg(route, ';' order by k) as top_route from r where k <= 3 group by from_id
""", "minutes")
def top3_routes(t):
    return stats.top_names(t.minutes.filter("n_rides >= 1"), ["from_id"], "route")


_MEDIAN = "m0 as (select from_id, total_time as x, sum(wait) as w from minutes group by all), m1 as (select *, sum(w) over (partition by from_id order by x rows unbounded preceding) as c, sum(w) over (partition by from_id) as t from m0)"


@query("weighted_median", f"with {_MEDIAN} select from_id, min(x) as median from m1 where c >= t / 2 group by from_id", "minutes")
def weighted_median(t):
    return stats.weighted_median(t.minutes, ["from_id"], "total_time", "wait", "median")


_RANK = "r as (select id, a, b, (rank() over (order by a) + (count(*) over (partition by a) - 1) / cast(2 as double)) as ra, (rank() over (order by b) + (count(*) over (partition by b) - 1) / cast(2 as double)) as rb, count(*) over () as n from q)"
_PART = "q as (select p_partkey as id, p_size as a, p_retailprice % 100 as b from part)"


def _parts(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("a"), (F.col("p_retailprice") % 100).alias("b"))


@query("spearman_rank", f"with {_PART}, {_RANK} select round(corr(ra, rb), 6) as rho, count(*) as n from r")
def spearman_rank(t):
    return tidy(stats.spearman(_parts(t), "a", "b"))


@query("pct_rank", f"with {_PART}, {_RANK} select id, round(ra / n, 6) as pct from r")
def pct_rank(t):
    return tidy(stats.percent_rank(_parts(t), "a", "pct").select("id", "pct"))


@query("pct_rank_diff", f"with {_PART}, {_RANK} select id, round(ra / n - rb / n, 6) as difference from r order by abs(round(ra / n - rb / n, 6)) desc, id limit 15")
def pct_rank_diff(t):
    return op.rank_differences(_parts(t), "id", "a", "b")


@query("gc_components", "select from_id, to_id, round(ride + 2 * walk + 2 * wait + cast(7.5 as double), 6) as gc from skim_a", "skim_a")
def gc_components(t):
    return tidy(t.skim_a.select("from_id", "to_id", op.gc_from_components(F.col("ride"), F.col("walk"), F.col("wait"), F.lit(1.0)).alias("gc")))


_CURVE = "case when x <= 0 then cast(0 as double) when x <= 5 then x when x <= 10 then 5 + (x - 5) * cast(0.6 as double) when x <= 20 then 8 + (x - 10) * cast(0.5 as double) else 13 + (x - 20) * cast(0.3 as double) end"


@query("wait_curve", f"select distinct wait, round({_CURVE}, 6) as felt from (select wait, wait * 4 as x from minutes)", "minutes")
def wait_curve(t):
    return tidy(t.minutes.select("wait", interpolate(F.col("wait") * 4, WAIT_CURVE).alias("felt")).distinct())


@query("gc_wait_curve", f"""
with f as (select from_id, to_id, total_time, wait, ride, walk, least(greatest(total_time - 20, 0), wait) as first from minutes), g as (select *, first * 2 as x from f)
select from_id, to_id, round(avg(ride + 2 * walk + 2 * (({_CURVE}) + wait - first)), 6) as gc from g group by all
""", "minutes")
def gc_wait_curve(t):
    gc = op.gc_with_curve(F.col("total_time"), F.lit(20.0), F.col("wait"), F.col("ride"), F.col("walk"), F.lit(0.0))
    return tidy(t.minutes.groupBy("from_id", "to_id").agg(F.avg(gc).alias("gc")))


@query("combine_offsets", """
with u as (select from_id, to_id, p50, ride, unreachable from skim_a union all select from_id, to_id, p50, ride, unreachable from skim_b)
select from_id, to_id, round(avg(p50) filter (not unreachable), 6) as p50, round(avg(ride) filter (not unreachable), 6) as ride, min(p50) filter (not unreachable) as p50_min_offsets, max(p50) filter (not unreachable) as p50_max_offsets,
  count(*) filter (not unreachable) as offsets_reachable, 2::bigint as offsets, count(*) filter (not unreachable) < 2 as unreachable from u group by all
""", "skim_a skim_b")
def combine_offsets(t):
    return tidy(op.combine_offsets([t.skim_a, t.skim_b], ["p50", "ride"]))


_WITHIN = "w as (select from_id, sum(case when p50 <= 24 then coalesce(jobs, 0) else 0 end)::bigint as jobs_24, sum(case when p50 <= 27 then coalesce(jobs, 0) else 0 end)::bigint as jobs_27 from skim_a left join jobs on to_id = zone where not unreachable group by from_id)"


@query("jobs_within", f"with {_WITHIN} select * from w", "skim_a jobs")
def jobs_within(t):
    return tidy(op.jobs_within(t.skim_a, t.jobs, [24, 27]))


@query("access_summary", f"""
with {_WITHIN}, b as (select residents, zone % 5 = 0 as edge, cast(coalesce(jobs_24, 0) as double) as a, cast(coalesce(jobs_27, 0) as double) as b from residents left join w on zone = from_id),
  l as (select residents, edge, 'jobs_24' as measure, a as v from b union all select residents, edge, 'jobs_27', b from b)
select measure, round(quantile_cont(v, 0.5) filter (not edge), 6) as median_core, round(quantile_cont(v, 0.5) filter (edge), 6) as median_edge, round(sum(v * residents) / sum(residents), 6) as weighted_mean from l group by measure
""", "skim_a jobs residents")
def access_summary(t):
    acc = op.jobs_within(t.skim_a, t.jobs, [24, 27])
    return tidy(op.access_summary(acc, t.residents, F.col("zone") % 5 == 0, ["jobs_24", "jobs_27"]))


@query("connectivity", """
with c as (select from_id, sum(coalesce(jobs, 0)) filter (p50 <= 30) as car_jobs from skim_b left join jobs on to_id = zone group by from_id),
  p as (select from_id, sum(case when p50 <= 25 then coalesce(jobs, 0) else 0 end)::bigint as jobs_within, sum(coalesce(jobs, 0) * exp(p50 * cast(-0.04 as double))) as jobs_decayed from skim_a left join jobs on to_id = zone where not unreachable group by from_id)
select from_id, jobs_within, round(jobs_decayed, 6) as jobs_decayed, car_jobs::bigint as car_jobs, round(case when car_jobs > 0 then jobs_within / cast(car_jobs as double) end, 6) as pt_car_ratio from p left join c using (from_id)
""", "skim_a skim_b jobs")
def connectivity(t):
    car = t.skim_b.join(t.jobs.withColumnRenamed("zone", "to_id"), "to_id", "left").groupBy("from_id").agg(F.sum(F.when(F.col("p50") <= 30, F.coalesce("jobs", F.lit(0)))).alias("car_jobs"))
    return tidy(op.connectivity(t.skim_a, t.jobs, car, 25))


_BOTH = "j as (select a.from_id, a.to_id, a.p50 as pa, b.p50 as pb, a.unreachable as ua, b.unreachable as ub, a.top_routes as ta, b.top_routes as tb, b.walk - a.walk as dw from skim_a a join skim_b b using (from_id, to_id)), d as (select *, case when not ua and not ub then pb - pa end as d from j)"


@query("skim_diff", f"""
with {_BOTH} select count(*) filter (not ua) as reachable_a, count(*) filter (not ub) as reachable_b, count(*) filter (ua and not ub) as gained, count(*) filter (not ua and ub) as lost, round(avg(d), 6) as mean_change,
  round(quantile_cont(d, 0.01), 6) as p1, round(quantile_cont(d, 0.05), 6) as p5, round(quantile_cont(d, 0.95), 6) as p95, count(*) filter (d <= -2) as faster_2, count(*) filter (d >= 2) as slower_2, count(*) filter (d <= -5) as faster_5 from d
""", "skim_a skim_b")
def skim_diff(t):
    return tidy(op.skim_diff(t.skim_a, t.skim_b))


@query("largest_gains", f"with {_BOTH} select from_id, to_id, pa as p50_a, pb as p50_b, d from d where d is not null order by d, from_id, to_id limit 8", "skim_a skim_b")
def largest_gains(t):
    return tidy(op.largest_gains(t.skim_a, t.skim_b))


_PEOPLE = f"""
  {_BOTH}, dj as (select d.*, coalesce(jobs, 0) as jobs from d left join jobs on to_id = zone),
  g as (select from_id, max(d) filter (to_id = 7) as centre_change, bool_or(to_id = 7 and ua and not ub) as centre_new, sum(pa * jobs) filter (d is not null) / nullif(sum(jobs) filter (d is not null), 0) as time_a, sum(pb * jobs) filter (d is not null) / nullif(sum(jobs) filter (d is not null), 0) as time_b,
    count(*) filter (d <= -2) as faster, coalesce(sum(jobs) filter (d <= -2), 0)::bigint as jobs_faster, count(*) filter (ua and not ub) as gained from dj group by from_id),
  p as (select zone, residents, centre_change, coalesce(centre_new, false) as centre_new, time_a, time_b, coalesce(faster, 0) as faster, coalesce(jobs_faster, 0) as jobs_faster, coalesce(gained, 0) as gained, time_b - time_a as time_change from residents left join g on zone = from_id)
"""


def _people(t):
    return op.people(t.skim_a, t.skim_b, t.residents, t.jobs, 7)


@query("people_by_oa", f"with {_PEOPLE} select zone, residents, centre_change, centre_new, round(time_a, 6) as time_a, round(time_b, 6) as time_b, faster, jobs_faster, gained, round(time_change, 6) as time_change from p", "skim_a skim_b residents jobs")
def people_by_oa(t):
    return tidy(_people(t))


@query("people_headline", f"""
with {_PEOPLE}, tj as (select sum(jobs) as all_jobs from jobs), c as (select *, sum(faster * residents) over (order by faster * residents desc rows unbounded preceding) as cum from p)
select sum(residents)::bigint as residents, coalesce(sum(residents) filter (centre_change <= -2), 0)::bigint as centre_faster, coalesce(sum(residents) filter (centre_change >= 2), 0)::bigint as centre_slower, coalesce(sum(residents) filter (centre_new), 0)::bigint as centre_new,
  coalesce(sum(residents) filter (time_change <= -1), 0)::bigint as jobs_faster_1, coalesce(sum(residents) filter (time_change >= 1), 0)::bigint as jobs_slower_1, round(sum(coalesce(time_change, 0) * residents) / sum(residents), 6) as mean_time_change,
  coalesce(sum(residents) filter (faster > 0), 0)::bigint as some_faster, coalesce(sum(residents) filter (jobs_faster >= 0.1 * all_jobs), 0)::bigint as tenth_of_jobs_faster, sum(faster * residents)::bigint as weighted_pairs,
  (select count(*) + 1 from c where cum <= (select sum(faster * residents) / cast(2 as double) from p)) as origins_with_half from p, tj
""", "skim_a skim_b residents jobs")
def people_headline(t):
    return tidy(op.people_headline(_people(t), t.jobs))


@query("offset_spread", """
with u as (select from_id, to_id, p50, unreachable, contains(coalesce(top_routes, ''), 'RO') or contains(coalesce(top_routes, ''), 'AF') as u from skim_a union all select from_id, to_id, p50, unreachable, contains(coalesce(top_routes, ''), 'RO') or contains(coalesce(top_routes, ''), 'AF') from skim_b),
  g as (select from_id, to_id, bool_or(u) as uses, max(p50) - min(p50) as r from u group by all having count(*) = 2 and not bool_or(unreachable))
select uses, count(*) as pairs, round(avg(r), 6) as mean_range, round(quantile_cont(r, 0.5), 6) as median_range, round(quantile_cont(r, 0.9), 6) as p90_range, max(r) as max_range, round(avg(case when r >= 2 then cast(1 as double) else 0 end), 6) as share_2 from g group by uses
""", "skim_a skim_b")
def offset_spread(t):
    return tidy(op.offset_spread([t.skim_a, t.skim_b], ["RO", "AF"]))


@query("across_offsets", "with m as (select route as metric, from_id, avg(total_time) as v from minutes group by all) select metric, round(avg(v), 6) as mean, round(min(v), 6) as min, round(max(v), 6) as max from m group by metric", "minutes")
def across_offsets(t):
    return tidy(op.across_offsets(t.minutes.groupBy(F.col("route").alias("metric"), "from_id").agg(F.avg("total_time").alias("value"))))


@query("attribution", f"""
with {_BOTH}, s as (select d.*, jobs, (ua and not ub) or (not ua and not ub and pa - pb >= 2) as sel, (list_contains(string_split_regex(coalesce(tb, ''), '[;|]'), 'AO') and not list_contains(string_split_regex(coalesce(ta, ''), '[;|]'), 'AO')) or (list_contains(string_split_regex(coalesce(tb, ''), '[;|]'), 'NO') and not list_contains(string_split_regex(coalesce(ta, ''), '[;|]'), 'NO')) as via from d join jobs on to_id = zone)
select from_id, coalesce(sum(jobs) filter (sel), 0)::bigint as jobs_faster, coalesce(sum(jobs) filter (sel and via), 0)::bigint as jobs_via, coalesce(sum(jobs) filter (sel and not ub and pb <= 25 and (ua or pa > 25)), 0)::bigint as jobs_new_within from s group by from_id
""", "skim_a skim_b jobs")
def attribution(t):
    return tidy(op.attribution(t.skim_a, t.skim_b, t.jobs, ["AO", "NO"], 2.0, 25.0))


@query("reach", f"""
with {_BOTH}, r as (select from_id, to_id, case when not ua then pa end as t0, case when not ub then pb end as t1 from j where from_id in (3, 8, 21))
select * from r where t0 <= 25 or t1 <= 25 or t0 - t1 >= 2
""", "skim_a skim_b")
def reach(t):
    return tidy(op.reach(t.skim_a, t.skim_b, [3, 8, 21], 2.0, 25.0))


@query("gateway_legs", """
with q as (select case when zone % 2 = 0 then 'in' else 'out' end as dir, zone % 4 as gateway, zone, residents as trips from residents),
  k as (select *, case when dir = 'in' then gateway else zone end as from_id, case when dir = 'in' then zone else gateway end as to_id from q),
  j as (select k.*, case when not a.unreachable then a.p50 end as t0, case when not b.unreachable then b.p50 end as t1 from k left join skim_a a using (from_id, to_id) left join skim_b b using (from_id, to_id))
select dir, gateway, sum(trips)::bigint as trips, coalesce(sum(trips) filter (t0 is not null and t1 is not null), 0)::bigint as compared, round(sum((t1 - t0) * trips) / sum(trips) filter (t0 is not null and t1 is not null), 6) as mean_change, coalesce(sum(trips) filter (t1 - t0 <= -2), 0)::bigint as faster, coalesce(sum(trips) filter (t1 - t0 >= 2), 0)::bigint as slower,
  coalesce(sum(trips) filter (t0 is null and t1 is not null), 0)::bigint as gained, coalesce(sum(trips) filter (t0 is not null and t1 is null), 0)::bigint as lost, round(coalesce(sum((t0 - t1) * trips) / 60, 0), 6) as person_hours from j group by all
""", "skim_a skim_b residents")
def gateway_legs(t):
    trips = t.residents.select(F.when(F.col("zone") % 2 == 0, "in").otherwise("out").alias("dir"), (F.col("zone") % 4).alias("gateway"), "zone", F.col("residents").alias("trips"))
    return tidy(op.gateway_legs(trips, t.skim_a, t.skim_b))


@query("network_change", f"""
with {_BOTH} select count(*) as pairs, count(*) filter (not ua and ub) as lost, count(*) filter (ua and not ub) as gained, round(quantile_cont(d, 0.05), 6) as p5, round(quantile_cont(d, 0.5), 6) as median, round(quantile_cont(d, 0.95), 6) as p95,
  round(avg(case when d <= -2 then cast(1 as double) when d is not null then 0 end), 6) as share_faster, round(avg(case when d >= 2 then cast(1 as double) when d is not null then 0 end), 6) as share_slower, round(avg(dw) filter (d is not null), 6) as walk_change from d
""", "skim_a skim_b")
def network_change(t):
    return tidy(op.skim_change(t.skim_a, t.skim_b, ["walk"]))


@query("spot_checks", """
with s as (select from_id, to_id, min(total_time) as best, quantile_cont(total_time, 0.25) as p25, quantile_cont(total_time, 0.5) as p50, quantile_cont(total_time, 0.75) as p75, cast((from_id * 7 + to_id * 3) % 50 as double) as o from minutes group by all)
select from_id, to_id, case when abs(o - best) <= best * cast(0.15 as double) then 'A' when o between p25 and p75 or abs(o - p50) <= p50 * cast(0.15 as double) then 'B' else 'none' end as verdict from s
""", "minutes")
def spot_checks(t):
    q = lambda p: F.percentile("total_time", F.lit(p))
    s = t.minutes.groupBy("from_id", "to_id").agg(F.min("total_time").alias("best"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"))
    s = s.withColumn("observed", ((F.col("from_id") * 7 + F.col("to_id") * 3) % 50).cast("double"))
    return op.spot_checks(s).select("from_id", "to_id", "verdict")
