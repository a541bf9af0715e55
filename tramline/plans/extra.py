"""Queries on relational primitives, sensors, sweeps and running costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import calibration, costs, demand, relational, spatial
from tramline.plans.more import D
from tramline.plans.registry import query
from tramline.plans.tidy import tidy
from tramline.sources import tables


@query("glob_scan", "select 'nation' as site, count(*) as n from nation")
def glob_scan(t):
    return tables.read_pattern(t.spark, f"{t.dir}/natio*.parquet").groupBy("site").agg(F.count("*").alias("n"))


@query("one_to_one", "select c_custkey as id, c_name, n from customer join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def one_to_one(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return relational.join_one_to_one(t.customer.select(F.col("c_custkey").alias("id"), "c_name"), n, ["id"])


@query("row_ids", "select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as row_id from orders")
def row_ids(t):
    return relational.row_ids(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_id")


@query("loss_by_key", "select o_custkey as id, count(*) as before, count(*) filter (where o_orderstatus <> 'P') as after, round(count(*) filter (where o_orderstatus = 'P') / cast(count(*) as double), 6) as lost, count(*) filter (where o_orderstatus = 'P') > 0.1 * count(*) as flagged from orders group by 1")
def loss_by_key(t):
    o = t.orders.withColumnRenamed("o_custkey", "id")
    return tidy(relational.loss_by_key(o, o.filter("o_orderstatus <> 'P'"), ["id"]))


@query("class_changes", "with a as (select p_partkey, p_brand as c from part where p_size > 5), b as (select p_partkey, p_type as c from part where p_size < 45) select a.c as was, b.c as now, count(*) as rows from a full join b using (p_partkey) group by all")
def class_changes(t):
    return relational.class_changes(t.part.filter("p_size > 5").select("p_partkey", F.col("p_brand").alias("c")), t.part.filter("p_size < 45").select("p_partkey", F.col("p_type").alias("c")), ["p_partkey"], "c")


@query("gaps_with_edges", """
with w as (select distinct user_id as k, timestamp '2024-01-01 06:00:00' as s, timestamp '2024-01-20 20:00:00' as e from events), p as (select user_id as k, ts as t, 1 as n from events join w on k = user_id where ts between s and e union all select k, s, 0 from w union all select k, e, 0 from w),
  g as (select *, epoch(t) - epoch(lag(t) over (partition by k order by t, n)) as gap from p)
select k, cast(sum(n) as bigint) as polls, round(sum(case when gap > 7200 then gap / 60 else 0 end), 4) as gap_min from g group by k
""")
def gaps_with_edges(t):
    e = t.events.select(F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("ts"))
    w = e.select("k").distinct().select("k", F.lit("2024-01-01 06:00:00").cast("timestamp").alias("start"), F.lit("2024-01-20 20:00:00").cast("timestamp").alias("end"))
    return tidy(relational.gaps_with_edges(e, w, "k", "ts", 7200.0), 4)


@query("opex_lines", f"""
with a as (select c_mktsegment as mode, sum(c_acctbal) as km, case when c_mktsegment <> 'BUILDING' then {D(2.5)} end as rate from customer where c_custkey % 3 <> 0 and c_mktsegment <> 'MACHINERY' group by all), b as (select c_mktsegment as mode, sum(c_acctbal) as km from customer where c_custkey % 3 = 0 and c_mktsegment <> 'FURNITURE' group by all)
select mode, round(coalesce(a.km, 0) - coalesce(b.km, 0), 4) as extra_km, round((coalesce(a.km, 0) - coalesce(b.km, 0)) * 300, 4) as yearly, round((coalesce(a.km, 0) - coalesce(b.km, 0)) * 300 * rate, 4) as cost from a full join b using (mode)
""")
def opex_lines(t):
    c = t.customer.withColumnRenamed("c_mktsegment", "mode")
    km = lambda df: df.groupBy("mode").agg(F.sum("c_acctbal").alias("km"))
    after = km(c.filter("c_custkey % 3 <> 0 and mode <> 'MACHINERY'")).withColumn("rate", F.when(F.col("mode") != "BUILDING", F.lit(2.5)))
    return tidy(costs.opex_lines(km(c.filter("c_custkey % 3 = 0 and mode <> 'FURNITURE'")), after, 300.0), 4)


@query("cost_completeness", "with l as (select item, kind, unit is null and item % 9 <> 0 as open from prices) select kind, count(*) as lines, count(*) filter (where open) as not_costed, count(*) filter (where open) = 0 as complete, coalesce(sum(item) filter (where open), 0)::bigint as item_sum from l group by kind", "prices")
def cost_completeness(t):
    p = t.prices.select("item", "kind", (F.col("qty") * F.col("unit")).alias("cost_high"), F.when(F.col("item") % 9 == 0, "upper").alias("bound"))
    got = costs.completeness(p, "item", "kind")
    return got.select("kind", "lines", "not_costed", "complete", F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x).alias("item_sum"))


_SITE = "sg as (select s_suppkey as id, s_suppkey % 3 as ref, cast(-2.6 as double) + (s_suppkey % 10) * cast(0.01 as double) as lon, cast(51.4 as double) + floor(s_suppkey / 10) * cast(0.01 as double) as lat, (s_suppkey * 37 % 360)::double as b, s_acctbal as f from supplier)"


@query("site_factors", f"""
with {_SITE}, st as (select * from sg where id % 8 = 0), p as (select a.id, s.id as sid, s.f, {D(111.32)} * sqrt(pow((a.lon - s.lon) * cos(radians((a.lat + s.lat) / 2)), 2) + pow(a.lat - s.lat, 2)) as km from sg a join st s on a.ref = s.ref and abs(mod(mod(a.b - s.b + 180, 360) + 360, 360) - 180) < 90),
  n as (select * from (select *, row_number() over (partition by id order by km, sid) as k from p where km <= 2) where k = 1)
select sg.id, round(coalesce(n.f, (select quantile_cont(f, 0.5) from st)), 6) as factor, case when km * 1000 < 50 then 'site' when n.f is not null then 'nearest_site' else 'mean' end as source from sg left join n using (id)
""")
def site_factors(t):
    k = F.col("s_suppkey")
    s = t.supplier.select(k.alias("id"), (k % 3).alias("ref"), (F.lit(-2.6) + (k % 10) * F.lit(0.01)).alias("lon"), (F.lit(51.4) + F.floor(k / 10) * F.lit(0.01)).alias("lat"), (k * 37 % 360).cast("double").alias("bearing"), F.col("s_acctbal").alias("factor"))
    return tidy(calibration.site_factors(s.drop("factor"), s.filter("id % 8 = 0"), 2.0))


@query("sensor_speeds", f"""
with k as (select distinct cast(ts as date) as day from events), d as (select day, case when isodow(day) >= 6 then 'weekend' when isodow(day) in (2, 3, 4) then 'neutral' else 'weekday_other' end as kind from k),
  r as (select user_id % 10 as site, hour(ts) * 60 + minute(ts) as m, hour(ts) as h, kind, value as mph, event_id % 8 as v from events join d on cast(ts as date) = day where value > 0 and event_id % 8 > 0),
  o as (select *, case when kind = 'weekend' then 'WE' when kind = 'neutral' then (case when m >= 420 and m < 600 then 'AM' when m >= 600 and m < 960 then 'IP' when m >= 960 and m < 1140 then 'PM' else 'OP' end) end as own from r), p as (select *, own as period from o where own is not null union all select *, 'AMPH' from o where own = 'AM' and h = 8)
select site, period, round(sum(v) / sum(v / (mph * {D(1.609344)})), 6) as kmh, count(*) as rows from p group by all
""")
def sensor_speeds(t):
    e = t.events.select((F.col("user_id") % 10).alias("site"), "ts", F.col("value").alias("mph"), (F.col("event_id") % 8).alias("volume"))
    days = t.events.select(F.to_date("ts").alias("day")).distinct()
    kind = F.when(F.weekday("day") >= 5, "weekend").when(F.weekday("day").between(1, 3), "neutral").otherwise("weekday_other")
    return tidy(calibration.sensor_speeds(e, days.withColumn("day_type", kind)))


@query("odd_origins", f"with p as (select l_suppkey as id, l_partkey as target, l_quantity * 30 as m, case when l_linenumber % 3 > 0 then l_quantity * l_linenumber / 2 end as w, row_number() over (partition by l_suppkey order by l_quantity * 30, l_partkey, l_orderkey, l_linenumber, l_extendedprice) as k from lineitem) select id, target, m as straight_m, w as walk_min from p where k = 1 and m <= {D(90)} and (w is null or w * 80 > 3 * m + 240)")
def odd_origins(t):
    x = t.lineitem.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("target"), (F.col("l_quantity") * 30).alias("straight_m"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity") * F.col("l_linenumber") / 2).alias("walk_min"))
    return spatial.odd_origins(x, 90.0)


@query("score_sweep", """
with rc as (select from_id as oa, to_id as cluster_id, min(wait) as w from minutes group by all), v as (select * from (values ('usual', cast(1 as double)), ('slow', cast(0.5 as double)), ('careful', cast(0.85 as double))) v(variant, scale)),
  g as (select variant, oa, sum(exp(-(w / scale) / 10) * least((s_suppkey % 9) + 1, 12)) as score from rc join supplier on s_suppkey = cluster_id cross join v group by all)
select variant, zone as oa, round(coalesce(score, 0), 6) as score from residents cross join v left join g on g.oa = zone and g.variant = v.variant
""".replace("select variant, zone as oa", "select v.variant, zone as oa"), "minutes residents")
def score_sweep(t):
    reach = t.minutes.groupBy(F.col("from_id").alias("oa"), F.col("to_id").alias("cluster_id")).agg(F.min("wait").alias("walk_min"))
    level = t.supplier.select(F.col("s_suppkey").alias("cluster_id"), ((F.col("s_suppkey") % 9) + 1.0).alias("dph_one_way"))
    return tidy(spatial.score_sweep(t.residents.select(F.col("zone").alias("oa")), reach, level, {"usual": 1.0, "slow": 0.5, "careful": 0.85}, 10.0, "oa"))


@query("matrix_steps", f"with a as (select sum(trips) as t from flows), b as (select sum(trips) as t from flows where o <> d), c as (select sum(trips * {D(0.9)}) as t from flows where o <> d) select 1::bigint as step, cast((select t from a) as double) as total, {D(0)} as change union all select 2, (select t from b), (select t from b) - (select t from a) union all select 3, round((select t from c), 4), round((select t from c) - (select t from b), 4)", "flows")
def matrix_steps(t):
    f = t.flows.select("o", "d", F.col("trips").cast("double").alias("trips"))
    inside = f.filter("o <> d")
    return tidy(demand.matrix_steps([f, inside, inside.withColumn("trips", F.col("trips") * 0.9)]), 4)


_KB = "k, b from (select *, case when (jt * pp - pt * pj) / det >= 0 then (pt * jj - jt * pj) / det else pt / pp end as k, greatest((jt * pp - pt * pj) / det, 0) as b from (select *, pp * jj - pj * pj as det from o))"


@query("profile_folds", f"""
with r as (select p_partkey % 4 as fold, {D('p_size * 2 + p_partkey % 7')} as t, {D('p_size')} as p, {D('p_partkey % 9')} as j, {D('p_partkey % 3 + 1')} as w from part), f as (select distinct fold from r),
  o as (select f.fold, sum(w * p * p) as pp, sum(w * p * j) as pj, sum(w * j * j) as jj, sum(w * p * t) as pt, sum(w * j * t) as jt from f join r on r.fold <> f.fold group by all), k as (select fold, {_KB}), e as (select fold, sum(w * p) as p, sum(w * j) as j, sum(w * t) as t from r group by fold)
select fold, round(k, 6) as k, round(b, 6) as b, round((k * p + b * j) / t - 1, 6) as error from k join e using (fold)
""")
def profile_folds(t):
    p = F.col("p_partkey")
    rows = t.part.select((p % 4).alias("fold"), (F.col("p_size") * 2 + p % 7).cast("double").alias("t"), F.col("p_size").cast("double").alias("profile"), (p % 9).cast("double").alias("junctions"), (p % 3 + 1).cast("double").alias("w"))
    return tidy(calibration.profile_folds(rows, "fold"))


@query("comparison", "with a as (select p_brand as metric, avg(p_size) as value from part where p_brand <> 'Brand#2' group by 1), b as (select p_brand as metric, avg(p_retailprice) as value from part where p_brand <> 'Brand#7' group by 1) select metric, round(a.value, 6) as a, round(b.value, 6) as b, round(b.value - a.value, 4) as change from a full join b using (metric)")
def comparison(t):
    m = lambda c, no: t.part.filter(F.col("p_brand") != no).groupBy(F.col("p_brand").alias("metric")).agg(F.avg(c).alias("value"))
    return tidy(relational.comparison(m("p_size", "Brand#2"), m("p_retailprice", "Brand#7"), ["B0"], ["B0", "S1"]))


@query("land_use", f"""
with z as (select c_custkey as zone, c_nationkey as parent, c_custkey % 5 as w from customer), j as (select s_nationkey as parent, count(*) * 100 as jobs from supplier group by 1), x as (select *, sum(w) over (partition by parent) as t, count(*) over (partition by parent) as n from z)
select zone, parent::bigint as parent, zone % 300 as residents, round(coalesce(jobs, 0) * case when t > 0 then w / {D('t')} else {D(1)} / n end, 6) as jobs, 'v1' as version from x left join j using (parent)
""")
def land_use(t):
    k = F.col("c_custkey")
    z = t.customer.select(k.alias("zone"), F.col("c_nationkey").alias("parent"), (k % 5).alias("weight"))
    jobs = t.supplier.groupBy(F.col("s_nationkey").alias("parent")).agg((F.count("*") * 100).alias("jobs"))
    return tidy(demand.land_use(z, t.customer.select(k.alias("zone"), (k % 300).alias("residents")), jobs, "v1"))


@query("event_json", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as digits, '{\"e\":\"' || event_type || '\",\"k\":' || cast(json_extract(props, '$.k') as bigint) || '}' as back from events")
def event_json(t):
    k = F.from_json("props", "k bigint")["k"]
    back = F.to_json(F.struct(F.col("event_type").alias("e"), k.alias("k")))
    return t.events.select("event_id", k.alias("k"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("digits"), back.alias("back"))


_SIDES = "x as (select from_id as zone, avg(p50) as minutes, count(*)::double as reached from skim_a where not unreachable group by 1), y as (select from_id as zone, avg(p50) as minutes, count(*)::double as reached from skim_b where not unreachable and from_id % 9 <> 4 group by 1), z as (select coalesce(x.zone, y.zone) as zone, unnest(['minutes', 'reached']) as metric, unnest([x.minutes, x.reached]) as a, unnest([y.minutes, y.reached]) as b from x full join y on x.zone = y.zone)"


def _sides(t):
    g = lambda df: df.filter("not unreachable").groupBy(F.col("from_id").alias("zone")).agg(F.avg("p50").alias("minutes"), F.count("*").alias("reached"))
    return relational.zone_comparison(g(t.skim_a), g(t.skim_b).filter("zone % 9 <> 4"), "zone", ["minutes", "reached"])


@query("zone_comparison", f"with {_SIDES} select zone, metric, round(a, 6) as a, round(b, 6) as b, round(b - a, 4) + 0 as change from z", "skim_a skim_b")
def zone_comparison(t):
    return tidy(_sides(t))


@query("comparison_report", f"""
with {_SIDES}, r as (select z.*, coalesce(residents, 0) as w, case when metric = 'minutes' then a - b else b - a end as gain from z left join residents using (zone))
select metric, count(a + b) as zones, round(sum(a * w) filter (b is not null) / sum(w) filter (a is not null and b is not null), 6) as a, round(sum(b * w) filter (a is not null) / sum(w) filter (a is not null and b is not null), 6) as b,
  round(sum(b * w) filter (a is not null) / sum(w) filter (a is not null and b is not null) - sum(a * w) filter (b is not null) / sum(w) filter (a is not null and b is not null), 4) as change, sum(case when gain >= 1 then w else 0 end)::double as better, sum(case when -gain >= 1 then w else 0 end)::double as worse, sum(case when gain is null then w else 0 end)::double as not_compared from r group by metric
""", "skim_a skim_b residents")
def comparison_report(t):
    return tidy(relational.comparison_report(_sides(t), t.residents.withColumnRenamed("residents", "weight"), "zone", ["minutes"], 1.0))
