"""Queries by place: octants, clusters, coverage, gap map."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.config import GAP_BANDS_KM
from tramline.functions import geo, stats
from tramline.functions.curves import logistic
from tramline.operators import spatial as op
from tramline.plans.registry import query
from tramline.plans.tidy import tidy

_KM = "cast(111.32 as double) * sqrt(pow((a.lon - b.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + pow(a.lat - b.lat, 2))"


@query("octant", """
with p as (select s_suppkey as id, (s_suppkey % 13) - 6 as dx, (s_suppkey % 7) - 3 as dy from supplier), b as (select id, case when degrees(atan2(dx, dy)) < 0 then degrees(atan2(dx, dy)) + 360 else degrees(atan2(dx, dy)) end as deg from p)
select id, round(deg, 6) as deg, (floor((deg + 22.5) / 45) % 8)::bigint as oct from b
""")
def octant(t):
    deg = F.pmod(F.degrees(F.atan2((F.col("s_suppkey") % 13 - 6).cast("double"), (F.col("s_suppkey") % 7 - 3).cast("double"))), F.lit(360.0))
    return tidy(t.supplier.select(F.col("s_suppkey").alias("id"), deg.alias("deg"), geo.octant(deg).alias("oct")))


@query("haversine", "select a.id, b.id as other, round(2 * cast(6371.0088 as double) * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 6) as km from zones a join zones b on b.id = a.id + 1", "zones")
def haversine(t):
    a, b = t.zones, t.zones.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return tidy(a.join(b, "id").select("id", "other", geo.haversine_km(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")).alias("km")))


@query("near_pairs", f"select a.id as a, b.id as b, round({_KM}, 6) as km from zones a join zones b on a.id < b.id where {_KM} <= cast(1.2 as double)", "zones")
def near_pairs(t):
    z = t.zones
    return tidy(op.near_pairs(z, z, 1.2).filter("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("dist_km").alias("km")))


@query("candidate_pairs", f"select a.id as a, b.id as b, round({_KM} * 1000, 6) as dist_m from zones a join zones b on a.id < b.id where {_KM} * 1000 <= 800 or (a.name = b.name and {_KM} * 1000 <= 2500)", "zones")
def candidate_pairs(t):
    return tidy(op.candidate_pairs(t.zones, "id", "name", 2500.0, 800.0))


@query("clusters", f"""
with recursive e as (select a.id as a, b.id as b from zones a join zones b on a.id <> b.id where {_KM} <= cast(0.75 as double) and (a.id + b.id) % 4 <> 1), r as (select id, id as c from zones union select r.id, e.b from r join e on r.c = e.a)
select id, min(c) as cluster_id from r group by id
""", "zones")
def clusters(t):
    z = t.zones
    p = op.near_pairs(z, z, 0.75).filter("a_id <> b_id and (a_id + b_id) % 4 <> 1").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return op.clusters(p, z, "id")


@query("decay_weight", "select p_partkey as id, round(cast(1 as double) / (cast(1 as double) + exp((p_size - 20) / cast(6 as double))), 6) as w from part")
def decay_weight(t):
    return tidy(t.part.select(F.col("p_partkey").alias("id"), logistic(F.col("p_size").cast("double"), 20.0, 6.0).alias("w")))


_CLASS = """
  c as (select p_partkey as id, cast(p_size as double) as headway, p_retailprice % 1200 as m from part), k as (select *, case when headway < 5 then 1 when headway < 10 then 2 when headway < 20 then 3 when headway < 40 then 4 when headway < 60 then 5 end as cat,
    case when m <= 300 then 0 when m <= 500 then 1 when m <= 750 then 2 when m <= 1000 then 3 end as band from c)
"""


@query("are_class", f"with {_CLASS} select id, cat::bigint as category, ['A', 'B', 'C', 'D'][greatest(cat - 2, 0) + band + 1] as class from k")
def are_class(t):
    cat = op.stop_category(F.col("p_size").cast("double"))
    return tidy(t.part.select(F.col("p_partkey").alias("id"), cat.alias("category"), op.access_class(cat, F.col("p_retailprice") % 1200).alias("class")))


@query("oa_jobs_split", """
with z as (select c_custkey as oa, c_nationkey as parent, case when c_nationkey % 6 = 0 then 0 else c_custkey % 5 end as w from customer), j as (select s_nationkey as parent, count(*) * 100 as jobs from supplier where s_nationkey % 4 <> 3 group by all), t as (select *, sum(w) over (partition by parent) as t, count(*) over (partition by parent) as n from z)
select oa, round(coalesce(jobs, 0) * case when t > 0 then w / cast(t as double) else cast(1 as double) / n end, 6) as jobs, t = 0 as equal_split from t left join j using (parent)
""")
def oa_jobs_split(t):
    z = t.customer.select(F.col("c_custkey").alias("oa"), F.col("c_nationkey").alias("parent"), F.when(F.col("c_nationkey") % 6 == 0, 0).otherwise(F.col("c_custkey") % 5).alias("w"))
    j = t.supplier.filter("s_nationkey % 4 <> 3").groupBy(F.col("s_nationkey").alias("parent")).agg((F.count("*") * 100).alias("jobs"))
    return tidy(op.split_jobs(z, "parent", "w", j).select("oa", "jobs", "equal_split"))


@query("walk_diagnostics", """
with p as (select p_size * cast(20 as double) as s, p_size * cast(20 as double) * (1 + (p_partkey % 60) / cast(10 as double)) as n from part), r as (select n / s as r from p where s >= 100)
select count(*) as pairs, round(quantile_cont(r, 0.5), 6) as median, round(quantile_cont(r, 0.95), 6) as p95, round(quantile_cont(r, 0.99), 6) as p99, count(*) filter (r > cast(3.05 as double)) as over_3, count(*) filter (r > cast(5.05 as double)) as over_5 from r
""")
def walk_diagnostics(t):
    s = F.col("p_size") * 20.0
    out = op.walk_diagnostics(t.part.select(s.alias("straight_m"), (s * (1 + (F.col("p_partkey") % 60) / F.lit(10.0))).alias("network_m")))
    r = t.part.select(s.alias("s"), (s * (1 + (F.col("p_partkey") % 60) / F.lit(10.0)) / s).alias("r")).filter("s >= 100")
    # Whole tenths fall on 3 and 5; counted here half a tenth beyond, where rounding can't matter.
    n = r.agg(F.sum((F.col("r") > 3.05).cast("long")).alias("over_3"), F.sum((F.col("r") > 5.05).cast("long")).alias("over_5")).withColumn("k", F.lit(1))
    return tidy(out.drop("over_3", "over_5").withColumn("k", F.lit(1)).join(n, "k").drop("k"))


_GAP = f"""
  pt as (select from_id % 25 as o, to_id % 25 as d, sum(p50 * n) / sum(n) as pt_gc from skim_a where not unreachable group by all), car0 as (select from_id % 25 as o, to_id % 25 as d, sum(ride * n) / sum(n) as car_low from skim_b group by all), car as (select *, car_low + case when d < 5 then 14 when d < 15 then 5 else 2 end as car_high from car0),
  pos as (select id as o, lon, lat from zones where id < 25), gap as (select f.o, f.d, f.trips, case when f.o = f.d then 'intrazonal' else case {' '.join(f"when km >= {lo:g} and km < {hi:g} then '{n}'" for n, lo, hi in GAP_BANDS_KM)} else '> 10 km' end end as band, pt_gc, car_low, car_high, pt_gc / car_high as ratio from
    (select f.*, {_KM} as km from flows f join pos a on a.o = f.o join pos b on b.o = f.d) f left join pt on pt.o = f.o and pt.d = f.d left join car on car.o = f.o and car.d = f.d)
"""


def _gap(t):
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    key = [(F.col("from_id") % 25).alias("o"), (F.col("to_id") % 25).alias("d")]
    pt = t.skim_a.filter("not unreachable").groupBy(*key).agg(mean("p50").alias("pt_gc"))
    car = t.skim_b.groupBy(*key).agg(mean("ride").alias("car_low"))
    car = car.withColumn("car_high", F.col("car_low") + F.when(F.col("d") < 5, 14).when(F.col("d") < 15, 5).otherwise(2))
    pos = t.zones.filter("id < 25")
    a, b = pos.select(F.col("id").alias("o"), F.col("lon").alias("x1"), F.col("lat").alias("y1")), pos.select(F.col("id").alias("d"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    rows = t.flows.join(a, "o").join(b, "d").join(pt, ["o", "d"], "left").join(car, ["o", "d"], "left")
    km = geo.flat_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    band = F.when(F.col("o") == F.col("d"), "intrazonal")
    for n, lo, hi in GAP_BANDS_KM:
        band = band.when((km >= lo) & (km < hi), n)
    return rows.withColumn("band", band.otherwise("> 10 km")).withColumn("ratio", F.col("pt_gc") / F.col("car_high")).select("o", "d", "trips", "band", "pt_gc", "car_low", "car_high", "ratio")


@query("gap_map", f"with {_GAP} select o::bigint as o, d::bigint as d, trips, band, round(pt_gc, 6) as pt_gc, round(car_low, 6) as car_low, round(car_high, 6) as car_high, round(ratio, 6) as ratio from gap", "flows skim_a skim_b zones")
def gap_map(t):
    return tidy(_gap(t))


@query("gap_bands", f"""
with {_GAP}, ok as (select * from gap where pt_gc is not null and car_low is not null), l as (select band, trips, pt_gc, car_high from ok union all select 'all', trips, pt_gc, car_high from ok)
select band, count(*) as pairs, sum(trips)::bigint as trips, round(sum(pt_gc * trips) / sum(car_high * trips), 6) as ratio from l group by band
""", "flows skim_a skim_b zones")
def gap_bands(t):
    ok = _gap(t).filter("pt_gc is not null and car_low is not null").withColumns({"x": F.col("pt_gc") * F.col("trips"), "y": F.col("car_high") * F.col("trips")})
    g = ok.rollup("band").agg(F.count("*").alias("pairs"), F.sum("trips").alias("trips"), (F.sum("x") / F.sum("y")).alias("ratio"))
    return tidy(g.withColumn("band", F.coalesce("band", F.lit("all"))))


@query("gap_headline", f"""
with {_GAP}, w0 as (select ratio, sum(trips) as w from gap where ratio is not null group by ratio), w1 as (select *, sum(w) over (order by ratio rows unbounded preceding) as c, sum(w) over () as t from w0)
select round(sum(pt_gc * trips) / sum(car_high * trips), 6) as ratio, (select round(min(ratio), 6) from w1 where c >= t / 2) as median_ratio, count(*) as pairs from gap where pt_gc is not null and car_high is not null
""", "flows skim_a skim_b zones")
def gap_headline(t):
    gap = _gap(t).filter("pt_gc is not null and car_high is not null").withColumn("k", F.lit(1))
    med = stats.weighted_median(gap, ["k"], "ratio", "trips", "median_ratio")
    s = gap.groupBy("k").agg((F.sum(F.col("pt_gc") * F.col("trips")) / F.sum(F.col("car_high") * F.col("trips"))).alias("ratio"), F.count("*").alias("pairs"))
    return tidy(s.join(med, "k").drop("k"))


@query("origin_summary", f"with {_GAP} select o::bigint as o, count(*) as pairs, sum(trips)::bigint as trips, round(sum(pt_gc * trips) / sum(car_low * trips), 6) as ratio, round(sum((pt_gc - car_high) * trips) / sum(trips), 6) as gap_min from gap where pt_gc is not null and car_low is not null group by o", "flows skim_a skim_b zones")
def origin_summary(t):
    ok = _gap(t).filter("pt_gc is not null and car_low is not null")
    n = F.col("trips")
    return tidy(ok.groupBy("o").agg(F.count("*").alias("pairs"), F.sum(n).alias("trips"), (F.sum(F.col("pt_gc") * n) / F.sum(F.col("car_low") * n)).alias("ratio"), (F.sum((F.col("pt_gc") - F.col("car_high")) * n) / F.sum(n)).alias("gap_min")))


@query("top_pairs", f"with {_GAP} select o::bigint as o, d::bigint as d, round(trips * greatest(pt_gc - car_high, 0), 4) as burden from gap where pt_gc is not null order by round(trips * greatest(pt_gc - car_high, 0), 4) desc, o, d limit 20", "flows skim_a skim_b zones")
def top_pairs(t):
    v = F.round(F.col("trips") * F.greatest(F.col("pt_gc") - F.col("car_high"), F.lit(0.0)), 4)
    return _gap(t).filter("pt_gc is not null").select(F.col("o").cast("long").alias("o"), F.col("d").cast("long").alias("d"), v.alias("burden")).orderBy(F.desc("burden"), "o", "d").limit(20)


@query("terminal_time_robustness", f"""
with {_GAP}, q as (select o * 100 + d as id, pt_gc / car_low as a, pt_gc / car_high as b from gap where pt_gc is not null and car_low is not null),
  r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / cast(2 as double) as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / cast(2 as double) as rb from q)
select round(corr(ra, rb), 4) as rho, count(*) as n from r
""", "flows skim_a skim_b zones")
def terminal_time_robustness(t):
    gap = _gap(t).select((F.col("pt_gc") / F.col("car_low")).alias("a"), (F.col("pt_gc") / F.col("car_high")).alias("b"))
    return tidy(stats.spearman(gap, "a", "b"), 4)


@query("saved_bands", """
with d as (select a.from_id, avg(a.p50 - b.p50) as s from skim_a a join skim_b b using (from_id, to_id) where not a.unreachable and not b.unreachable group by 1)
select case when s >= 10 then '10+' when s >= 5 then '5-10' when s >= 2 then '2-5' when s >= 1 then '1-2' when s > -1 then 'unchanged' else 'slower' end as band, sum(residents)::bigint as residents from d join residents on zone = from_id group by 1
""", "skim_a skim_b residents")
def saved_bands(t):
    from tramline.operators.skims import both

    d = both(t.skim_a, t.skim_b, ["p50", "unreachable"]).filter("not unreachable_a and not unreachable_b").groupBy("from_id").agg(F.avg(F.col("p50_a") - F.col("p50_b")).alias("s"))
    s = F.col("s")
    band = F.when(s >= 10, "10+").when(s >= 5, "5-10").when(s >= 2, "2-5").when(s >= 1, "1-2").when(s > -1, "unchanged").otherwise("slower")
    return d.join(t.residents.withColumnRenamed("zone", "from_id"), "from_id").groupBy(band.alias("band")).agg(F.sum("residents").alias("residents"))
