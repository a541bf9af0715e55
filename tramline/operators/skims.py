"""Operators over origin-destination skims: summaries, generalised cost, offsets, differences, accessibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import DECAY_BETA, GC_WEIGHTS, REACH_SHARE, WAIT_CURVE
from tramline.functions.curves import interpolate
from tramline.functions.stats import average_rank, qualify, ranked, sum_before, top_names

PAIR = ["from_id", "to_id"]


def skim_summary(rows: DataFrame, slots: int, routes: bool = True) -> DataFrame:
    """One row a pair from per-minute rows (total_time, wait, ride, walk, n_rides, route); `slots` minutes were asked for.

    A minute without rides is walking only. Percentiles are nearest ranks in which a missing minute is infinite; r_* are
    means over minutes with rides; a pair is unreachable where fewer than half of the slots have a journey.
    """
    rides = F.col("n_rides") >= 1
    over = lambda c: F.avg(F.when(rides, F.col(c)))
    out = rows.groupBy(*PAIR).agg(
        F.avg("total_time").alias("total"), F.min("total_time").alias("best"), F.sort_array(F.collect_list("total_time")).alias("_t"),
        F.avg("wait").alias("wait"), F.avg("walk").alias("walk"), F.avg("ride").alias("ride"), F.avg("n_rides").alias("rides"),
        over("wait").alias("r_wait"), over("walk").alias("r_walk"), over("ride").alias("r_ride"), F.avg(rides.cast("double")).alias("ride_share"),
        (F.count("*") / F.lit(slots)).alias("reach_share"), F.avg((~rides).cast("double")).alias("walk_only_share"),
    )
    # A pair has a row a minute, so its list is no longer than the slots.
    out = out.withColumns({f"p{p}": ranked("_t", p / 100, F.lit(slots)) for p in (25, 50, 75)} | {"unreachable": F.col("reach_share") < REACH_SHARE}).drop("_t")
    return out.join(top_names(rows.filter(rides), PAIR, "route"), PAIR, "left") if routes else out


def gc_from_components(ride: Column, walk: Column, wait: Column, transfers: Column, w: dict[str, float] = GC_WEIGHTS) -> Column:
    return ride * w["ride"] + walk * w["walk"] + wait * w["wait"] + transfers * w["transfer"]


def gc_with_curve(total: Column, best: Column, wait: Column, ride: Column, walk: Column, transfers: Column, curve: list[tuple[float, float]] = WAIT_CURVE) -> Column:
    """As above, but the wait for the first vehicle (total - best, between 0 and the whole wait) is half a headway and goes through the curve."""
    first = F.least(F.greatest(total - best, F.lit(0.0)), wait)
    return ride * GC_WEIGHTS["ride"] + walk * GC_WEIGHTS["walk"] + (interpolate(first * 2, curve) + (wait - first)) * GC_WEIGHTS["wait"] + transfers * GC_WEIGHTS["transfer"]


def masked(skim: DataFrame) -> DataFrame:
    """Costs are null where a pair is unreachable, and ride costs where rides are rarer than half."""
    return skim.withColumn("gc_min", F.when(~F.col("unreachable"), F.col("gc_min"))).withColumn("gc_ride_min", F.when(~F.col("unreachable") & (F.col("ride_share") >= 0.5), F.col("gc_ride_min")))


def combine_offsets(frames: list[DataFrame], means: list[str]) -> DataFrame:
    """One skim of several timetable offsets: means over the offsets that reach the pair, the range of p50, reachable only if at all."""
    rows = reduce(DataFrame.unionByName, [f.select(*PAIR, *means, "unreachable") for f in frames])
    ok = ~F.col("unreachable")
    out = rows.groupBy(*PAIR).agg(*[F.avg(F.when(ok, F.col(c))).alias(c) for c in means], F.min(F.when(ok, F.col("p50"))).alias("p50_min_offsets"), F.max(F.when(ok, F.col("p50"))).alias("p50_max_offsets"), F.sum(ok.cast("int")).alias("offsets_reachable"))
    return out.withColumn("offsets", F.lit(len(frames))).withColumn("unreachable", F.col("offsets_reachable") < len(frames))


def jobs_within(skim: DataFrame, jobs: DataFrame, thresholds: list[int], time: str = "p50") -> DataFrame:
    """Per origin: jobs at destinations within each threshold. jobs: zone, jobs."""
    j = skim.filter(~F.col("unreachable")).join(jobs.withColumnRenamed("zone", "to_id"), "to_id", "left")
    n = F.coalesce("jobs", F.lit(0))
    return j.groupBy("from_id").agg(*[F.sum(F.when(F.col(time) <= t, n).otherwise(0)).alias(f"jobs_{t}") for t in thresholds])


def access_summary(acc: DataFrame, residents: DataFrame, edge: Column, columns: list[str]) -> DataFrame:
    """Per measure: median over core and edge origins, mean weighted by residents; origins without access count 0."""
    base = residents.join(acc.withColumnRenamed("from_id", "zone"), "zone", "left")
    rows = base.select("residents", edge.alias("edge"), F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.coalesce(F.col(c), F.lit(0)).cast("double").alias("v")) for c in columns])).alias("m")).select("residents", "edge", "m.*")
    half = lambda c: F.percentile(F.when(c, F.col("v")), F.lit(0.5))
    return rows.groupBy("measure").agg(half(~F.col("edge")).alias("median_core"), half(F.col("edge")).alias("median_edge"), (F.sum(F.col("v") * F.col("residents")) / F.sum("residents")).alias("weighted_mean"))


def connectivity(skim: DataFrame, jobs: DataFrame, car_jobs: DataFrame, threshold: int, beta: float = DECAY_BETA) -> DataFrame:
    """Per origin: jobs within the threshold, decayed jobs sum(jobs e^(-beta t)), and the ratio to jobs by car (null where that is 0)."""
    j = skim.filter(~F.col("unreachable")).join(jobs.withColumnRenamed("zone", "to_id"), "to_id", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0)))
    out = j.groupBy("from_id").agg(F.sum(F.when(F.col("p50") <= threshold, F.col("jobs")).otherwise(0)).alias("jobs_within"), F.sum(F.col("jobs") * F.exp(F.col("p50") * -beta)).alias("jobs_decayed"))
    out = out.join(car_jobs, "from_id", "left")
    return out.withColumn("pt_car_ratio", F.when(F.col("car_jobs") > 0, F.col("jobs_within") / F.col("car_jobs")))


def both(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs in both skims, columns suffixed _a and _b."""
    cut = lambda s, x: s.select(*PAIR, *[F.col(c).alias(f"{c}_{x}") for c in columns])
    return cut(a, "a").join(cut(b, "b"), PAIR)


def skim_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: reachable, gained and lost pairs, and how p50 changes over pairs reachable in both."""
    j = both(a, b, ["p50", "unreachable"])
    ra, rb = ~F.col("unreachable_a"), ~F.col("unreachable_b")
    d = F.when(ra & rb, F.col("p50_b") - F.col("p50_a"))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return j.agg(
        n(ra).alias("reachable_a"), n(rb).alias("reachable_b"), n(~ra & rb).alias("gained"), n(ra & ~rb).alias("lost"), F.avg(d).alias("mean_change"),
        *[F.percentile(d, F.lit(p)).alias(k) for p, k in ((0.01, "p1"), (0.05, "p5"), (0.95, "p95"))],
        n(d <= -2).alias("faster_2"), n(d >= 2).alias("slower_2"), n(d <= -5).alias("faster_5"),
    )


def largest_gains(a: DataFrame, b: DataFrame, k: int = 8) -> DataFrame:
    j = both(a, b, ["p50", "unreachable"]).filter("not unreachable_a and not unreachable_b").withColumn("d", F.col("p50_b") - F.col("p50_a"))
    return j.orderBy("d", *PAIR).limit(k).select(*PAIR, "p50_a", "p50_b", "d")


def people(a: DataFrame, b: DataFrame, residents: DataFrame, jobs: DataFrame, centre: int, by_min: float = 2.0) -> DataFrame:
    """Per origin with residents: change of time to the centre, of the jobs-weighted mean time, destinations and jobs faster by by_min, destinations gained."""
    j = both(a, b, ["p50", "unreachable"]).join(jobs.withColumnRenamed("zone", "to_id"), "to_id", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0)))
    ok = ~F.col("unreachable_a") & ~F.col("unreachable_b")
    d, at = F.col("p50_b") - F.col("p50_a"), F.col("to_id") == centre
    fast = ok & (d <= -by_min)
    mean = lambda c: F.try_divide(F.sum(F.when(ok, F.col(c) * F.col("jobs"))), F.sum(F.when(ok, F.col("jobs"))))
    g = j.groupBy("from_id").agg(
        F.max(F.when(at & ok, d)).alias("centre_change"), F.max(F.when(at, F.col("unreachable_a") & ~F.col("unreachable_b"))).alias("centre_new"),
        mean("p50_a").alias("time_a"), mean("p50_b").alias("time_b"), F.sum(fast.cast("long")).alias("faster"), F.sum(F.when(fast, F.col("jobs")).otherwise(0)).alias("jobs_faster"),
        F.sum((F.col("unreachable_a") & ~F.col("unreachable_b")).cast("long")).alias("gained"),
    )
    out = residents.join(g.withColumnRenamed("from_id", "zone"), "zone", "left").withColumn("time_change", F.col("time_b") - F.col("time_a"))
    return out.fillna({"faster": 0, "jobs_faster": 0, "gained": 0, "centre_new": False})


def people_headline(oas: DataFrame, total_jobs: DataFrame, by_min: float = 2.0) -> DataFrame:
    """One row of residents: faster or slower to the centre and to jobs, and how few origins hold half of the faster pairs."""
    r = F.col("residents")
    s = lambda c: F.sum(F.when(c, r).otherwise(0))
    rows = oas.join(total_jobs.select(F.sum("jobs").alias("all_jobs")).withColumn("_k", F.lit(1)), F.lit(1) == F.col("_k"))
    out = rows.agg(
        F.sum(r).alias("residents"), s(F.col("centre_change") <= -by_min).alias("centre_faster"), s(F.col("centre_change") >= by_min).alias("centre_slower"), s(F.col("centre_new")).alias("centre_new"),
        s(F.col("time_change") <= -1).alias("jobs_faster_1"), s(F.col("time_change") >= 1).alias("jobs_slower_1"), (F.sum(F.coalesce("time_change", F.lit(0.0)) * r) / F.sum(r)).alias("mean_time_change"),
        s(F.col("faster") > 0).alias("some_faster"), s(F.col("jobs_faster") >= 0.1 * F.col("all_jobs")).alias("tenth_of_jobs_faster"), F.sum(F.col("faster") * r).alias("weighted_pairs"),
    )
    # The origins in descending order of weighted pairs up to half of all: one more than those whose running sum is within half.
    v = oas.select("zone", (F.col("faster") * r).cast("long").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    v = sum_before(v.withColumn("vn", F.col("v") * F.col("n")), "v", "vn", "before", descending=True)
    half = v.join(out.select((F.col("weighted_pairs") / 2).alias("h")).withColumn("_k", F.lit(1)), F.lit(1) == F.col("_k"))
    n = F.when(F.col("v") > 0, F.greatest(F.lit(0), F.least(F.col("n"), F.floor((F.col("h") - F.col("before")) / F.col("v"))))).otherwise(F.when(F.col("before") <= F.col("h"), F.col("n")).otherwise(F.lit(0)))
    half = half.agg((F.sum(n) + 1).cast("long").alias("origins_with_half")).withColumn("_k", F.lit(1))
    return out.join(half, F.lit(1) == F.col("_k")).drop("_k")


def offset_spread(frames: list[DataFrame], routes: list[str]) -> DataFrame:
    """Range of p50 over the offsets, for pairs that use one of the routes at some offset, and for the rest; pairs reachable at all offsets."""
    hit = F.exists(F.array(*map(F.lit, routes)), lambda x: F.contains(F.coalesce("top_routes", F.lit("")), x)) if routes else F.lit(False)
    rows = reduce(DataFrame.unionByName, [f.select(*PAIR, "p50", "unreachable", hit.alias("u")) for f in frames])
    g = rows.groupBy(*PAIR).agg(F.count("*").alias("n"), F.max("unreachable").alias("x"), F.max("u").alias("uses"), (F.max("p50") - F.min("p50")).alias("r"))
    g = g.filter((F.col("n") == len(frames)) & ~F.col("x"))
    return g.groupBy("uses").agg(F.count("*").alias("pairs"), F.avg("r").alias("mean_range"), F.percentile("r", F.lit(0.5)).alias("median_range"), F.percentile("r", F.lit(0.9)).alias("p90_range"), F.max("r").alias("max_range"), F.avg((F.col("r") >= 2).cast("double")).alias("share_2"))


def across_offsets(metrics: DataFrame) -> DataFrame:
    """metric, value of each offset -> mean, min and max."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


def attribution(a: DataFrame, b: DataFrame, jobs: DataFrame, routes: list[str], min_gain: float, limit: float = 45.0) -> DataFrame:
    """Per origin: jobs in zones faster by min_gain or newly reachable; of these those whose new routes have one of `routes` that the old lack; jobs newly within the limit by such a gain."""
    j = both(a, b, ["p50", "unreachable", "top_routes"]).join(jobs.withColumnRenamed("zone", "to_id"), "to_id")
    ua, ub = F.col("unreachable_a"), F.col("unreachable_b")
    sel = (ua & ~ub) | (~ua & ~ub & (F.col("p50_a") - F.col("p50_b") >= min_gain))
    names = lambda c: F.split(F.coalesce(c, F.lit("")), "[;|]")
    via = F.arrays_overlap(F.array_except(F.array_intersect(names("top_routes_b"), F.array(*map(F.lit, routes))), names("top_routes_a")), F.array(*map(F.lit, routes)))
    new = sel & ~ub & (F.col("p50_b") <= limit) & (ua | (F.col("p50_a") > limit))
    s = lambda c: F.sum(F.when(c, F.col("jobs")).otherwise(0))
    return j.groupBy("from_id").agg(s(sel).alias("jobs_faster"), s(sel & via).alias("jobs_via"), s(new).alias("jobs_new_within"))


def reach(a: DataFrame, b: DataFrame, origins: list[int], min_gain: float, limit: float = 45.0) -> DataFrame:
    """For chosen origins the zones within the limit before or after, or faster by min_gain; times null where unreachable."""
    j = both(a, b, ["p50", "unreachable"]).filter(F.col("from_id").isin(origins))
    t = j.select(*PAIR, F.when(~F.col("unreachable_a"), F.col("p50_a")).alias("t0"), F.when(~F.col("unreachable_b"), F.col("p50_b")).alias("t1"))
    return t.filter((F.col("t0") <= limit) | (F.col("t1") <= limit) | (F.col("t0") - F.col("t1") >= min_gain))


def gateway_legs(trips: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Per gateway and direction: trips, trips with both times, mean change, trips 2 minutes faster or slower, gained, lost, person-hours saved.

    trips: dir (in or out), gateway, zone, trips. Inward trips go gateway to zone, outward ones zone to gateway. A pair that a skim lacks is unreachable in it.
    """
    inward = F.col("dir") == "in"
    q = trips.withColumns({"from_id": F.when(inward, F.col("gateway")).otherwise(F.col("zone")), "to_id": F.when(inward, F.col("zone")).otherwise(F.col("gateway"))})
    time = lambda s, x: s.select(*PAIR, F.when(~F.col("unreachable"), F.col("p50")).alias(x))
    q = q.join(time(a, "t0"), PAIR, "left").join(time(b, "t1"), PAIR, "left").withColumn("d", F.col("t1") - F.col("t0"))
    n = F.col("trips")
    s = lambda c: F.sum(F.when(c, n).otherwise(0))
    return q.groupBy("dir", "gateway").agg(
        F.sum(n).alias("trips"), s(F.col("d").isNotNull()).alias("compared"), F.try_divide(F.sum(F.col("d") * n), F.sum(F.when(F.col("d").isNotNull(), n))).alias("mean_change"), s(F.col("d") <= -2).alias("faster"), s(F.col("d") >= 2).alias("slower"),
        s(F.col("t0").isNull() & F.col("t1").isNotNull()).alias("gained"), s(F.col("t0").isNotNull() & F.col("t1").isNull()).alias("lost"), F.coalesce(F.sum(-F.col("d") * n) / 60, F.lit(0.0)).alias("person_hours"),
    )


def skim_change(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row between network versions: pairs, reachable, lost, gained, p50 quantiles and mean changes of components."""
    j = both(a, b, ["p50", "unreachable", *columns])
    ra, rb = ~F.col("unreachable_a"), ~F.col("unreachable_b")
    d = lambda c: F.when(ra & rb, F.col(f"{c}_b") - F.col(f"{c}_a"))
    return j.agg(
        F.count("*").alias("pairs"), F.sum((ra & ~rb).cast("long")).alias("lost"), F.sum((~ra & rb).cast("long")).alias("gained"), F.percentile(d("p50"), F.lit(0.05)).alias("p5"), F.percentile(d("p50"), F.lit(0.5)).alias("median"), F.percentile(d("p50"), F.lit(0.95)).alias("p95"),
        F.avg((d("p50") <= -2).cast("double")).alias("share_faster"), F.avg((d("p50") >= 2).cast("double")).alias("share_slower"), *[F.avg(d(c)).alias(f"{c}_change") for c in columns],
    )


def rank_differences(df: DataFrame, key: str, a: str, b: str, k: int = 15) -> DataFrame:
    """The k rows whose percent ranks differ most between two columns."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, a, b)
    n = rows.agg(F.count("*").alias("_n")).withColumn("_k", F.lit(1))
    ranked = average_rank(average_rank(rows, a, "_ra"), b, "_rb").join(n, F.lit(1) == F.col("_k"))
    out = ranked.select(key, (F.col("_ra") / F.col("_n") - F.col("_rb") / F.col("_n")).alias("difference"))
    return out.withColumn("difference", F.round("difference", 6)).orderBy(F.desc(F.abs("difference")), key).limit(k)


def spot_checks(checks: DataFrame) -> DataFrame:
    """pass A (within 15 % of the best), B (between p25 and p75, or within 15 % of p50), else none. checks: id, observed, best, p25, p50, p75."""
    o = F.col("observed")
    near = lambda c: F.abs(o - F.col(c)) <= F.col(c) * 0.15
    return checks.withColumn("verdict", F.when(near("best"), "A").when(o.between(F.col("p25"), F.col("p75")) | near("p50"), "B").otherwise("none"))


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    return qualify(df, keys, order, k)


def metric_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, change: b less a to four places, for metrics in both. Each has metric, value."""
    j = a.select("metric", F.col("value").alias("_a")).join(b.select("metric", F.col("value").alias("_b")), "metric")
    return j.select("metric", F.round(F.col("_b") - F.col("_a"), 4).alias("change"))


def offset_pairs(scenario: list, parent: list) -> list[tuple]:
    """(parent's, scenario's) skims to compare: offset by offset where both have as many, all against the parent's one, else an error."""
    if len(parent) not in (1, len(scenario)):
        raise ValueError(f"{len(scenario)} offsets of a scenario can't be paired with {len(parent)} of its parent")
    return list(zip(parent * len(scenario) if len(parent) == 1 else parent, scenario, strict=False))


def top_overlap(df: DataFrame, key: str, a: str, b: str, k: int) -> DataFrame:
    """One row: how many keys are among the k largest by both columns (ties to the smaller key), and the share of k."""
    top = lambda c: df.filter(F.col(c).isNotNull()).orderBy(F.desc(c), key).limit(k).select(key)
    return top(a).intersect(top(b)).agg(F.count("*").alias("shared")).withColumn("share", F.col("shared") / F.lit(float(k)))
