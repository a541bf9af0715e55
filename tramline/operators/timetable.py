"""Operators over calls of trips: service days, departures, service levels, capacity, rolling clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.config import AM_PEAK_HOUR, DIRECTION_MIN_SHARE, PERIODS
from tramline.functions.clock import period
from tramline.functions.stats import qualify


def active_services(calendar: DataFrame, dates: DataFrame, day: str) -> DataFrame:
    """service_id of those that run on the day (`YYYYMMDD`): weekday flag within the range, less exceptions of type 2, with those of type 1."""
    import datetime as dt

    flag = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"][dt.datetime.strptime(day, "%Y%m%d").weekday()]
    base = calendar.filter((F.col(flag) == "1") & (F.col("start_date") <= day) & (F.col("end_date") >= day)).select("service_id")
    at = dates.filter(F.col("date") == day)
    off = at.filter(F.col("exception_type") == "2").select("service_id")
    on = at.filter(F.col("exception_type") == "1").select("service_id")
    return base.join(off, "service_id", "left_anti").union(on).distinct()


def sequence_key(calls: DataFrame, keys: list[str], order: str, token: Column, out: str = "pattern") -> DataFrame:
    """MD5 of each key's tokens in order."""
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), token.alias("t"))))
    return calls.groupBy(*keys).agg(F.md5(F.array_join(F.transform(steps, lambda s: s["t"]), ",")).alias(out))


def dedupe_trips(trips: DataFrame, key: str, first: list[Column]) -> DataFrame:
    """One trip of each key: the first in the given order."""
    return qualify(trips, [key], first)


def clip_trips(calls: DataFrame, keys: list[str], inside: Column, kept: Column) -> DataFrame:
    """Calls within the outer box, of trips with a call in the inner area and two calls or more left."""
    has = calls.groupBy(*keys).agg(F.max(inside.cast("int")).alias("_in"), F.sum(kept.cast("int")).alias("_n"))
    good = has.filter("_in = 1 and _n >= 2").select(*keys)
    return calls.filter(kept).join(good, keys, "left_semi")


def next_calls(calls: DataFrame, keys: list[str], order: str, *carry: str) -> DataFrame:
    """Adds next_<column> for each carried column; the last call of a trip has nulls."""
    w = Window.partitionBy(*keys).orderBy(order)
    return calls.withColumns({f"next_{c}": F.lead(c).over(w) for c in carry})


def departures(calls: DataFrame, keys: list[str], order: str = "seq", stop: str = "stop", minute: str = "minute", pickup: str | None = None) -> DataFrame:
    """Boardable departures: calls but the last of each trip, without those that take nobody up, once for each journey, stop and minute."""
    out = next_calls(calls, keys, order, stop).filter(F.col(f"next_{stop}").isNotNull())
    if pickup:
        out = out.filter(F.coalesce(pickup, F.lit("0")) != "1")
    return qualify(out, [*keys, stop, minute], [F.asc(order)])


def in_periods(dep: DataFrame, minute: str, periods: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows within a period, with period; where periods overlap, the first that holds the time."""
    return dep.withColumn("period", period(F.col(minute), periods, other=None)).filter(F.col("period").isNotNull())


def _edges(periods: dict[str, tuple[float, float]]) -> tuple[Column, Column]:
    """Where a row's period begins and ends."""
    at = [F.create_map(*[F.lit(x) for k, v in periods.items() for x in (k, float(v[i]))]) for i in (0, 1)]
    return F.element_at(at[0], F.col("period")), F.element_at(at[1], F.col("period"))


def service_levels(dep: DataFrame, keys: list[str], minute: str = "minute", periods: dict[str, tuple[float, float]] = PERIODS) -> DataFrame:
    """Per key and period: departures_per_hour, mean_headway_min, max_headway_min (the longest gap, from the period's start and to its end)."""
    by = [*keys, "period"]
    rows = in_periods(dep, minute, periods)
    gap = F.col(minute) - F.lag(minute).over(Window.partitionBy(*by).orderBy(minute))
    g = rows.withColumn("_g", gap).groupBy(*by).agg(F.count("*").alias("_n"), F.max("_g").alias("_g"), F.min(minute).alias("_a"), F.max(minute).alias("_z"))
    lo, hi = _edges(periods)
    longest = F.greatest(F.coalesce("_g", F.lit(0.0)), F.col("_a") - lo, hi - F.col("_z"))
    return g.select(*by, (F.col("_n") / ((hi - lo) / 60)).alias("departures_per_hour"), ((hi - lo) / F.col("_n")).alias("mean_headway_min"), longest.alias("max_headway_min"))


def sides(dep: DataFrame, keys: list[str], direction: str, min_share: float = DIRECTION_MIN_SHARE) -> DataFrame:
    """Per key: directions (octants with at least min_share of departures) and sides (2 where two of them are 90 degrees or more apart)."""
    n = dep.groupBy(*keys, direction).agg(F.count("*").alias("_n"))
    n = n.withColumn("_s", F.col("_n") / F.sum("_n").over(Window.partitionBy(*keys)))
    octs = n.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("_s") >= min_share, F.col(direction)))).alias("o"))
    apart = lambda a, b: F.least(F.abs(a - b), F.lit(8) - F.abs(a - b)) >= 2
    two = F.exists("o", lambda a: F.exists("o", lambda b: apart(a, b)))
    return octs.select(*keys, F.size("o").alias("directions"), F.when(two, 2).otherwise(1).alias("sides"))


def cluster_service(dep: DataFrame, keys: list[str], direction: str, minute: str = "minute", periods: dict[str, tuple[float, float]] = PERIODS, min_share: float = DIRECTION_MIN_SHARE) -> DataFrame:
    """Service levels with directions, sides, dph_one_way and headway_min."""
    level = service_levels(dep, keys, minute, periods)
    both = sides(in_periods(dep, minute, periods), [*keys, "period"], direction, min_share)
    out = level.join(both, [*keys, "period"])
    out = out.withColumn("dph_one_way", F.col("departures_per_hour") / F.col("sides"))
    return out.withColumn("headway_min", F.lit(60.0) / F.col("dph_one_way"))


def headline(service: DataFrame, keys: list[str], periods: list[str]) -> DataFrame:
    """The worse of the periods for each key: lowest dph_one_way, 0 where a period has none; most directions."""
    p = service.filter(F.col("period").isin(periods)).groupBy(*keys)
    p = p.agg(*[F.coalesce(F.max(F.when(F.col("period") == x, F.col("dph_one_way"))), F.lit(0.0)).alias(f"_{x}") for x in periods], F.max("directions").alias("directions"))
    low = F.least(*[F.col(f"_{x}") for x in periods]) if len(periods) > 1 else F.col(f"_{periods[0]}")
    return p.select(*keys, low.alias("dph_one_way"), "directions", F.lit("HEADLINE").alias("period"))


def same_start_groups(calls: DataFrame, route: list[str], trip: list[str], stop: str = "stop", minute: str = "minute", seq: str = "seq") -> DataFrame:
    """Groups of a route's trips that start at one stop and time and end at more than one stop."""
    ends = calls.groupBy(*route, *trip).agg(F.min_by(F.struct(stop, minute), seq).alias("f"), F.max_by(stop, seq).alias("last"))
    g = ends.groupBy(*route, F.col(f"f.{stop}").alias("first_stop"), F.col(f"f.{minute}").alias("first_minute"))
    return g.agg(F.count("*").alias("trips"), F.countDistinct("last").alias("ends")).filter("ends > 1")


def roll_midnight(df: DataFrame, keys: list[str], order: str, value: str, out: str, day: float = 1440.0, drop: float = 0.0) -> DataFrame:
    """Adds a day for each time the value falls by more than `drop` from the row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    fell = F.coalesce((F.lag(value).over(w) - F.col(value) > drop).cast("int"), F.lit(0))
    run = F.sum("_fell").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_fell", fell).withColumn(out, F.col(value) + run * F.lit(day)).drop("_fell")


def merge_consecutive(calls: DataFrame, keys: list[str], order: str, place: str, arr: str, dep: str) -> DataFrame:
    """Runs of consecutive calls at one place as one call: first arrival, last departure; renumbered."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((~F.col(place).eqNullSafe(F.lag(place).over(w))).cast("int"), F.lit(1))
    new = F.when(F.lag(order).over(w).isNull(), 1).otherwise(new)
    runs = calls.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*keys, "_run").agg(F.first(place).alias(place), F.min_by(arr, order).alias(arr), F.max_by(dep, order).alias(dep), F.count("*").alias("n"))
    return out.withColumnRenamed("_run", order)


def section_use(points: DataFrame, keys: list[str], order: str, place: str, dep_s: str) -> DataFrame:
    """Trains by directed section and clock hour; a section from a place to itself is none."""
    legs = next_calls(points, keys, order, place).filter(F.col(f"next_{place}").isNotNull() & (F.col(place) != F.col(f"next_{place}")))
    hour = F.pmod(F.floor(F.col(dep_s) / 3600), F.lit(24)).cast("int")
    return legs.groupBy(F.col(place).alias("from"), F.col(f"next_{place}").alias("to"), hour.alias("hour")).agg(F.count("*").alias("trains"))


def section_run_times(points: DataFrame, keys: list[str], order: str, place: str, dep: str, arr: str) -> DataFrame:
    """Median minutes from departure to the next arrival, by directed section."""
    legs = next_calls(points, keys, order, place, arr).filter(F.col(f"next_{place}").isNotNull() & (F.col(place) != F.col(f"next_{place}")))
    return legs.groupBy(F.col(place).alias("from"), F.col(f"next_{place}").alias("to")).agg(F.percentile(F.col(f"next_{arr}") - F.col(dep), F.lit(0.5)).alias("median_min"), F.count("*").alias("n"))


def busiest_hour(use: DataFrame, periods: dict[str, tuple[float, float]] = PERIODS) -> DataFrame:
    """Per section and period: the busiest clock hour (the earliest of ties) and its trains."""
    hours = F.create_map(*[F.lit(x) for h in range(24) for x in (h, next((k for k, (a, b) in periods.items() if a <= h * 60 < b), "OP"))])
    rows = use.withColumn("period", F.element_at(hours, F.col("hour")))
    return rows.groupBy("from", "to", "period").agg(F.max(F.struct("trains", (-F.col("hour")).alias("h"))).alias("b")).select("from", "to", "period", (-F.col("b.h")).alias("hour"), F.col("b.trains").alias("trains"))


def dominant_pattern(calls: DataFrame, trip: list[str], group: list[str], stop: str = "stop") -> DataFrame:
    """Per group the most frequent set of stops (sorted, joined by |), ties to the first in order."""
    sets = calls.groupBy(*trip, *[g for g in group if g not in trip]).agg(F.array_join(F.array_sort(F.collect_set(stop)), "|").alias("pattern"))
    n = sets.groupBy(*group, "pattern").agg(F.count("*").alias("trips"))
    return qualify(n, group, [F.desc("trips"), F.asc("pattern")])


def truncate(calls: DataFrame, keys: list[str], order: str, stop: str, at: str, before: bool = True) -> DataFrame:
    """Calls up to (or from) the first call at a stop; trips without it stay; fewer than two calls go; renumbered."""
    cut = calls.filter(F.col(stop) == at).groupBy(*keys).agg(F.min(order).alias("_cut"))
    side = F.col(order) <= F.col("_cut") if before else F.col(order) >= F.col("_cut")
    out = calls.join(cut, keys, "left").filter(F.col("_cut").isNull() | side).drop("_cut")
    w = Window.partitionBy(*keys)
    out = out.withColumn("_n", F.count("*").over(w)).filter("_n >= 2").drop("_n")
    return out.withColumn(order, F.row_number().over(w.orderBy(order)))


def remove_calls(calls: DataFrame, keys: list[str], order: str, stop: str, gone: list[str], arr: str, dep: str) -> DataFrame:
    """Without the calls at the stops; the dwell saved comes off all later times; renumbered. First and last calls must stay."""
    w = Window.partitionBy(*keys).orderBy(order)
    cut = F.col(stop).isin(gone)
    run = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = calls.withColumns({"_cut": cut, "_first": F.row_number().over(w) == 1, "_last": F.lead(order).over(w).isNull()})
    rows = rows.withColumn("_cut", F.when(F.col("_cut") & (F.col("_first") | F.col("_last")), F.raise_error(F.lit("a first or last call cannot be removed")).cast("boolean")).otherwise(F.col("_cut")))
    rows = rows.withColumn("_saved", F.coalesce(F.sum(F.when(F.col("_cut"), F.col(dep) - F.col(arr)).otherwise(0.0)).over(run), F.lit(0.0)))
    rows = rows.filter(~F.col("_cut")).withColumns({arr: F.col(arr) - F.col("_saved"), dep: F.col(dep) - F.col("_saved")})
    return rows.withColumn(order, F.row_number().over(w)).drop("_cut", "_first", "_last", "_saved")


def extend_to(calls: DataFrame, keys: list[str], order: str, stop: str, arr: str, dep: str, at: str, new: str, run: float, dwell: float) -> DataFrame:
    """A call at `new` after trips that end at `at`, and before trips that start there; renumbered."""
    last = calls.groupBy(*keys).agg(F.max_by(F.struct(stop, arr, dep, order), order).alias("l"), F.min_by(F.struct(stop, arr, dep, order), order).alias("f"))
    after = last.filter(F.col(f"l.{stop}") == at).select(*keys, (F.col(f"l.{order}") + 1).alias(order), F.lit(new).alias(stop), (F.col(f"l.{arr}") + dwell + run).alias(arr), (F.col(f"l.{arr}") + dwell + run).alias(dep))
    ahead = last.filter(F.col(f"f.{stop}") == at).select(*keys, (F.col(f"f.{order}") - 1).alias(order), F.lit(new).alias(stop), (F.col(f"f.{dep}") - dwell - run).alias(arr), (F.col(f"f.{dep}") - dwell - run).alias(dep))
    kept = calls.select(*keys, order, stop, arr, dep)
    # The old end now dwells before it goes on.
    turned = kept.join(last.select(*keys, F.col(f"l.{order}").alias("_lo"), F.col(f"l.{stop}").alias("_ls")), keys)
    turned = turned.withColumn(dep, F.when((F.col(order) == F.col("_lo")) & (F.col("_ls") == at), F.col(arr) + dwell).otherwise(F.col(dep))).drop("_lo", "_ls")
    return turned.unionByName(after).unionByName(ahead).withColumn(order, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def retime_nearest(wanted: DataFrame, templates: DataFrame, group: list[str], want: str, start: str, trip: str) -> DataFrame:
    """For each wanted departure the template of its group that starts nearest, ties to the earlier, then the smaller name; with the shift.

    Wanted and templates are merged in time order and the last template at or before, and the first after, are carried to
    each wanted row: no list of pairs.
    """
    t = templates.groupBy(*group, F.col(start).alias("at")).agg(F.min(trip).alias("trip")).select(*group, "at", "trip", F.lit(None).cast("double").alias("want"))
    q = wanted.select(*group, F.col(want).alias("at"), F.lit(None).cast(t.schema["trip"].dataType).alias("trip"), F.col(want).cast("double").alias("want"))
    key = F.when(F.col("trip").isNotNull(), F.struct("at", "trip"))
    w = Window.partitionBy(*group).orderBy("at", F.col("want").isNotNull())
    back = Window.partitionBy(*group).orderBy(F.desc("at"), F.col("want").isNotNull())
    # Both windows put a template before a wanted departure at the same time.
    rows = t.unionByName(q).withColumn("_k", key)
    rows = rows.withColumns({"_b": F.last("_k", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_a": F.last("_k", True).over(back.rowsBetween(Window.unboundedPreceding, 0))})
    near = F.when(F.col("_a").isNull() | (F.col("want") - F.col("_b.at") <= F.col("_a.at") - F.col("want")), F.col("_b")).otherwise(F.col("_a"))
    return rows.filter(F.col("want").isNotNull()).withColumn("_n", near).select(*group, F.col("want").alias(want), F.col("_n.trip").alias("template"), (F.col("want") - F.col("_n.at")).alias("shift"))


def fill_span(starts: DataFrame, keys: list[str], start: str, lo: float, hi: float) -> DataFrame:
    """Departures that extend a service to a span at its median headway: before its first start down to lo, after its last up to (not at) hi."""
    w = Window.partitionBy(*keys).orderBy(start)
    g = starts.withColumn("_h", F.col(start) - F.lag(start).over(w)).groupBy(*keys)
    g = g.agg(F.min(start).alias("first"), F.max(start).alias("last"), F.percentile("_h", F.lit(0.5)).alias("hw")).filter("hw > 0")
    down = F.floor((F.col("first") - lo) / F.col("hw") + 1e-9).cast("int")
    up = F.ceil((F.lit(hi) - F.col("last")) / F.col("hw") - 1e-9).cast("int") - 1
    steps = lambda n: F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    early = F.transform(steps(down), lambda i: F.col("first") - i * F.col("hw"))
    late = F.transform(steps(up), lambda i: F.col("last") + i * F.col("hw"))
    return g.select(*keys, F.explode(F.concat(early, late)).alias(start))


def working_times(calls: DataFrame, trip: list[str], order: str, stop: str, arr: str, dep: str, operator: str) -> dict[str, DataFrame]:
    """Median run times by (from, to, operator) and (from, to), and median dwells by operator and overall."""
    legs = next_calls(calls, trip, order, stop, arr).filter(F.col(f"next_{stop}").isNotNull()).withColumn("run", F.col(f"next_{arr}") - F.col(dep))
    med = lambda c: F.percentile(c, F.lit(0.5))
    a, b = F.col(stop).alias("from"), F.col(f"next_{stop}").alias("to")
    dwell = calls.withColumn("dwell", F.col(dep) - F.col(arr))
    return {
        "run_by_operator": legs.groupBy(a, b, operator).agg(med("run").alias("run"), F.count("*").alias("n")),
        "run": legs.groupBy(a, b).agg(med("run").alias("run"), F.count("*").alias("n")),
        "dwell_by_operator": dwell.groupBy(operator).agg(med("dwell").alias("dwell")),
        "dwell_by_station": dwell.groupBy(stop, operator).agg(med("dwell").alias("dwell")),
        "dwell": dwell.agg(med("dwell").alias("dwell")),
    }


def trace_sessions(df: DataFrame, keys: list[str], ts: str, gap_s: float, out: str = "trace") -> DataFrame:
    """Numbers traces within each key: a new one where the gap to the row before is over gap_s."""
    w = Window.partitionBy(*keys).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    return df.withColumn("_new", F.coalesce((gap > gap_s * 1e6).cast("int"), F.lit(0))).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def chunks_with_overlap(df: DataFrame, keys: list[str], order: str, size: int, out: str = "chunk") -> DataFrame:
    """Chunks of `size` rows of each key, the last row of one being the first of the next."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    k = F.floor(F.col("_i") / (size - 1)).cast("int")
    edge = (F.col("_i") % (size - 1) == 0) & (F.col("_i") > 0)
    last = F.col("_i") == F.col("_n") - 1
    own = F.when(edge & last, F.array(k - 1)).when(edge, F.array(k - 1, k)).otherwise(F.array(k))
    return rows.withColumn(out, F.explode(own)).drop("_i", "_n")


def thin_snapshots(df: DataFrame, keys: list[str], ts: str, every_s: int, tie: str) -> DataFrame:
    """The latest row of each key and clock bucket of every_s seconds."""
    bucket = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / every_s)
    return qualify(df.withColumn("bucket", bucket), [*keys, "bucket"], [F.desc(ts), F.desc(tie)])


def newer_only(df: DataFrame, keys: list[str], arrival: list[str], recorded: str, previous: Column | None = None) -> DataFrame:
    """Rows recorded strictly after everything kept before of the same key, in order of arrival (then of recording).

    A row is kept exactly if it is newer than all earlier arrivals of its key, so a running maximum decides. `previous`
    (a column) marks stale those recorded before it; they stay.
    """
    w = Window.partitionBy(*keys).orderBy(*arrival, recorded).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_top", F.max(recorded).over(w)).filter(F.col("_top").isNull() | (F.col(recorded) > F.col("_top"))).drop("_top")
    return out if previous is None else out.withColumn("stale", F.coalesce(F.col(recorded) < previous, F.lit(False)))


def gap_minutes(df: DataFrame, keys: list[str], ts: str, allowed_s: float) -> DataFrame:
    """Per key: rows, and minutes lost in gaps of over allowed_s between rows."""
    w = Window.partitionBy(*keys).orderBy(ts)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / F.lit(1e6)
    return df.withColumn("_g", gap).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_g") > allowed_s, F.col("_g") / 60).otherwise(0.0)).alias("gap_min"))


def variant_resolve(variants: DataFrame, seen: DataFrame, group: list[str], end: str) -> DataFrame:
    """Per variant: keep if its end was observed; drop if others of its group were and it was not; else unresolved."""
    w = Window.partitionBy(*group)
    rows = variants.join(seen.select(*group, end).distinct().withColumn("_seen", F.lit(True)), [*group, end], "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    some = F.max(F.col("_seen").cast("int")).over(w) == 1
    return rows.withColumn("decision", F.when(F.col("_seen"), "keep").when(some, "drop").otherwise("unresolved")).drop("_seen")


def peak_flag(minute: Column) -> Column:
    return (minute >= AM_PEAK_HOUR[0]) & (minute < AM_PEAK_HOUR[1])


def best_rows(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    return qualify(df, keys, order, k)


# Mode classes by route type, basic and extended: (first, last, class); a route may be named bus rapid transit whatever its type.
ROUTE_TYPES = [(0, 0, "tram"), (5, 5, "tram"), (900, 999, "tram"), (1, 1, "metro"), (400, 499, "metro"), (2, 2, "rail"), (100, 199, "rail"), (4, 4, "ferry"), (1000, 1099, "ferry"), (1200, 1200, "ferry"), (200, 299, "coach"), (3, 3, "bus"), (11, 11, "bus"), (700, 799, "bus")]


def mode_class(route_type: Column, brt: Column) -> Column:
    """The mode class of a route; brt: whether it is named one. A type without a class raises."""
    out = F.when(F.coalesce(brt, F.lit(False)), "brt")
    for first, last, name in ROUTE_TYPES:
        out = out.when(route_type.cast("int").between(first, last), name)
    return out.otherwise(F.raise_error(F.concat(F.lit("no mode class for route type "), F.coalesce(route_type.cast("string"), F.lit("null")))))


def exclude_variants(trips: DataFrame, excluded: DataFrame, trip: str, pattern: str) -> DataFrame:
    """Trips without those of an excluded trip's pattern, so copies under other ids go too."""
    gone = trips.join(excluded.select(trip).distinct(), trip, "left_semi").select(pattern).distinct()
    return trips.join(gone, pattern, "left_anti").select(*trips.columns)


def at_or_after(slot: Column, clock: Column, day: float = 720.0) -> Column:
    """The first time at or after the slot that a 12-hour clock shows so (minutes)."""
    return F.ceil((slot - clock) / F.lit(day)) * F.lit(day) + clock


def previous_snapshots(rows: DataFrame, response: str, nominal_s: float, last: Column | None = None) -> DataFrame:
    """response, cut: for each snapshot when the one before it was sent, whatever vehicles it held; the first has `last`, else its own time less nominal_s."""
    times = rows.select(response).distinct()
    # One row a snapshot; those of a day at a poll every ten seconds are under ten thousand.
    before = F.lag(response).over(Window.orderBy(response))
    first = F.col(response) - F.make_interval(secs=F.lit(float(nominal_s)))
    return times.select(response, F.coalesce(before, last if last is not None else F.lit(None), first).alias("cut"))


def flagged_stale(rows: DataFrame, snapshots: DataFrame, response: str, recorded: str) -> DataFrame:
    """Adds stale: recorded before the previous snapshot was sent."""
    return rows.join(snapshots, response, "left").withColumn("stale", F.coalesce(F.col(recorded) < F.col("cut"), F.lit(False))).drop("cut")
