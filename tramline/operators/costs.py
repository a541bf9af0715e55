"""Cost operators: price lines, ranges, tunnel runs, fleets, capacity limits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.functions.geo import haversine_km


def rebased(lines: DataFrame, index: DataFrame, deflator: DataFrame, to: int, real_growth: float = 0.0, year: str = "year") -> DataFrame:
    """lines with factor: from the price year of each to year `to` by the construction index, and before that begins by the deflator to its first year, with real growth.

    index, deflator: year, value (one a year). A year that neither holds, or a missing year `to`, raises when rows are read.
    """
    first = index.agg(F.min("year").alias("_first"))
    at = index.filter(F.col("year") == to).select(F.col("value").alias("_to"))
    ends = first.join(index.select("year", F.col("value").alias("_start")), F.col("_first") == F.col("year")).drop("year").join(deflator.select("year", F.col("value").alias("_d_start")), F.col("_first") == F.col("year"), "left").drop("year")
    one = ends.withColumn("_k", F.lit(1)).join(at.withColumn("_k", F.lit(1)), "_k", "left")
    j = lines.withColumn("_k", F.lit(1)).join(one, "_k", "left")
    j = j.join(index.select(F.col("year").alias(year), F.col("value").alias("_i")), year, "left").join(deflator.select(F.col("year").alias(year), F.col("value").alias("_d")), year, "left")
    before = F.col(year) < F.col("_first")
    grown = F.col("_d_start") / F.col("_d") * F.pow(F.lit(1.0 + real_growth), F.col("_first") - F.col(year)) * F.col("_to") / F.col("_start")
    factor = F.when(before, grown).otherwise(F.col("_to") / F.col("_i"))
    known = F.when(factor.isNull() & F.col(year).isNotNull(), F.raise_error(F.lit("no index for a price year")).cast("double")).otherwise(factor)
    return j.select(*lines.columns, known.alias("factor"))


def cost_lines(lines: DataFrame, factor: float = 1.0, bias: float = 0.0) -> DataFrame:
    """Adds cost_low, cost_central, cost_high = qty x unit x factor x (1 + bias); a null unit gives null costs and keeps the row; bound `upper` fills cost_high alone.

    lines: qty, low, central, high, bound. A central value outside its range raises.
    """
    ok = F.col("central").isNull() | F.col("central").between(F.col("low"), F.col("high"))
    c = lambda n: F.col("qty") * F.col(n) * F.lit(factor * (1 + bias))
    upper = F.coalesce(F.col("bound") == "upper", F.lit(False))
    return lines.withColumns({
        "cost_low": F.when(~upper, c("low")), "cost_high": c("high"),
        "cost_central": F.when(~ok, F.raise_error(F.lit("a value lies outside its range")).cast("double")).when(~upper, c("central")),
    })


def cost_totals(lines: DataFrame, by: list[str]) -> DataFrame:
    """Totals by group, withheld (null) where a line bounds from above only; lines without a cost are counted, not summed."""
    upper = F.max(F.coalesce(F.col("bound") == "upper", F.lit(False)))
    s = lambda n: F.when(~upper, F.sum(n))
    return lines.groupBy(*by).agg(s("cost_low").alias("low"), s("cost_central").alias("central"), s("cost_high").alias("high"), F.count("*").alias("lines"), F.sum(F.col("cost_high").isNull().cast("long")).alias("not_costed"))


def tunnel_runs(legs: DataFrame, line: str, order: str, metres: str, tunnel: str) -> DataFrame:
    """Runs of consecutive legs with tunnel: km, and portals, one at each end but where the run reaches the line's end on a leg that is all tunnel (99.9 %)."""
    w = Window.partitionBy(line).orderBy(order)
    in_run = F.col(tunnel) > 0
    rows = legs.withColumns({"_in": in_run, "_new": (in_run & ~F.coalesce(F.lag(tunnel).over(w) > 0, F.lit(False))).cast("int"), "_first": F.lag(order).over(w).isNull(), "_last": F.lead(order).over(w).isNull(), "_all": F.col(tunnel) >= 0.999 * F.col(metres)})
    rows = rows.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_in")
    shut = lambda c: F.max((F.col(c) & F.col("_all")).cast("int"))
    return rows.groupBy(line, "run").agg((F.sum(tunnel) / 1000).alias("km"), (F.lit(2) - shut("_first") - shut("_last")).alias("portals"))


def fleet(round_trip: Column, headway: Column) -> Column:
    return F.ceil(round_trip / headway - 1e-9).cast("long")


def with_spares(df: DataFrame, mode: str, vehicles: str, share: float) -> DataFrame:
    """Vehicles by mode, spares rounded up once for each mode."""
    return df.groupBy(mode).agg(F.sum(vehicles).alias("in_service")).withColumn("with_spares", F.col("in_service") + F.ceil(F.col("in_service") * share - 1e-9))


def once_per_build(lines: DataFrame, same: list[str], order: list[str], qty: str) -> DataFrame:
    """Later lines that build the same thing keep a quantity of 0."""
    w = Window.partitionBy(*same).orderBy(*order)
    return lines.withColumn(qty, F.when(F.row_number().over(w) == 1, F.col(qty)).otherwise(F.lit(0).cast(lines.schema[qty].dataType)))


def feed_km(calls: DataFrame, trip: str, journey: str, order: str, mode: str) -> DataFrame:
    """Vehicle-km by mode: great-circle steps of each journey, copies of a journey counted once (its smallest trip id). calls have lon, lat."""
    one = calls.groupBy(journey).agg(F.min(trip).alias(trip))
    rows = calls.join(one, [journey, trip], "left_semi")
    w = Window.partitionBy(trip).orderBy(order)
    step = haversine_km(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    return rows.withColumn("_km", step).groupBy(mode).agg(F.coalesce(F.sum("_km"), F.lit(0.0)).alias("km"), F.countDistinct(trip).alias("journeys"))


def block_trains(run_min: float, dwell_min: float, margin_min: float) -> int:
    """Trains an hour over single track: there and back, each with run, dwell and margin."""
    return math.floor(60 / (2 * (run_min + dwell_min) + 2 * margin_min) + 1e-9)


def capacity_limits(use: DataFrame, runs: DataFrame, overrides: DataFrame, tracks: DataFrame, dwell: float, margin: float, double: int, freight: int = 0) -> DataFrame:
    """Trains an hour by section: override, else the single-track formula with the mean run of both directions, else the double default; at least today's busiest hour with freight.

    use: from, to, hour, trains; runs: from, to, median_min; overrides: from, to, limit; tracks: from, to, tracks.
    """
    keys = ["from", "to"]
    back = runs.select(F.col("to").alias("from"), F.col("from").alias("to"), F.col("median_min").alias("_back"))
    mean = runs.join(back, keys, "left").select(*keys, ((F.col("median_min") + F.coalesce("_back", "median_min")) / 2).alias("_run"))
    busy = use.groupBy(*keys).agg(F.max("trains").alias("_busy"))
    j = busy.join(overrides, keys, "left").join(tracks, keys, "left").join(mean, keys, "left")
    single = F.floor(F.lit(60.0) / (F.lit(2.0) * (F.col("_run") + dwell) + 2 * margin) + 1e-9).cast("long")
    base = F.coalesce(F.col("limit").cast("long"), F.when(F.col("tracks") == 1, single), F.lit(double).cast("long"))
    return j.select(*keys, F.greatest(base, F.col("_busy") + freight).alias("limit"))


def capacity_check(use: DataFrame, added: DataFrame, limits: DataFrame) -> DataFrame:
    """Per section and hour: use with the scenario's trains against the limit."""
    keys = ["from", "to", "hour"]
    all_ = use.unionByName(added).groupBy(*keys).agg(F.sum("trains").alias("trains"))
    return all_.join(limits, ["from", "to"]).withColumn("over", F.col("trains") > F.col("limit"))


def copied_use(points: DataFrame, copies: DataFrame, rid: str, order: str, place: str, dep_s: str) -> DataFrame:
    """The section use of journeys' copies, each shifted in time and, where it is cut short, kept up to or from a place.

    copies: journey, shift_s, trim_at (place or null), keep (`before` or `after`); a journey may be copied several times. A
    copy of a journey that there is not, or that does not pass the place, raises. The first passing of the place counts.
    """
    from tramline.operators.timetable import section_use

    c = copies.select(F.col("journey").alias(rid), "shift_s", "trim_at", "keep").withColumn("_copy", F.monotonically_increasing_id())
    rows = c.join(points.select(rid, order, place, dep_s).withColumn("_there", F.lit(True)), rid, "left")
    cut = F.min(F.when(F.col(place) == F.col("trim_at"), F.col(order))).over(Window.partitionBy("_copy"))
    wrong = F.when(F.col("_there").isNull(), "a copied journey is not there").when(F.col("trim_at").isNotNull() & F.col("_cut").isNull(), "a copied journey does not pass the place that it is cut at")
    stays = F.when(F.col("trim_at").isNull(), True).when(F.col("keep") == "before", F.col(order) <= F.col("_cut")).otherwise(F.col(order) >= F.col("_cut"))
    rows = rows.withColumn("_cut", cut).withColumn("_stays", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(stays)).filter("_stays")
    return section_use(rows.withColumn(dep_s, F.col(dep_s) + F.col("shift_s")), ["_copy"], order, place, dep_s)


def scenario_use(legs: DataFrame, trips_per_hour: DataFrame) -> DataFrame:
    """Legs of a line (line, from, to, offset_min) times its trips by departure hour (line, hour, trips)."""
    j = legs.join(trips_per_hour, "line")
    hour = F.pmod(F.col("hour") + F.floor(F.col("offset_min") / 60), F.lit(24)).cast("int")
    return j.groupBy("from", "to", hour.alias("hour")).agg(F.sum("trips").alias("trains"))


def capital_lines(way: DataFrame, runs: DataFrame, stations: DataFrame, vehicles: DataFrame) -> DataFrame:
    """line, item, qty of lines' builds: km of way by type, km, machines (two where there is a tunnel) and portals of tunnels, stations and vehicles by kind, a depot for each kind of vehicle. Quantities of 0 give no line.

    way: line, type, m; runs: line, km, portals; stations: line, kind, n; vehicles: line, mode, n.
    """
    named = lambda prefix, kind: F.concat(F.lit(prefix), F.col(kind))
    tunnel = runs.groupBy("line").agg(F.sum("km").alias("km"), F.sum("portals").cast("double").alias("portals"))
    parts = F.array(*[F.struct(F.lit(n).alias("item"), q.alias("qty")) for n, q in (("tunnel_km", F.col("km")), ("tunnel_machines", F.when(F.col("km") > 0, 2.0).otherwise(0.0)), ("tunnel_portals", F.col("portals")))])
    fleets = vehicles.groupBy("line", "mode").agg(F.sum("n").cast("double").alias("n"))
    out = way.groupBy("line", named("way_", "type").alias("item")).agg((F.sum("m") / 1000).alias("qty"))
    out = out.unionByName(tunnel.select("line", F.explode(parts).alias("p")).select("line", "p.item", "p.qty"))
    out = out.unionByName(stations.groupBy("line", named("station_", "kind").alias("item")).agg(F.sum("n").cast("double").alias("qty")))
    out = out.unionByName(fleets.select("line", named("vehicle_", "mode").alias("item"), F.col("n").alias("qty")))
    out = out.unionByName(fleets.filter("n > 0").select("line", named("depot_", "mode").alias("item"), F.lit(1.0).alias("qty")))
    return out.filter("qty <> 0")


def operating_cost(extra_km: float, days: float, rate: float, fixed: dict[str, float]) -> float:
    return extra_km * days * rate + sum(fixed.values())


def opex_lines(before: DataFrame, after: DataFrame, days: float, rate: str = "rate") -> DataFrame:
    """mode, extra_km (a weekday), yearly, cost of the change in vehicle-km. before, after: mode, km; after also holds a rate by mode (null: no cost, the line stays). Modes without a change give no line."""
    j = after.select("mode", F.col("km").alias("_a"), rate).join(before.select("mode", F.col("km").alias("_b")), "mode", "full")
    extra = F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))
    return j.withColumn("extra_km", extra).filter(F.abs("extra_km") >= 1e-6).select("mode", "extra_km", (F.col("extra_km") * days).alias("yearly"), (F.col("extra_km") * days * F.col(rate)).alias("cost"))


def completeness(lines: DataFrame, item: str, tag: str) -> DataFrame:
    """By tag: lines, those without a cost (upper bounds aside), and their items in order; a scheme is complete where none are."""
    open_ = F.col("cost_high").isNull() & ~F.coalesce(F.col("bound") == "upper", F.lit(False))
    g = lines.groupBy(tag).agg(F.count("*").alias("lines"), F.sum(open_.cast("long")).alias("not_costed"), F.sort_array(F.collect_set(F.when(open_, F.col(item)))).alias("items"))
    return g.withColumn("complete", F.col("not_costed") == 0)
