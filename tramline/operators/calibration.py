"""Road-speed calibration inputs: calendars, number-plate observations, link times, ladders, targets, hold-outs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import PERIODS
from tramline.functions.clock import period

# Fixed values: (first month and day, last month and day) of what counts as holidays where no calendar is at hand.
HOLIDAYS = [((8, 1), (8, 31)), ((12, 18), (12, 31)), ((1, 1), (1, 4)), ((7, 22), (7, 31)), ((9, 1), (9, 3))]
KMH_PER_MPH = 1.609344


def in_holidays(day: Column) -> Column:
    """Whether a date is in one of the HOLIDAYS."""
    at = F.month(day) * 100 + F.dayofmonth(day)
    return reduce(lambda a, b: a | b, [at.between(100 * a + b, 100 * c + d) for (a, b), (c, d) in HOLIDAYS])


def day_types(days: DataFrame, terms: DataFrame, bank_holidays: DataFrame, day: str = "day") -> DataFrame:
    """Adds day_type: weekend; neutral (Tuesday to Thursday in a term, no bank holiday, not August); weekday_other. terms: first, last; bank_holidays: day."""
    free = days.join(bank_holidays.select(F.col("day").alias(day)).distinct().withColumn("_bank", F.lit(True)), day, "left")
    # Terms are a handful a year; each opens into its days, so an equi-join finds the term.
    taught = terms.select(F.explode(F.sequence("first", "last")).alias(day)).distinct().withColumn("_term", F.lit(True))
    rows = free.join(taught, day, "left")
    kind = F.when(F.weekday(day) >= 5, "weekend").when(F.weekday(day).between(1, 3) & (F.month(day) != 8) & F.col("_bank").isNull() & F.col("_term").isNotNull(), "neutral")
    return rows.withColumn("day_type", kind.otherwise("weekday_other")).drop("_bank", "_term")


def plate_observations(rows: DataFrame, stamp: str = "end", periods: dict[str, tuple[float, float]] = PERIODS) -> DataFrame:
    """Per link and period: obs_s (journey seconds weighted by matches) and hours. rows: link_id, ts (hour, local), matches, journey_s.

    A stamp at the hour's end is moved back by one. Holidays and hours without matches go; weekends are WE; Mondays and
    Fridays go; other hours have their period, else OP. 8 h within AM also counts as AMPH, 17 h within PM as PMPH.
    """
    if stamp not in ("start", "end"):
        raise ValueError(f"a stamp marks the start or the end of its hour, not {stamp!r}")
    at = F.col("ts") - F.expr("interval 1 hour") if stamp == "end" else F.col("ts")
    x = rows.withColumn("_t", at).filter(~in_holidays(F.col("_t")) & (F.col("matches") > 0) & (F.col("journey_s") > 0))
    hour, dow = F.hour("_t"), F.weekday("_t")
    own = F.when(dow >= 5, "WE").when(dow.between(1, 3), period(hour * 60, periods))
    peak = F.when((own == "AM") & (hour == 8), "AMPH").when((own == "PM") & (hour == 17), "PMPH")
    x = x.withColumn("period", F.explode(F.filter(F.array(own, peak), lambda p: p.isNotNull())))
    return x.groupBy("link_id", "period").agg((F.sum(F.col("journey_s") * F.col("matches")) / F.sum("matches")).alias("obs_s"), F.count("*").alias("hours"))


def _on_links(paths: DataFrame, speeds: DataFrame, segments: DataFrame) -> DataFrame:
    """paths: link_id, u, v; speeds: u, v, speed_kmh, length_m; segments: u, v, area, srn, signal (v has one)."""
    s = paths.join(speeds, ["u", "v"], "left").join(segments, ["u", "v"], "left")
    return s.withColumn("_t", F.col("length_m") / (F.col("speed_kmh") / 3.6))


def link_times(paths: DataFrame, speeds: DataFrame, segments: DataFrame, delays: dict[str, float], most_missing: float = 0.05) -> DataFrame:
    """link_id, model_s: running seconds plus each signal's delay by its area (else the urban one), for links with less than most_missing of their segments unknown."""
    named = F.create_map(*[F.lit(x) for k, v in delays.items() for x in (k, float(v))])
    late = F.when(F.col("signal"), F.coalesce(F.try_element_at(named, F.col("area")), F.lit(float(delays.get("urban", 0.0))))).otherwise(0.0)
    g = _on_links(paths, speeds, segments).groupBy("link_id").agg(F.sum("_t").alias("_run"), F.sum(late).alias("_wait"), F.avg(F.col("_t").isNull().cast("double")).alias("_miss"))
    return g.filter(F.col("_miss") < most_missing).select("link_id", (F.coalesce("_run", F.lit(0.0)) + F.col("_wait")).alias("model_s"))


def link_area(paths: DataFrame, segments: DataFrame) -> DataFrame:
    """link_id, area: the area with most of the link's length (unknown: rural; ties to the first in the alphabet). paths: link_id, u, v, length_m."""
    g = paths.join(segments.select("u", "v", "area"), ["u", "v"], "left").groupBy("link_id", F.coalesce("area", F.lit("rural")).alias("area")).agg(F.sum("length_m").alias("_m"))
    return g.groupBy("link_id").agg(F.min(F.struct((-F.col("_m")).alias("m"), "area")).alias("_b")).select("link_id", "_b.area")


def link_components(paths: DataFrame, speeds: DataFrame, segments: DataFrame, areas: list[str], most_missing: float = 0.05) -> DataFrame:
    """Per link: t_<area> and s_<area> (seconds on segments that a layer may change, signals among them), t_other."""
    adj = F.coalesce(F.col("area").isin(areas) & ~F.coalesce("srn", F.lit(False)), F.lit(False))
    sums = [x for a in areas for x in (
        F.coalesce(F.sum(F.when(adj & (F.col("area") == a), F.col("_t"))), F.lit(0.0)).alias(f"t_{a}"),
        F.sum(F.when(adj & (F.col("area") == a) & F.coalesce("signal", F.lit(False)), 1).otherwise(0)).alias(f"s_{a}"),
    )]
    g = _on_links(paths, speeds, segments).groupBy("link_id").agg(*sums, F.coalesce(F.sum(F.when(~adj, F.col("_t"))), F.lit(0.0)).alias("t_other"), F.avg(F.col("_t").isNull().cast("double")).alias("_miss"))
    return g.filter(F.col("_miss") < most_missing).drop("_miss")


def layer_times(components: DataFrame, k: dict[str, float], d: dict[str, float]) -> DataFrame:
    """link_id, model_s under a layer: each area's seconds over k, with d seconds a signal."""
    total = reduce(lambda t, a: t + F.col(f"t_{a}") / F.lit(float(k[a])) + F.col(f"s_{a}") * F.lit(float(d.get(a, 0.0))), k, F.col("t_other"))
    return components.select("link_id", total.alias("model_s"))


def road_class(point_m: Column, category: Column, known: Column, highway: Column, ref: Column, most_m: float) -> Column:
    """Class of a segment: by a count point within most_m, else what is known, else by its tags."""
    near = point_m <= most_m
    return (
        F.when(near & category.isin("TM", "TA"), "srn").when(near & category.isin("PM", "PA"), "local_a").when(known.isNotNull(), known)
        .when(highway.isin("motorway", "motorway_link", "trunk", "trunk_link"), "srn").when(ref.startswith("A"), "local_a").when(ref.startswith("B"), "b_road").otherwise("minor")
    )


def area_type(zone: Column, central: Column, urban: Column) -> Column:
    """buffer (no zone), centre, urban, rural."""
    return F.when(zone.isNull(), "buffer").when(central, "centre").when(urban, "urban").otherwise("rural")


def heading(lon_u: Column, lat_u: Column, mid_lon: Column, mid_lat: Column, lon: Column, lat: Column, squeeze: float = 0.39) -> Column:
    """inbound where a segment's middle is nearer to the centre (lon, lat) than its start, else outbound; squeeze: squared length of a degree of longitude over one of latitude."""
    far = lambda x, y: (x - lon) * (x - lon) * squeeze + (y - lat) * (y - lat)
    return F.when(far(mid_lon, mid_lat) < far(lon_u, lat_u), "inbound").otherwise("outbound")


def targets(rows: DataFrame) -> DataFrame:
    """Published speeds (mph as text, perhaps no number) in km/h; rows without one go."""
    return rows.withColumn("kmh", F.col("mph").cast("string").try_cast("double") * KMH_PER_MPH).filter(F.col("kmh").isNotNull())


def profile_shares(profile: DataFrame) -> DataFrame:
    """Adds share: each hour's index over the sum of all. profile: dow, hour, index (168 rows)."""
    total = profile.agg(F.sum("index").alias("_s")).withColumn("_k", F.lit(1))
    return profile.withColumn("_k", F.lit(1)).join(total, "_k").withColumn("share", F.col("index") / F.col("_s")).drop("_s", "_k")


def clip_share(segments: DataFrame, keys: list[str], box: tuple[float, float, float, float]) -> DataFrame:
    """Km by key, and km of segments whose middle is in the box. segments: length_m, x, y."""
    w, s, e, n = box
    inside = F.col("x").between(w, e) & F.col("y").between(s, n)
    return segments.groupBy(*keys).agg((F.sum("length_m") / 1000).alias("km_total"), (F.sum(F.when(inside, F.col("length_m"))) / 1000).alias("km_inside"))


def ratio_hold_out(cells: DataFrame, keys: list[str], fold: str, coarse: str, min_cells: int) -> DataFrame:
    """Each cell's speed predicted from the other folds: car_kmh times the ratio of summed hours (car over bus) of its group, or of its coarse group where the others hold fewer than min_cells of it.

    cells: keys, fold, bus_kmh, car_kmh, bus_h, car_h. Adds ratio, fallback, pred_kmh, err (relative). A fold's complement is
    the whole less the fold, so nothing is fitted fold by fold.
    """

    def without(by: list[str], name: str) -> DataFrame:
        """Sums of every fold's complement by group; groups that a fold lacks come from the whole."""
        own = cells.groupBy(*by, fold).agg(F.sum("car_h").alias("_c"), F.sum("bus_h").alias("_b"), F.count("*").alias("_n"))
        whole = own.groupBy(*by).agg(F.sum("_c").alias("_wc"), F.sum("_b").alias("_wb"), F.sum("_n").alias("_wn"))
        j = own.join(whole, by)
        rest = F.try_divide(F.col("_wc") - F.col("_c"), F.col("_wb") - F.col("_b"))
        return j.select(*by, fold, F.when(F.col("_wn") > F.col("_n"), rest).alias(name), (F.col("_wn") - F.col("_n")).alias(f"{name}_n"))

    j = cells.join(without(keys, "_fine"), [*keys, fold]).join(without([coarse], "_coarse"), [coarse, fold])
    enough = (F.col("_fine_n") >= min_cells) & F.col("_fine").isNotNull()
    j = j.withColumns({"fallback": ~enough, "ratio": F.when(enough, F.col("_fine")).otherwise(F.col("_coarse"))})
    return j.drop("_fine", "_fine_n", "_coarse", "_coarse_n").withColumn("pred_kmh", F.col("car_kmh") * F.col("ratio")).withColumn("err", F.abs(F.col("pred_kmh") - F.col("bus_kmh")) / F.col("bus_kmh"))


def free_flow_ladder(limit_kmh: Column, area: Column, highway: Column, wales: Column, service: float, urban_wales: float, urban: float, rural_main: float, rural_minor: float) -> Column:
    """Free-flow speed: the signed limit, else by kind of road and place."""
    built_up = area.isin("centre", "urban")
    main = F.regexp_replace(highway, "_link", "").isin("motorway", "trunk", "primary", "secondary", "tertiary")
    ladder = F.when(highway.isin("service", "living_street"), service).when(built_up & wales, urban_wales).when(built_up, urban).when(main, rural_main).otherwise(rural_minor)
    return F.coalesce(limit_kmh.cast("double"), ladder.cast("double"))


def site_factors(segments: DataFrame, sites: DataFrame, km: float = 10.0, at_site_m: float = 50.0) -> DataFrame:
    """id, factor, source of trunk segments: the factor of the nearest site of their road, of like bearing and within km (`site` under at_site_m, else `nearest_site`), else the median of all sites (`mean`).

    segments, sites: id, ref, lon, lat, bearing; sites also factor. The nearest is found over grid cells, not all pairs.
    """
    from tramline.functions.geo import angle_between
    from tramline.functions.stats import qualify
    from tramline.operators.spatial import near_pairs

    near = near_pairs(segments, sites, km).filter((F.col("a_ref") == F.col("b_ref")) & (angle_between(F.col("a_bearing"), F.col("b_bearing")) < 90))
    near = qualify(near, ["a_id"], [F.asc("dist_km"), F.asc("b_id")])
    near = near.select(F.col("a_id").alias("id"), F.col("b_factor").alias("_f"), "dist_km")
    every = sites.agg(F.percentile("factor", F.lit(0.5)).alias("_m")).withColumn("_k", F.lit(1))
    rows = segments.select("id").withColumn("_k", F.lit(1)).join(every, "_k").join(near, "id", "left")
    source = F.when(F.col("dist_km") * 1000 < at_site_m, "site").when(F.col("_f").isNotNull(), "nearest_site").otherwise("mean")
    return rows.select("id", F.coalesce("_f", "_m").alias("factor"), source.alias("source"))


def sensor_speeds(rows: DataFrame, day_kinds: DataFrame, periods: dict[str, tuple[float, float]] = PERIODS) -> DataFrame:
    """site, period, kmh (harmonic, weighted by volume), rows of quarter-hour sensor rows (site, ts, mph, volume), each in the period of its start.

    Neutral days alone count for weekday periods (others: none), weekends are WE; 8 h within AM counts as AMPH too.
    day_kinds: day, day_type.
    """
    x = rows.filter((F.col("mph") > 0) & (F.col("volume") > 0)).withColumn("day", F.to_date("ts")).join(day_kinds, "day")
    own = F.when(F.col("day_type") == "weekend", "WE").when(F.col("day_type") == "neutral", period(F.hour("ts") * 60 + F.minute("ts"), periods))
    x = x.withColumn("period", F.explode(F.filter(F.array(own, F.when((own == "AM") & (F.hour("ts") == 8), "AMPH")), lambda p: p.isNotNull())))
    kmh = F.sum("volume") / F.sum(F.col("volume") / (F.col("mph") * KMH_PER_MPH))
    return x.groupBy("site", "period").agg(kmh.alias("kmh"), F.count("*").alias("rows"))


def pair_fold(a: Column, b: Column, k: int) -> Column:
    """Fold of an unordered pair of places, by hash."""
    return F.pmod(F.crc32(F.concat_ws("|", F.least(a, b), F.greatest(a, b)).cast("binary")), F.lit(k)).cast("int")


def profile_folds(rows: DataFrame, fold: str) -> DataFrame:
    """Per fold: (k, b) of the other folds that minimise sum w (t - k profile - b junctions)^2 with b >= 0, from sums of the whole less the fold's own; and the fold's relative error in all its time. rows: t, profile, junctions, w."""
    w, p, j, t = (F.col(c) for c in ("w", "profile", "junctions", "t"))
    names = {"pp": w * p * p, "pj": w * p * j, "jj": w * j * j, "pt": w * p * t, "jt": w * j * t}
    own = rows.groupBy(fold).agg(*[F.sum(x).alias(n) for n, x in names.items()], F.sum(w * p).alias("_p"), F.sum(w * j).alias("_j"), F.sum(w * t).alias("_t")).withColumn("_k", F.lit(1))
    whole = own.groupBy("_k").agg(*[F.sum(n).alias(f"all_{n}") for n in names])
    rest = own.join(whole, "_k").withColumns({n: F.col(f"all_{n}") - F.col(n) for n in names})
    det = F.col("pp") * F.col("jj") - F.col("pj") * F.col("pj")
    b = (F.col("jt") * F.col("pp") - F.col("pt") * F.col("pj")) / det
    k = F.when(b >= 0, (F.col("pt") * F.col("jj") - F.col("jt") * F.col("pj")) / det).otherwise(F.col("pt") / F.col("pp"))
    fit = rest.withColumns({"k": k, "b": F.greatest(b, F.lit(0.0))})
    return fit.select(fold, "k", "b", ((F.col("k") * F.col("_p") + F.col("b") * F.col("_j")) / F.col("_t") - 1).alias("error"))
