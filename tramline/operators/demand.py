"""Demand operators: base matrices, distances, fallbacks, splits, gateways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.config import GRAVITY_KM, RAIL_SHARE_BANDS_KM, RAIL_SHARE_MIN_N, STATION_COUNT, STATION_OFFSET_KM
from tramline.functions.curves import band_index
from tramline.functions.stats import share_in_group
from tramline.operators.nearest import nearest


def flow_tag(o_in: Column, d_in: Column) -> Column:
    """null for internal flows, `out` from inside to outside, `in` the other way, `both` where both ends are outside."""
    return F.when(o_in & d_in, F.lit(None).cast("string")).when(o_in, "out").when(d_in, "in").otherwise("both")


def base_matrix(flows: DataFrame, internal: DataFrame, parent: DataFrame) -> DataFrame:
    """Trips by origin zone (the zone inside, its parent outside), destination parent and tag. flows: o, d, trips; internal: zone; parent: zone, parent. Zones without a parent raise."""
    p = lambda c: parent.select(F.col("zone").alias(c), F.col("parent").alias(f"{c}_parent"))
    i = lambda c: internal.select(F.col("zone").alias(c)).distinct().withColumn(f"{c}_in", F.lit(True))
    rows = flows.join(p("o"), "o", "left").join(p("d"), "d", "left").join(i("o"), "o", "left").join(i("d"), "d", "left")
    known = lambda c: F.when(F.col(f"{c}_parent").isNull(), F.raise_error(F.lit("a zone has no parent")).cast("int")).otherwise(F.col(f"{c}_parent"))
    oi, di = F.coalesce("o_in", F.lit(False)), F.coalesce("d_in", F.lit(False))
    rows = rows.select(F.when(oi, F.col("o")).otherwise(known("o")).alias("o_zone"), F.when(oi, "zone").otherwise("parent").alias("o_level"), known("d").alias("d_parent"), flow_tag(oi, di).alias("external"), "trips")
    return rows.groupBy("o_zone", "o_level", "d_parent", "external").agg(F.sum("trips").cast("double").alias("trips"))


def external_distance(outside: DataFrame, inside: DataFrame, key: str) -> DataFrame:
    """Distance from each outside point to the nearest inside one (cosine at the outside point)."""
    return nearest(outside.select(key, "lon", "lat"), inside.select(F.col(key).alias("target"), "lon", "lat"), "target").select(key, "km")


def split_destinations(matrix: DataFrame, jobs: DataFrame, parent: str = "d_parent") -> DataFrame:
    """Trips to a parent dealt to its zones by job share (zones with jobs). jobs: parent, zone, jobs. Trips that would be lost raise at the end of `conserved`."""
    share = jobs.filter("jobs > 0").withColumn("share", share_in_group(F.col("jobs"), [parent])).select(parent, F.col("zone").alias("d_zone"), "share")
    return matrix.join(share, parent).withColumn("trips", F.col("trips") * F.col("share")).drop("share")


def conserved(before: DataFrame, after: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: total before and after, and whether they agree."""
    a = before.agg(F.sum("trips").alias("before")).withColumn("_k", F.lit(1))
    b = after.agg(F.sum("trips").alias("after")).withColumn("_k", F.lit(1))
    return a.join(b, "_k").select("before", "after", (F.abs(F.col("before") - F.col("after")) <= tolerance).alias("conserved"))


def external_factors(modelled: DataFrame, jobs: DataFrame, discount: float, check: float) -> DataFrame:
    """Per destination parent: factor = jobs (1 - discount) / inflow if that exists and is at most `check`, else the overall ratio; with its basis."""
    want = jobs.groupBy("d_parent").agg((F.sum("jobs") * F.lit(1 - discount)).alias("want"))
    got = modelled.groupBy("d_parent").agg(F.sum("trips").alias("got"))
    both = got.join(want, "d_parent", "left").withColumn("own", F.try_divide("want", "got"))
    pool = both.agg(F.try_divide(F.sum("want"), F.sum(F.when(F.col("want").isNotNull(), F.col("got")))).alias("pool")).withColumn("_k", F.lit(1))
    fine = F.col("own").isNotNull() & (F.col("own") <= check)
    out = both.join(pool, F.lit(1) == F.col("_k"))
    return out.select("d_parent", F.when(fine, F.col("own")).otherwise(F.col("pool")).alias("factor"), F.when(fine, "own").otherwise("pooled").alias("basis"))


def fallback_share(rows: DataFrame, levels: list[list[str]], hit: Column, min_n: int) -> DataFrame:
    """Per finest key: the share of hits at the first level with at least min_n rows, the last level whatever its number; with the level used."""
    rows = rows.withColumn("_h", hit.cast("double"))
    out = rows.select(*levels[0]).distinct()
    for i, keys in enumerate(levels):
        g = rows.groupBy(*keys).agg(F.avg("_h").alias(f"_s{i}"), F.count("*").alias(f"_n{i}"))
        out = out.join(g, keys, "left")
    share, basis = F.col(f"_s{len(levels) - 1}"), F.lit(len(levels))
    for i in range(len(levels) - 2, -1, -1):
        ok = F.col(f"_n{i}") >= min_n
        share, basis = F.when(ok, F.col(f"_s{i}")).otherwise(share), F.when(ok, i + 1).otherwise(basis)
    return out.select(*levels[0], share.alias("share"), basis.alias("level"))


def segment_split(matrix: DataFrame, share: DataFrame, keys: list[str]) -> DataFrame:
    """Each flow as two rows: CA with the share, NCA with the rest."""
    rows = matrix.join(share, keys)
    two = F.array(F.struct(F.lit("CA").alias("segment"), F.col("share").alias("w")), F.struct(F.lit("NCA").alias("segment"), (F.lit(1.0) - F.col("share")).alias("w")))
    return rows.withColumn("_s", F.explode(two)).select(*matrix.columns[:-1], F.col("_s.segment").alias("segment"), (F.col("trips") * F.col("_s.w")).alias("trips"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: totals of two matrices, and the largest absolute difference over keys in either."""
    s = lambda df, c: df.groupBy(*keys).agg(F.sum("trips").alias(c))
    j = s(a, "a").join(s(b, "b"), keys, "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return j.agg(F.sum("a").alias("total_a"), F.sum("b").alias("total_b"), F.max(F.abs(F.col("a") - F.col("b"))).alias("worst"))


def discount(high: Column, survey: Column) -> dict[str, Column]:
    """Low, central and high workplace discounts from two attendance shares, the higher one and the survey's."""
    return {"low": 1 - high, "central": 1 - (high + survey) / 2, "high": 1 - survey}


def correct(matrix: DataFrame, no_fixed: DataFrame, jobs: DataFrame, d: float) -> DataFrame:
    """Origin totals raised by workers without a fixed place, then destinations scaled to jobs x (1 - d); destinations without jobs stay.

    Two explicit proportional steps of our own design; another correction can be put in its place.
    """
    o = matrix.groupBy("o_zone").agg(F.sum("trips").alias("_o")).join(no_fixed, "o_zone", "left")
    up = matrix.join(o.select("o_zone", (F.lit(1.0) + F.coalesce(F.col("workers") / F.col("_o"), F.lit(0.0))).alias("_u")), "o_zone").withColumn("trips", F.col("trips") * F.col("_u")).drop("_u")
    at = up.groupBy("d_zone").agg(F.sum("trips").alias("_d")).join(jobs, "d_zone", "left")
    f = at.select("d_zone", F.coalesce(F.try_divide(F.col("jobs") * F.lit(1 - d), F.col("_d")), F.lit(1.0)).alias("_f"))
    return up.join(f, "d_zone").withColumn("trips", F.col("trips") * F.col("_f")).select(*matrix.columns)


def gateway_flows(od: DataFrame, gateways: DataFrame) -> DataFrame:
    """Journeys with exactly one end at a gateway: dir `in` where it is the destination. od: o, d, j; gateways: station."""
    g = lambda c: gateways.select(F.col("station").alias(c)).distinct().withColumn(f"g_{c}", F.lit(True))
    rows = od.join(g("o"), "o", "left").join(g("d"), "d", "left").na.fill(False, ["g_o", "g_d"]).filter("g_o <> g_d")
    out = rows.select(F.when(F.col("g_d"), "in").otherwise("out").alias("dir"), F.when(F.col("g_d"), F.col("d")).otherwise(F.col("o")).alias("gateway"), F.when(F.col("g_d"), F.col("o")).otherwise(F.col("d")).alias("station"), "j")
    return out.groupBy("dir", "gateway", "station").agg(F.sum("j").alias("j"))


def rail_share(flows: DataFrame, min_n: int = RAIL_SHARE_MIN_N, cuts: list[float] | None = None) -> DataFrame:
    """Train share by (zone, dir): own where it rests on min_n commuters, else pooled over its distance band. flows: zone, dir, km, train, n."""
    rows = flows.withColumn("band", band_index(F.col("km"), cuts or RAIL_SHARE_BANDS_KM))
    own = rows.groupBy("zone", "dir", "band").agg(F.sum("train").alias("_t"), F.sum("n").alias("_n"))
    pool = rows.groupBy("dir", "band").agg(F.try_divide(F.sum("train"), F.sum("n")).alias("_p"))
    j = own.join(pool, ["dir", "band"])
    return j.select("zone", "dir", "band", F.when(F.col("_n") >= min_n, F.col("_t") / F.col("_n")).otherwise(F.col("_p")).alias("share"), F.when(F.col("_n") >= min_n, "own").otherwise("band").alias("basis"))


def station_weights(zones: DataFrame, stations: DataFrame, key: str, k: int = STATION_COUNT, offset_km: float = STATION_OFFSET_KM) -> DataFrame:
    """The k nearest stations with flow of each zone, weights flow / (km + offset)^2 that sum to 1. stations: station, lon, lat, flow."""
    near = nearest(zones.select(key, "lon", "lat"), stations.filter("flow > 0").select("station", "lon", "lat"), "station", k)
    near = near.join(stations.select("station", "flow"), "station")
    w = F.col("flow") / F.pow(F.col("km") + offset_km, F.lit(2.0))
    return near.withColumn("_w", w).select(key, "station", "km", (F.col("_w") / F.sum("_w").over(Window.partitionBy(key))).alias("weight"))


def gateway_demand(journeys: DataFrame, pattern: DataFrame, size: DataFrame, factor: float, min_commuters: float, decay_km: float = GRAVITY_KM) -> DataFrame:
    """Weekday trips of each gateway and direction dealt to zones: by commuting pattern where it rests on min_commuters, else by size x exp(-km / decay).

    journeys: dir, gateway, j; pattern: dir, gateway, zone, commuters; size: dir, gateway, zone, size, km.
    """
    keys = ["dir", "gateway"]
    n = pattern.groupBy(*keys).agg(F.sum("commuters").alias("_c"))
    j = journeys.join(n, keys, "left").withColumn("_known", F.coalesce("_c", F.lit(0)) >= min_commuters)
    a = pattern.withColumn("w", share_in_group(F.col("commuters").cast("double"), keys)).select(*keys, "zone", "w")
    b = size.withColumn("w", share_in_group(F.col("size") * F.exp(-F.col("km") / decay_km), keys)).select(*keys, "zone", "w")
    put = lambda known, w, basis: j.filter(F.col("_known") == known).join(w, keys).select(*keys, "zone", (F.col("j") * factor * F.col("w")).alias("trips"), F.lit(basis).alias("basis"))
    return put(True, a, "pattern").unionByName(put(False, b, "gravity"))


# Country codes that stand for zones beyond the classification, by the first letter of an area's code.
COUNTRY = {"S": "S92000003", "N": "N92000002"}
#: Share of journeys at stations without a place beyond which gateway flows are no use.
MOST_UNLOCATED = 0.05


def country_default(zone: Column, code: Column) -> Column:
    """The zone, else the country that the code's first letter names, else null."""
    out = zone
    for letter, country in COUNTRY.items():
        out = F.coalesce(out, F.when(code.startswith(letter), F.lit(country)))
    return out


def fixed_place_flows(flows: DataFrame, zones: DataFrame) -> DataFrame:
    """Flows (o, d, place, n) to a fixed workplace (place 3) that touch the zones (code) at either end."""
    known = lambda c: zones.select(F.col("code").alias(c)).distinct().withColumn(f"_{c}", F.lit(True))
    rows = flows.filter("place = 3").join(known("o"), "o", "left").join(known("d"), "d", "left")
    return rows.filter("_o or _d").select("o", "d", "n")


def no_fixed_place(workers: DataFrame, parent: DataFrame, share_at_home: float) -> DataFrame:
    """zone, nofixed: workers without a fixed place or offshore, less those at home. workers: code, nofixed_offshore; parent: code, zone."""
    return workers.join(parent.select("code", "zone").distinct(), "code").groupBy("zone").agg(F.sum(F.col("nofixed_offshore") * F.lit(1 - share_at_home)).alias("nofixed"))


def jobs_by_parent(jobs: DataFrame, parent: DataFrame, internal: DataFrame) -> DataFrame:
    """parent, jobs: jobs (zone, jobs) of internal zones (zone) by their parent (zone, parent)."""
    return jobs.join(internal.select("zone").distinct(), "zone", "left_semi").join(parent.select("zone", "parent").distinct(), "zone").groupBy("parent").agg(F.sum("jobs").alias("jobs"))


def unlocated_share(flows: DataFrame, stations: DataFrame, most: float = MOST_UNLOCATED) -> DataFrame:
    """One row: journeys, share at stations (station) without a place, how many those are. More than `most` of them, or no journeys, raise when the row is read."""
    rows = flows.join(stations.select("station").distinct().withColumn("_known", F.lit(True)), "station", "left")
    lost = F.col("_known").isNull()
    one = rows.agg(F.sum("j").alias("journeys"), F.coalesce(F.sum(F.when(lost, F.col("j"))), F.lit(0)).alias("_l"), F.countDistinct(F.when(lost, F.col("station"))).alias("unlocated"))
    share = F.col("_l") / F.col("journeys")
    bad = F.coalesce(F.col("journeys"), F.lit(0)) == 0
    checked = F.when(bad, F.raise_error(F.lit("no journey has exactly one end at a gateway")).cast("double")).when(share > most, F.raise_error(F.lit("too many journeys at stations without a place")).cast("double")).otherwise(share)
    return one.select("journeys", checked.alias("share"), "unlocated")


def matrix_steps(steps: list[DataFrame]) -> DataFrame:
    """step (from 1), total, change: what each cumulative step of a correction leaves of all trips, and its change. Each holds trips."""
    one = [s.agg(F.sum("trips").alias("total")).withColumn("step", F.lit(i)) for i, s in enumerate(steps, 1)]
    rows = one[0]
    for s in one[1:]:
        rows = rows.unionByName(s)
    before = rows.select((F.col("step") + 1).alias("step"), F.col("total").alias("_b"))
    return rows.join(before, "step", "left").select("step", "total", F.coalesce(F.col("total") - F.col("_b"), F.lit(0.0)).alias("change"))


def land_use(zones: DataFrame, residents: DataFrame, jobs: DataFrame, version: str) -> DataFrame:
    """zone, parent, residents, jobs, version: one row a zone. A zone without residents raises when its row is read. zones: zone, parent, weight; residents: zone, residents; jobs: parent, jobs, dealt by weight."""
    from tramline.operators.spatial import split_jobs

    j = split_jobs(zones, "parent", "weight", jobs).join(residents.select("zone", F.col("residents").alias("_r")), "zone", "left")
    known = F.coalesce("_r", F.raise_error(F.concat(F.lit("no residents for zone "), F.col("zone").cast("string"))).cast("long"))
    return j.select("zone", "parent", known.alias("residents"), "jobs", F.lit(version).alias("version"))
