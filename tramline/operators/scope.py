"""What a study takes in: zones by their centroid, central zones, one built-up area, sensor sites by their description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.geo import in_box
from tramline.operators.spatial import in_polygon, touching_components

#: Directions that end a site's description, and their bearings.
BEARINGS = {"Northbound": 0, "Eastbound": 90, "Southbound": 180, "Westbound": 270}


def _needed(column: str, what: str) -> Column:
    return F.when(F.col(column).isNull(), F.raise_error(F.lit(what)).cast("double")).otherwise(F.col(column))


def zones_inside(zones: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Zones whose centroid lies in the box (west, south, east, north; closed). zones: zone, lon, lat and others; one without a centroid raises when rows are read."""
    known = zones.withColumns({c: _needed(c, "a zone has no centroid") for c in ("lon", "lat")})
    return known.filter(in_box(F.col("lon"), F.col("lat"), box))


def central_zones(zones: DataFrame, least_per_km2: float, least_together: int) -> DataFrame:
    """zone, cluster: urban zones with a density of jobs over the least, in groups that touch and hold at least so many; a cluster has its smallest zone's number.

    zones: zone (long), ring, jobs (null: 0), km2, urban.
    """
    dense = zones.filter(F.col("urban") & (F.coalesce("jobs", F.lit(0)) / F.col("km2") >= least_per_km2))
    found = touching_components(dense.select(F.col("zone").alias("id"), "ring"))
    many = found.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= least_together)
    return found.join(many, "component", "left_semi").select(F.col("id").alias("zone"), F.col("component").alias("cluster"))


def built_up_scope(areas: DataFrame, zones: DataFrame, seed: int, core: str, fringe: list[str]) -> DataFrame:
    """zone, district, area_type, in_scope for the zones of a built-up area's districts.

    The area is all of `areas` (id, ring) that touch the seed's, directly or over others. In scope are the centre and urban
    zones of the core district, and those of the fringe districts whose centroid lies in the area. zones: zone, district,
    area_type, lon, lat. A seed that is no area raises when rows are read.
    """
    parts = touching_components(areas)
    own = parts.filter(F.col("id") == seed).agg(F.first("component").alias("component"))
    own = own.select(F.when(F.col("component").isNull(), F.raise_error(F.lit("the seed is no built-up area")).cast("long")).otherwise(F.col("component")).alias("component"))
    members = areas.join(parts.join(own, "component", "left_semi").select("id"), "id").select(F.col("id").alias("name"), "ring")
    near = zones.filter(F.col("district").isin(core, *fringe))
    within = in_polygon(near.filter(F.col("district").isin(*fringe)), members, "zone", "name").select("zone").distinct().withColumn("_in", F.lit(True))
    # Read even where nothing lies within, so that a wrong seed shows.
    near = near.join(own.select(F.lit(True).alias("_known")), F.lit(True) == F.col("_known")).drop("_known").join(within, "zone", "left")
    built = F.col("area_type").isin("centre", "urban")
    return near.select("zone", "district", "area_type", (built & ((F.col("district") == core) | F.coalesce("_in", F.lit(False)))).alias("in_scope"))


def sensor_sites(sites: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """site, name, road, kind, direction, bearing, lon, lat of the active sites on main carriageways in the box.

    sites: site, name, description, status, lon, lat. The direction is what the description ends with, after a semicolon; a
    site whose description begins with MIDAS is named by its road, others say which road they are on and between what.
    Slip roads and connectors say neither.
    """
    text = F.coalesce("description", F.lit(""))
    direction = F.trim(F.element_at(F.split(text, ";"), -1))
    midas = text.startswith("MIDAS")
    on = F.regexp_extract(text, r"\bon (?:link )?([AM]\d+(?:\(M\))?)(?![\w(])", 1)
    on = F.when(on == "", F.regexp_extract(text, r"\bon (?:link )?([AM]\d+)\b", 1)).otherwise(on)
    rows = sites.filter((F.col("status") == "Active") & in_box(F.col("lon"), F.col("lat"), box)).withColumns({"direction": direction, "kind": F.when(midas, "midas").otherwise("tmu"), "road": F.when(midas, F.element_at(F.split("name", "/"), 1)).otherwise(F.nullif(on, F.lit("")))})
    named = F.create_map(*[F.lit(x) for pair in BEARINGS.items() for x in pair])
    rows = rows.withColumn("bearing", F.try_element_at(named, F.col("direction"))).filter("bearing is not null and road is not null")
    between = text.contains(" between ")
    return rows.filter((F.col("kind") == "midas") | between).select("site", "name", "road", "kind", "direction", "bearing", "lon", "lat")


def signal_delays(segments: DataFrame, signals: DataFrame, delays: DataFrame, periods: list[str], default: str = "IP") -> DataFrame:
    """segments with period and delay_s, a row a segment and period: the seconds of the segment's area at approaches to signals (v is a signal's node), else 0.

    segments: v, area_type and others; signals: node; delays: period, area, delay_s. A period without delays takes those of
    `default`; an area without one (a buffer counts as rural) takes the urban one's, or 0. A handful of delays is held as a map.
    """
    known = delays.groupBy("period").agg(F.map_from_entries(F.collect_list(F.struct("area", "delay_s"))).alias("_d"))
    wanted = delays.sparkSession.createDataFrame([(p,) for p in periods], "period string")
    other = known.filter(F.col("period") == default).select(F.col("_d").alias("_o"), F.lit(1).alias("_k"))
    by = wanted.join(known, "period", "left").withColumn("_k", F.lit(1)).join(other, "_k", "left").select("period", F.coalesce("_d", "_o").alias("_d"))
    at = signals.select(F.col("node").alias("v")).distinct().withColumn("_s", F.lit(True))
    rows = segments.join(at, "v", "left").join(F.broadcast(by))  # a row a period
    area = F.when(F.col("area_type") == "buffer", "rural").otherwise(F.col("area_type"))
    late = F.coalesce(F.try_element_at("_d", area), F.try_element_at("_d", F.lit("urban")), F.lit(0.0))
    return rows.select(*segments.columns, "period", F.when(F.coalesce("_s", F.lit(False)), late).otherwise(F.lit(0.0)).alias("delay_s"))
