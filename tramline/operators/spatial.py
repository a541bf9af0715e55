"""Joins by place: grid buckets instead of cross joins, nearest neighbours, polygons, and scores built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import DISTANCE_BANDS, INTERVAL_BANDS, KM_PER_DEGREE, SCORE_CAP_DPH
from tramline.functions.curves import first_at_least
from tramline.functions.geo import flat_km
from tramline.functions.stats import qualify
from tramline.operators.components import components


#: A row of cells in which the cosine of the latitude may fall below this is one cell, whatever the longitude.
LEAST_COS = 1e-6


def near_pairs(left: DataFrame, right: DataFrame, km: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows of left and right (columns prefixed a_ and b_) within km of each other, with dist_km.

    A row of cells is as high as the radius. Its cells are as wide as the radius at the row's least cosine, one row to either
    side included, so a match lies in the cell or one of its eight neighbours at any latitude; the right side is posted in
    its cell, the left asks three in each of three rows. Coordinates that are null or not finite match nothing.
    """
    high = km * (1 + 1e-9) / KM_PER_DEGREE if km > 0 else 1.0
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    row = lambda c: F.floor(F.col(c) / high).cast("double")

    def column(c: str, y: Column) -> Column:
        south, north = (y - 1) * high, (y + 2) * high
        least = F.least(F.abs(F.cos(F.radians(south))), F.abs(F.cos(F.radians(north))))
        over_pole = F.floor((south - 90) / 180) != F.floor((north - 90) / 180)
        return F.when(over_pole | (least < LEAST_COS), F.lit(0.0)).otherwise(F.floor(F.col(c) * least / high).cast("double"))

    a = left.select([F.col(c).alias(f"a_{c}") for c in left.columns]).filter(finite(f"a_{lon}") & finite(f"a_{lat}"))
    b = right.select([F.col(c).alias(f"b_{c}") for c in right.columns]).filter(finite(f"b_{lon}") & finite(f"b_{lat}"))
    near = lambda: F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    a = a.withColumn("_d", near()).withColumn("_y", row(f"a_{lat}") + F.col("_d")).withColumn("_d", near()).withColumn("_x", column(f"a_{lon}", F.col("_y")) + F.col("_d")).drop("_d")
    b = b.withColumn("_y", row(f"b_{lat}"))
    out = a.join(b.withColumn("_x", column(f"b_{lon}", F.col("_y"))), ["_x", "_y"])
    out = out.withColumn("dist_km", flat_km(F.col(f"a_{lon}"), F.col(f"a_{lat}"), F.col(f"b_{lon}"), F.col(f"b_{lat}")))
    return out.filter(F.col("dist_km") <= km).drop("_x", "_y")


def near_flag(left: DataFrame, right: DataFrame, km: float, key: str, out: str = "near") -> DataFrame:
    """left with a flag: whether any right point lies within km."""
    hit = near_pairs(left.select(key, "lon", "lat"), right.select("lon", "lat"), km).select(F.col(f"a_{key}").alias(key)).distinct().withColumn(out, F.lit(True))
    return left.join(hit, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def count_within(left: DataFrame, right: DataFrame, km: float, key: str, out: str = "n_near") -> DataFrame:
    n = near_pairs(left.select(key, "lon", "lat"), right.select("lon", "lat"), km).groupBy(F.col(f"a_{key}").alias(key)).agg(F.count("*").alias(out))
    return left.join(n, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def in_polygon(points: DataFrame, polygons: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name) of points inside polygons (name, ring: array of struct lon, lat) by even-odd parity of crossed edges; cells of each polygon's box meet the points' cells."""
    size = 0.05
    box = polygons.withColumns({"x0": F.array_min(F.transform("ring", lambda p: p["lon"])), "x1": F.array_max(F.transform("ring", lambda p: p["lon"])), "y0": F.array_min(F.transform("ring", lambda p: p["lat"])), "y1": F.array_max(F.transform("ring", lambda p: p["lat"]))})
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    box = box.withColumn("_x", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("_y", F.explode(F.sequence(cell("y0"), cell("y1"))))
    at = points.select(key, "lon", "lat", cell("lon").alias("_x"), cell("lat").alias("_y"))
    rows = at.join(box, ["_x", "_y"]).filter(F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1")))
    n = F.size("ring")

    def crosses(i):
        a, b = F.get("ring", i), F.get("ring", F.pmod(i + 1, n))
        straddles = (a["lat"] > F.col("lat")) != (b["lat"] > F.col("lat"))
        x = a["lon"] + (F.col("lat") - a["lat"]) * (b["lon"] - a["lon"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0))
        return F.when(straddles & (F.col("lon") < x), 1).otherwise(0)

    parity = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + crosses(i)) % 2
    return rows.filter(parity == 1).select(key, name)


def clusters(pairs: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """(key, cluster_id): components of the pairs (a, b), each named by its smallest member; points in no pair are their own."""
    got = components(pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    return points.select(key).join(got.withColumnRenamed("id", key), key, "left").select(key, F.coalesce("component", F.col(key)).alias("cluster_id"))


def candidate_pairs(points: DataFrame, key: str, name: str, same_m: float, any_m: float) -> DataFrame:
    """a < b within same_m metres if they share a name, within any_m otherwise."""
    cut = points.select(key, name, "lon", "lat")
    p = near_pairs(cut, cut, max(same_m, any_m) / 1000).filter(F.col(f"a_{key}") < F.col(f"b_{key}"))
    return p.filter((F.col("dist_km") * 1000 <= any_m) | ((F.col(f"a_{name}") == F.col(f"b_{name}")) & (F.col("dist_km") * 1000 <= same_m))).select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), (F.col("dist_km") * 1000).alias("dist_m"))


def stop_category(headway: Column, cuts: list[float] = INTERVAL_BANDS) -> Column:
    """1 for a headway below the first cut, ...; null from the last cut on."""
    out = None
    for i, c in enumerate(cuts):
        out = F.when(headway < c, i + 1) if out is None else out.when(headway < c, i + 1)
    return out


def access_class(category: Column, metres: Column, cuts: list[float] = DISTANCE_BANDS) -> Column:
    """A to D by stop category and distance band: a step down for each band further and each category lower; null past D."""
    band = first_at_least(metres, cuts)
    return F.get(F.array(*map(F.lit, "ABCD")), (F.greatest(category - 2, F.lit(0)) + band).cast("int"))


def coverage_score(base: DataFrame, reach: DataFrame, level: DataFrame, decay: Column, key: str, headways: list[float], cap: float = SCORE_CAP_DPH) -> DataFrame:
    """Per base row: best class, score sum(decay x min(departures, cap)), and for each headway whether a service that frequent is in reach, and its nearest walk.

    reach: key, cluster_id, walk_min; level: cluster_id, mode, dph_one_way, directions. Rows with nothing in reach stay: class none, 0, false, null.
    """
    m = reach.join(level, "cluster_id").withColumn("_w", decay)
    cls = access_class(stop_category(F.lit(60.0) / F.col("dph_one_way")), F.col("walk_min") * 80)
    # A headway that is promised counts on both directions being served.
    often = lambda h: (F.col("dph_one_way") >= 60.0 / h) & (F.col("directions") >= 1)
    g = m.groupBy(key).agg(F.min(cls).alias("class"), F.sum(F.col("_w") * F.least("dph_one_way", F.lit(cap))).alias("score"), *[x for h in headways for x in (F.max(often(h)).alias(f"frequent_{h:g}"), F.min(F.when(often(h), F.col("walk_min"))).alias(f"walk_{h:g}"))])
    out = base.join(g, key, "left")
    fill = {"class": "none", "score": 0.0} | {f"frequent_{h:g}": False for h in headways}
    return out.fillna(fill)


def split_jobs(zones: DataFrame, parent: str, weight: str, jobs: DataFrame) -> DataFrame:
    """Jobs of a parent dealt to its zones by weight; equally where all weights are 0; parents without jobs give 0. jobs: parent, jobs."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(parent)
    rows = zones.withColumns({"_t": F.sum(weight).over(w), "_n": F.count("*").over(w)}).join(jobs.select(parent, F.col("jobs").alias("_j")), parent, "left")
    share = F.when(F.col("_t") > 0, F.col(weight) / F.col("_t")).otherwise(F.lit(1.0) / F.col("_n"))
    return rows.withColumns({"jobs": F.coalesce("_j", F.lit(0)) * share, "equal_split": F.col("_t") == 0}).drop("_t", "_n", "_j")


def coverage_summary(oas: DataFrame, by: str, flags: list[str]) -> DataFrame:
    """Per class: zones, residents, jobs, residents' mean score, and residents served by each flag."""
    r = F.col("residents")
    return oas.groupBy(by).agg(F.count("*").alias("zones"), F.sum(r).alias("residents"), F.sum("jobs").alias("jobs"), F.try_divide(F.sum(F.col("score") * r), F.sum(r)).alias("mean_score"), *[F.sum(F.when(F.col(f), r).otherwise(0)).alias(f"served_{f}") for f in flags])


def walk_diagnostics(pairs: DataFrame, at_least_m: float = 100.0) -> DataFrame:
    """Network over straight distance: median, p95, p99 and counts above 3 and 5. pairs: network_m, straight_m."""
    r = F.col("network_m") / F.col("straight_m")
    rows = pairs.filter(F.col("straight_m") >= at_least_m)
    return rows.agg(F.count("*").alias("pairs"), *[F.percentile(r, F.lit(p)).alias(k) for p, k in ((0.5, "median"), (0.95, "p95"), (0.99, "p99"))], F.sum((r > 3).cast("long")).alias("over_3"), F.sum((r > 5).cast("long")).alias("over_5"))


def nearest_on_side(segments: DataFrame, sites: DataFrame, by: str, km: float, max_turn: float = 90.0) -> DataFrame:
    """For each site the nearest segment of its road within km whose bearing differs by under max_turn; ties to the smaller segment."""
    from tramline.functions.geo import angle_between

    p = near_pairs(sites, segments, km).filter((F.col(f"a_{by}") == F.col(f"b_{by}")) & (angle_between(F.col("a_bearing"), F.col("b_bearing")) < max_turn))
    return qualify(p, ["a_id"], [F.asc("dist_km"), F.asc("b_id")])


def walkable(pairs: DataFrame, walks: DataFrame, most_min: float) -> tuple[DataFrame, DataFrame]:
    """(pairs that hold, pairs that are cut) by the worse of the walking times between a and b. pairs: a, b; walks: from, to, minutes.

    A pair is cut where the longer of its two walks is over most_min, or where neither is known.
    """
    way = lambda x, y, out: walks.groupBy(F.col("from").alias(x), F.col("to").alias(y)).agg(F.min("minutes").alias(out))
    j = pairs.join(way("a", "b", "_there"), ["a", "b"], "left").join(way("b", "a", "_back"), ["a", "b"], "left")
    worse = F.greatest("_there", "_back")  # nulls are passed over
    j = j.withColumn("walk_min", worse).drop("_there", "_back")
    good = F.col("walk_min").isNotNull() & (F.col("walk_min") <= most_min)
    return j.filter(good).select(*pairs.columns), j.filter(~good)


#: Coordinates of rings are whole numbers of this many to a degree (about a centimetre), so that touching is exact.
RING_UNITS = 10_000_000


def _sides(rings: DataFrame) -> DataFrame:
    """id, ax, ay, bx, by: the sides of rings in whole units, left end first; closing sides included, points without length not."""
    unit = lambda c: F.round(c * RING_UNITS).cast("long")
    at = F.transform("ring", lambda p: F.struct(unit(p["lon"]).alias("x"), unit(p["lat"]).alias("y")))
    rows = rings.select("id", at.alias("p")).select("id", F.explode(F.arrays_zip(F.col("p").alias("a"), F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1)).alias("b"))).alias("s"))
    rows = rows.select("id", F.least("s.a", "s.b").alias("l"), F.greatest("s.a", "s.b").alias("r")).filter("l <> r")
    return rows.select("id", F.col("l.x").alias("ax"), F.col("l.y").alias("ay"), F.col("r.x").alias("bx"), F.col("r.y").alias("by")).distinct()


def _meet() -> Column:
    """Whether sides a-b and c-d (whole numbers) have a point in common, ends and stretches in line included."""

    def turn(px, py, qx, qy, rx, ry):
        p, q, r = ((F.col(x), F.col(y)) for x, y in ((px, py), (qx, qy), (rx, ry)))
        return F.signum((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))

    a, b, c, d = (("ax", "ay"), ("bx", "by"), ("cx", "cy"), ("dx", "dy"))
    apart = (turn(*a, *b, *c) * turn(*a, *b, *d) > 0) | (turn(*c, *d, *a) * turn(*c, *d, *b) > 0)
    box = (F.col("ax") <= F.col("dx")) & (F.col("cx") <= F.col("bx")) & (F.least("ay", "by") <= F.greatest("cy", "dy")) & (F.least("cy", "dy") <= F.greatest("ay", "by"))
    return box & ~apart


def touching_components(rings: DataFrame) -> DataFrame:
    """(id, component) of polygons that touch, cross or contain each other, directly or over others; component is the smallest id. rings: id (long), ring (array of lon, lat; closed or not).

    Equal rings count once. Polygons hang on the smallest one at each corner and each side that they share; sides of what is
    still apart then meet in grid cells and are tested exactly on whole units; last, of what is still apart, a corner of one
    is looked for inside the other. A ring of fewer than three corners touches as the line or point that it is.
    """
    from tramline.operators.components import components
    from tramline.session import written

    rings = rings.filter("size(ring) > 0").select(F.col("id").cast("long").alias("id"), F.transform("ring", lambda p: F.struct(p["lon"].cast("double").alias("lon"), p["lat"].cast("double").alias("lat"))).alias("ring"))
    first = rings.groupBy("ring").agg(F.min("id").alias("one"))
    copies = written(rings.join(first, "ring").select("id", "one"), "ring-copies")
    kept = written(first.select(F.col("one").alias("id"), "ring"), "rings")
    unit = lambda c: F.round(c * RING_UNITS).cast("long")
    corners = kept.select("id", F.explode("ring").alias("p")).select("id", unit(F.col("p.lon")).alias("x"), unit(F.col("p.lat")).alias("y")).distinct()
    hung = corners.join(corners.groupBy("x", "y").agg(F.min("id").alias("b")), ["x", "y"]).select(F.col("id").alias("a"), "b").distinct()
    near = written(components(hung), "ring-corners")

    # A point is a side too where its ring has no other.
    points = corners.groupBy("id").agg(F.count("*").alias("n"), F.min("x").alias("ax"), F.min("y").alias("ay")).filter("n = 1").select("id", "ax", "ay", F.col("ax").alias("bx"), F.col("ay").alias("by"))
    sides = written(_sides(kept).unionByName(points).join(near, "id").groupBy("ax", "ay", "bx", "by", "component").agg(F.min("id").alias("id")), "ring-sides")
    wide = sides.agg(F.avg(F.greatest(F.col("bx") - F.col("ax"), F.abs(F.col("by") - F.col("ay"))))).first()[0] or 0.0
    cell = max(1000, int(2 * wide))
    # The cells that a side passes, column by column, with a cell to spare above and below for rounding.
    column = F.explode(F.sequence(F.floor(F.col("ax") / cell), F.floor(F.col("bx") / cell)))
    lo_x, hi_x = F.greatest(F.col("ax"), F.col("i") * cell), F.least(F.col("bx"), (F.col("i") + 1) * cell)
    y_at = lambda x: F.when(F.col("bx") == F.col("ax"), F.col("ay").cast("double")).otherwise(F.col("ay") + (F.col("by") - F.col("ay")) * ((x - F.col("ax")) / (F.col("bx") - F.col("ax"))))
    steep = F.col("bx") == F.col("ax")
    y0 = F.when(steep, F.least("ay", "by").cast("double")).otherwise(F.least(y_at(lo_x), y_at(hi_x))) - 2
    y1 = F.when(steep, F.greatest("ay", "by").cast("double")).otherwise(F.greatest(y_at(lo_x), y_at(hi_x))) + 2
    posted = sides.withColumn("i", column).withColumn("j", F.explode(F.sequence(F.floor(y0 / cell), F.floor(y1 / cell))))
    other = posted.select("i", "j", F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"), F.col("component").alias("b"))
    crossing = posted.withColumnRenamed("component", "a").join(other, ["i", "j"]).filter("a < b").filter(_meet()).select("a", "b").distinct()
    over = components(crossing).select(F.col("id").alias("component"), F.col("component").alias("top"))
    joined = written(near.join(over, "component", "left").select("id", F.coalesce("top", "component").alias("component")), "ring-crossings")

    # What neither shares a corner nor crosses either lies apart or within: one corner of each piece tells.
    label = joined.select(F.col("id").alias("of"), "component")
    at = corners.join(joined, "id").groupBy("component").agg(F.min(F.struct("x", "y")).alias("p"))
    at = at.select(F.col("component").alias("piece"), (F.col("p.x") / F.lit(float(RING_UNITS))).alias("lon"), (F.col("p.y") / F.lit(float(RING_UNITS))).alias("lat"))
    inside = in_polygon(at, kept.filter("size(ring) > 2").select(F.col("id").alias("of"), "ring"), "piece", "of").join(label, "of").filter("piece <> component")
    last = components(inside.select(F.col("piece").alias("a"), F.col("component").alias("b")).distinct()).select(F.col("id").alias("component"), F.col("component").alias("top"))
    one = joined.join(last, "component", "left").select(F.col("id").alias("one"), F.coalesce("top", "component").alias("component"))
    low = copies.join(one, "one")
    names = low.groupBy("component").agg(F.min("id").alias("low"))
    return low.join(names, "component").select("id", F.col("low").alias("component"))


def odd_origins(pairs: DataFrame, near_m: float = 400.0) -> DataFrame:
    """Origins whose nearest target is at most near_m away in a straight line, but whose walk there is missing or far longer (minutes x 80 over 3 x metres + 240). pairs: id, target, straight_m, walk_min."""
    one = qualify(pairs, ["id"], [F.asc("straight_m"), F.asc("target")]).filter(F.col("straight_m") <= near_m)
    return one.filter(F.col("walk_min").isNull() | (F.col("walk_min") * 80 > 3 * F.col("straight_m") + 240))


def score_sweep(base: DataFrame, reach: DataFrame, level: DataFrame, scales: dict[str, float], tau: float, key: str, cap: float = SCORE_CAP_DPH) -> DataFrame:
    """variant, key, score for each way of walking: times over a scale (0.5: half as fast) in exp(-minutes / tau). One pass: rows open into a row a variant, a handful."""
    ways = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(float(s)).alias("scale")) for n, s in scales.items()])
    m = reach.join(level, "cluster_id").withColumn("_v", F.explode(ways))
    worth = F.exp(-(F.col("walk_min") / F.col("_v.scale")) / tau) * F.least("dph_one_way", F.lit(cap))
    g = m.groupBy(F.col("_v.variant").alias("variant"), key).agg(F.sum(worth).alias("score"))
    return base.select(key).withColumn("variant", F.explode(F.array(*map(F.lit, scales)))).join(g, ["variant", key], "left").fillna(0.0, ["score"]).select("variant", key, "score")
