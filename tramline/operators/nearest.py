"""The k nearest targets of every point, exactly and at any number of either, over a grid of nested cells.

Targets are counted in cells of several sizes, each a quarter as wide and high as the one around it, down to a size at
which none holds more than CELL_TARGETS. A point starts in the smallest of its own cells that holds k targets; the
farthest corner of that cell bounds its search. The ring of cells within the bound is then opened level by level: of the
cells at hand, those nearest by their far corners that hold k targets give a tighter bound, and cells wholly beyond it go.
What is left at the finest level is met target by target. No row, task or message holds all targets; a point on an empty
plain beside a full town opens only the town's near edge.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.config import KM_PER_DEGREE
from tramline.functions.geo import flat_km
from tramline.functions.stats import qualify
from tramline.session import fresh, written

#: Targets that a cell of the finest level may hold before there is a finer one.
CELL_TARGETS = 16
#: Levels below the one on which targets spread evenly would be one a cell.
DEEPER = 3
#: Room for rounding when a distance is bounded.
SLACK = 1e-9


def _step(x: Column, low: float, width: float, level: Column, deepest: int) -> Column:
    """Cell number along one axis, on a level; cells of level 0 are all there is."""
    finest = F.floor((x - low) / F.lit(width) * F.lit(float(4**deepest))).cast("long")
    return F.floor(finest / F.pow(F.lit(4.0), deepest - level)).cast("long")


def _corner_km(lon: Column, lat: Column, box: dict[str, Column], far: bool, at_left: bool) -> Column:
    """Least distance to a box of targets, or the most, for any target in it (see flat_km: the cosine is the point's own, or midway)."""
    x0, x1, y0, y1 = (box[c] for c in ("x0", "x1", "y0", "y1"))
    zero = F.lit(0.0)
    if far:
        dx, dy = F.greatest(F.abs(lon - x0), F.abs(lon - x1)), F.greatest(F.abs(lat - y0), F.abs(lat - y1))
    else:
        dx, dy = F.greatest(x0 - lon, lon - x1, zero), F.greatest(y0 - lat, lat - y1, zero)
    if at_left:
        c = F.cos(F.radians(lat))
    else:  # between those midway to the box's two sides, or 1 where the equator is between them
        a, b = (lat + y0) / 2, (lat + y1) / 2
        ends = (F.cos(F.radians(a)), F.cos(F.radians(b)))
        c = F.when(a * b < 0, F.lit(1.0)).otherwise(F.greatest(*ends)) if far else F.least(*ends)
    return F.lit(KM_PER_DEGREE) * F.sqrt(F.pow(dx * c, F.lit(2.0)) + F.pow(dy, F.lit(2.0)))


def nearest(left: DataFrame, right: DataFrame, target: str, k: int = 1, at_left: bool = True) -> DataFrame:
    """Rows of left (lon, lat and any others) with rank (from 1), target and km of the k nearest rows of right (target, lon, lat), ties to the smaller target.

    Distance is the flat formula, its cosine at the left point, or midway. Fewer targets than k give fewer rows; rows
    without a place take no part, on either side; rows that repeat count as often as they stand there. Points of one place
    are searched once, and a place of many targets keeps its k smallest.
    """
    x0, x1, y0, y1, lo, la, q, level, cx, cy = fresh([*left.columns, "rank", target, "km"], "x0", "x1", "y0", "y1", "q_lon", "q_lat", "q", "level", "cx", "cy")
    box = {c: F.col(n) for c, n in zip(("x0", "x1", "y0", "y1"), (x0, x1, y0, y1))}
    here = right.select(F.col(target).alias("t"), F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    spots = written(qualify(here, ["x", "y"], [F.asc("t")], k), "nearest-targets")
    n, west, east, south, north = spots.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    out = [*left.columns, "rank", target, "km"]
    nothing = left.withColumns({"rank": F.lit(0), target: F.lit(None).cast(right.schema[target].dataType), "km": F.lit(0.0)}).filter("false").select(*out)
    if not n:
        return nothing
    # Wider by a part in a million, so the last target lies in the last cell.
    width, height = max((east - west) * (1 + 1e-6), 1e-9), max((north - south) * (1 + 1e-6), 1e-9)
    deepest = min(13, max(1, ceil(log(n, 16)) + DEEPER))

    def place(lon: Column, lat: Column, on: Column) -> list[Column]:
        return [_step(lon, west, width, on, deepest).alias(cx), _step(lat, south, height, on, deepest).alias(cy)]

    every = F.sequence(F.lit(0), F.lit(deepest))
    cells = spots.withColumn(level, F.explode(every)).select(level, "x", "y", *place(F.col("x"), F.col("y"), F.col(level)))
    cells = written(cells.groupBy(level, cx, cy).agg(F.count("*").alias("n"), F.min("x").alias(x0), F.max("x").alias(x1), F.min("y").alias(y0), F.max("y").alias(y1)), "nearest-cells")
    full = {r[0]: r[1] for r in cells.groupBy(level).agg(F.max("n")).collect()}  # a row a level
    finest = next((d for d in sorted(full) if full[d] <= CELL_TARGETS), deepest)
    cells = cells.filter(F.col(level) <= finest)

    points = left.select(F.col("lon").cast("double").alias(lo), F.col("lat").cast("double").alias(la)).filter(F.col(lo).isNotNull() & F.col(la).isNotNull() & ~F.isnan(lo) & ~F.isnan(la)).distinct()
    points = written(points.withColumn(q, F.monotonically_increasing_id()), "nearest-points")
    at = [F.col(lo), F.col(la)]
    own = points.withColumn(level, F.explode(F.sequence(F.lit(0), F.lit(finest)))).select(q, lo, la, level, *place(*at, F.col(level)))
    held = own.join(cells.filter(F.col("n") >= k), [level, cx, cy])
    start = held.groupBy(q).agg(F.max(F.struct(level, _corner_km(*at, box, True, at_left).alias("km"))).alias("s")).select(q, F.col(f"s.{level}").alias("first"), F.col("s.km").alias("bound"))
    # A point whose cells all hold too few starts with the one cell of level 0.
    begun = written(points.join(start, q, "left").withColumn("first", F.coalesce("first", F.lit(0))), "nearest-starts")

    starts = {r[0] for r in begun.select("first").distinct().collect()}  # a row a level at most
    if not starts:
        return nothing
    open_ = None
    for d in range(min(starts), finest + 1):
        reach = F.col("bound") * (1 + SLACK) / KM_PER_DEGREE + SLACK
        # Where the bound reaches in longitude: by the least cosine that a distance within it can have.
        least = F.cos(F.radians(F.least(F.abs(F.col(la)) + reach, F.lit(90.0)))) if not at_left else F.cos(F.radians(F.col(la)))
        wide = F.when(least > 1e-6, reach / least).otherwise(F.lit(360.0))
        steps = 4**d

        def span(centre: Column, away: Column, low: float, size: float, steps: int = steps) -> Column:
            a, b = (F.floor((centre + s * away - low) / size * steps) for s in (-1, 1))
            return F.explode(F.sequence(F.least(F.greatest(a, F.lit(0)), F.lit(steps - 1)), F.least(F.greatest(b, F.lit(0)), F.lit(steps - 1))))

        if d not in starts:
            fresh_ = None
        elif d == 0:
            fresh_ = begun.filter("first = 0").select(q, lo, la, F.lit(0).cast("long").alias(cx), F.lit(0).cast("long").alias(cy))
        else:
            fresh_ = begun.filter(F.col("first") == d).withColumn(cx, span(F.col(lo), wide, west, width)).withColumn(cy, span(F.col(la), reach, south, height)).select(q, lo, la, cx, cy)
        if open_ is not None:
            four = F.sequence(F.lit(0), F.lit(3))
            below = open_.withColumn("i", F.explode(four)).withColumn("j", F.explode(four)).select(q, lo, la, (F.col(cx) * 4 + F.col("i")).alias(cx), (F.col(cy) * 4 + F.col("j")).alias(cy))
            fresh_ = below if fresh_ is None else fresh_.unionByName(below)
        met = fresh_.join(cells.filter(F.col(level) == d), [cx, cy])
        met = met.select(q, lo, la, cx, cy, "n", _corner_km(*at, box, False, at_left).alias("near"), _corner_km(*at, box, True, at_left).alias("far"))
        sum_to = Window.partitionBy(q).orderBy("far", cx, cy).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        enough = F.when(F.sum("n").over(sum_to) >= k, F.col("far"))
        met = met.select(q, lo, la, cx, cy, "near", enough.alias("enough"))
        most = F.min("enough").over(Window.partitionBy(q))
        open_ = met.select(q, lo, la, cx, cy, "near", most.alias("most")).filter(F.col("most").isNull() | (F.col("near") <= F.col("most") * (1 + SLACK) + SLACK)).select(q, lo, la, cx, cy)

    posted = spots.select("t", "x", "y", *place(F.col("x"), F.col("y"), F.lit(finest)))
    found = open_.join(posted, [cx, cy]).select(q, "t", flat_km(*at, F.col("x"), F.col("y"), F.col(la) if at_left else None).alias("km"))
    rank = F.row_number().over(Window.partitionBy(q).orderBy("km", "t"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k).join(points, q).select(lo, la, "rank", F.col("t").alias(target), "km")
    rows = left.withColumns({lo: F.col("lon").cast("double"), la: F.col("lat").cast("double")})
    return rows.join(found, [lo, la]).select(*out)
