"""Curves, ladders and bands as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear: clamped on the left, carried on by the last slope on the right."""
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for i, ((a, p), (b, q)) in enumerate(zip(points, points[1:], strict=False)):
        line = F.lit(float(p)) + (x - float(a)) * float((q - p) / (b - a))
        out = out.when(x <= float(b), line) if i + 2 < len(points) else out.otherwise(line)
    return out


def band_index(x: Column, cuts: list[float]) -> Column:
    """How many cuts are <= x."""
    return sum(((x >= c).cast("int") for c in cuts), F.lit(0))


def first_at_least(x: Column, cuts: list[float]) -> Column:
    """Index of the first cut >= x (right-closed bins), null beyond the last."""
    out = None
    for i, c in enumerate(cuts):
        out = F.when(x <= c, F.lit(i)) if out is None else out.when(x <= c, F.lit(i))
    return out


def logistic(x: Column, a: Column | float, b: Column | float) -> Column:
    """1 / (1 + exp((x - a) / b))."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.lit(1.0) / (F.lit(1.0) + F.exp((x - lift(a)) / lift(b)))


def fit_logistic(mean: float, p85: float) -> tuple[float, float]:
    """(a, b) of a logistic walking-decay curve whose distances have this mean and 85th percentile.

    Distances have the survival S(x) = (1 + e^(-a/b)) / (1 + e^((x-a)/b)); mean = integral of S, S(p85) = 0.15. Bisection
    on b, with a from the percentile.
    """

    def a_of(b: float) -> float:
        # (1 + e^(-a/b)) / (1 + e^((p-a)/b)) = 0.15, in u = e^(-a/b)
        e = math.exp(min(p85 / b, 700))
        u = 0.85 / (0.15 * e - 1)
        return -b * math.log(u) if u > 0 else float("nan")

    def mean_of(b: float) -> float:
        a = a_of(b)
        return (1 + math.exp(-a / b)) * b * math.log1p(math.exp(a / b))

    lo, hi = p85 / 200, p85 / (math.log(1 / 0.15) + 1e-9)
    for _ in range(200):
        mid = (lo + hi) / 2
        if (mean_of(mid) < mean) == (mean_of(hi * 0.999999) >= mean_of(lo)):
            lo = mid
        else:
            hi = mid
    return a_of(lo), lo


def fit_exponential(mean: float) -> float:
    """The rate of an exponential curve with this mean."""
    return 1.0 / mean


def half_weight(a: float, b: float) -> float:
    """Where a logistic curve is half its value at 0."""
    return a + b * math.log(1 + 2 * math.exp(-a / b)) if -a / b < 700 else 0.0


def decay_curves(walked: DataFrame, between: dict[str, float], alike: dict[str, str] | None = None) -> DataFrame:
    """mode, mean_m, p85_m, a_m, b_m: a logistic curve for each mode that was walked to, for modes between bus (0) and rail (1), and for modes that take another's curve.

    walked: mode, metres. Mean and 85th percentile come from the rows; those of a mode between are weighed between bus's and
    rail's. Metro takes rail's curve where nobody was seen to walk to it, ferry takes bus's, as `alike` may say of others. The
    handful of curves is fitted on the driver. A mode without rows that another needs raises.
    """
    seen = {r[0]: (r[1], r[2]) for r in walked.filter("metres is not null").groupBy("mode").agg(F.avg("metres"), F.percentile("metres", F.lit(0.85))).collect()}
    missing = {"bus", "rail"} - set(seen) if between else set()
    if missing:
        raise ValueError(f"nobody walked to {', '.join(sorted(missing))}")
    for mode, w in between.items():
        seen[mode] = tuple((1 - w) * x + w * y for x, y in zip(seen["bus"], seen["rail"], strict=True))
    for mode, like in ({"metro": "rail", "ferry": "bus"} | (alike or {})).items():
        if like in seen and (mode not in seen or mode != "metro"):
            seen[mode] = seen[like]
    rows = [(m, float(x), float(p), *map(float, fit_logistic(x, p))) for m, (x, p) in sorted(seen.items())]
    return walked.sparkSession.createDataFrame(rows, "mode string, mean_m double, p85_m double, a_m double, b_m double")


def survival(metres: Column, a: float, b: float) -> Column:
    """Share who walk at least so far by a logistic curve: 1 at 0."""
    return F.lit(1 + math.exp(-a / b)) / (F.lit(1.0) + F.exp((metres - a) / b))


def ring_field(spark: SparkSession, most_m: float = 3000.0, rings: int = 6000) -> DataFrame:
    """metres, w: origins spread evenly over the plane around a stop, as rings (more of them further out)."""
    return spark.range(rings).select(((F.col("id") + 0.5) * most_m / rings).alias("metres")).withColumn("w", F.col("metres"))


def whole_minutes(origins: DataFrame, a: float, b: float, walk_kmh: float, threshold_m: float) -> DataFrame:
    """What whole-minute walking times do: minutes (exact, truncated, rounded half to even), weight (mean decay weight), within (share inside threshold_m), and each over the exact one in percent. origins: metres, w."""
    speed = walk_kmh * 1000 / 60
    exact = F.col("metres") / speed
    ways = F.array(*[F.struct(F.lit(n).alias("minutes"), v.cast("double").alias("t")) for n, v in (("exact", exact), ("truncated", F.floor(exact)), ("rounded", F.bround(exact, 0)))])
    x = origins.select("w", F.explode(ways).alias("x")).select("w", "x.minutes", "x.t")
    w = F.col("w")
    g = x.groupBy("minutes").agg((F.sum(w * survival(F.col("t") * speed, a, b)) / F.sum(w)).alias("weight"), (F.sum(F.when(F.col("t") <= threshold_m / speed, w).otherwise(0.0)) / F.sum(w)).alias("within"))
    one = g.filter("minutes = 'exact'").select(F.col("weight").alias("_w"), F.col("within").alias("_s"), F.lit(1).alias("_k"))
    pct = lambda c, e: F.round(100 * (F.col(c) / F.col(e) - 1), 1).alias(f"{c}_pct")
    return g.join(one, F.lit(1) == F.col("_k")).select("minutes", "weight", "within", pct("weight", "_w"), pct("within", "_s"))


def run_seconds(metres: Column, v: Column, acc: Column) -> Column:
    """Time over a distance from rest to rest: trapezoid of speeds where top speed v is reached, else triangle."""
    return F.when(metres >= v * v / acc, metres / v + v / acc).otherwise(F.lit(2.0) * F.sqrt(metres / acc))


def road_speed_kmh(text: Column) -> Column:
    """A maxspeed tag as km/h: `mph` is converted, of several the least counts, what is no number is null."""
    one = lambda x: F.when(F.lower(x).contains("mph"), F.regexp_extract(x, r"([0-9.]+)", 1).try_cast("double") * 1.609344).otherwise(F.regexp_extract(x, r"([0-9.]+)", 1).try_cast("double"))
    return F.array_min(F.transform(F.split(text, "[;|]"), one))
