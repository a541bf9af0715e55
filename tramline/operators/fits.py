"""Fits whose data stay in Spark: every round is one aggregate of residual and slope columns; only the small normal system is solved outside."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import ANPR_DELAY, ANPR_K, ANPR_SOFT_SCALE
from tramline.session import forget, written


def normal_sums(rows: DataFrame, residual: Column, slopes: dict[str, Column], scale: float | None = None) -> DataFrame:
    """One row: the sums of a Gauss-Newton step. rr (the cost), r_<a> (slope times residual) and <a>_<b> (slope times slope), weighted for a soft-L1 loss of that scale if one is given."""
    held = rows.select(residual.alias("_r"), *[s.alias(f"_s{i}") for i, s in enumerate(slopes.values())]).filter(F.col("_r").isNotNull())
    r, w, cost = F.col("_r"), F.lit(1.0), F.col("_r") * F.col("_r")
    if scale is not None:
        root = F.sqrt(1 + F.pow(r / F.lit(scale), F.lit(2.0)))
        w, cost = 1 / root, F.lit(2 * scale**2) * (root - 1)
    names = list(slopes)
    s = [F.col(f"_s{i}") for i in range(len(names))]
    sums = [F.sum(cost).alias("rr"), *[F.sum(w * s[i] * r).alias(f"r_{a}") for i, a in enumerate(names)]]
    return held.agg(*sums, *[F.sum(w * s[i] * s[j]).alias(f"{a}_{b}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j])


def least_squares(
    rows: DataFrame, residual: Callable[[dict[str, float]], Column], slopes: Callable[[dict[str, float]], dict[str, Column]],
    start: dict[str, float], low: float | dict[str, float] = -np.inf, high: float | dict[str, float] = np.inf, scale: float | None = None, rounds: int = 40,
) -> dict[str, float]:
    """Parameters that minimise the sum of squared (or soft-L1) residuals within bounds, by damped Gauss-Newton steps.

    residual and slopes (the residual's derivative by parameter) are columns for given parameters; rows with a null residual do
    not count. A parameter at a bound that the step would leave stays there for the round. For a few dozen parameters; rows
    may be any number. No row, or none that counts: the start comes back.
    """
    names = list(start)
    bound = lambda b: np.array([b[n] if isinstance(b, dict) else b for n in names], float)
    lo, hi = bound(low), bound(high)

    def measured(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
        p = dict(zip(names, map(float, x)))
        got = normal_sums(rows, residual(p), slopes(p), scale).first()
        if got["rr"] is None:
            return None
        a = np.zeros((len(names), len(names)))
        for i, m in enumerate(names):
            for j, n in enumerate(names[i:], i):
                a[i, j] = a[j, i] = got[f"{m}_{n}"]
        return got["rr"], np.array([got[f"r_{n}"] for n in names]), a

    x, damp = np.clip(np.array([start[n] for n in names], float), lo, hi), 1e-4
    here = measured(x)
    for _ in range(rounds if here else 0):
        cost, g, a = here
        free = ~(((x <= lo) & (g > 0)) | ((x >= hi) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < 1e-12:
            break
        at = np.flatnonzero(free)
        step = np.zeros(len(x))
        block = a[np.ix_(at, at)]
        step[at] = -np.linalg.lstsq(block + damp * np.diag(np.diag(block) + 1e-12), g[at], rcond=None)[0]
        new = np.clip(x + step, lo, hi)
        there = measured(new)
        if there[0] < cost:
            moved = np.abs(new - x).max()
            x, here, damp = new, there, damp / 5
            if cost - there[0] <= 1e-14 * cost or moved < 1e-10:
                break
        elif np.abs(new - x).max() < 1e-10 or (damp := damp * 8) > 1e8:
            break
    return dict(zip(names, map(float, x)))


@dataclass
class Levels:
    """What fit_levels finds. roads: case, road, multiplier, modelled, target, error (relative)."""

    area: dict[str, dict[str, float]]
    authority: dict[str, dict[str, float]]
    roads: DataFrame
    edf: dict[str, float]
    rounds: int


def road_hours(segments: DataFrame, shares: dict[str, float], ratio: dict[str, Column] | None = None, delay_s: dict[str, Column] | None = None) -> DataFrame:
    """Per road, area and authority what a level acts on: lw (km times weight), run_h (weighted hours at level 1) and wait_h (weighted hours of fixed delay), over the periods by their shares of traffic.

    segments: road, area, authority, length_m, w, ff_kmh, and what the columns of `ratio` (a period's speed over the level's,
    else 1) and `delay_s` (seconds on the segment, else 0) use. However many segments a road has, it goes on as a row for
    each area and authority that it crosses.
    """
    ratio, delay_s = ratio or {}, delay_s or {}
    km, w = F.col("length_m") / 1000, F.col("w")
    per_h = sum((F.lit(p) / ratio.get(k, F.lit(1.0)) for k, p in shares.items()), F.lit(0.0))
    late_h = sum((F.lit(p) * delay_s.get(k, F.lit(0.0)) / 3600 for k, p in shares.items()), F.lit(0.0))
    return segments.groupBy("road", "area", "authority").agg(F.sum(km * w).alias("lw"), F.sum(w * km / F.col("ff_kmh") * per_h).alias("run_h"), F.sum(w * late_h).alias("wait_h"))


def level_rows(hours: DataFrame, targets: DataFrame, at: DataFrame, own: DataFrame | None, road_lam: float | None) -> DataFrame:
    """Per case and road, at the parameters `at` (case, name, x) and the roads' own (case, road, mu): modelled speed, residual (log modelled less log target), c (its slope by the road's own level), weight, and v, the list of (name, slope) with the residual under the name ''.

    hours: case, road, area, authority (null: none to fit), lw, run_h, wait_h; targets: road, kmh. With a ridge of road_lam on
    the roads' own levels these are solved for road by road, which leaves each road the weight lam / (c^2 + lam) and the
    residual less c mu.
    """
    x = lambda name, out: at.select("case", F.col("name").alias(name), F.col("x").alias(out))
    h = hours.withColumns({"n_area": F.concat(F.lit("area:"), "area"), "n_auth": F.concat(F.lit("authority:"), "authority")})
    h = h.join(x("n_area", "xa"), ["case", "n_area"]).join(x("n_auth", "xb"), ["case", "n_auth"], "left")
    if own is not None:
        h = h.join(own, ["case", "road"], "left")
    mu = F.coalesce(F.col("mu"), F.lit(0.0)) if own is not None else F.lit(0.0)
    h = h.select("case", "road", "n_area", "n_auth", "lw", "wait_h", mu.alias("mu"), (F.col("run_h") * F.exp(-(F.col("xa") + F.coalesce("xb", F.lit(0.0)) + mu))).alias("run"))
    parts = F.filter(F.collect_list(F.struct("n_area", "n_auth", "run")), lambda s: s["run"] > 0)
    g = h.groupBy("case", "road").agg(F.sum("lw").alias("lw"), F.sum("run").alias("run"), (F.sum("run") + F.sum("wait_h")).alias("t"), F.max("mu").alias("mu"), parts.alias("parts")).join(targets, "road")
    g = g.withColumns({"modelled": F.col("lw") / F.col("t"), "c": F.col("run") / F.col("t")})
    lam = F.lit(float(road_lam)) if road_lam is not None else None
    weight = lam / (F.col("c") * F.col("c") + lam) if lam is not None else F.lit(1.0)
    r = F.log(F.col("modelled") / F.col("kmh"))
    slopes = F.flatten(F.transform("parts", lambda s: F.array(F.struct(s["n_area"].alias("n"), (s["run"] / F.col("t")).alias("s")), F.struct(s["n_auth"].alias("n"), (s["run"] / F.col("t")).alias("s")))))
    own_r = F.struct(F.lit("").alias("n"), (r - F.col("c") * F.col("mu")).alias("s"))
    v = F.concat(F.array(own_r), F.filter(slopes, lambda e: e["n"].isNotNull()))
    return g.select("case", "road", "kmh", "modelled", "mu", "c", r.alias("residual"), weight.alias("weight"), v.alias("v"))


def level_sums(rows: DataFrame) -> DataFrame:
    """case, i, j, jj, jj2: sums over roads of weight (and its square) times slope i times slope j, i <= j; '' is the residual. As many rows as pairs of parameters that meet on a road."""
    one = rows.select("case", "weight", F.explode(F.flatten(F.transform("v", lambda a: F.transform("v", lambda b: F.struct(a["n"].alias("i"), b["n"].alias("j"), (a["s"] * b["s"]).alias("p")))))).alias("e"))
    w = F.col("weight")
    return one.filter("e.i <= e.j").groupBy("case", F.col("e.i").alias("i"), F.col("e.j").alias("j")).agg(F.sum(w * F.col("e.p")).alias("jj"), F.sum(w * w * F.col("e.p")).alias("jj2"))


def fit_levels(hours: DataFrame, targets: DataFrame, lam: float = 1.0, road_lam: float | None = None, authority: bool = True, rounds: int = 30) -> Levels:
    """Levels by area, multipliers by authority (ridge `lam` on their logarithms) and, with `road_lam`, by road, that bring modelled all-day speeds of roads to their targets in the logarithm.

    hours: what `road_hours` gives, perhaps with a column case: each case is a fit of its own, all in the same rounds. targets:
    road, kmh. A road's own multiplier stays a column; the driver solves a system of areas and authorities. edf is
    the trace of J (J'J + L)^+ J', roads' own multipliers included.
    """
    spark = hours.sparkSession
    if "case" not in hours.columns:
        hours = hours.withColumn("case", F.lit(""))
    hours = hours.withColumn("case", F.col("case").cast("string"))
    if not authority:
        hours = hours.withColumn("authority", F.lit(None).cast("string"))
    names = [F.concat(F.lit("area:"), "area"), F.concat(F.lit("authority:"), "authority")]
    hours = written(hours.join(targets.select("road"), "road", "left_semi"), "level-hours")
    params = hours.select("case", F.explode(F.array(*names)).alias("name")).filter("name is not null").distinct().collect()
    x: dict[str, dict[str, float]] = {}
    for case, name in sorted(map(tuple, params)):
        x.setdefault(case, {})[name] = 0.0
    table = lambda v: spark.createDataFrame([(c, n, float(y)) for c, row in v.items() for n, y in row.items()], "case string, name string, x double")
    own = None

    def solved(sums: list, case: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        order = list(x[case])
        at = {n: i for i, n in enumerate(order)}
        a, a2, g = np.zeros((len(order),) * 2), np.zeros((len(order),) * 2), np.zeros(len(order))
        for r in sums:
            if r["case"] != case or r["j"] == "":
                continue
            if r["i"] == "":
                g[at[r["j"]]] = r["jj"]
            else:
                i, j = at[r["i"]], at[r["j"]]
                a[i, j] = a[j, i] = r["jj"]
                a2[i, j] = a2[j, i] = r["jj2"]
        ridge = np.array([lam if n.startswith("authority:") else 0.0 for n in order])
        return a + np.diag(ridge), a2, g + ridge * np.array([x[case][n] for n in order]), order

    taken = 0
    rows = sums = None
    for taken in range(1, rounds + 1):
        rows = level_rows(hours, targets, table(x), own, road_lam)
        sums = level_sums(rows).collect()
        moved, delta = 0.0, {}
        for case in x:
            a, _, g, order = solved(sums, case)
            d = np.clip(-np.linalg.pinv(a) @ g, -1.0, 1.0)
            delta[case] = dict(zip(order, d))
            moved = max(moved, float(np.abs(d).max(initial=0.0)))
        if road_lam is not None:  # each road's own level, given the step of the others
            d = table(delta).withColumnsRenamed({"name": "n", "x": "d"})
            e = rows.select("case", "road", "c", "mu", F.explode("v").alias("e")).select("case", "road", "c", "mu", F.col("e.n").alias("n"), F.col("e.s").alias("s")).join(d, ["case", "n"], "left")
            e = e.groupBy("case", "road", "c", "mu").agg(F.sum(F.when(F.col("n") == "", F.col("s")).otherwise(F.col("s") * F.col("d"))).alias("e"))
            made = written(e.select("case", "road", (-F.col("c") * F.col("e") / (F.col("c") * F.col("c") + F.lit(float(road_lam)))).alias("mu")), "level-roads")
            step = made.join(rows.select("case", "road", F.col("mu").alias("was")), ["case", "road"]).agg(F.max(F.abs(F.col("mu") - F.col("was")))).first()[0]
            moved = max(moved, step or 0.0)
            forget(*([own] if own is not None else []))
            own = made
        x = {case: {n: x[case][n] + delta[case][n] for n in x[case]} for case in x}
        if moved < 1e-9:
            break
    rows = level_rows(hours, targets, table(x), own, road_lam)
    sums = level_sums(rows).collect()
    edf = {}
    for case in x:
        a, a2, _, _ = solved(sums, case)
        edf[case] = float(np.trace(np.linalg.pinv(a) @ a2))
    if road_lam is not None:
        c2 = F.col("c") * F.col("c")
        for r in rows.groupBy("case").agg(F.sum(c2 / (c2 + F.lit(float(road_lam)))).alias("own")).collect():
            edf[r["case"]] += r["own"]
    named = lambda kind: {c: {n.split(":", 1)[1]: float(np.exp(v)) for n, v in row.items() if n.startswith(kind)} for c, row in x.items()}
    found = rows.select("case", "road", F.exp("mu").alias("multiplier"), "modelled", F.col("kmh").alias("target"), (F.col("modelled") / F.col("kmh") - 1).alias("error"))
    return Levels(named("area:"), named("authority:"), found, edf, taken)


def hold_out_levels(hours: DataFrame, targets: DataFrame, folds: DataFrame) -> DataFrame:
    """road, fold, target, predicted, error: every road predicted by the area levels that the roads of other folds give. folds: road, fold (a fold a road: leave one out).

    All folds are fitted in the same rounds, over a copy of the roads' rows for each other fold: folds times roads, so a few
    folds for many roads. A road in an area that its fold's complement lacks has no prediction.
    """
    every = folds.select(F.col("fold").cast("string").alias("fold")).distinct()
    rows = hours.join(folds.withColumn("fold", F.col("fold").cast("string")), "road")
    others = rows.join(every.withColumnRenamed("fold", "case"), F.col("fold") != F.col("case"))
    fit = fit_levels(others.drop("fold"), targets, authority=False)
    level = hours.sparkSession.createDataFrame([(c, a, float(v)) for c, row in fit.area.items() for a, v in row.items()], "fold string, area string, level double")
    held = rows.join(level, ["fold", "area"], "left")
    g = held.groupBy("road", "fold").agg(F.sum("lw").alias("lw"), F.sum(F.col("run_h") / F.col("level") + F.col("wait_h")).alias("t"), F.max(F.col("level").isNull()).alias("unknown"))
    out = g.join(targets, "road").withColumn("predicted", F.when(~F.col("unknown"), F.col("lw") / F.col("t")))
    return out.select("road", "fold", F.col("kmh").alias("target"), "predicted", (F.col("predicted") / F.col("kmh") - 1).alias("error"))


def fit_delays(links: DataFrame, areas: list[str], most_s: float = 180.0) -> dict[str, float]:
    """Seconds a signal by area, 0 to most_s, that bring run_s + sum of s_<area> (signals on the link) times seconds nearest to obs_s, in the logarithm. links: run_s, s_<area>, obs_s; a link without signals or without an observation tells nothing and does not count."""
    ok = links.filter((F.col("obs_s") > 0) & (F.col("run_s") > 0))
    model = lambda p: sum((F.col(f"s_{a}") * F.lit(p[a]) for a in areas), F.col("run_s"))
    return least_squares(ok, lambda p: F.log(model(p) / F.col("obs_s")), lambda p: {a: F.col(f"s_{a}") / model(p) for a in areas}, dict.fromkeys(areas, 10.0), 0.0, most_s)


def fit_layer(components: DataFrame, areas: list[str], periods: list[str], k_range: tuple[float, float] = ANPR_K, d_range: tuple[float, float] = ANPR_DELAY, scale: float = ANPR_SOFT_SCALE) -> dict[str, dict]:
    """{"k": {(area, period): k}, "d": {area: seconds}} that bring t_other + sum t_<area> / k + sum s_<area> d nearest to obs_s by a soft-L1 loss on the log ratio. components: period, t_<area>, s_<area>, t_other, obs_s, a row a link and period."""
    key = {(a, p): f"k{i}_{j}" for i, a in enumerate(areas) for j, p in enumerate(periods)}
    late = {a: f"d{i}" for i, a in enumerate(areas)}
    at = lambda p, a: F.coalesce(*[F.when(F.col("period") == q, F.lit(p[key[a, q]])) for q in periods])
    model = lambda p: sum((F.col(f"t_{a}") / at(p, a) + F.col(f"s_{a}") * F.lit(p[late[a]]) for a in areas), F.col("t_other"))

    def slopes(p: dict[str, float]) -> dict[str, Column]:
        k = {key[a, q]: F.when(F.col("period") == q, -F.col(f"t_{a}") / F.lit(p[key[a, q]] ** 2) / model(p)).otherwise(0.0) for a, q in key}
        return k | {late[a]: F.col(f"s_{a}") / model(p) for a in areas}

    start = dict.fromkeys(key.values(), 0.9) | dict.fromkeys(late.values(), 10.0)
    low, high = ({n: (k_range if n in key.values() else d_range)[i] for n in start} for i in (0, 1))
    x = least_squares(components.filter("obs_s > 0"), lambda p: F.log(model(p) / F.col("obs_s")), slopes, start, low, high, scale)
    return {"k": {pair: x[n] for pair, n in key.items()}, "d": {a: x[n] for a, n in late.items()}}
