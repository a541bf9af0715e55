"""Road-speed operators: cells of probe speeds, leg filters, ratios with fallback, fits and hold-outs."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.config import MAX_KMH, MIN_CELLS, MIN_OBS
from tramline.functions.stats import harmonic_mean, medians_without_fold


def harmonic_cells(legs: DataFrame, keys: list[str], kmh: str = "kmh", min_obs: int = 1) -> DataFrame:
    """Harmonic mean speed and number of legs of each cell with min_obs legs or more."""
    return legs.filter(F.col(kmh) > 0).groupBy(*keys).agg(F.count("*").alias("n"), harmonic_mean(F.col(kmh)).alias("kmh")).filter(F.col("n") >= min_obs)


def flow_weighted_speed(rows: DataFrame, keys: list[str], speed: str, volume: str) -> DataFrame:
    """Space-mean speed sum(v) / sum(v / s)."""
    ok = rows.filter((F.col(speed) > 0) & (F.col(volume) > 0))
    return ok.groupBy(*keys).agg((F.sum(volume) / F.sum(F.col(volume) / F.col(speed))).alias("speed"), F.sum(volume).alias("volume"))


def leg_filters(legs: DataFrame, max_dt: float = 90.0, min_confidence: float = 0.3, moving_kmh: float = 5.0, near_m: float = 30.0) -> DataFrame:
    """Adds kmh and reason (null for a leg that counts): confidence, gap, no distance, dwell at a stop, too fast. legs: dist_m, dt_s, confidence, stop_m."""
    v = F.col("dist_m") / F.nullif(F.col("dt_s"), F.lit(0.0)) * 3.6
    reason = (
        F.when(F.col("confidence") < min_confidence, "confidence").when((F.col("dt_s") <= 0) | (F.col("dt_s") > max_dt), "gap").when(F.col("dist_m") <= 0, "no distance")
        .when((v < moving_kmh) & (F.col("stop_m") <= near_m), "dwell").when(v > MAX_KMH, "too fast")
    )
    return legs.withColumns({"kmh": v, "reason": reason})


def explode_legs(legs: DataFrame, nodes: str = "nodes") -> DataFrame:
    """Each leg's speed on every consecutive pair (u, v) of its nodes."""
    n = F.size(nodes)
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get(nodes, i).alias("u"), F.get(nodes, i + 1).alias("v")))).otherwise(F.array().cast("array<struct<u:bigint,v:bigint>>"))
    return legs.withColumn("_p", F.explode(pairs)).select(*[c for c in legs.columns if c != nodes], "_p.u", "_p.v")


def bus_shape(cells: DataFrame, group: list[str], national: DataFrame, min_obs: int = MIN_OBS, min_cells: int = MIN_CELLS, base: str = "IP") -> DataFrame:
    """Per group and period: the median ratio of a segment's speed to its own in the base period, if enough segments have both; else the national ratio.

    cells: segment, period, n, kmh and the group's columns; national: period, ratio.
    """
    ok = cells.filter(F.col("n") >= min_obs)
    ref = ok.filter(F.col("period") == base).select("segment", *group, F.col("kmh").alias("_b"))
    r = ok.join(ref, ["segment", *group]).groupBy(*group, "period").agg(F.percentile(F.col("kmh") / F.col("_b"), F.lit(0.5)).alias("_m"), F.count("*").alias("_n"))
    grid = cells.select(*group).distinct().join(national.withColumn("_k", F.lit(1)), F.lit(1) == F.col("_k")).drop("_k")
    j = grid.join(r, [*group, "period"], "left")
    own = F.coalesce(F.col("_n") >= min_cells, F.lit(False))
    return j.select(*group, "period", F.when(own, F.col("_m")).otherwise(F.col("ratio")).alias("ratio"), F.when(own, "own").otherwise("national").alias("basis"))


def ratio_of_sums(rows: DataFrame, keys: list[str], a: str, b: str, out: str = "ratio") -> DataFrame:
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(a), F.sum(b)).alias(out), F.count("*").alias("n"))


def spacing_ratio(full: DataFrame, thinned: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Thinned over full harmonic speed of cells in both: median, p10 and p90 by group."""
    j = harmonic_cells(full, keys).select(*keys, F.col("kmh").alias("_f")).join(harmonic_cells(thinned, keys).select(*keys, F.col("kmh").alias("_t")), keys)
    r = F.col("_t") / F.col("_f")
    return j.groupBy(*by).agg(*[F.percentile(r, F.lit(p)).alias(k) for p, k in ((0.5, "median"), (0.1, "p10"), (0.9, "p90"))], F.count("*").alias("cells"))


def noise_floor(legs: DataFrame, keys: list[str], leg: str, kmh: str = "kmh", min_obs: int = MIN_OBS) -> DataFrame:
    """Legs of a cell in two halves by hash: |h1 - h2| over their mean, for cells with twice min_obs."""
    side = F.pmod(F.crc32(F.col(leg).cast("string").cast("binary")), F.lit(2))
    ok = legs.filter(F.col(kmh) > 0)
    h = lambda s: F.sum((side == s).cast("double")) / F.sum(F.when(side == s, F.lit(1.0) / F.col(kmh)))
    g = ok.groupBy(*keys).agg(F.count("*").alias("n"), h(0).alias("h0"), h(1).alias("h1")).filter((F.col("n") >= 2 * min_obs) & F.col("h0").isNotNull() & F.col("h1").isNotNull())
    return g.select(*keys, "n", (F.abs(F.col("h0") - F.col("h1")) / ((F.col("h0") + F.col("h1")) / 2)).alias("disagreement"))


def assembled_speed(free: Column, factor: Column, k: Column, length_m: Column, delay_s: Column) -> Column:
    """clip(free x factor, 3, 1.2 free) x k, with a signal delay folded in, at least 1 km/h."""
    v = F.least(F.greatest(free * factor, F.lit(3.0)), free * 1.2) * k
    with_delay = length_m / (length_m / (v / 3.6) + delay_s) * 3.6
    return F.greatest(F.when(delay_s > 0, with_delay).otherwise(v), F.lit(1.0))


def period_weights(profile: DataFrame, periods: dict[str, tuple[float, float]]) -> DataFrame:
    """Share of traffic by period: weekday hours by the first period that holds them, else OP; weekend WE. profile: dow (0 = Monday), hour, share."""
    from tramline.functions.clock import period

    p = F.when(F.col("dow") >= 5, "WE").otherwise(period(F.col("hour") * 60, periods))
    g = profile.groupBy(p.alias("period")).agg(F.sum("share").alias("w"))
    total = profile.agg(F.sum("share").alias("_t")).withColumn("_k", F.lit(1))
    return g.join(total, F.lit(1) == F.col("_k")).select("period", (F.col("w") / F.col("_t")).alias("weight"))


def folds(lon: Column, lat: Column, km: float, k: int, seed: int = 0) -> Column:
    """Fold of a square block of ground, by hash."""
    block = F.concat_ws(":", F.floor(lon * 69.4 / km).cast("string"), F.floor(lat * 111.3 / km).cast("string"), F.lit(str(seed)))
    return F.pmod(F.crc32(block.cast("binary")), F.lit(k)).cast("int")


def bus_hold_out(cells: DataFrame, keys: list[str], fold: str, seen: str, modelled: str) -> DataFrame:
    """cells with ratio, fallback, pred and error: each cell's speed predicted from the model's by the median of seen over modelled in its group, over the other folds alone; where these have none of the group, over all their cells.

    A fold's complement is the whole less the fold (`stats.medians_without_fold`), so nothing is fitted fold by fold. Cells
    without a speed on either side tell nothing and have no prediction where the model has none.
    """
    ratio = F.when((F.col(seen) > 0) & (F.col(modelled) > 0), F.col(seen) / F.col(modelled))
    rows = cells.withColumns({"_ratio": ratio, "_all": F.lit(1)})
    own = medians_without_fold(rows, keys, fold, "_ratio", "_own").drop("n")
    every = medians_without_fold(rows, ["_all"], fold, "_ratio", "_every").drop("n")
    j = rows.join(own, [*keys, fold], "left").join(every, ["_all", fold], "left")
    j = j.withColumns({"ratio": F.coalesce("_own", "_every"), "fallback": F.col("_own").isNull()}).withColumn("pred", F.col(modelled) * F.col("ratio"))
    return j.withColumn("error", F.col("pred") / F.col(seen) - 1).select(*cells.columns, "ratio", "fallback", "pred", "error")


def _dealt(sizes: np.ndarray, start: int) -> np.ndarray:
    """Which half each block goes to (0 calibration), given how many more links that half already has."""
    out, more = np.zeros(len(sizes), np.int8), start
    for i, n in enumerate(sizes.tolist()):
        out[i] = more > 0
        more += -n if more > 0 else n
    return out


def _transfer(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """What dealing the blocks does to any difference from -most to most: the first difference of each stretch, and the stretch's shift."""
    first, shift = np.array([-most]), np.array([0])
    for n in sizes.tolist():
        last = np.append(first[1:], most + 1) - 1
        cut = 1 - shift  # from this difference on the image is over 0
        split = (cut > first) & (cut <= last)
        first, shift = np.concatenate([first, cut[split]]), np.concatenate([shift, shift[split]])
        order = np.argsort(first, kind="stable")
        first, shift = first[order], shift[order]
        shift = shift + np.where(first + shift > 0, -n, n)
        keep = np.append(True, shift[1:] != shift[:-1])
        first, shift = first[keep], shift[keep]
    return first, shift


def balanced_halves(links: DataFrame, block_km: float, seed: int = 0) -> DataFrame:
    """link_id, half: calibration or validation. Whole blocks of ground go to one half; within an area, blocks are dealt in a seeded order to whichever half has fewer links so far, calibration first.

    links: link_id, area (null: rural), lon, lat. The deal is a scan over range partitions of the blocks: each range says what
    it does to any lead that one half may have on entry (no more than the largest block), ranges are put together in order, and
    each is then dealt from its own entry. The halves of an area differ by one block's links at most.
    """
    import pandas as pd

    from tramline.session import written

    at = lambda c, per: F.floor(F.col(c) * per / block_km).cast("long")
    rows = links.select("link_id", F.coalesce("area", F.lit("rural")).alias("area"), at("lon", 69.4).alias("bx"), at("lat", 111.3).alias("by"))
    rows = rows.withColumn("o", F.xxhash64("area", "bx", "by", F.lit(seed)))
    key = ["area", "o", "bx", "by"]
    blocks = rows.groupBy(*key).agg(F.count("*").alias("n"))
    held = written(blocks.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()), "blocks")
    most = {r[0]: int(r[1]) for r in held.groupBy("area").agg(F.max("n")).collect()}  # a row an area

    def moves(key, pdf):
        first, shift = _transfer(pdf.sort_values(["o", "bx", "by"]).n.to_numpy(), most[key[0]])
        return pd.DataFrame({"area": [key[0]], "part": [key[1]], "first": [first.tolist()], "shift": [shift.tolist()]})

    entry, lead = {}, dict.fromkeys(most, 0)
    steps = held.groupBy("area", "part").applyInPandas(moves, "area string, part int, first array<long>, shift array<long>")
    for r in sorted(steps.collect(), key=lambda r: (r.area, r.part)):  # a row a range and area
        entry[r.area, r.part] = lead[r.area]
        lead[r.area] += r["shift"][int(np.searchsorted(r["first"], lead[r.area], "right")) - 1]

    def deal(key, pdf):
        pdf = pdf.sort_values(["o", "bx", "by"])
        pdf["half"] = np.array(["calibration", "validation"])[_dealt(pdf.n.to_numpy(), entry[key[0], key[1]])]
        return pdf[["area", "bx", "by", "half"]]

    dealt = held.groupBy("area", "part").applyInPandas(deal, "area string, bx long, by long, half string")
    return rows.join(dealt, ["area", "bx", "by"]).select("link_id", "half")


def corridors(cells: DataFrame, by: list[str], min_m: float = 1000.0) -> DataFrame:
    """Stretches of connected segments within each group, at least min_m long: length-weighted harmonic speeds observed and predicted. cells: u, v, length_m, obs, pred.

    A stretch has the smallest of its nodes as corridor. Nodes of all groups are numbered together and one run of components joins them.
    """
    from tramline.operators.components import components
    from tramline.session import written

    ends = cells.select(*by, F.col("u").alias("_node")).union(cells.select(*by, "v")).distinct()
    ends = written(ends, "nodes").withColumn("_id", F.monotonically_increasing_id())  # numbered once written, so the numbers stay

    def numbered(df: DataFrame, node: str, out: str) -> DataFrame:
        n = ends.select(*[F.col(c).alias(f"_{out}_{c}") for c in by], F.col("_node").alias(f"_{out}_node"), F.col("_id").alias(out))
        on = [F.col(c).eqNullSafe(F.col(f"_{out}_{c}")) for c in by] + [F.col(node) == F.col(f"_{out}_node")]
        return df.join(n, reduce(lambda a, b: a & b, on)).drop(*[f"_{out}_{c}" for c in by], f"_{out}_node")

    rows = numbered(numbered(cells, "u", "_a"), "v", "_b")
    part = components(rows.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    low = ends.join(part, ends["_id"] == part["id"]).groupBy("component").agg(F.min("_node").alias("corridor"))
    rows = rows.join(part, rows["_a"] == part["id"]).join(low, "component")
    g = rows.groupBy(*by, "corridor").agg(F.sum("length_m").alias("length_m"), F.sum(F.col("length_m") / F.col("obs")).alias("_o"), F.sum(F.col("length_m") / F.col("pred")).alias("_p"))
    return g.filter(F.col("length_m") >= min_m).select(*by, "corridor", "length_m", (F.col("length_m") / F.col("_o")).alias("obs"), (F.col("length_m") / F.col("_p")).alias("pred"))


def profile_fit(rows: DataFrame, k_only: bool = False) -> tuple[float, float]:
    """(k, b) that minimise sum w (t - k profile - b junctions)^2 with b >= 0; the sums come from Spark. rows: t, profile, junctions, w."""
    w = F.col("w")
    s = rows.agg(*[F.sum(w * a * b).alias(n) for n, a, b in (("pp", F.col("profile"), F.col("profile")), ("pj", F.col("profile"), F.col("junctions")), ("jj", F.col("junctions"), F.col("junctions")), ("pt", F.col("profile"), F.col("t")), ("jt", F.col("junctions"), F.col("t")))]).first()
    det = s.pp * s.jj - s.pj**2
    if k_only or abs(det) < 1e-12:
        return s.pt / s.pp, 0.0
    k, b = (s.pt * s.jj - s.jt * s.pj) / det, (s.jt * s.pp - s.pt * s.pj) / det
    return (k, b) if b >= 0 else (s.pt / s.pp, 0.0)


def national_fallback(rows: DataFrame, keys: list[str], value: str, min_n: int) -> DataFrame:
    """Median by key where min_n rows hold it, else over all; with its basis."""
    own = rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_m"), F.count("*").alias("_n"))
    all_ = rows.agg(F.percentile(value, F.lit(0.5)).alias("_a")).withColumn("_k", F.lit(1))
    j = own.join(all_, F.lit(1) == F.col("_k"))
    ok = F.col("_n") >= min_n
    return j.select(*keys, F.when(ok, F.col("_m")).otherwise(F.col("_a")).alias("value"), F.when(ok, "own").otherwise("all").alias("basis"))


def densify(lines: DataFrame, step_m: float = 10.0) -> DataFrame:
    """Points along segments (id, lon1, lat1, lon2, lat2), about step_m apart, both ends included."""
    from tramline.functions.geo import haversine_km

    d = haversine_km(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")) * 1000
    k = F.greatest(F.lit(1), F.floor(d / step_m).cast("int"))
    i = F.explode(F.sequence(F.lit(0), k))
    rows = lines.select("id", "lon1", "lat1", "lon2", "lat2", k.alias("k"), i.alias("i"))
    part = F.col("i") / F.col("k")
    return rows.select("id", "i", (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * part).alias("lon"), (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * part).alias("lat"))


def directed(ways: DataFrame) -> DataFrame:
    """One row a permitted direction: oneway yes or 1 forward only, -1 backward only, else both; a roundabout is forward only."""
    tag = F.lower(F.coalesce("oneway", F.lit("no")))
    ring = F.coalesce(F.col("junction") == "roundabout", F.lit(False))
    d = F.when(tag == "-1", F.array(F.lit(False))).when(tag.isin("yes", "true", "1") | (ring & (tag != "no")), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    return ways.withColumn("forward", F.explode(d))


def free_flow(area: Column, cls: Column, limit_kmh: Column, table: dict[tuple[str, str], float], default: float = 0.9) -> Column:
    """Free-flow speed: a table by (area, class), else a share of the limit."""
    out = None
    for (a, c), v in table.items():
        hit = (area == a) & (cls == c)
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    rest = limit_kmh * default
    return rest if out is None else out.otherwise(rest)
