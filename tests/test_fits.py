"""Nearest targets, fits, roads: hand-worked answers and brute force."""

import heapq
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tramline.operators import fits, roads
from tramline.operators.nearest import nearest


def flat(a, b, at_left):
    c = np.cos(np.radians(a[:, None, 1] if at_left else (a[:, None, 1] + b[None, :, 1]) / 2))
    return 111.32 * np.sqrt(((a[:, None, 0] - b[None, :, 0]) * c) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2)


def points(spark, xy, name):
    return spark.createDataFrame(pd.DataFrame({name: range(len(xy)), "lon": xy[:, 0], "lat": xy[:, 1]}))


def some(r, n):
    return np.column_stack([r.uniform(-6, 2, n), r.uniform(49, 60, n)])


@pytest.mark.parametrize(("k", "at_left"), [(1, True), (4, True), (3, False)])
def test_nearest_equals_all_pairs(spark, k, at_left):
    """A town among scattered targets, copies of a place, points in the town, far outside and at the same spot many times."""
    r = np.random.default_rng(k)
    b = np.vstack([r.normal([-2.6, 51.4], 0.01, (600, 2)), some(r, 60), np.repeat([[-1.0, 52.0]], 40, 0)])
    a = np.vstack([some(r, 80), r.normal([-2.6, 51.4], 0.02, (60, 2)), np.repeat([[-1.0, 52.0]], 30, 0), [[100.0, -80.0], [-170.0, 89.0]]])
    got = nearest(points(spark, a, "id"), points(spark, b, "t"), "t", k, at_left).toPandas().sort_values(["id", "rank"])
    km = flat(a, b, at_left)
    order = np.argsort(km, axis=1, kind="stable")[:, :k]
    assert got.km.to_numpy().reshape(-1, k) == pytest.approx(np.take_along_axis(km, order, 1), rel=1e-12, abs=1e-12)
    assert (got[got.id.between(140, 169)].t.to_numpy().reshape(-1, k) == np.arange(660, 660 + k)).all()  # of equal places the smallest targets


def test_nearest_among_25000_targets(spark):
    r = np.random.default_rng(9)
    a, b = some(r, 400), some(r, 25_000)
    got = nearest(points(spark, a, "id"), points(spark, b, "t"), "t", 3).toPandas().sort_values(["id", "rank"])
    km = flat(a, b, True)
    assert (got.t.to_numpy().reshape(-1, 3) == np.argsort(km, axis=1)[:, :3]).all()


def test_nearest_of_odd_rows(spark):
    left = spark.createDataFrame([(1, None, 51.0, "a"), (2, 0.0, 51.0, "b"), (2, 0.0, 51.0, "b"), (None, float("nan"), 1.0, "c")], "id int, lon double, lat double, q string")
    right = spark.createDataFrame([(7, 1.0, 51.0), (8, None, 51.0), (6, 1.0, 51.0)], "t int, lon double, lat double")
    assert sorted((r.id, r.q, r["rank"], r.t) for r in nearest(left, right, "t", 5).collect()) == [(2, "b", 1, 6), (2, "b", 1, 6), (2, "b", 2, 7), (2, "b", 2, 7)]
    assert nearest(left, right.limit(0), "t").count() == 0 and nearest(left.limit(0), right, "t").count() == 0


SHARES = {"AM": 0.15, "IP": 0.3, "OP": 0.55}


def network(spark, n_roads=24, seed=0, delay=0.0):
    """Segments of roads in three areas and four authorities, and their hours at level 1."""
    r = np.random.default_rng(seed)
    rows = []
    for road in range(n_roads):
        for _ in range(int(r.integers(8, 20))):
            rows.append((f"r{road:02}", ["centre", "urban", "rural"][int(r.integers(0, 3))], f"A{road % 4 + 1}", float(r.uniform(50, 400)), float(r.uniform(1000, 9000)), float(r.uniform(30, 100)), float(r.integers(0, 2)) * delay))
    seg = spark.createDataFrame(rows, "road string, area string, authority string, length_m double, w double, ff_kmh double, late double")
    ratio = {"AM": F.when(F.col("area") == "centre", 0.8).otherwise(0.9)}
    return fits.road_hours(seg, SHARES, ratio, {k: F.col("late") for k in SHARES})


LEVEL = {"centre": 0.45, "urban": 0.62, "rural": 0.78}


def speeds(hours, authority=None, own=None):
    """road, kmh that given levels make."""
    g = hours.toPandas()
    level = g.area.map(LEVEL) * (g.authority.map(authority) if authority else 1) * (g.road.map(own) if own else 1)
    g["t"] = g.run_h / level + g.wait_h
    s = g.groupby("road")[["lw", "t"]].sum()
    return s.lw / s.t


def table(spark, series):
    return spark.createDataFrame([(k, float(v)) for k, v in series.items()], "road string, kmh double")


def test_road_speed_is_flow_weighted_and_holds_delays(spark):
    seg = spark.createDataFrame([("x", "a", None, 100.0, 1.0, 20.0), ("x", "a", None, 100.0, 3.0, 60.0)], "road string, area string, authority string, length_m double, w double, ff_kmh double")
    h = fits.road_hours(seg, SHARES).first()
    assert h.lw / h.run_h == pytest.approx(400 / (100 / 20 + 300 / 60))
    one = fits.road_hours(seg.limit(1).withColumn("length_m", F.lit(1000.0)).withColumn("ff_kmh", F.lit(60.0)), SHARES, None, {k: F.lit(60.0) for k in SHARES}).first()
    assert one.lw / (one.run_h + one.wait_h) == pytest.approx(1 / (1 / 60 + 60 / 3600))


def test_levels_and_authorities_are_found_again(spark):
    hours = network(spark, delay=5.0)
    true = {"A1": 1.0, "A2": 0.92, "A3": 1.07, "A4": 0.97}
    fit = fits.fit_levels(hours, table(spark, speeds(hours, true)), lam=1e-6)
    assert fit.roads.agg(F.max(F.abs("error"))).first()[0] < 1e-4 and fit.rounds < 15
    for a in LEVEL:  # known up to a scale between the two
        for k in true:
            assert fit.area[""][a] * fit.authority[""][k] == pytest.approx(LEVEL[a] * true[k], rel=1e-3)


def test_ridge_draws_authorities_together(spark):
    hours = network(spark, seed=1)
    noisy = speeds(hours) * np.random.default_rng(2).lognormal(0, 0.05, 24)
    spread = lambda lam: np.std(np.log(list(fits.fit_levels(hours, table(spark, noisy), lam=lam).authority[""].values())))
    assert spread(100.0) < spread(1e-6)


def test_own_levels_of_roads_and_degrees_of_freedom(spark):
    """The roads' own levels, solved road by road, against one dense fit of everything."""
    hours = network(spark, seed=3, delay=4.0)
    r = np.random.default_rng(4)
    kmh = speeds(hours, own={f"r{i:02}": float(r.lognormal(0, 0.15)) for i in range(24)})
    base = fits.fit_levels(hours, table(spark, kmh), authority=False)
    full = fits.fit_levels(hours, table(spark, kmh), authority=False, road_lam=0.1)
    worst = lambda f: f.roads.agg(F.max(F.abs("error"))).first()[0]
    assert base.edf[""] == pytest.approx(3) and 3 < full.edf[""] < 27 and worst(full) < worst(base)

    g = hours.toPandas()
    areas, names = sorted(LEVEL), sorted(kmh.index)

    def model(x):
        run = g.run_h / np.exp(x[[areas.index(a) for a in g.area]] + x[3 + np.array([names.index(n) for n in g.road])])
        s = pd.DataFrame({"road": g.road, "lw": g.lw, "t": run + g.wait_h}).groupby("road").sum().loc[names]
        return np.concatenate([np.log(s.lw / s.t / kmh.loc[names]).to_numpy(), np.sqrt(0.1) * x[3:]])

    x = np.zeros(27)
    for _ in range(30):
        f = model(x)
        j = np.stack([(model(x + h) - f) / 1e-6 for h in np.eye(27) * 1e-6], 1)
        x -= np.linalg.lstsq(j, f, rcond=None)[0]
    assert [full.area[""][a] for a in areas] == pytest.approx(np.exp(x[:3]), rel=1e-4)
    own = {row.road: row.multiplier for row in full.roads.collect()}
    assert [own[n] for n in names] == pytest.approx(np.exp(x[3:]), rel=1e-4)
    hat = j[:24] @ np.linalg.pinv(j.T @ j) @ j[:24].T
    assert full.edf[""] == pytest.approx(np.trace(hat), rel=1e-3)


def test_roads_left_out_are_predicted(spark):
    hours = network(spark, n_roads=12, seed=7)
    kmh = table(spark, speeds(hours))
    out = fits.hold_out_levels(hours, kmh, kmh.select("road", F.col("road").alias("fold"))).toPandas()
    assert len(out) == 12 and out.error.abs().max() < 1e-4


def test_delays_come_back(spark):
    r = np.random.default_rng(5)
    n = 300
    links = pd.DataFrame({"run_s": r.uniform(60, 600, n), "s_centre": r.integers(0, 6, n), "s_urban": r.integers(0, 6, n), "s_rural": r.integers(0, 3, n)})
    links["obs_s"] = links.run_s + 21 * links.s_centre + 9 * links.s_urban
    got = fits.fit_delays(spark.createDataFrame(links), ["centre", "urban", "rural"])
    assert got == pytest.approx({"centre": 21, "urban": 9, "rural": 0}, abs=1e-3)
    faster = spark.createDataFrame(links).withColumn("obs_s", F.col("run_s") * 0.9)
    assert fits.fit_delays(faster, ["centre"]) == {"centre": 0.0}
    assert fits.fit_delays(faster.limit(0), ["centre"]) == {"centre": 10.0}


def test_layers_are_found_again_beside_outliers(spark):
    r = np.random.default_rng(1)
    n = 300
    at = r.integers(0, 2, n)
    p = pd.DataFrame({"period": np.array(["AM", "IP"])[at], "t_centre": r.uniform(20, 200, n), "t_urban": r.uniform(20, 200, n), "s_centre": r.integers(0, 5, n), "s_urban": r.integers(0, 5, n), "t_other": r.uniform(10, 50, n)})
    k = np.array([[0.6, 0.8], [0.9, 1.1]])
    p["obs_s"] = p.t_other + p.t_centre / k[0][at] + p.t_urban / k[1][at] + p.s_centre * 20 + p.s_urban * 8
    p.loc[:9, "obs_s"] *= 5
    got = fits.fit_layer(spark.createDataFrame(p), ["centre", "urban"], ["AM", "IP"], scale=0.01)
    assert [got["k"][a, q] for a in ("centre", "urban") for q in ("AM", "IP")] == pytest.approx(k.ravel().tolist(), rel=0.02)
    assert got["d"] == pytest.approx({"centre": 20, "urban": 8}, rel=0.1)


def brute_seeds(edges, seeds):
    near, out = {}, {}
    for ref, u, v, m in edges:
        near.setdefault((ref, u), []).append((v, round(m * 1e6)))
        near.setdefault((ref, v), []).append((u, round(m * 1e6)))
    heap = [(0, n, ref, n) for ref, n in seeds if (ref, n) in near]
    heapq.heapify(heap)
    while heap:
        d, seed, ref, n = heapq.heappop(heap)
        if (ref, n) not in out:
            out[ref, n] = (d / 1e6, seed)
            for m, step in near[ref, n]:
                heapq.heappush(heap, (d + step, seed, ref, m))
    return {x: out.get(x, (None, None)) for x in near}


def test_nearest_seeds_equal_shortest_paths(spark):
    """Chains, rings with and without seeds, junctions, parallel edges, loops, islands, ties."""
    r = random.Random(6)
    edges = [("chain", i, i + 1, r.randint(1, 9)) for i in range(60)] + [("ring", i, (i + 1) % 9, 2.0) for i in range(9)] + [("bare", i, (i + 1) % 7, 1.0) for i in range(7)]
    edges += [("two", 1, 2, 3.0), ("two", 2, 1, 2.5), ("two", 2, 2, 1.0), ("two", 2, 3, 0.1)]
    edges += [("net", r.randrange(40), r.randrange(40), r.choice([1.0, 2.0, 0.5])) for _ in range(60)] + [("net", 100 + i, 101 + i, 1.0) for i in range(5)]
    edges += [("all", i, (i + 1) % 4, 1.0) for i in range(4)] + [("even", i, i + 1, 1.0) for i in range(6)]
    seeds = [("chain", 10), ("chain", 11), ("chain", 47), ("ring", 4), ("two", 3), ("net", 3), ("net", 17), ("net", 39), ("net", 102), ("all", 0), ("all", 1), ("all", 2), ("all", 3), ("even", 6), ("even", 0), ("gone", 1), ("two", 99)]
    e = spark.createDataFrame([(a, b, c, float(m)) for a, b, c, m in edges], "ref string, u long, v long, length_m double")
    got = {(x.ref, x.node): (x.dist_m, x.seed) for x in roads.nearest_seed(e, spark.createDataFrame(seeds, "ref string, node long")).collect()}
    assert got == brute_seeds(edges, seeds)


def road(ref, n, lon0=-3.0, node0=1):
    rows = []
    for i in range(n):
        a, b = (node0 + i, lon0 + i * 0.01), (node0 + i + 1, lon0 + (i + 1) * 0.01)
        for (u, x), (v, y) in ((a, b), (b, a)):
            rows.append((ref, u, v, 700.0, x, 51.5, y, 51.5, i))
    return rows


SEGMENTS = "ref string, u long, v long, length_m double, lon_u double, lat_u double, lon_v double, lat_v double, seq int"
POINTS = "point long, ref string, cls string, lon double, lat double, link_km double"


def test_classes_part_between_count_points(spark):
    seg = spark.createDataFrame([*road("A1", 10), *road("A2", 3, node0=50), *road("A1", 3, lon0=-2.5, node0=100), (None, 1, 2, 5.0, -3.0, 51.5, -2.99, 51.5, 0)], SEGMENTS)
    pts = spark.createDataFrame([(1, "A1", "srn", -2.9995, 51.5, 1.0), (2, "A1", "local_a", -2.9105, 51.5, None), (3, "A1", "local_a", -2.9994, 51.5, 1.0), (4, "A2", "srn", -1.0, 51.5, 1.0)], POINTS)
    found = roads.classified(seg, pts)
    rows = found.collect()
    assert len(rows) == seg.count()
    for r in rows:
        if r.ref == "A1" and r.u < 50:
            assert (r.cls, r.point) == (("srn", 1) if r.seq < 5 else ("local_a", 2))
            assert r.basis == ("count_point" if r.seq in (0, 8, 9) else "propagated") and r.along_m == 700 * (r.seq if r.seq < 5 else max(0, 8 - r.seq))
        else:
            assert (r.cls, r.basis, r.point, r.along_m) == (None, "osm_fallback", None, None)
    assert [tuple(x) for x in roads.boundaries(found).collect()] == [("A1", 6, ["local_a", "srn"])]
