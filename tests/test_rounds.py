"""Hold-outs, balanced halves and polygons that meet: brute force."""

import collections
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tramline.functions import stats
from tramline.operators import congestion, spatial


def test_running_sums_of_one_large_key(spark):
    r = np.random.default_rng(0)
    df = pd.DataFrame({"k": np.where(r.random(4000) < 0.6, "hot", r.integers(0, 30, 4000).astype(str)), "o": r.permutation(4000), "n": r.integers(0, 9, 4000)})
    got = stats.running_sums(spark.createDataFrame(df).union(spark.createDataFrame([(None, 1, 1)], "k string, o long, n long")), ["k"], ["o"], ["n"]).toPandas().sort_values("o")
    want = df.sort_values("o")
    assert (got.n_to.to_numpy() == want.groupby("k").n.cumsum().to_numpy()).all()


def test_medians_without_a_fold_equal_one_refit_a_fold(spark):
    r = np.random.default_rng(1)
    df = pd.DataFrame({"g": r.choice(["a", "b", "c"], 900), "h": r.integers(0, 2, 900), "fold": r.integers(0, 5, 900), "v": r.integers(0, 12, 900) / 4})
    df = df[(df.g != "c") | (df.fold == 2)]  # one group is in one fold alone
    got = {(x.g, x.h, x.fold): (x.m, x.n) for x in stats.medians_without_fold(spark.createDataFrame(df), ["g", "h"], "fold", "v", "m").collect()}
    want = {}
    for f in range(5):
        for (g, h), part in df[df.fold != f].groupby(["g", "h"]):
            want[g, h, f] = (part.v.median(), len(part))
    assert got == want
    assert stats.medians_without_fold(spark.createDataFrame(df).limit(0), ["g", "h"], "fold", "v").count() == 0


def test_bus_hold_out_equals_a_refit_a_fold(spark):
    r = np.random.default_rng(2)
    df = pd.DataFrame({"id": range(600), "cls": r.choice(["x", "y"], 600), "fold": r.integers(0, 4, 600), "bus": r.integers(5, 40, 600).astype(float), "model": r.integers(5, 60, 600).astype(float)})
    df.loc[df.index[:5], "cls"] = "alone"
    df.loc[df.index[:5], "fold"] = 1
    got = congestion.bus_hold_out(spark.createDataFrame(df), ["cls"], "fold", "bus", "model").toPandas().set_index("id")
    for f in range(4):
        train, test = df[df.fold != f], df[df.fold == f]
        k = (train.bus / train.model).groupby(train.cls).median()
        kappa = test.cls.map(k)
        assert got.loc[test.id, "fallback"].to_numpy().tolist() == kappa.isna().tolist()
        assert got.loc[test.id, "pred"].to_numpy() == pytest.approx((test.model * kappa.fillna((train.bus / train.model).median())).to_numpy())


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_halves_equal_a_deal_in_order(spark, parts):
    r = np.random.default_rng(parts)
    df = pd.DataFrame({"link_id": range(1500), "area": r.choice(["centre", "urban", None], 1500, p=[0.1, 0.6, 0.3]), "lon": r.normal(-2.5, 0.2, 1500), "lat": r.normal(51.5, 0.2, 1500)})
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = congestion.balanced_halves(spark.createDataFrame(df), 5.0, seed=3).toPandas().set_index("link_id").half
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    df["bx"], df["by"], df["area"] = np.floor(df.lon * 69.4 / 5).astype(int), np.floor(df.lat * 111.3 / 5).astype(int), df.area.fillna("rural")
    blocks = df.groupby(["area", "bx", "by"]).link_id.agg(["size", "first"]).reset_index()
    keys = spark.createDataFrame(blocks).select("first", F.xxhash64("area", F.col("bx").cast("long"), F.col("by").cast("long"), F.lit(3)).alias("o")).toPandas()
    blocks = blocks.merge(keys, on="first").sort_values(["area", "o", "bx", "by"])
    want = {}
    for area, part in blocks.groupby("area"):
        n = {"calibration": 0, "validation": 0}
        for b in part.itertuples():
            half = "calibration" if n["calibration"] <= n["validation"] else "validation"
            n[half] += b.size
            want[area, b.bx, b.by] = half
        assert abs(n["calibration"] - n["validation"]) <= part["size"].max()
    assert got.loc[df.link_id].tolist() == [want[k] for k in zip(df.area, df.bx, df.by)]


def meet(p, q):
    """Whether two rings of whole points have a point in common, as areas."""
    t = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def sides(r):
        return [(r[i], r[(i + 1) % len(r)]) for i in range(len(r))]

    def cross(a, b, c, d):
        if max(min(a[0], b[0]), min(c[0], d[0])) > min(max(a[0], b[0]), max(c[0], d[0])) or max(min(a[1], b[1]), min(c[1], d[1])) > min(max(a[1], b[1]), max(c[1], d[1])):
            return False
        return t(a, b, c) * t(a, b, d) <= 0 and t(c, d, a) * t(c, d, b) <= 0

    def holds(r, c):
        odd = False
        for a, b in sides(r):
            if (a[1] > c[1]) != (b[1] > c[1]) and c[0] < a[0] + (c[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
                odd = not odd
        return odd

    return any(cross(a, b, c, d) for a, b in sides(p) for c, d in sides(q)) or holds(p, q[0]) or holds(q, p[0])


def brute_components(rings):
    up = {i: i for i in rings}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in rings:
        for j in rings:
            if i < j and meet(rings[i], rings[j]):
                up[root(j)] = root(i)
    low = collections.defaultdict(list)
    for i in rings:
        low[root(i)].append(i)
    return {i: min(m) for m in low.values() for i in m}


@pytest.mark.parametrize("seed", [0, 1])
def test_polygons_that_meet_equal_all_pairs(spark, seed):
    """Boxes and triangles of many sizes, some in others, some copies, some with corners on others' sides."""
    r = random.Random(seed)
    rings = {}
    for i in range(90):
        x, y, s = r.randrange(0, 4000), r.randrange(0, 4000), r.choice([30, 60, 200])
        kind = r.random()
        if kind < 0.5:
            rings[i] = [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
        elif kind < 0.8:
            rings[i] = [(x, y), (x + s, y + r.randrange(-s, s)), (x + r.randrange(-s, s), y + s)]
        elif rings and kind < 0.9:
            rings[i] = list(rings[r.choice(list(rings))])
        elif rings:  # a corner on the middle of another's side, exactly
            a, b = rings[r.choice(list(rings))][:2]
            m = ((a[0] + b[0]) // 2, a[1]) if a[1] == b[1] else a
            rings[i] = [m, (m[0] + 7, m[1] - 90), (m[0] - 7, m[1] - 90)]
    rings[200] = [(-50, -50), (300, -50), (300, 300), (-50, 300)]
    rings[201] = [(100, 100), (110, 100), (110, 110)]  # within, touching nothing
    rows = [(i, [(x * 1e-4, y * 1e-4) for x, y in ring]) for i, ring in rings.items()]
    df = spark.createDataFrame(rows, "id long, ring array<struct<lon:double,lat:double>>")
    got = {x.id: x.component for x in spatial.touching_components(df).collect()}
    assert got == brute_components(rings)
    assert len(set(got.values())) > 5
