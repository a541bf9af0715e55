"""Road classes spread along roads from count points, by rounds of joins: no road is one task's work.

Nodes of a road that have two neighbours and no seed are a chain's inside. Their two pointers double in reach every
round (a pointer's end hands on its own pointer away from where one came), so a chain of n nodes knows its two ends
after log2(n) rounds. Between ends, junctions and seeds is left a small graph; distances are relaxed on it from the
nodes that got nearer in the round before. Lengths are whole micrometres, so sums and ties do not hang on the order.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.geo import flat_km
from tramline.functions.stats import qualify
from tramline.session import forget, written

#: Units of a metre.
UNITS = 1_000_000


def nearest_seed(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """ref, node, dist_m, seed for every node of a road: its nearest seed along the road, ties to the lower seed; nulls where none can be reached.

    edges: ref, u, v, length_m (undirected; of several between two nodes the shortest counts); seeds: ref, node. Edges and
    seeds without a ref belong to no road; a seed that is no node of its road is passed over.
    """
    both = lambda a, b: edges.filter("ref is not null").select("ref", F.col(a).alias("a"), F.col(b).alias("b"), F.round(F.col("length_m") * UNITS).cast("long").alias("w"))
    nodes = both("u", "v").select("ref", "a").union(both("v", "u").select("ref", "a")).distinct()
    at = seeds.filter("ref is not null").select("ref", F.col("node").alias("a")).distinct()
    e = written(both("u", "v").union(both("v", "u")).filter("a <> b").groupBy("ref", "a", "b").agg(F.min("w").alias("w")), "road-edges")
    degree = e.groupBy("ref", "a").agg(F.count("*").alias("degree")).join(at.withColumn("seed", F.lit(True)), ["ref", "a"], "left")
    inside = written(degree.filter("degree = 2 and seed is null").select("ref", "a"), "road-insides")
    ends = inside.select("ref", F.col("a").alias("b"), F.lit(False).alias("stop"))
    known = e.join(ends, ["ref", "b"], "left").withColumn("stop", F.coalesce("stop", F.lit(True)))
    direct = known.filter("stop").join(inside, ["ref", "a"], "left_anti").select("ref", "a", "b", "w")
    pointer = written(known.join(inside, ["ref", "a"], "left_semi").select("ref", "a", "b", "w", "stop"), "road-pointers")
    size = inside.count()
    done = [pointer.filter("stop")]
    going = pointer.filter("not stop")
    # Rings without an end or a seed never stop; no chain needs more rounds than this.
    for _ in range(ceil(log2(size + 1)) + 1 if size else 0):
        every = done[0].select("ref", "a", "b", "w", "stop")
        for d in done[1:]:
            every = every.union(d.select("ref", "a", "b", "w", "stop"))
        on = every.union(going).select("ref", F.col("a").alias("b"), F.col("b").alias("c"), F.col("w").alias("w2"), F.col("stop").alias("stop2"))
        jumped = written(going.join(on, ["ref", "b"]).filter("c <> a").select("ref", "a", F.col("c").alias("b"), (F.col("w") + F.col("w2")).alias("w"), F.col("stop2").alias("stop")), "road-pointers")
        done.append(jumped.filter("stop"))
        going = jumped.filter("not stop")
        if going.isEmpty():
            break
    reached = done[0]
    for d in done[1:]:
        reached = reached.union(d)
    reached = written(reached.select("ref", "a", "b", "w"), "road-ends")
    two = reached.groupBy("ref", "a").agg(F.array_sort(F.collect_list(F.struct("b", "w"))).alias("t")).filter("size(t) = 2 and t[0].b <> t[1].b")
    across = two.select("ref", F.col("t")[0]["b"].alias("a"), F.col("t")[1]["b"].alias("b"), (F.col("t")[0]["w"] + F.col("t")[1]["w"]).alias("w"))
    small = direct.union(across).union(across.select("ref", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    small = written(small.groupBy("ref", "a", "b").agg(F.min("w").alias("w")), "road-graph")

    best = front = written(at.join(nodes, ["ref", "a"], "left_semi").select("ref", "a", F.struct(F.lit(0).cast("long").alias("d"), F.col("a").alias("seed")).alias("l")), "road-labels")
    while True:
        asked = front.join(small, ["ref", "a"]).select("ref", F.col("b").alias("a"), F.struct((F.col("l.d") + F.col("w")).alias("d"), F.col("l.seed").alias("seed")).alias("l"))
        asked = asked.groupBy("ref", "a").agg(F.min("l").alias("l"))
        better = written(asked.join(best.withColumnRenamed("l", "was"), ["ref", "a"], "left").filter("was is null or l < was").select("ref", "a", "l"), "road-labels")
        if better.isEmpty():
            break
        after = written(best.union(better).groupBy("ref", "a").agg(F.min("l").alias("l")), "road-labels")
        if front is not best:
            forget(front)
        forget(best)
        best, front = after, better
    by_end = reached.join(best.select("ref", F.col("a").alias("b"), "l"), ["ref", "b"]).select("ref", "a", F.struct((F.col("l.d") + F.col("w")).alias("d"), F.col("l.seed").alias("seed")).alias("l"))
    labels = best.union(by_end).groupBy("ref", "a").agg(F.min("l").alias("l"))
    return nodes.join(labels, ["ref", "a"], "left").select("ref", F.col("a").alias("node"), (F.col("l.d") / F.lit(float(UNITS))).alias("dist_m"), F.col("l.seed").alias("seed"))


def propagate_class(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """ref, node, dist_m, cls: the class of the nearest seed along the road for every node; ties to the lower seed node; nodes that no seed reaches have none.

    edges: ref, u, v, length_m; seeds: ref, node, cls (of several at a node the first in the alphabet). Nodes of edges without a ref have no class.
    """
    one = seeds.filter("ref is not null").groupBy("ref", F.col("node").alias("seed")).agg(F.min("cls").alias("cls"))
    named = nearest_seed(edges, seeds).join(one, ["ref", "seed"], "left").select("ref", "node", "dist_m", "cls")
    loose = edges.filter("ref is null")
    nodes = loose.select(F.col("u").alias("node")).union(loose.select("v")).distinct()
    none = F.lit(None)
    return named.unionByName(nodes.select(none.cast("string").alias("ref"), "node", none.cast("double").alias("dist_m"), none.cast("string").alias("cls")))


def classified(segments: DataFrame, points: DataFrame, most_m: float = 1000.0, half_link_m: float = 500.0) -> DataFrame:
    """segments with cls, basis, point and along_m: the class of the count point that is nearest along the segment's road.

    segments: ref, u, v, length_m, lon_u, lat_u, lon_v, lat_v; points: point, ref, cls, lon, lat, link_km (null: half_link_m is
    half of it). A count point seeds the nearest node of its road within most_m; of several at a node the lowest counts. A
    segment's nearer end decides, ties to the lower node, so both directions agree. basis: count_point within half the
    point's link length, propagated beyond, osm_fallback where no point can be reached (and where there is no ref).
    """
    from tramline.operators.spatial import near_pairs

    end = lambda n: segments.filter("ref is not null").select("ref", F.col(n).alias("node"), F.col(f"lon_{n}").alias("lon"), F.col(f"lat_{n}").alias("lat"))
    nodes = end("u").union(end("v")).groupBy("ref", "node").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))
    near = near_pairs(points.filter("ref is not null"), nodes, most_m / 1000).filter("a_ref = b_ref")
    near = near.withColumn("dist_km", flat_km(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"), F.col("a_lat")))
    near = qualify(near, ["a_point"], [F.asc("dist_km"), F.asc("b_node")])
    meta = qualify(near.select(F.col("b_ref").alias("ref"), F.col("b_node").alias("seed"), F.col("a_point").alias("point"), F.col("a_cls").alias("cls"), F.coalesce(F.col("a_link_km") * 500, F.lit(half_link_m)).alias("half_m")), ["ref", "seed"], [F.asc("point")])
    meta = written(meta, "road-seeds")
    found = written(nearest_seed(segments.select("ref", "u", "v", "length_m"), meta.select("ref", F.col("seed").alias("node"))).filter("seed is not null"), "road-nodes")
    side = lambda n: found.select("ref", F.col("node").alias(n), F.struct(F.col("dist_m").alias("d"), F.col("node").alias("n"), F.col("seed").alias("seed")).alias(f"_{n}"))
    rows = segments.join(side("u"), ["ref", "u"], "left").join(side("v"), ["ref", "v"], "left").withColumn("_l", F.least("_u", "_v")).withColumn("seed", F.col("_l.seed"))
    rows = rows.join(meta, ["ref", "seed"], "left").withColumn("along_m", F.when(F.col("point").isNotNull(), F.col("_l.d")))
    basis = F.when(F.col("point").isNull(), "osm_fallback").when(F.col("along_m") <= F.col("half_m"), "count_point").otherwise("propagated")
    return rows.select(*segments.columns, "cls", basis.alias("basis"), "point", "along_m")


def boundaries(segments: DataFrame) -> DataFrame:
    """ref, node, classes (sorted) of nodes at which segments of a road differ in class."""
    ends = segments.filter("ref is not null and cls is not null").select("ref", F.explode(F.array("u", "v")).alias("node"), "cls")
    return ends.groupBy("ref", "node").agg(F.array_sort(F.collect_set("cls")).alias("classes")).filter("size(classes) > 1")
