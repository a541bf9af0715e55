"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.session import forget, written


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars: each vertex beside the smallest one it reaches in this partition."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    pairs = [(v, r) for v in up if (r := root(v)) != v]
    for i in range(0, len(pairs), 50_000):
        v, r = zip(*pairs[i : i + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(r, pa.int64())], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours of a vertex are hung on the smallest vertex beside it. The minimum is summed up before the shuffle and the join has one row a key on one side, so a hub can be split."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.filter("b < a")
    low = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = seen.join(low, "a")
    if large:
        return hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    own = low.filter("m < a").select("a", F.col("m").alias("b"))
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(own).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for each vertex of the edges (a, b: long, not null); component is its smallest vertex.

    Each partition first contracts its own edges; then large-star and small-star steps alternate, with contraction, until
    every vertex hangs on a root (O(log^2 n) rounds). Loops (a = b) give a vertex of its own. An empty table gives an empty table.
    """
    names = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    now = written(edges.filter("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long"), "edges")
    for _ in range(max_rounds):
        # Settled once every vertex hangs on one root that hangs on nothing.
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("hangs"), F.lit(0).alias("roots")).union(now.select("b", F.lit(0), F.lit(1)))
        loose = ends.groupBy("v").agg(F.sum("hangs").alias("hangs"), F.max("roots").alias("roots")).filter("hangs > 1 or hangs = 1 and roots = 1")
        if loose.isEmpty():
            break
        old, now = now, written(_star(_star(now, True), False).mapInArrow(_contract, "a long, b long"), "edges")
        forget(old)
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return names.join(now.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
