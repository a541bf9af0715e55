"""Relational primitives that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def join_one_to_one(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose keys must not repeat on either side; a key that does raises when rows are read."""

    def once(df: DataFrame, flag: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*keys))
        return df.withColumn(flag, F.when(n > 1, F.raise_error(F.lit("a key repeats in a one-to-one join")).cast("int")).otherwise(0))

    return once(a, "_once_a").join(once(b, "_once_b"), keys, how).filter("coalesce(_once_a, 0) + coalesce(_once_b, 0) = 0").drop("_once_a", "_once_b")


def row_ids(df: DataFrame, order: list[str], out: str = "row_id") -> DataFrame:
    """Numbers all rows from 1 by a total order, over range partitions: each partition's rows are counted first, and numbered within it after."""
    from tramline.session import written

    held = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    n = held.groupBy("_p").agg(F.count("*").alias("_n"))
    first = n.withColumn("_b", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_b", F.lit(0)).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return held.withColumn("_r", rank).join(first, "_p").withColumn(out, F.col("_r") + F.col("_b")).drop("_p", "_r", "_b")


def loss_by_key(before: DataFrame, after: DataFrame, keys: list[str], most: float = 0.1) -> DataFrame:
    """Rows by key before and after a step, the share lost, and whether that is more than `most`."""
    n = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    j = n(before, "before").join(n(after, "after"), keys, "left").fillna(0, ["after"])
    lost = F.col("before") - F.col("after")
    return j.withColumns({"lost": lost / F.col("before"), "flagged": lost > most * F.col("before")})


def class_changes(was: DataFrame, now: DataFrame, keys: list[str], cls: str) -> DataFrame:
    """was, now, rows: how many keys went from which class to which; a key that one side lacks has null there."""
    a, b = was.select(*keys, F.col(cls).alias("was")), now.select(*keys, F.col(cls).alias("now"))
    return a.join(b, keys, "full").groupBy("was", "now").agg(F.count("*").alias("rows"))


def gaps_with_edges(polls: DataFrame, windows: DataFrame, key: str, ts: str, limit_s: float) -> DataFrame:
    """Per window (key, start, end): polls in it, and minutes lost in gaps over limit_s, from its start, between polls and to its end. A window without polls is all gap."""
    ends = windows.select(key, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(0).alias("n")), F.struct(F.col("end").alias("t"), F.lit(0).alias("n")))).alias("x")).select(key, "x.t", "x.n")
    inside = polls.join(windows, key).filter((F.col(ts) >= F.col("start")) & (F.col(ts) <= F.col("end"))).select(key, F.col(ts).alias("t"), F.lit(1).alias("n"))
    w = Window.partitionBy(key).orderBy("t", "n")
    gap = (F.unix_micros(F.col("t")) - F.unix_micros(F.lag("t").over(w))) / F.lit(1e6)
    rows = ends.unionByName(inside).withColumn("_g", gap)
    return rows.groupBy(key).agg(F.sum("n").alias("polls"), F.sum(F.when(F.col("_g") > limit_s, F.col("_g") / 60).otherwise(0.0)).alias("gap_min"))


def comparison(a: DataFrame, b: DataFrame, chain_a: list[str], chain_b: list[str], anyway: bool = False) -> DataFrame:
    """metric, a, b, change (four places) of two evaluated scenarios, of which one must be the other's ancestor unless `anyway`; a metric that one lacks has nulls. Each has metric, value."""
    from tramline.operators.scenario import related

    if not anyway and not related(chain_a, chain_b):
        raise ValueError("neither scenario is an ancestor of the other")
    j = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full")
    return j.withColumn("change", F.round(F.col("b") - F.col("a"), 4))


def zone_comparison(a: DataFrame, b: DataFrame, zone: str, metrics: list[str]) -> DataFrame:
    """zone, metric, a, b, change (four places): both scenarios' values of every zone and metric. A zone that one of them lacks has nulls there, and no change."""
    side = lambda df, c: df.select(zone, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(c)) for m in metrics])).alias("x")).select(zone, "x.metric", f"x.{c}")
    j = side(a, "a").join(side(b, "b"), [zone, "metric"], "full")
    return j.withColumn("change", F.round(F.col("b") - F.col("a"), 4))


def comparison_report(rows: DataFrame, weights: DataFrame, zone: str, less_is_better: list[str], threshold: float = 0.0) -> DataFrame:
    """metric, zones, a, b, change, better, worse, not_compared: weighted means of both scenarios over the zones that both have, and the weight of zones that got better or worse by the threshold or more (whichever side of 0), beside each other; zones that one lacks are counted by weight.

    rows: what zone_comparison gives; weights: zone, weight (residents, say; a zone without one weighs nothing).
    """
    r = rows.join(weights.select(zone, F.col("weight").cast("double").alias("_w")), zone, "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    w, both = F.col("_w"), F.col("a").isNotNull() & F.col("b").isNotNull()
    gain = F.when(F.col("metric").isin(*less_is_better), F.col("a") - F.col("b")).otherwise(F.col("b") - F.col("a"))
    weigh = lambda c: F.try_divide(F.sum(F.when(both, F.col(c) * w)), F.sum(F.when(both, w)))
    moved = lambda x: F.sum(F.when(both & (x >= threshold) & (x > 0), w).otherwise(0.0))
    g = r.groupBy("metric").agg(F.sum(both.cast("long")).alias("zones"), weigh("a").alias("a"), weigh("b").alias("b"), moved(gain).alias("better"), moved(-gain).alias("worse"), F.sum(F.when(both, 0.0).otherwise(w)).alias("not_compared"))
    return g.select("metric", "zones", "a", "b", F.round(F.col("b") - F.col("a"), 4).alias("change"), "better", "worse", "not_compared")
