"""Grouped statistics that Spark has not built in, over any keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def qualify(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in order: QUALIFY row_number() <= k."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def weighted_mean(x: Column, w: Column) -> Column:
    """Aggregate: sum(x w) / sum(w) over rows that have both; null without weight."""
    both = x.isNotNull() & w.isNotNull()
    return F.try_divide(F.sum(F.when(both, x * w)), F.sum(F.when(both, w)))


def harmonic_mean(x: Column) -> Column:
    """Aggregate: n / sum(1 / x) over positive x."""
    ok = F.when(x > 0, x)
    return F.count(ok) / F.sum(F.lit(1.0) / ok)


def weighted_median(df: DataFrame, keys: list[str], x: str, w: str, out: str) -> DataFrame:
    """One row a key: the lowest x at which the running weight reaches half of the total. Equal x are added up first."""
    sums = df.filter(F.col(x).isNotNull() & F.col(w).isNotNull()).groupBy(*keys, x).agg(F.sum(w).alias("_w"))
    part = Window.partitionBy(*keys)
    run = sums.withColumns({"_c": F.sum("_w").over(part.orderBy(x).rowsBetween(Window.unboundedPreceding, 0)), "_t": F.sum("_w").over(part)})
    return run.filter(F.col("_c") >= F.col("_t") / 2).groupBy(*keys).agg(F.min(x).alias(out))


def nearest_rank(x: str, p: float, slots: Column) -> Column:
    """Aggregate: the ceil(p * slots)-th smallest of x, missing slots counting as infinite; null beyond what there is."""
    return ranked(F.sort_array(F.collect_list(x)), p, slots)


def ranked(values: Column | str, p: float, slots: Column) -> Column:
    """The ceil(p * slots)-th of sorted values; null beyond what there is."""
    return F.get(values, (F.ceil(F.lit(float(p)) * slots) - 1).cast("int"))


def sum_before(rows: DataFrame, column: str, weight: str, out: str, descending: bool = False) -> DataFrame:
    """Adds the sum of `weight` over all rows before each in order of `column` (one row a value), without a window over all.

    Rows go over range partitions: a first pass sums each partition, its sums (one row a partition) are added up, and rows
    are summed within theirs.
    """
    from tramline.session import written

    order = F.desc(column) if descending else F.asc(column)
    held = written(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()), "ranks")
    first = held.groupBy("_p").agg(F.sum(weight).alias("_s"))
    first = first.withColumn("_b", F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_b", F.lit(0)).alias("_b"))
    w = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("_o", F.coalesce(F.sum(weight).over(w), F.lit(0))).join(first, "_p").withColumn(out, F.col("_o") + F.col("_b")).drop("_p", "_o", "_b")


def average_rank(df: DataFrame, column: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """Ranks with ties at their mean, from counts by value, so no value's rows need one task; nulls have none."""
    keys = keys or []
    value = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    if keys:
        w = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
        ranked = value.withColumn("_c", F.sum("_n").over(w))
    else:
        ranked = sum_before(value, column, "_n", "_c").withColumn("_c", F.col("_c") + F.col("_n"))
    ranked = ranked.withColumn(out, F.col("_c") - (F.col("_n") - 1) / F.lit(2.0)).drop("_n", "_c")
    return df.join(ranked, [*keys, column], "left")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Spearman's rank correlation of rows that have both, and how many."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_rank(average_rank(both, a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("rho"), F.count("*").alias("n"))


def percent_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average rank over the number of values."""
    n = df.agg(F.count(column).alias("_n"))
    return average_rank(df, column, "_r").join(n.withColumn("_k", F.lit(1)), F.lit(1) == F.col("_k")).withColumn(out, F.col("_r") / F.col("_n")).drop("_r", "_n", "_k")


def top_names(df: DataFrame, keys: list[str], name: str, k: int = 3, sep: str = ";") -> DataFrame:
    """The k most frequent names of each key, most frequent first, ties by name, joined."""
    n = df.filter(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count("*").alias("_n"))
    top = qualify(n, keys, [F.desc("_n"), F.asc(name)], k)
    order = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(name).alias("x"))))
    return top.groupBy(*keys).agg(F.array_join(F.transform(order, lambda s: s["x"]), sep).alias(f"top_{name}"))


def share_in_group(x: Column, keys: list[str]) -> Column:
    """x over the sum of x in its group; null where that is 0."""
    return F.try_divide(x, F.sum(x).over(Window.partitionBy(*keys)))


def gap_with_edges(df: DataFrame, keys: list[str], t: str, lo: float, hi: float) -> DataFrame:
    """Per key: n, and the longest gap between consecutive times counting from lo and to hi."""
    w = Window.partitionBy(*keys).orderBy(t)
    gaps = df.withColumn("_g", F.col(t) - F.lag(t).over(w))
    return gaps.groupBy(*keys).agg(
        F.count("*").alias("n"), F.greatest(F.coalesce(F.max("_g"), F.lit(0.0)), F.min(t) - F.lit(float(lo)), F.lit(float(hi)) - F.max(t)).alias("max_gap")
    )


def running_sums(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """`df` with <column>_to for each column: its sum within the keys up to the row by a total order, itself included.

    Runs over range partitions: sums by key and range first, then within a range, so no key's rows need one task. Rows with a
    null key go.
    """
    from functools import reduce

    from tramline.session import written

    df = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    held = written(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_p", F.spark_partition_id()), "running")
    parts = held.groupBy(*keys, "_p").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_p", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    own = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = held.withColumns({f"{c}_to": F.sum(c).over(own) for c in columns}).join(parts, [*keys, "_p"])
    return out.select(*df.columns, *[(F.col(f"{c}_to") + F.col(f"_{c}")).alias(f"{c}_to") for c in columns])


def medians_without_fold(df: DataFrame, keys: list[str], fold: str, value: str, out: str = "median") -> DataFrame:
    """keys, fold, `out`, n: for every group and every fold of the table, the exact median (midway between two) of the group's values in other folds, and how many there are; a group with none there has no row.

    One pass for all folds: counts by value and fold are summed up in the order of values, and a fold's complement is the
    whole less the fold. Folds are a handful: each is a column. Nulls are no values, and a null key is no group.
    """
    rows = df.filter(F.col(value).isNotNull() & F.col(fold).isNotNull())
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    none = df.select(*keys, fold, F.lit(0.0).alias(out), F.lit(0).cast("long").alias("n")).filter("false")
    if not folds:
        return none
    n = lambda i: F.sum(F.when(F.col(fold) == F.lit(folds[i]), 1).otherwise(0))
    names = [f"_n{i}" for i in range(len(folds))]
    by = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), *[n(i).alias(c) for i, c in enumerate(names)])
    run = running_sums(by, keys, [value], ["_n", *names])
    total = by.groupBy(*keys).agg(F.sum("_n").alias("_t"), *[F.sum(c).alias(f"{c}_t") for c in names])
    j = run.join(total, keys)
    low, high = [], []
    for c in names:
        rest, up = F.col("_t") - F.col(f"{c}_t"), F.col("_n_to") - F.col(f"{c}_to")
        low.append(F.min(F.when(up >= F.floor((rest + 1) / 2), F.col(value))))
        high.append(F.min(F.when(up >= F.floor((rest + 2) / 2), F.col(value))))
    found = j.groupBy(*keys).agg(F.array(*[F.struct(F.lit(f).alias(fold), ((a + b) / 2).alias(out), F.max(F.col("_t") - F.col(f"{c}_t")).alias("n")) for f, c, a, b in zip(folds, names, low, high)]).alias("_m"))
    return found.select(*keys, F.explode("_m").alias("_m")).select(*keys, f"_m.{fold}", f"_m.{out}", "_m.n").filter("n > 0")
