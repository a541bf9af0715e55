"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Every source's size is summed over all documents (characters, and one for each document, so no source has size 0). Its
mean repetition rate is target weight x output size / size. A document's uniform number comes from MD5 of the seed and its
id, and is inverted through its source's Poisson distribution function, held as one array a source. The document is
exploded by its count, and the copies are dealt to all partitions, and sorted there, by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.session import fresh, written


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """source, cdf: P(count <= j) for j = 0 up to where the rest is beyond double precision, of rates (source, rate; one row a source).

    In logarithms, so large rates don't underflow; running sums over j, so a table costs as much as it is long. A rate of 0 has P(count <= 0) = 1.
    """
    w = Window.partitionBy("source").orderBy("j")
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    rows = rates.filter("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0), top)).alias("j"))
    step = F.when(F.col("j") > 0, F.log("rate") - F.log(F.col("j").cast("double"))).otherwise(-F.col("rate"))
    rows = rows.withColumn("l", F.sum(step).over(w)).withColumn("p", F.sum(F.exp("l")).over(w))
    some = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("j", "p"))).alias("t")).select("source", F.transform("t", lambda x: x["p"]).alias("cdf"))
    return some.unionByName(rates.filter("not (rate > 0)").select("source", F.array(F.lit(1.0)).alias("cdf")))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.7, out_share: float = 1.0) -> DataFrame:
    """One row a source: source, n_docs, size, weight (sums to 1 over the sources present), rate.

    weights: (source, weight); sources it lacks get 0. None: size ** temperature. out_share: output size over input size.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    else:
        own = weights.groupBy(F.col("source").alias("w_source")).agg(F.max("weight").alias("w"))
        sizes = sizes.join(own, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source").withColumn("w", F.coalesce(F.col("w").cast("double"), F.lit(0.0)))
    # Sums over the sources, themselves one row a source; joined by a constant key.
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("w").alias("all_w")).withColumn("one", F.lit(1))
    sizes = sizes.withColumn("one", F.lit(1)).join(total, "one").drop("one")
    weight = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(F.lit(0.0))
    return sizes.select("source", "n_docs", "size", weight.alias("weight"), (weight * F.col("all_size") * F.lit(out_share) / F.col("size")).alias("rate"))


def mix(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.7, out_share: float = 1.0, seed: int = 0) -> DataFrame:
    """The columns of `docs` (doc_id, text, source and any others), copy (0, 1, ...) and mix_key, globally shuffled.

    A null source is a source of its own. A null id is replaced by the text's MD5 in the hash; null or empty text counts
    one character. Repeated rows have the same draw. A rate of 0 (a source without weight) gives no copies. An empty table
    gives an empty table. Older columns named copy or mix_key are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("copy", "mix_key")])
    r_source, r_cdf, r_n = fresh(docs.columns, "r_source", "r_cdf", "r_n")
    # Written, so that Spark knows its size: within the session's limit it is broadcast and no document moves, else both sides are sorted.
    rates = written(poisson_tables(source_rates(docs, weights, temperature, out_share)), "rates").select(F.col("source").alias(r_source), F.col("cdf").alias(r_cdf))
    who = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    u = uniform(F.lit(f"{seed}"), F.lit("count"), who)
    out = docs.join(rates, F.col("source").eqNullSafe(F.col(r_source)))
    # The number stands in an array of one, so that it is hashed once a row and not once a comparison.
    below = F.transform(F.array(u), lambda x: F.size(F.filter(r_cdf, lambda c: c <= x)))
    out = out.withColumn(r_n, F.get(below, F.lit(0))).drop(r_source, r_cdf).filter(F.col(r_n) > 0)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(r_n) - 1))).drop(r_n)
    out = out.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(f"{seed}"), F.lit("place"), who, F.col("copy").cast("string"))))
    return out.repartition("mix_key").sortWithinPartitions("mix_key", "doc_id")


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed to weights of source size ** 0.7, with copy numbers and place keys."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"))


OP5_SQL = """
with d as (
  select *, coalesce(cast(doc_id as varchar), md5(text), '') as who from documents
), s as (
  select source, sum(coalesce(length(text), 0) + 1)::bigint as size from d group by source
), w as (
  select source, size, pow(size::double, 0.7::double) as w from s
), r as (
  select source, (w / sum(w) over ()) * cast(sum(size) over () as double) / size as rate from w
), p as (
  select source, j, sum(exp(-rate + j * ln(rate) - lgamma(j + 1.0))) over (partition by source order by j) as cdf
  from r, range(0, 400) t(j) where j <= ceil(rate + 12 * sqrt(rate) + 30)
), u as (
  select *, ('0x' || substr(md5('0|count|' || who), 1, 13))::bigint / 4503599627370496.0::double as u from d
), n as (
  select u.*, (select count(*) from p where p.source is not distinct from u.source and p.cdf <= u.u) as n from u
)
select doc_id, text, lang, source, n_chars, cast(copy as integer) as copy, md5('0|place|' || who || '|' || copy) as mix_key
from n, lateral (select unnest(range(0, n)) as copy)
"""
