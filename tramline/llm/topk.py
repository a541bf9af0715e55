"""Exact top-k search by distributed histogram selection.

For a wave of queries everything is scored, and each partition counts its scores in bins, of which it sends the highest
that hold k of its own (lower ones can't hold the k-th). Summed up, they say in which bin each query's k-th score lies;
the next round counts within that bin alone, until it is one value wide. A last pass keeps the scores at or over it; at
the k-th value itself each partition sends its k smallest ids. Scores are made again in each pass and never stored. They
are exact: in double precision while no product of norms reaches 2 ** 53, in 64-bit integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.llm.vectors import CELLS, best_of, matrix, own_cells, usable, waves
from tramline.session import Table

BINS = 1024
#: Sums of products under EXACT are integers that a double holds; those over WIDE may not fit into 64 bits.
EXACT, WIDE = 2.0**53, 2.0**62


def _scored(batches: Iterator[pa.RecordBatch], dim: int, scale: float, query_ids: np.ndarray, queries: np.ndarray):
    """(ids, scores: rows x queries) block by block; a query's own row scores below everything."""
    step = max(1, CELLS // len(query_ids))
    none = -np.inf if queries.dtype == np.float64 else np.iinfo(np.int64).min
    for b in batches:
        ids, x = matrix(b.column("vec_id"), b.column("embedding"), dim)
        x = np.floor(scale * x).astype(queries.dtype)
        for i in range(0, len(ids), step):
            s = x[i : i + step] @ queries.T
            row, col = own_cells(ids[i : i + step], query_ids)
            s[row, col] = none
            yield ids[i : i + step], s


def _histogram(shared, dim: int, scale: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, low, high, width, need = shared.value
        n = len(query_ids)
        total = np.zeros(n * (BINS + 1), np.int64)
        for _, s in _scored(batches, dim, scale, query_ids, queries):
            b = np.floor((s - low) / width) if s.dtype == np.float64 else (s - low) // width  # of the query itself, anything
            inside = (s >= low) & (s < high)
            b = np.where(inside, b, BINS).astype(np.int64) + np.arange(n) * (BINS + 1)
            total += np.bincount(b.ravel(), minlength=len(total))
        hist = total.reshape(n, BINS + 1)[:, :BINS][:, ::-1]
        before = np.cumsum(hist, axis=1) - hist
        q, b = np.nonzero((hist > 0) & (before < need[:, None]))
        for i in range(0, len(q), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(q[j].astype(np.int32)), pa.array((BINS - 1 - b[j]).astype(np.int32)), pa.array(hist[q[j], b[j]])], names=["q", "bin", "n"])

    return run


def _selected(shared, dim: int, scale: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, least = shared.value
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, queries.dtype)]
        for ids, s in _scored(batches, dim, scale, query_ids, queries):
            row, q = np.nonzero(s >= least)
            held = [np.concatenate(x) for x in zip(held, (q, ids[row], s[row, q]), strict=True)]
            if len(held[0]) > 2 * k * len(query_ids) + 100_000:
                at = best_of(*held, k)
                held = [x[at] for x in held]
        at = best_of(*held, k)
        q, ids, s = (x[at] for x in held)
        for i in range(0, len(q), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[q[j]]), pa.array(ids[j]), pa.array(s[j].astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def _kth_bin(need: Column) -> Column:
    """Of bins (struct bin, n) from the highest down: the struct (bin, n before it) in which the need-th lies; bin null if there are fewer."""
    zero = F.struct(F.lit(None).cast("int").alias("bin"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(
        F.reverse(F.array_sort("bins")), zero,
        lambda a, x: F.when(a["bin"].isNotNull(), a).when(a["sum"] + x["n"] >= need, F.struct(x["bin"].alias("bin"), a["sum"].alias("sum"))).otherwise(F.struct(a["bin"].alias("bin"), (a["sum"] + x["n"]).alias("sum"))),
    )


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long): each query's k rows of highest inner product of floor(scale * x).

    queries: a condition on vec_id that picks the queries. Candidates are all rows whose id is not the query's; ties go to
    the smaller id; fewer candidates than k give all of them. Rows without id, and vectors null, empty of one dimension
    with nobody, or holding null or non-finite components take no part; vectors meet only vectors of their dimension. An id
    that repeats is one query (its smallest vector) but as many candidates as it has rows. Empty tables give no rows.
    """
    rows = usable(vectors, vec_id, vector)
    spark = vectors.sparkSession
    found = Table(spark, "top", "query_id long, vec_id long, score long")
    for dim, ids, x in waves(rows, queries):
        own = rows.filter(F.col("dim") == dim).select("vec_id", "embedding")
        q = np.floor(scale * x)
        # No score is beyond the product of the norms.
        norm = own.select(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + F.pow(F.floor(v * scale), F.lit(2.0))))).first()[0]
        top = np.ceil(np.sqrt((q * q).sum(1)) * np.sqrt(norm) * (1 + 1e-9)) + 1
        if top.max() >= WIDE:
            raise ValueError("scores may not fit into 64 bits")
        if top.max() >= EXACT:
            q, top = q.astype(np.int64), top.astype(np.int64)
        low, width, need = -top, np.maximum(1, -(-(2 * top + 1) // BINS)), np.full(len(ids), k)
        high = low + BINS * width
        enough, done = np.ones(len(ids), bool), False
        while not done:
            done = bool((width <= 1).all())
            shared = spark.sparkContext.broadcast((ids, q, low, high, width, need))
            hist = own.mapInArrow(_histogram(shared, dim, scale, k), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            per = hist.groupBy("q").agg(F.collect_list(F.struct("bin", "n")).alias("bins"))
            needs = spark.createDataFrame(list(enumerate(need.tolist())), "q int, need long")
            per = per.join(needs, "q")
            where = {r[0]: (r[1], r[2]) for r in per.select("q", _kth_bin(F.col("need")).alias("f")).select("q", "f.bin", "f.sum").collect()}  # one row a query of the wave
            for i in range(len(ids)):
                b, above = where.get(i, (None, 0))
                if b is None:  # fewer than k candidates: all of them
                    enough[i], width[i], high[i] = False, 1, low[i]
                else:
                    low[i], need[i] = low[i] + b * width[i], need[i] - above
                    high[i] = low[i] + width[i]
                    width[i] = max(1, -(-width[i] // BINS))
        shared = spark.sparkContext.broadcast((ids, q, np.where(enough, low, -top)))
        found.append(own.mapInArrow(_selected(shared, dim, scale, k), found.schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.read().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 highest-scoring rows of each fiftieth vector."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""
