"""Approximate nearest neighbours by a permutation index.

A vector stands for the order of its POSTED nearest pivots. Vectors are dealt into shards by a hash of their id; a shard
posts each distinct vector in the inverted files of these pivots alone, with the place that the pivot has in its order.
The index is one table, a row a shard, made once. A query goes through the files of its own nearest pivots; a vector found
there gains what it is nearer by the footrule distance of the two lists (a pivot at places a and b of lists of length l
takes 2 * (l - max(a, b)) off it), and vectors that share no pivot are never touched. Orders tell directions alone, so the
gain is weighed by the vector's length; the DEPTH best of a shard are then scored exactly, copies of a vector as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.llm.vectors import best_of, matrix, usable, waves
from tramline.session import Table, forget, written

#: Pivots: a bounded sample of the distinct vectors, drawn by hash of the vector. POSTED: a vector's nearest ones that stand for it.
PIVOTS, POSTED = 384, 96
#: Rows of a shard on average at most, and those of its distinct vectors that are scored exactly.
SHARD, DEPTH = 8192, 820
INDEX = "shard long, dim int, ids binary, starts binary, x binary, first binary, member binary, place binary"


def _orders(x: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """The `posted` nearest pivots of each row in order, nearest in direction first."""
    pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :posted].astype(np.int16)


def _copies(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows of x, ids by distinct row and value, where each distinct row's ids start, and the end)."""
    x = np.ascontiguousarray(x + 0.0)  # a negative zero is a zero
    _, first, own = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    start = np.append(0, np.cumsum(np.bincount(own, minlength=len(first))))
    return x[first], ids[np.lexsort((ids, own))], start


def _posted(ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, posted: int) -> tuple[np.ndarray, ...]:
    """A shard's index: ids, where each distinct vector's start, the distinct vectors, and the inverted files: where each pivot's starts, its members and its place in each one's order."""
    x, ids, starts = _copies(ids, x)
    own = _orders(x, pivots, posted)
    pivot = own.ravel()
    by = np.argsort(pivot, kind="stable")
    first = np.searchsorted(pivot[by], np.arange(len(pivots) + 1)).astype(np.int64)
    return ids, starts.astype(np.int64), x, first, (by // own.shape[1]).astype(np.int32), (by % own.shape[1]).astype(np.uint8)


def _gains(files: np.ndarray, left: np.ndarray) -> np.ndarray:
    """What each vector gains from the files (bytes, an even number of vectors) of a query's pivots, the nearest first: posted - max(a, b) is the lesser of what both places leave.

    Two bytes are added up at a time as the halves of 16 bits; the sums of up to 255 places fit in 16 bits.
    """
    pairs = np.minimum(files, left, out=files).view("<u2")
    even = np.add.reduce(pairs & np.uint16(255), axis=0, dtype=np.uint16)
    return np.stack([even, np.add.reduce(pairs >> np.uint16(8), axis=0, dtype=np.uint16)], 1).reshape(-1)


def _answer(index: tuple[np.ndarray, ...], query_ids, queries, orders, k: int, depth: int):
    """(query, vec_id, score) of each query's k best in one shard. Copies are indexed and scored once, then stand for their ids."""
    ids, start, x, first, member, place = index
    lowest, highest, single = ids[start[:-1]], ids[start[1:] - 1], np.diff(start) == 1
    n, posted = len(x), orders.shape[1]
    length = np.linalg.norm(x, axis=1)
    if depth < n:
        # The files side by side: what each of a pivot's places is short of `posted`, 0 for vectors that are not in its file.
        files = np.zeros((len(first) - 1, n + n % 2), np.uint8)
        files[np.repeat(np.arange(len(first) - 1), np.diff(first)), member] = posted - place
        left = np.repeat((posted - np.arange(posted)).astype(np.uint8), files.shape[1]).reshape(posted, -1)
    q_out, id_out, s_out = [], [], []
    for q in range(len(query_ids)):
        if depth < n:
            worth = _gains(files[orders[q]], left)[:n] * length
            some = np.flatnonzero(worth >= np.partition(worth, n - depth)[n - depth])  # all that tie at the cut
        else:
            some = np.arange(n)
        some = some[(lowest[some] != query_ids[q]) | (highest[some] != query_ids[q])]
        s = np.einsum("ij,j->i", x[some], queries[q])
        if len(s) > 2 * k:  # everything at or over the k-th score, ties included
            keep = s >= np.partition(s, len(s) - k)[len(s) - k]
            some, s = some[keep], s[keep]
        one = single[some]
        got, score = [lowest[some[one]]], [s[one]]
        for g, v in zip(some[~one], s[~one], strict=True):
            own = ids[start[g] : start[g + 1]]
            lo, hi = np.searchsorted(own, query_ids[q]), np.searchsorted(own, query_ids[q], "right")
            got.append(np.concatenate([own[: min(lo, k)], own[hi : hi + k]])[:k])
            score.append(np.full(len(got[-1]), v))
        id_out.append(np.concatenate(got))
        s_out.append(np.concatenate(score))
        q_out.append(np.full(len(id_out[-1]), q))
    q, i, s = np.concatenate(q_out), np.concatenate(id_out), np.concatenate(s_out)
    at = best_of(q, i, s, k)
    return q[at], i[at], s[at]


TYPES = (np.int64, np.int64, np.float64, np.int64, np.int32, np.uint8)


def _built(pivots: dict[int, np.ndarray], posted: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, shard = key[0].as_py(), key[1].as_py()
        ids, x = matrix(table.column("vec_id").combine_chunks(), table.column("embedding").combine_chunks(), dim)
        more = table.column("n").to_numpy()
        at = np.repeat(np.arange(len(ids)), more)
        parts = [np.ascontiguousarray(p).tobytes() for p in _posted(ids[at], x[at], pivots[dim], posted)]
        return pa.table([pa.array([shard], pa.int64()), pa.array([dim], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], names=["shard", "dim", "ids", "starts", "x", "first", "member", "place"])

    return run


def _searched(shared, dim: int, k: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, orders = shared.value
        for b in batches:
            for row in range(b.num_rows):
                index = [np.frombuffer(b.column(c)[row].as_buffer(), t) for c, t in zip(("ids", "starts", "x", "first", "member", "place"), TYPES, strict=True)]
                index[2] = index[2].reshape(-1, dim)
                q, i, s = _answer(tuple(index), query_ids, queries, orders, k, depth)
                for a in range(0, len(q), 100_000):
                    j = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[q[j]]), pa.array(i[j]), pa.array(s[j])], names=["query_id", "vec_id", "score"])

    return run


def build(rows: DataFrame, dims: dict[int, int], pivots: int = PIVOTS, posted: int = POSTED, shard: int = SHARD) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(the index table, each dimension's pivots) of rows (vec_id, embedding, dim); dims: rows of each dimension.

    Rows are first counted by id and vector, up to what a shard holds of them is one row with a count. A shard's rows
    follow from the ids alone, so the same table gives the same index however it is partitioned.
    """
    made = {}
    for dim in dims:
        drawn = rows.filter(F.col("dim") == dim).select(F.xxhash64("embedding", F.lit(9)).alias("h"), "vec_id", "embedding")
        lowest = [r.h for r in drawn.select("h").distinct().orderBy("h").limit(pivots).collect()]
        got = drawn.filter(F.col("h").isin(lowest)).groupBy("h").agg(F.min("vec_id").alias("vec_id"), F.min("embedding").alias("embedding")).orderBy("h").toArrow()
        made[dim] = matrix(got.column("vec_id").combine_chunks(), got.column("embedding").combine_chunks(), dim)[1]
    shards = F.coalesce(*[F.when(F.col("dim") == d, F.lit(max(1, -(-n // shard)))) for d, n in dims.items()])
    dealt = rows.groupBy("vec_id", "embedding", "dim").agg(F.count("*").alias("n")).withColumn("shard", F.pmod(F.xxhash64("vec_id"), shards))
    dealt = dealt.repartition(sum(max(1, -(-n // shard)) for n in dims.values()), "dim", "shard")  # about a shard a task, however small
    return written(dealt.groupBy("dim", "shard").applyInArrow(_built(made, posted), INDEX), "permutations"), made


def nearest(vectors: DataFrame, queries: Column, k: int = 20, pivots: int = PIVOTS, posted: int = POSTED, shard: int = SHARD, depth: int = DEPTH, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows of largest inner product among those found.

    queries: a condition on vec_id that picks the queries. Candidates are all rows whose id is not the query's; ties go to
    the smaller id; fewer candidates than k give all of them. Rows without id, and vectors null, all zero, or holding null
    or non-finite components take no part; vectors meet only vectors of their dimension. A repeated id is one query (its
    smallest vector) but as many candidates as it has rows. A shard of up to `depth` vectors is scored whole. Empty tables
    give no rows.
    """
    rows = usable(vectors, vec_id, vector).filter(F.exists("embedding", lambda v: v != 0))
    spark = vectors.sparkSession
    dims = {r[0]: r[1] for r in rows.groupBy("dim").count().collect()}  # one row a dimension
    found = Table(spark, "neighbours", "query_id long, vec_id long, score double")
    if dims:
        index, made = build(rows, dims, pivots, posted, shard)
        for dim, ids, x in waves(rows, queries):
            shared = spark.sparkContext.broadcast((ids, x, _orders(x, made[dim], posted)))  # a wave of queries
            found.append(index.filter(F.col("dim") == dim).mapInArrow(_searched(shared, dim, k, depth), found.schema))
        forget(index)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.read().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of each twentieth vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
