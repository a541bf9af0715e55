"""What vector search shares: Arrow columns as matrices, and queries in waves of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries that are sent to all executors at a time, about; a wave of twice as many is an error.
WAVE = 4096
#: Scores that a task holds at a time.
CELLS = 1 << 22


def matrix(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, float64 rows) of the rows that have an id and a vector of `dim` finite components."""
    keep = pa.compute.and_(ids.is_valid(), pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(vectors), dim), False))
    ids, vectors = ids.filter(keep), vectors.filter(keep)
    flat = vectors.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dim)  # nulls come as NaN
    fine = np.isfinite(x).all(1)
    return ids.to_numpy()[fine], x[fine]


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, embedding, dim) of the rows that can take part; rows that repeat both count once in searches anyway."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(whole).withColumn("dim", F.size("embedding"))


def waves(rows: DataFrame, pick: Column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, ids, float64 rows) of the queries, about WAVE at a time; a repeated id counts once, with its smallest vector."""
    asked = rows.filter(pick).select("vec_id", "embedding", "dim")
    for dim, n in sorted((r[0], r[1]) for r in asked.groupBy("dim").count().collect()):  # one row a dimension
        count = max(1, -(-n * 5 // (4 * WAVE))) if n > WAVE else 1
        for w in range(count):
            part = asked.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(count)) == w)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
            got = part.orderBy("vec_id").limit(2 * WAVE).toArrow()
            if got.num_rows == 2 * WAVE:
                raise ValueError("a wave of queries is twice as large as planned")
            if got.num_rows:
                ids, x = matrix(got.column("vec_id").combine_chunks(), got.column("embedding").combine_chunks(), dim)
                yield dim, ids, x


def own_cells(ids: np.ndarray, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) places where a candidate is the query itself; query_ids are sorted."""
    at = np.minimum(np.searchsorted(query_ids, ids), len(query_ids) - 1)
    row = np.flatnonzero(query_ids[at] == ids)
    return row, at[row]


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best: highest score, then smallest id; a repeated id with one score counts each time."""
    by = np.lexsort((ids, -score, query))
    q = query[by]
    first = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(q)))
    return by[np.arange(len(q)) - np.repeat(first, size) < k]
