"""Vector searches against brute force, and the odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, rank int"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5:300] = x[5]  # a third are copies, so ties run deep
    rows = [(i, v.tolist(), 7) for i, v in enumerate(x.astype("float32"))]
    odd = [(900, None, 1), (None, rows[0][1], 1), (901, [], 1), (902, [1.0, None] + [0.0] * 14, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] + [0.0] * 15, 1), (905, [1.0, 2.0], 1), (920, [0.0] * 16, 1), (7, rows[7][1], 1)]
    return spark.createDataFrame(rows + odd, SCHEMA), rows


def usable(rows, zero):
    ids = np.array([r[0] for r in rows] + ([920] if zero else []) + [7])
    x = np.array([r[1] for r in rows] + ([[0.0] * 16] if zero else []) + [rows[7][1]], np.float32).astype(float)
    return ids, x


def best(ids, x, every, k, scored):
    out = {}
    for q in sorted({int(i) for i in ids if i % every == 0}):
        s = scored(x) @ scored(x[np.flatnonzero(ids == q)[0]])
        ok = np.flatnonzero(ids != q)
        out[q] = [(int(ids[i]), s[i]) for i in sorted(ok, key=lambda i: (-s[i], ids[i]))[:k]]
    return out


def test_top_k_equals_brute_force(vectors):
    df, rows = vectors
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == best(*usable(rows, True), 50, 5, lambda v: np.floor(256 * v))


def test_few_and_no_candidates(spark):
    two = spark.createDataFrame([(0, [1.0], 1), (50, [2.0], 1)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id) for r in topk.top_k(two, F.col("vec_id") % 50 == 0).orderBy("query_id").collect()] == [(0, 1, 50), (50, 1, 0)]
    assert [(r.query_id, r.vec_id) for r in ann.nearest(two, F.col("vec_id") % 50 == 0).orderBy("query_id").collect()] == [(0, 50), (50, 0)]
    none = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(none, F.col("vec_id") % 50 == 0).count() == ann.nearest(none, F.col("vec_id") % 20 == 0).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    """Components of a million: products no longer fit into a double's 53 bits."""
    r = np.random.default_rng(8)
    x = np.round(r.uniform(-1e6, 1e6, (60, 8)), 3)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, rank int")
    ints = [[int(np.floor(256 * c)) for c in v] for v in x]
    want = []
    for q in (0, 50):
        s = [(-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in enumerate(ints) if i != q]
        want += [(q, rank, i, -score) for rank, (score, i) in enumerate(sorted(s)[:5], 1)]
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()] == want
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1e17], 0)], "vec_id long, embedding array<double>, rank int"), F.col("vec_id") % 50 == 0)


def answer(ids, x, pivots, query_ids, queries, posted, depth, k=20):
    return ann._answer(ann._posted(ids, x, pivots, posted), query_ids, queries, ann._orders(queries, pivots, posted), k, depth)


@pytest.mark.parametrize("n", [900, 4000])
def test_neighbours_of_copies_by_id(n):
    """More copies than a shard scores: the ids are those of the tie rule, in whatever order the rows come."""
    r = np.random.default_rng(4)
    x = r.normal(size=(n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = r.permutation(n).astype(np.int64)
    x[ids < n // 3] = x[0]
    ids[ids == 9] = 8  # a repeated id counts with each of its rows, except for itself
    query_ids = np.arange(0, n // 3, 20)
    queries = np.repeat(x[:1], len(query_ids), 0)
    pivots = x[r.choice(n, 64, replace=False)]
    for order in (np.arange(n), np.argsort(ids, kind="stable"), np.argsort(-ids, kind="stable")):
        q, i, s = answer(ids[order], x[order], pivots, query_ids, queries, 16, 200)
        for j, own in enumerate(query_ids):
            assert i[q == j].tolist() == [v for v in sorted(ids) if v != own][:20]
            assert np.allclose(s[q == j], queries[j] @ queries[j], atol=1e-12)


@pytest.mark.parametrize("spread", [0, 0.5, 1])
def test_neighbours_of_varied_length(spread):
    """A full shard at the production sizes, with log-normal lengths: recall by id against brute force."""
    n, r = ann.SHARD, np.random.default_rng(3)
    x = r.normal(size=(n, 64))
    x *= np.exp(spread * r.normal(size=(n, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(n)
    asked = ids[::200]
    pivots = x[r.choice(n, ann.PIVOTS, replace=False)]
    q, i, _ = answer(ids, x, pivots, asked, x[asked], ann.POSTED, ann.DEPTH)
    hits = []
    for j, own in enumerate(asked):
        s = x @ x[own]
        s[own] = -np.inf
        hits.append(len(set(i[q == j]) & set(np.argsort(-s)[:20])) / 20)
    assert np.mean(hits) >= 0.95


def test_a_vector_is_posted_for_its_own_pivots_alone():
    r = np.random.default_rng(6)
    x, pivots = r.normal(size=(500, 16)), r.normal(size=(40, 16))
    _, _, y, first, member, place = ann._posted(np.arange(500), x, pivots, 8)
    assert len(member) == 500 * 8 and np.bincount(member, minlength=500).tolist() == [8] * 500
    near = np.argsort(-(y @ (pivots / np.linalg.norm(pivots, axis=1, keepdims=True)).T), axis=1)
    for p in (0, 17, 39):
        own = slice(first[p], first[p + 1])
        assert all(near[m, a] == p for m, a in zip(member[own], place[own]))


def test_neighbours_recall_and_scores(vectors):
    df, rows = vectors
    asked = lambda d: sorted(tuple(r) for r in ann.nearest(d, F.col("vec_id") % 20 == 0, shard=300, depth=60).collect())
    found = asked(df.repartition(8))
    assert found == asked(df.coalesce(1))  # partitions change nothing
    got = {}
    for q, _, v, s in found:
        got.setdefault(q, []).append((v, s))
    want = best(*usable(rows, False), 20, 20, lambda v: v)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    # Ties make several right answers; a hit is a score at least as high as the twentieth.
    hits = [sum(s >= want[q][-1][1] - 1e-12 for _, s in got[q]) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    ids, x = usable(rows, False)
    at = {int(i): v for i, v in zip(ids, x)}
    assert all(abs(at[q] @ at[v] - s) < 1e-12 for q in got for v, s in got[q])


def test_op9_recall_by_id(spark):
    """The registered query on its whole table: 500 vectors and more, against brute force."""
    at = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding").collect() if r.embedding]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    want = best(ids, x, 20, 20, lambda v: v)
    got = {}
    for r in ann.op9_nearest_neighbours(spark, at).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9


@pytest.mark.parametrize("posted", [7, 96, 255])
def test_gains_are_what_the_files_say(posted):
    """Side by side, the files give each vector what going through them one by one does."""
    r = np.random.default_rng(posted)
    n, many = 302, 2 * posted
    place = np.argsort(r.random((n, many)), axis=1)[:, :posted]  # each vector's pivots in order
    asked = r.permutation(many)[:posted]
    files = np.zeros((many, n), np.uint8)
    for v in range(n):
        files[place[v], v] = posted - np.arange(posted)
    at = [{int(p): i for i, p in enumerate(row)} for row in place]
    want = [sum(posted - max(a, at[v][int(p)]) for a, p in enumerate(asked) if int(p) in at[v]) for v in range(n)]
    left = np.repeat((posted - np.arange(posted)).astype(np.uint8), n).reshape(posted, n)
    assert ann._gains(files[asked], left).tolist() == want
