"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets form a class, told by the SHA-256 of all the set's words; classes are compared, so copies
cost nothing. Shingles are hashed under a key drawn for each run. A class has a signature of BANDS x ROWS minima; classes that agree on a whole band meet in that band's bucket. With 32 bands of 4 rows a pair of
similarity 0.8 misses every bucket with probability (1 - 0.8**4)**32 = 5e-8.

A candidate pair's signatures are compared in batches of 16. After each batch the posterior of the similarity (uniform
prior) says how likely it is still at or over the threshold; below MISS the pair is dropped. Survivors are verified on
the full sets: first on 64-bit hashes of all shingles, then, before a link comes out, on the shingles' words themselves.

Pairs within a bucket are not all listed. First every member meets the smallest one of its bucket (of all its buckets, the
one that most meet before the others). The links found give components; a pair within one component decides nothing more. Then, in buckets that still hold several components, the
members outside the bucket's largest component meet all members of other components, in blocks of bounded size. Every
bucket pair is so compared, or is already connected. Steps with nothing left to do are passed over, and the driver lets go
of finished plans between steps.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.textops import MULT, U64, given_back, mix64, set_digests, shingle_sets, slices
from tramline.operators.components import components
from tramline.session import forget, fresh, release, written

BANDS, ROWS, BATCH = 32, 4, 16
#: The probability at which a pair at or over the threshold may be dropped in a batch.
MISS = 1e-9
#: Members of a bucket that meet in one block, on either side.
BLOCK = 512
PERMS = BANDS * ROWS


def _signatures(vals: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """For each row with a set: PERMS minima, 32 bits each."""
    n = len(edge) - 1
    out = np.zeros((n, PERMS), np.uint32)
    full = np.flatnonzero(np.diff(edge))
    if len(full):
        at = edge[:-1][full]
        a = mix64(np.arange(1, PERMS + 1, dtype=U64) * U64(MULT)) | U64(1)
        b = mix64(np.arange(1, PERMS + 1, dtype=U64) * U64(MULT) + U64(77))
        for j in range(PERMS):
            v = ((vals * a[j] + b[j]) >> U64(32)).astype(np.uint32)
            out[full, j] = np.minimum.reduceat(v, at)
    return out


def _binary(a: np.ndarray) -> pa.Array:
    """A binary value for each row of a 2-d array."""
    a = np.ascontiguousarray(a)
    wide = a.shape[1] * a.itemsize
    offs = np.arange(len(a) + 1, dtype=np.int32) * wide
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offs), pa.py_buffer(a)])


def _signed(k: int, key: int):
    """doc_id, th, text -> doc_id, th, n_shingles, cls (digest of the set's words), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in slices(b.column("text")):
                vals, edge, digests = set_digests(buf, offs, k, key)
                cols = [b.column("doc_id").slice(i, j - i), b.column("th").slice(i, j - i), pa.array(np.diff(edge)), pa.array(digests, pa.binary()), _binary(_signatures(vals, edge))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n_shingles", "cls", "sig"])

    return run


def _classed(k: int, key: int):
    """text -> cls (digest of the set's words), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in slices(b.column("text")):
                digests = set_digests(buf, offs, k, key)[2]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), b.column("text").slice(i, j - i).cast(pa.string())], names=["cls", "text"])

    return run


def _hash_sets(texts: pa.Array, k: int, key: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    for _, _, buf, offs in slices(texts):
        vals, edge = shingle_sets(buf, offs, k, key)
        yield from (vals[x:y] for x, y in zip(edge, edge[1:], strict=False))


def word_shingles(text: str, k: int) -> set[tuple[bytes, ...]]:
    """The shingles of `shingle_sets` as words."""
    w = text.encode().lower().split()  # of bytes: A-Z alone, and runs of 0x20 and 0x09-0x0D
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def confirmed(a: str, b: str, k: int, percent: int) -> bool:
    """100 * intersection >= percent * union, of the shingles' words."""
    x, y = word_shingles(a, k), word_shingles(b, k)
    both = len(x & y)
    return bool(x) and bool(y) and 100 * both >= percent * (len(x) + len(y) - both)


def _sig_array(column: pa.Array) -> np.ndarray:
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint32)[offs[0] // 4 : offs[-1] // 4].reshape(len(column), PERMS)


def _keys(sig: np.ndarray) -> np.ndarray:
    """The bucket of each signature in each band."""
    s = sig.astype(U64).reshape(-1, BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=U64), s.shape[:2]).copy()
    for r in range(ROWS):
        h = mix64(h * U64(MULT) + s[:, :, r])
    return h.view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """nid, sig -> bucket, nid: one row a band."""
    for b in batches:
        if not b.num_rows:
            continue
        nid = np.repeat(b.column("nid").to_numpy(), BANDS)
        flat = _keys(_sig_array(b.column("sig"))).reshape(-1)
        for i in range(0, len(flat), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(flat[i : i + 100_000]), pa.array(nid[i : i + 100_000])], names=["bucket", "nid"])


def needed_matches(threshold: float, miss: float = MISS) -> list[int]:
    """After each batch of n minima: the fewest matches m with P(similarity >= threshold | m of n agree) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, PERMS + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                out.append(m)
                break
    return out


def _survive(left: np.ndarray, right: np.ndarray, need: list[int]) -> np.ndarray:
    """Indices of the signature pairs that no batch drops."""
    alive, got = np.arange(len(left)), np.zeros(len(left), np.int64)
    for i, m in enumerate(need):
        cut = slice(i * BATCH, (i + 1) * BATCH)
        got = got + (left[alive, cut] == right[alive, cut]).sum(1)
        keep = got >= m
        alive, got = alive[keep], got[keep]
    return alive


def _pruned(need: list[int]):
    """a, b, sig_a, sig_b -> a, b: pairs that the Bayesian bounds leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = pa.array(_survive(_sig_array(b.column("sig_a")), _sig_array(b.column("sig_b")), need))
                yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], names=["a", "b"])

    return run


def _verified(k: int, percent: int, key: int):
    """a, b, text_a, text_b -> a, b: pairs with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(_hash_sets(b.column("text_a"), k, key), _hash_sets(b.column("text_b"), k, key), strict=True)):
                # Sets of too different sizes can't reach the threshold.
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and _similar(x, y, percent) and confirmed(b.column("text_a")[i].as_py(), b.column("text_b")[i].as_py(), k, percent):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], names=["a", "b"])

    return run


BLOCK_KEY = ("bucket", "u", "v")


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list]]:
    """(key, columns) of each block, from rows sorted by (bucket, u, v): signatures as a matrix, texts as a list, the rest as numpy."""
    held: list = []
    last = None

    def made():
        return last, [sum((c for c in col), []) if isinstance(col[0], list) else np.concatenate(col) for col in zip(*held, strict=True)]

    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in BLOCK_KEY], 1)
        cols = [_sig_array(b.column(c)) if c == "sig" else b.column(c).to_pylist() if c == "text" else b.column(c).to_numpy() for c in columns]
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[s])
            if held and key != last:
                yield made()
                held = []
            last = key
            held.append([c[s:e] if isinstance(c, list) else c[s:e].copy() for c in cols])
    if held:
        yield made()


def _left_open(bucket: int, comp, side, sig, need: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of an outer member (side 0) and any member (side 1) of another component that the bounds leave. A pair counts in the first bucket that it shares."""
    keys = _keys(sig)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    step = max(1, 12_000 // max(1, len(right)))
    for i in range(0, len(left), step):
        some = left[i : i + step]
        x, y = np.repeat(some, len(right)), np.tile(right, len(some))
        ok = comp[x] != comp[y]
        x, y = x[ok], y[ok]
        at = _survive(sig[x], sig[y], need)
        x, y = x[at], y[at]
        ok = keys[x, (keys[x] == keys[y]).argmax(1)] == bucket
        if ok.any():
            yield x[ok], y[ok]


def _concerned(need: list[int]):
    """Blocks -> their rows that are in a pair which the bounds leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (nid, comp, side, sig) in _blocks(batches, ["nid", "comp", "side", "sig"]):
            hit = np.zeros(len(nid), bool)
            for x, y in _left_open(key[0], comp, side, sig, need):
                hit[x] = hit[y] = True
            if hit.any():
                n = int(hit.sum())
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, k), t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.array(nid[hit]), pa.array(comp[hit]), pa.array(side[hit], pa.int32())], names=[*BLOCK_KEY, "nid", "comp", "side"])

    return run


def _linked(need: list[int], k: int, percent: int, key: int):
    """Blocks with texts -> a, b: links between components, one of those that join the same two within a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (nid, comp, side, sig, texts) in _blocks(batches, ["nid", "comp", "side", "sig", "text"]):
            sets = list(_hash_sets(pa.array(texts, pa.large_string()), k, key))
            up: dict[int, int] = {}

            def root(c: int) -> int:
                while up.setdefault(c, c) != c:  # noqa: B023
                    up[c] = up[up[c]]  # noqa: B023
                    c = up[c]  # noqa: B023
                return c

            size, out = np.array([len(x) for x in sets]), []
            for x, y in _left_open(block[0], comp, side, sig, need):
                ok = 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
                for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                    a, b = root(int(comp[i])), root(int(comp[j]))
                    if a != b and _similar(sets[i], sets[j], percent) and confirmed(texts[i], texts[j], k, percent):
                        up[a] = b
                        out.append((int(nid[i]), int(nid[j])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes."""
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _texts_of(ids: DataFrame, docs: DataFrame, classes: DataFrame, k: int, key: int) -> DataFrame:
    """(nid, text) for the classes asked for (nid): the text of one document of each."""
    asked = classes.join(ids, "nid", "left_semi").select("nid", "cls", F.col("id").alias("w_id"))
    texts = docs.join(asked.select("w_id").distinct(), F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi").select("text")
    found = texts.mapInArrow(given_back(_classed(k, key)), "cls binary, text string").join(asked.select("nid", "cls"), "cls")
    return written(found.groupBy("nid").agg(F.min("text").alias("text")), "texts")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per document (doc_id, text): doc_id, n_shingles (distinct k-word shingles), component_id (smallest doc_id it reaches
    over links of similarity percent / 100 or more), kept (it is that document); besides th (xxhash64 of the text) and group
    (a number for each component in this result, null for an empty set).

    Words: A-Z lower-cased, runs of other than 0x20 and 0x09-0x0D. Fewer than k words: the whole sequence is the one
    shingle. No words or null text: an empty set, linked with nothing, kept. Repeated rows are members of one component
    and have the same result, whichever row it is. Rows without doc_id take part; their component_id is null, and they are
    kept, only where no member has an id. An empty table gives an empty table; further columns are ignored.
    """
    need = needed_matches(percent / 100)
    key = int.from_bytes(os.urandom(8), "little")
    docs = docs.select("doc_id", "text")
    signed = written(docs.withColumn("th", F.xxhash64("text")).mapInArrow(given_back(_signed(k, key)), "doc_id long, th long, n_shingles long, cls binary, sig binary"), "signed")
    # The signature is the same for all rows of a class. Numbered once written, so the numbers stay.
    own = signed.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"))
    classes = written(own.withColumn("nid", F.monotonically_increasing_id()), "classes")
    sig = classes.select("nid", "sig")

    banded = sig.select("nid", "sig").mapInArrow(given_back(_banded), "bucket long, nid long")
    shared = banded.groupBy("bucket").agg(F.min("nid").alias("low"), F.count("*").alias("n")).filter("n > 1")
    met = written(banded.join(shared, "bucket").select("bucket", "nid", "low"), "buckets")

    def with_sigs(pairs: DataFrame) -> DataFrame:
        a = sig.select(F.col("nid").alias("a"), F.col("sig").alias("sig_a"))
        b = sig.select(F.col("nid").alias("b"), F.col("sig").alias("sig_b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b")

    star = met.filter("nid <> low").select(F.col("low").alias("a"), F.col("nid").alias("b")).distinct()
    star = written(with_sigs(star).mapInArrow(given_back(_pruned(need)), "a long, b long"), "pairs")

    def confirmed_links(pairs: DataFrame) -> DataFrame:
        texts = _texts_of(pairs.select(F.col("a").alias("nid")).union(pairs.select("b")).distinct(), docs, classes, k, key)
        both = pairs.join(texts.select(F.col("nid").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("nid").alias("b"), F.col("text").alias("text_b")), "b")
        out = written(both.select("a", "b", "text_a", "text_b").mapInArrow(given_back(_verified(k, percent, key)), "a long, b long"), "links")
        forget(texts)
        return out

    # A class first meets the one of its buckets' smallest that most classes meet; texts of the other pairs travel only where that left the two apart.
    hubs = star.groupBy("a").agg(F.count("*").alias("n"))
    chosen = written(star.join(hubs, "a").groupBy("b").agg(F.min(F.struct((-F.col("n")).alias("n"), "a")).alias("m")).select(F.col("m.a").alias("a"), "b"), "chosen")
    links = confirmed_links(chosen)
    release(docs.sparkSession)
    first = written(components(links), "components")
    part = lambda c: first.select(F.col("id").alias(c), F.col("component").alias(f"{c}_c"))
    rest = star.join(chosen, ["a", "b"], "left_anti").join(part("a"), "a", "left").join(part("b"), "b", "left")
    rest = written(rest.filter(F.coalesce("a_c", "a") != F.coalesce("b_c", "b")).select("a", "b"), "pairs")
    if not rest.isEmpty():
        more = confirmed_links(rest)
        old, first = first, written(components(links.union(more)), "components")
        forget(more, old)
    forget(star, chosen, rest, links)
    release(docs.sparkSession)

    # Buckets that hold more than one component: every member outside the largest meets all members of others.
    tagged = met.join(first.select(F.col("id").alias("nid"), "component"), "nid", "left").select("bucket", "nid", F.coalesce("component", "nid").alias("comp"))
    parts = tagged.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n_all"), F.count("*").alias("n_comps")).filter("n_comps > 1")
    mixed = mixed.select("bucket", F.col("top.comp").alias("major"), F.ceil((F.col("n_all") - F.col("top.n")) / BLOCK).cast("int").alias("nu"), F.ceil(F.col("n_all") / BLOCK).cast("int").alias("nv"))
    left = written(tagged.join(mixed, "bucket"), "mixed")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = left.filter("comp <> major").select("bucket", F.pmod(F.xxhash64("nid"), "nu").cast("int").alias("u"), upto("nv").alias("v"), "nid", "comp", F.lit(0).alias("side"))
    inner = left.select("bucket", upto("nu").alias("u"), F.pmod(F.xxhash64("nid", F.lit(1)), "nv").cast("int").alias("v"), "nid", "comp", F.lit(1).alias("side"))
    blocks = outer.select("bucket", "u", "v", "nid", "comp", "side").union(inner.select("bucket", "u", "v", "nid", "comp", "side")).join(sig, "nid")
    dealt = lambda df: df.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)
    cols = [*BLOCK_KEY, "nid", "comp", "side"]
    # First the rows in question, by signatures; their texts then go to the blocks, and only links come out.
    open_ = written(dealt(blocks.select(*cols, "sig")).mapInArrow(given_back(_concerned(need)), "bucket long, u int, v int, nid long, comp long, side int"), "open")
    forget(left, met)
    release(docs.sparkSession)
    node = classes.select("nid", "cls", "id").join(first.select(F.col("id").alias("nid"), "component"), "nid", "left").select("cls", "id", F.coalesce("component", "nid").alias("comp"))
    found = None
    if not open_.isEmpty():
        texts = _texts_of(open_.select("nid").distinct(), docs, classes, k, key)
        full = open_.join(sig, "nid").join(texts, "nid").select(*cols, "sig", "text")
        found = written(dealt(full).mapInArrow(given_back(_linked(need, k, percent, key)), "a long, b long"), "links")
        forget(texts)
    if found is not None and not found.isEmpty():
        # Components of components: the second links join what the first left apart.
        lab = lambda c: first.select(F.col("id").alias(c), F.col("component").alias(f"{c}_c"))
        lifted = found.join(lab("a"), "a", "left").join(lab("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
        top = components(lifted).withColumnRenamed("id", "comp")
        node = node.join(top, "comp", "left").select("cls", "id", F.coalesce("component", "comp").alias("comp"))
    node = written(node, "nodes")
    forget(open_, first, classes, *([] if found is None else [found]))
    release(docs.sparkSession)
    low = node.groupBy("comp").agg(F.min("id").alias("component_id"))
    node = node.join(low, "comp").select("cls", "component_id", F.col("comp").alias("group"))
    out = signed.select("doc_id", "th", "n_shingles", "cls").join(node, "cls", "left")
    out = out.select("doc_id", "th", "n_shingles", "group", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` (doc_id, text and any others) with one document of each component: the smallest doc_id, then smallest text hash.

    Rows without an id come after those with one. Equal rows count as one document. Documents without words stay.
    """
    found = written(near_duplicates(docs, k, percent), "near")
    th, d_id, d_th = fresh(docs.columns, "th", "d_id", "d_th")
    best = found.filter("n_shingles > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("b"))
    keep = best.select(F.col("b.doc_id").alias(d_id), F.col("b.th").alias(d_th))
    keep = keep.union(found.filter("n_shingles = 0").select("doc_id", "th").distinct())
    rows = docs.withColumn(th, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(d_id)) & (F.col(th) == F.col(d_th))
    out = rows.join(keep, same, "left_semi")
    again = found.filter("n_shingles > 0").groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(d_id), F.col("th").alias(d_th))
    if not again.isEmpty():  # rows that repeat both: one of them stays
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["doc_id", th]))
    return out.select(*docs.columns)


def op6_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 2-word shingles."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = r"""
with recursive d as (
  select doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), ' +') as raw from documents
), w as (
  select doc_id, list_filter(raw, lambda x: x <> '') as w from d
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then list_distinct([w[1]])
    else list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) end as s from w
), c as (
  select s, min(doc_id) as id, len(s) as n from s where len(s) > 0 group by s
), e as (
  select id, n, unnest(s) as x from c
), p as (
  select a.id as a, b.id as b, count(*) as common, any_value(a.n) as an, any_value(b.n) as bn from e a join e b on a.x = b.x and a.id < b.id
    and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n group by 1, 2
), l as (
  select a, b from p where 100 * common >= 80 * (an + bn - common)
), u as (
  select a, b from l union all select b, a from l union all select id, id from c
), r as (
  select a as id, b as low from u union select r.id, u.b from r join u on u.a = r.low
), m as (
  select id, min(low) as component_id from r group by id
)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(m.component_id, s.doc_id) as component_id, s.doc_id = coalesce(m.component_id, s.doc_id) as kept
from s left join c on c.s = s.s left join m on m.id = c.id
"""
