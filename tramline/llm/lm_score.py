"""Stupid-backoff scores, computed relationally from n-gram count tables.

Documents are dealt into batches, and their texts are cut into words and hashed there, once: a batch keeps the hashes of its
distinct words and the number of each word in turn. A batch's n-grams of every order explode into rows (gram, who, n), one
for each 64-bit hash with its count in the batch, so that a frequent n-gram is a row a batch; `who` is the batch and the
n-gram's place in the batch's sorted lists. Dealt by hash, a window over each n-gram sums up its count and hands it back to
its rows in the same pass: each batch learns what the other batches hold of its n-grams, and n-grams of one batch alone,
which no other can tell it about, drop out. Each document's words are then scored from the counts and summed. Counts are
those of the whole corpus less the document's own, so a document does not vouch for itself.

The n-gram space is worked off in WAVES ranges of hashes, one after the other: the rows of one are in shuffles at a time.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.llm.textops import MULT, SLICE, U64, give_back, given_back, lower_ascii, mix64, slices, word_hashes, words
from tramline.session import Table, forget, release, written

#: Bytes of text in a batch, about, and parts of the n-gram space.
BATCH_BYTES, WAVES = 3 << 20, 6
ORDER, ALPHA = 3, 0.4
#: Rows of the join that are put in order at once.
TOLD_ROWS = 1 << 18
#: Words that are hashed at once, so that arrays stay in the processor's cache.
BLOCK = 1 << 14


def packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return np.int64(len(x)).tobytes() + (pa.compress(planes, codec="zstd", asbytes=True) if len(x) else b"")


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, size = int(np.frombuffer(data, np.int64, 1)[0]), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(memoryview(data)[8:], decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(-1)


def cut(table: pa.Table, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all rows' texts in turn, words of each row)."""
    hashes, sizes = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for chunk in table.column("text").chunks:
        for i, j, buf, offs in slices(chunk, SLICE):
            low = lower_ascii(buf)
            s, e, r = words(low, offs)
            hashes.append(word_hashes(low, s, e, key))
            sizes.append(np.bincount(r, minlength=j - i))
    return np.concatenate(hashes), np.concatenate(sizes)


def grams(h: np.ndarray, row: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For m = 1 to order, from the words' hashes and rows: the hash of the m words that end at each, 0 where the row has
    fewer before it; others are 2 at least, as 1 stands for the empty gram."""
    chain = np.zeros(len(h), U64)
    for m in range(1, order + 1):
        out = np.zeros(len(h), U64)
        for s in reversed(range(m - 1, len(h), BLOCK)):  # in place: a block needs the one before it as it was
            e = min(s + BLOCK, len(h))
            x = mix64(h[s:e] + U64(MULT)) if m == 1 else mix64((chain[s - 1 : e - 1] * U64(MULT) + h[s:e]) ^ U64(m)) * (row[s:e] == row[s - m + 1 : e - m + 1])
            chain[s:e], out[s:e] = x, x | (x != 0).astype(U64) << U64(1)
        yield out
        del out


def in_order(x: np.ndarray) -> np.ndarray:
    """The places of sorted hashes, equal ones as they stand. Leading bits are sorted together with the places; where those bits don't tell hashes apart, all are."""
    low = U64((1 << max(1, len(x).bit_length())) - 1)
    o = (np.sort((x & ~low) | np.arange(len(x), dtype=U64)) & low).astype(np.int64)
    s = x[o]
    return o if (s[1:] >= s[:-1]).all() else np.argsort(x, kind="stable")


def wave_ranges(waves: int) -> list[tuple[np.uint64, np.uint64]]:
    """The first and the last hash of each wave; 0 and 1 are in none."""
    ends = [((w + 1) << 64) // waves - 1 for w in range(waves)]
    return [(U64(a + 1), U64(b)) for a, b in zip([1, *ends], ends, strict=False)]


def pack_hashes(u: np.ndarray) -> bytes:
    """Sorted hashes, or places, as differences."""
    return pack_counts(np.diff(u, prepend=U64(0)))


def unpack_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_counts(data).view(U64))


def pack_counts(n: np.ndarray) -> bytes:
    """In as few bytes each as the largest needs, compressed."""
    x = n.astype(np.min_scalar_type(int(n.max(initial=0))))
    return bytes([x.itemsize]) + packed(x)


def unpack_counts(data: bytes) -> np.ndarray:
    data = memoryview(data)
    return unpacked(data[1:], f"u{data[0]}").astype(np.int64)


def _bundled(key: int):
    """A batch's documents -> batch, docs (an Arrow stream of doc_id, n_words), vocabulary (hashes, frequent words first), words (the number of each in it)."""

    def run(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h, size = cut(table, key)
        o = in_order(h)
        s = h[o]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        u, n = s[new], np.diff(np.append(np.flatnonzero(new), len(s)))
        number = np.empty(len(s), np.int64)
        number[o] = np.cumsum(new) - 1
        del h, o, s, new
        by = np.argsort(-n, kind="stable")
        rank = np.empty(len(u), np.uint32)
        rank[by] = np.arange(len(u), dtype=np.uint32)
        docs = pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(size)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(docs)
        row = [group[0].as_py(), sink.getvalue().to_pybytes(), u[by].tobytes(), packed(rank[number])]
        del u, number, n, by, rank, table
        give_back()
        return pa.table({k: pa.array([v], kind) for k, v, kind in zip(("batch", "docs", "vocabulary", "words"), row, (pa.int64(), *[pa.binary()] * 3), strict=True)})

    return run


def _unbundled(docs: pa.Scalar, vocabulary: pa.Scalar, numbers: pa.Scalar) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(doc_id and n_words, the words' hashes, the row of each)."""
    table = pa.ipc.open_stream(docs.as_buffer()).read_all()
    h = np.frombuffer(vocabulary.as_buffer(), U64)[unpacked(numbers.as_buffer(), np.uint32)]
    return table, h, np.repeat(np.arange(table.num_rows, dtype=np.int32), table.column("n_words").to_numpy())


def _exploded(order: int, wave: int, waves: int):
    """batch, docs, vocabulary, words -> gram, who, n: the batch's distinct n-grams of the wave, the empty one first, then order by order."""
    first, last = wave_ranges(waves)[wave]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(u: np.ndarray, n: np.ndarray, at: int) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(u), 100_000):
                own = u[i : i + 100_000]
                who = (number << 32) + np.arange(at + i, at + i + len(own))
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(who), pa.array(n[i : i + 100_000])], names=["gram", "who", "n"])

        for b in batches:
            for number, *bundle in zip(b.column("batch").to_pylist(), b.column("docs"), b.column("vocabulary"), b.column("words"), strict=True):
                _, h, row = _unbundled(*bundle)
                if wave == 0 and len(h):  # the empty gram occurs once a word
                    yield from made(np.ones(1, U64), np.array([len(h)]), 0)
                at = int(wave == 0)
                for own in grams(h, row, order):
                    u, n = np.unique(own[own - first <= last - first], return_counts=True)
                    yield from made(u, n, at)
                    at += len(u)

    return run


def _told(wave: int):
    """Rows (who, others) -> batch, wave, places, others: a row for each batch among every TOLD_ROWS rows."""

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        who, n = t.column("who").to_numpy(), t.column("others").to_numpy()
        o = np.argsort(who)
        who, n = who[o], n[o]
        number, at = who >> 32, (who & 0xFFFFFFFF).astype(U64)
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        runs = list(zip(cuts, cuts[1:], strict=False))
        return pa.RecordBatch.from_arrays([pa.array(number[cuts[:-1]]), pa.array([wave] * len(runs), pa.int32()), pa.array([pack_hashes(at[s:e]) for s, e in runs], pa.binary()), pa.array([pack_counts(n[s:e]) for s, e in runs], pa.binary())], names=["batch", "wave", "places", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= TOLD_ROWS:
                yield made(held)
                held, rows = [], 0
        if held:
            yield made(held)

    return run


def _learned(parts: list[tuple[pa.Scalar, pa.Scalar]]) -> tuple[np.ndarray, np.ndarray]:
    """(places in order, what others hold there) of a wave's parts, which come in any order."""
    at = np.concatenate([np.zeros(0, np.uint32), *(unpack_hashes(x.as_buffer()).astype(np.uint32) for x, _ in parts)])
    n = np.concatenate([np.zeros(0, np.int64), *(unpack_counts(x.as_buffer()) for _, x in parts)])
    o = np.argsort(at)
    return at[o], n[o]


def _scored(order: int, alpha: float, waves: int):
    """A batch's words and what others hold of its n-grams -> doc_id, n_words, log10. Arrays of all words are few; the rest is made wave by wave."""
    ranges = wave_ranges(waves)

    def scores(bundle: pa.Table, told: pa.Table) -> pa.Table:
        docs, h, row = _unbundled(*[bundle.column(c)[0] for c in ("docs", "vocabulary", "words")])
        size = docs.column("n_words").to_numpy()
        parts: list[list[tuple[pa.Scalar, pa.Scalar]]] = [[] for _ in range(waves)]
        for w, *own in zip(told.column("wave").to_pylist(), told.column("places"), told.column("others"), strict=True):
            parts[w].append(own)
        others = [_learned(own) for own in parts]
        # The empty gram, in place 0 of the first wave, counts the words of all documents.
        places, known = others[0]
        every = len(h) + (int(known[0]) if len(places) and places[0] == 0 else 0)
        begin = [int(w == 0) for w in range(waves)]
        value, before, each = np.zeros(len(h)), np.zeros(0, np.int64), grams(h, row, order)
        for m in range(1, order + 1):
            gram, count = next(each), np.zeros(len(h), np.int64)
            for w, (first, last) in enumerate(ranges):
                # In the order of their hashes, each document's in a run: where a gram begins, and a document's share of it.
                at = np.flatnonzero(gram - first <= last - first)
                at = at[in_order(gram[at])]
                g, r = gram[at], row[at]
                new = np.ones(len(at), bool)
                new[1:] = g[1:] != g[:-1]
                many = np.diff(np.append(np.flatnonzero(new), len(at)))
                new[1:] |= r[1:] != r[:-1]
                share = np.diff(np.append(np.flatnonzero(new), len(at)))
                total, (places, known) = many.copy(), others[w]
                i, j = np.searchsorted(places, [begin[w], begin[w] + len(total)])
                total[places[i:j] - begin[w]] += known[i:j]
                begin[w] += len(total)
                n = np.repeat(total, many) - np.repeat(share, share)
                count[at] = n
                held = n > 0
                some, none = at[held], at[~held]
                if m == 1:
                    value[some] = np.log10(n[held] / (every - size[r[held]]))
                    value[none] = np.log10(alpha / (every - size[r[~held]] + 1))
                else:
                    value[some] = np.log10(n[held] / before[some - 1])
                    value[none] += np.log10(alpha)
            before = count
            del gram, count  # before the next order's are made
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(size), "log10": pa.array(np.bincount(row, value, docs.num_rows))})

    def run(_: tuple[pa.Scalar, ...], bundle: pa.Table, told: pa.Table) -> pa.Table:
        out = scores(bundle, told)
        give_back()  # when all arrays of the batch are gone
        return out

    return run


def counted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows dealt by gram, the count table: gram, total, batches) of rows (gram, who, n)."""
    dealt = rows.repartition("gram")
    return dealt, dealt.groupBy("gram").agg(F.sum("n").alias("total"), F.count("who").alias("batches"))


def shared(rows: DataFrame) -> DataFrame:
    """who, others of rows (gram, who, n) whose gram other rows hold too: the gram's total in the count table less the row's own."""
    total = F.sum("n").over(Window.partitionBy("gram"))
    return rows.withColumn("total", total).filter("total > n").select("who", (F.col("total") - F.col("n")).alias("others"))


def _one_wave(held: DataFrame, told: Table, order: int, wave: int, waves: int) -> None:
    """What each batch learns of its n-grams in one part of the n-gram space."""
    rows = held.mapInArrow(given_back(_exploded(order, wave, waves)), "gram long, who long, n long")
    told.append(shared(rows).mapInArrow(given_back(_told(wave)), told.schema))


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, waves: int = WAVES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_words, log10 (sum of the words' log scores) and score (their mean; null without words).

    Words: A-Z lower-cased, runs of other than 0x20 and 0x09-0x0D. A word scores count(gram) / count(its first words) at
    the longest gram up to `order` that other documents hold, times alpha for each order given up; a word that they lack
    scores alpha / (their words + 1). Null text: no words. Every row is a document, repeated ones too, and other rows with
    the same text do count. An empty table gives an empty table; further columns are ignored.
    """
    spark, key = docs.sparkSession, int.from_bytes(os.urandom(8), "little")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # By place in the table, so that rows that repeat are dealt out like any others; written at once, so the deal stands.
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-size // batch_bytes) or 1)))
    held = written(dealt.groupBy("batch").applyInArrow(_bundled(key), "batch long, docs binary, vocabulary binary, words binary"), "batches")
    release(spark)
    told = Table(spark, "counts", "batch long, wave int, places binary, others binary")
    for wave in range(waves):
        _one_wave(held, told, order, wave, waves)
        release(spark)
    out = held.groupBy("batch").cogroup(told.read().groupBy("batch")).applyInArrow(_scored(order, alpha, waves), "doc_id long, n_words long, log10 double")
    out = written(out, "scores")
    forget(held)
    told.forget()
    return out.withColumn("score", F.when(F.col("n_words") > 0, F.col("log10") / F.col("n_words")))


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """The mean log score of every document's words under the trigrams of all other documents."""
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", F.round("score", 6).alias("score"))


OP4_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), t as (
  select doc_id, unnest(words) as w, generate_subscripts(words, 1) as i from d
), b as (
  select *, lag(w) over q as p, lag(w, 2) over q as o from t window q as (partition by doc_id order by i)
), u as (
  select w, count(*) as c from b group by w
), ud as (
  select doc_id, w, count(*) as c from b group by doc_id, w
), g as (
  select p, w, count(*) as c from b where p is not null group by p, w
), gd as (
  select doc_id, p, w, count(*) as c from b where p is not null group by doc_id, p, w
), h as (
  select o, p, w, count(*) as c from b where o is not null group by o, p, w
), hd as (
  select doc_id, o, p, w, count(*) as c from b where o is not null group by doc_id, o, p, w
), s as (
  select b.doc_id, (select count(*) from t) - len(d.words) as every, b.p is not null as has2, b.o is not null as has3,
    coalesce(h.c - hd.c, 0) as c3, before.c - befored.c as d3, coalesce(g.c - gd.c, 0) as c2, first.c - firstd.c as d2, u.c - ud.c as c1
  from b join d using (doc_id) join u on u.w = b.w join ud on ud.doc_id = b.doc_id and ud.w = b.w
  left join g on g.p = b.p and g.w = b.w left join gd on gd.doc_id = b.doc_id and gd.p = b.p and gd.w = b.w
  left join h on h.o = b.o and h.p = b.p and h.w = b.w left join hd on hd.doc_id = b.doc_id and hd.o = b.o and hd.p = b.p and hd.w = b.w
  left join g before on before.p = b.o and before.w = b.p left join gd befored on befored.doc_id = b.doc_id and befored.p = b.o and befored.w = b.p
  left join u first on first.w = b.p left join ud firstd on firstd.doc_id = b.doc_id and firstd.w = b.p
), v as (
  select doc_id, case when c3 > 0 then log10(c3 / d3) else (case when has3 then log10(0.4::double) else 0 end)
    + case when c2 > 0 then log10(c2 / d2) else (case when has2 then log10(0.4::double) else 0 end)
    + case when c1 > 0 then log10(c1 / every) else log10(0.4::double / (every + 1)) end end end as x from s
), a as (
  select doc_id, sum(x) / count(*) as m from v group by doc_id
)
select d.doc_id, cast(len(words) as bigint) as n_words, round(m, 6) as score from d left join a using (doc_id)
"""
