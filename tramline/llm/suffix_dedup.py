"""Suffix-array dedup: longest-previous-factor arrays find every byte string of a given length that occurs before.

A suffix array over a whole corpus is one sorted object; here it is made in parts that lose no match. Every window of
`length` bytes has an anchor, the 64-byte gram of smallest hash in it (leftmost on ties), which depends on the window's
bytes alone: equal windows have equal anchors at equal places. Neighbouring windows with one anchor make a run, kept as a
row of hashes. Runs that are equal as a whole (128 bits of hash) decide each other at once and are counted with a partial
sum, whatever their number. Only runs that share an anchor and differ are compared byte by byte: one copy of each distinct
run is fetched, and suffix arrays with LPF arrays are built over them. Groups with many distinct runs are first split by
the bytes that all windows of a stretch of offsets share; those bytes then stand as a single symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.textops import MULT, U64, given_back, guard, mix64, powers, range_hash, running, slices
from tramline.session import forget, fresh, written

#: Bytes of an anchor.
GRAM = 64
#: Bits of a gram's key that hold its place; the others are of its hash. Fixed, so that grams have one order whatever is read with them, and
#: enough for the longest text of a row (2 GB).
PLACE = U64(31)
#: Groups of more distinct runs than this are split by offsets, in stretches of STRETCH.
MANY, STRETCH = 256, 32
#: Symbols of one suffix array, unless one group alone has more.
SYMBOLS = 400_000


def window_min(key: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each window of w keys."""
    n = len(key)
    pad = np.full(-(-n // w) * w, np.iinfo(U64).max, U64)
    pad[:n] = key
    rows = pad.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).reshape(-1)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def runs(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, start (in its row), windows, repeats, anchor place (from the start), anchor hash, run hash.

    Equal runs that follow each other without a gap (periodic text) are one entry with repeats.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(7))
    if len(buf) < length:
        return none
    up, down = powers(len(buf) + 1)
    c = running(buf)
    g = mix64((c[gram:] - c[:-gram]) * down[: len(c) - gram])
    low = window_min((g >> PLACE << PLACE) | np.arange(len(g), dtype=U64), length - gram + 1)
    anchor = (low & ((U64(1) << PLACE) - U64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.maximum(np.diff(offs) - length + 1, 0))
    counts = np.maximum(np.diff(offs) - length + 1, 0)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + offs[:-1][row]
    if not len(row):
        return none
    a = anchor[start]
    new = np.ones(len(row), bool)
    new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(row)))
    s, a, row = start[at], a[at], row[at]
    ah = g[a]
    end = s + n - 1 + length
    sh = mix64(range_hash(c, s, end) + (a - s).astype(U64) * U64(MULT) + mix64(guard(buf)(s, end) + U64(1)))
    same = np.zeros(len(at), bool)
    same[1:] = (row[1:] == row[:-1]) & (ah[1:] == ah[:-1]) & (sh[1:] == sh[:-1]) & (n[1:] == n[:-1]) & (s[1:] == s[:-1] + n[:-1])
    first = np.flatnonzero(~same)
    reps = np.diff(np.append(first, len(at)))
    return row[first], s[first] - offs[:-1][row[first]], n[first], reps, (a - s)[first], ah[first].view(np.int64), sh[first].view(np.int64)


RUNS = "doc_id long, th long, start int, n int, reps int, place int, ah long, sh long"


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, buf, offs in slices(b.column("text")):
                row, start, n, reps, place, ah, sh = runs(buf, offs, length, gram)
                at = pa.array(row + i)
                cols = [b.column("doc_id").take(at), b.column("th").take(at), *(pa.array(x.astype(np.int32)) for x in (start, n, reps, place)), pa.array(ah), pa.array(sh)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "start", "n", "reps", "place", "ah", "sh"])

    return run


def _parts(length: int, gram: int):
    """One copy of each distinct run -> parts: key, c, ah, sh, from window, symbols (bytes), place of the collapsed core, doc_id and start for the order."""
    width = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "c", "doc_id", "start", "ah", "sh", "first", "core", "bytes"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for b in batches:
            out: list[tuple] = []
            cols = [b.column(x).to_pylist() for x in ("ah", "sh", "doc_id", "start", "n", "place", "segs", "bytes")]
            for ah, sh, doc, start, n, place, segs, data in zip(*cols, strict=True):
                step = width if segs <= MANY else STRETCH
                hi = place  # the offset of the first window; offsets fall from window to window
                lo = place - (n - 1)
                for chunk in range(lo // step, hi // step + 1):
                    o_lo, o_hi = chunk * step, min(chunk * step + step, width) - 1
                    oa, ob = max(lo, o_lo), min(hi, o_hi)
                    core_at, core_end = place - o_lo, place - o_hi + length
                    left, right = data[place - ob : core_at], data[core_end : place - oa + length]
                    key = hash_bytes(data[core_at:core_end], (ah & 0xFFFFFFFFFFFFFFFF) + chunk)
                    out.append((key, o_hi - o_lo + 1, doc, start, ah, sh, place - ob, len(left), left + right))
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 20_000], strict=True), types, strict=True)], names=names)

    return run


def hash_bytes(data: bytes, salt: int) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=(salt & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")).digest(), "little", signed=True)


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in order of their first `depth` symbols (ties in any order, which no shared length depends on), and ranks by the first 1, 2, 4, ... symbols."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    levels, h = [(1, rank.astype(np.int32))], 1

    def pair(first: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        nxt = np.zeros(n, np.int64)
        nxt[: n - shift] = rank[shift:] + 1
        key = first * (n + 1) + nxt
        order = np.argsort(key)
        k = key[order]
        r = np.empty(n, np.int64)
        r[order] = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)]))
        return order, r

    order = np.argsort(rank)
    while h * 2 <= depth:
        order, rank = pair(rank, min(h, n))
        h *= 2
        levels.append((h, rank.astype(np.int32)))
    if h < depth:
        order, rank = pair(rank, min(depth - h, n))
    return order, levels


def adjacent_lcp(order: np.ndarray, levels: list[tuple[int, np.ndarray]], depth: int) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in order, up to `depth`; from the ranks, largest first."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    got = np.zeros(max(n - 1, 0), np.int64)
    for h, rank in [levels[-1], *reversed(levels)]:
        ok = (a < n) & (b < n) & (got < depth)
        at = np.flatnonzero(ok)
        at = at[rank[a[at]] == rank[b[at]]]
        a[at] += h
        b[at] += h
        got[at] += h
    return np.concatenate([[0], np.minimum(got, depth)])


def _toward(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place in suffix order: what its suffix shares with the nearest earlier one in order that stands earlier in the text (0 if none).

    All places step at once along the pointers of the places they have reached, taking minima of shared lengths along.
    """
    n = len(order)
    ptr = np.arange(n) - 1
    low = lcp.copy()
    todo = np.flatnonzero(ptr >= 0)
    todo = todo[order[ptr[todo]] > order[todo]]
    while len(todo):
        p = ptr[todo]
        low_new = np.minimum(low[todo], low[p])
        ptr_new = ptr[p]
        low[todo], ptr[todo] = low_new, ptr_new
        todo = todo[(ptr_new >= 0) & (low_new > 0)]
        todo = todo[order[ptr[todo]] > order[todo]]
    low[ptr < 0] = 0
    return low


def longest_previous_factor(text: np.ndarray, depth: int, later: bool = False) -> np.ndarray:
    """At each position: the longest factor, up to `depth`, that also begins at an earlier position (or a later one, if so asked)."""
    earlier, after = longest_factors(text, depth)
    return after if later else earlier


def longest_factors(text: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """`longest_previous_factor` for earlier positions, then for later ones, from one suffix array."""
    n = len(text)
    if n == 0:
        yield from (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return
    order, levels = suffix_array(text, depth)
    lcp = adjacent_lcp(order, levels, depth)
    back = np.concatenate([[0], lcp[1:][::-1]])  # the same seen from the other end of the order
    for place in (order, n - 1 - order):
        out = np.zeros(n, np.int64)
        out[order] = np.maximum(_toward(place, lcp), _toward(place[::-1], back)[::-1])
        yield out


def _matched(keep_first: bool):
    """Parts sorted by (c, key, doc_id, start) -> ah, sh, from window, to window: windows found elsewhere."""

    def search(c: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        text, spot, mark, keys = [], [], 257, {}
        at = 0
        for key, _, _, _, _, _, _, core, data in rows:
            sym = keys.setdefault(key, len(keys))
            d = np.frombuffer(data, np.uint8).astype(np.int64)
            # A core symbol for each key, and a different end after each part, so nothing matches across.
            text += [d[:core], np.array([300 + 2 * sym]), d[core:], np.array([301 + 2 * mark])]
            spot.append((at, len(data) + 1))
            at += len(data) + 2
            mark += 1
        whole = np.concatenate(text)
        factors = longest_factors(whole, c)
        dup = next(factors) >= c
        if not keep_first:
            dup |= next(factors) >= c
        out = []
        for (_, _, _, _, ah, sh, first, _, _), (s, n) in zip(rows, spot, strict=True):
            w = np.concatenate([[False], dup[s : s + n - c + 1], [False]])
            for x, y in np.flatnonzero(w[1:] != w[:-1]).reshape(-1, 2):
                out.append((ah, sh, first + int(x), first + int(y)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["ah", "sh", "w_from", "w_to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []  # whole groups, for the next suffix array
        group: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(x).to_pylist() for x in ("key", "c", "doc_id", "start", "ah", "sh", "first", "core", "bytes")), strict=True):
                if group and (r[0], r[1]) != (group[0][0], group[0][1]):
                    if len(group) > 1:  # a part without a partner has no match
                        if ready and ready[0][1] != group[0][1]:
                            yield from search(ready[0][1], ready)
                            ready, size = [], 0
                        ready += group
                        size += sum(len(x[8]) + 2 for x in group)
                        if size > SYMBOLS:
                            yield from search(ready[0][1], ready)
                            ready, size = [], 0
                    group = []
                group.append(r)
        if len(group) > 1:
            if ready and ready[0][1] != group[0][1]:
                yield from search(ready[0][1], ready)
                ready = []
            ready += group
        if ready:
            yield from search(ready[0][1], ready)

    return run


def _cut(length: int, name: str):
    """Adds spans (maximal runs of removed bytes) and kept (the other bytes) from the windows' ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans, kept, shown = [], [], []
            for text, ranges in zip(b.column("text"), b.column(name).to_pylist(), strict=True):
                data = b"" if not text.is_valid else bytes(text.as_buffer())
                merged: list[list[int]] = []
                for s, e in sorted((r["s"], r["e"] - 1 + length) for r in ranges or []):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                at, rest = 0, []
                for s, e in merged:
                    rest.append(data[at:s])
                    at = e
                spans.append([{"start": s, "end": e} for s, e in merged])
                kept.append(b"".join(rest) + data[at:])
                shown.append(kept[-1].decode("utf-8", "ignore") if merged else None)
            keep = [i for i, n in enumerate(b.schema.names) if n != name]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(shown, pa.string())], names=[*(b.schema.names[i] for i in keep), "spans", "kept", "kept_text"])

    return run


def repeated_spans(docs: DataFrame, length: int = 400, keep_first: bool = False) -> DataFrame:
    """The columns of `docs` (doc_id, text and any others), spans (array of start, end: bytes to remove, maximal runs), kept (the bytes left) and
    kept_text (those as text, without characters that a cut splits; null if nothing goes).

    A byte goes if a `length`-byte string that covers it also starts at another place of any document's UTF-8 bytes
    (keep_first: at an earlier place, by doc_id, then place; so one copy stays). Matches don't cross documents; strings are
    judged on the input. Null and short texts (under `length` bytes) lose nothing; null text leaves empty bytes. Rows that
    repeat a text are copies of each other; rows that repeat doc_id and text get the same result (keep_first: they count as
    one document). A null doc_id comes first. Older columns named spans, kept or kept_text are replaced. An empty table gives an empty table.
    """
    gram = min(GRAM, max(4, length // 4))
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("spans", "kept", "kept_text")])
    keyed = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    found = written(keyed.filter(F.octet_length("text") >= length).select("doc_id", "th", "text").mapInArrow(given_back(_runs(length, gram)), RUNS), "runs")

    seg = found.groupBy("ah", "sh").agg(F.sum("reps").alias("c"))
    group = seg.groupBy("ah").agg(F.count("*").alias("segs"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("single"), F.sum("c").alias("all"))
    group = group.filter("all > 1")
    # Compared byte by byte: groups with differing runs, of which one at least is still open.
    group = group.withColumn("open", (F.col("segs") > 1) & (F.lit(keep_first) | (F.col("single") > 0)))
    met = seg.join(group.select("ah", "segs", "open"), "ah").filter("c > 1 or open")
    hit = written(found.join(met, ["ah", "sh"]), "hits")
    forget(found)

    low = F.min(F.struct("doc_id", "th", "start")).alias("low")
    one = hit.groupBy("ah", "sh").agg(low, F.max("n").alias("n"), F.max("place").alias("place"), F.max("segs").alias("segs"), F.max("open").alias("open"))
    one = written(one.select("ah", "sh", "low.doc_id", "low.th", "low.start", "n", "place", "segs", "open"), "distinct")
    ask = one.filter("open").select("ah", "sh", F.col("doc_id").alias("o_id"), F.col("th").alias("o_th"), "start", "n", "place", "segs")
    bytes_of = F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("n") - 1 + length)
    texts = ask.join(keyed.filter(F.octet_length("text") >= length), F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("th") == F.col("o_th")))
    texts = texts.select("ah", "sh", "doc_id", "start", "n", "place", "segs", bytes_of.alias("bytes"))
    parts = texts.mapInArrow(given_back(_parts(length, gram)), "key long, c int, doc_id long, start int, ah long, sh long, first int, core int, bytes binary")
    parts = parts.repartition("c", "key").sortWithinPartitions("c", "key", F.asc_nulls_first("doc_id"), "start", "ah", "sh")
    windows = parts.mapInArrow(given_back(_matched(keep_first)), "ah long, sh long, w_from int, w_to int")
    windows = windows.groupBy("ah", "sh").agg(F.collect_set(F.struct("w_from", "w_to")).alias("w"))

    kept, hit = hit, hit.join(windows, ["ah", "sh"], "left")
    some = F.transform(F.coalesce("w", F.array().cast("array<struct<w_from:int,w_to:int>>")), lambda r: F.struct((F.col("start") + r["w_from"]).alias("s"), (F.col("start") + r["w_to"]).alias("e")))
    end = F.col("start") + F.col("n") * F.col("reps")
    whole = F.array(F.struct(F.col("start").alias("s"), end.alias("e")))
    if keep_first:
        own = one.select("ah", "sh", F.col("doc_id").alias("f_id"), F.col("th").alias("f_th"), F.col("start").alias("f_start"))
        hit = hit.join(own, ["ah", "sh"])
        first = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")) & (F.col("start") == F.col("f_start"))
        again = F.when(F.col("reps") > 1, F.array(F.struct((F.col("start") + F.col("n")).alias("s"), end.alias("e")))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
        ranges = F.when(first, F.concat(some, again)).otherwise(whole)
    else:
        ranges = F.when(F.col("c") > 1, whole).otherwise(some)
    ranges = hit.select("doc_id", "th", F.explode(ranges).alias("r")).groupBy("doc_id", "th").agg(F.collect_set("r").alias("ranges"))
    ranges = written(ranges, "ranges")
    forget(kept, one)
    th, r_id, r_th, name = fresh(docs.columns, "th", "r_id", "r_th", "ranges")
    ranges = ranges.select(F.col("doc_id").alias(r_id), F.col("th").alias(r_th), F.col("ranges").alias(name))
    out = docs.withColumn(th, F.xxhash64("text")).join(ranges, F.col("doc_id").eqNullSafe(F.col(r_id)) & (F.col(th) == F.col(r_th)), "left").drop(r_id, r_th, th)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return out.mapInArrow(given_back(_cut(length, name)), T.StructType([*docs.schema.fields, T.StructField("spans", span), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())]))


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """`docs` with later copies of repeated byte strings taken out of text, and n_chars counted anew. The first copy stays.

    A character that a cut splits is dropped. No row is dropped; null text stays null.
    """
    out = repeated_spans(docs, length, keep_first=True)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.col("kept_text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What each document loses to 400-byte strings that also start elsewhere; text: what is left of it."""
    out = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.when(F.size("spans") == 0, F.col("text")).otherwise(F.col("kept_text")).alias("text"),
    )


def _ranked(length: int) -> str:
    """CTEs that number the windows of `length` bytes by content: ranks of 1, 2, 4, ... bytes, then of two that overlap."""
    # A rank of n bytes joins two of h <= n bytes, at distance n - h.
    out, last, h = [], "r0", 1
    while h < length:
        n = min(2 * h, length)
        name = f"r{len(out) + 1}"
        out.append(
            f"{name} as (select doc_id, i, dense_rank() over (order by a, b) as r from (select doc_id, i, r as a, lead(r, {n - h}) over (partition by doc_id order by i) as b from {last}) where b is not null)"
        )
        last, h = name, n
    return ",\n".join(out) + f",\nranked as (select * from {last})"


OP8_LENGTH = 400
OP8_SQL = f"""
with d as (
  select doc_id, text, encode(coalesce(text, '')) as data from documents
), h as (
  select doc_id, hex(data) as h, octet_length(data) as n from d
), p as (
  select doc_id, unnest(string_split_regex(regexp_replace(h, '(..)', '\\1,', 'g'), ',')) as x, generate_subscripts(string_split_regex(regexp_replace(h, '(..)', '\\1,', 'g'), ','), 1) - 1 as i from h
), r0 as (
  select doc_id, i, dense_rank() over (order by x) as r from p where x <> ''
),
{_ranked(OP8_LENGTH)}, t as (
  select r from ranked group by r having count(*) > 1
), w as (
  select ranked.doc_id, ranked.i from ranked semi join t on ranked.r = t.r
), g as (
  select doc_id, i, case when i <= coalesce(lag(i) over (partition by doc_id order by i), -{OP8_LENGTH} - 1) + {OP8_LENGTH} then 0 else 1 end as first from w
), k as (
  select doc_id, i, sum(first) over (partition by doc_id order by i) as k from g
), z as (
  select doc_id, k, min(i) as s, max(i) + {OP8_LENGTH} as e from k group by doc_id, k
), c as (
  select doc_id, s, e, lag(e, 1, 0) over (partition by doc_id order by s) as f from z
), o as (
  select doc_id, sum(e - s) as n_removed, count(*) as n_spans, max(e) as last, string_agg(substring(h, cast(2 * f + 1 as bigint), cast(2 * (s - f) as bigint)), '' order by s) as a from c join h using (doc_id) group by doc_id
), q as (
  select h.doc_id, n, h, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, coalesce(a, '') || substring(h, cast(2 * coalesce(last, 0) + 1 as bigint)) as rest from h left join o using (doc_id)
)
select q.doc_id, cast(n as bigint) as n_bytes, cast(n_removed as bigint) as n_removed, cast(n_spans as bigint) as n_spans, sha256(unhex(rest)) as kept_sha256,
  case when n_spans = 0 then text else try(decode(unhex(rest))) end as text from q join d using (doc_id) -- SQL gives null, the query drops the bytes, where a cut splits a character
"""
