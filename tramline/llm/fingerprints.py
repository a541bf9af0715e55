"""Document fingerprints: a digest of the quartiles of hashed byte triplets, and a bounded likeness of two digests.

Every window of five bytes gives the triplets of its first byte and two of the other four, in order; each is hashed, by
pattern and bytes, into one of BUCKETS counts. A count is encoded by how many of the text's own three quartiles it
exceeds (two bits), the length in bytes by its logarithm (eight steps a doubling). The digest is hex: two digits of
length, then the buckets' codes. Local edits move few counts across a quartile, so near texts have near digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.textops import given_back
from tramline.session import fresh, written

BUCKETS = 256
#: The other two bytes of a triplet, as distances from its first.
PATTERNS = [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
#: Bytes counted at once; a longer text is counted in pieces that overlap by a window less one byte.
PIECE = 1 << 19
OVERLAP = 4
#: Difference of two codes that are so many quartiles apart.
STEPS = np.array([0, 1, 2, 3])
#: Steps of length (eight a doubling) beyond which lengths are as different as can be, and what each adds.
LENGTH_SPAN, LENGTH_STEP = 24, 4


def _counts(texts: list[bytes]) -> np.ndarray:
    """Triplet counts by text and bucket."""
    out = np.zeros((len(texts), BUCKETS), np.int64)
    held: list[bytes] = []
    rows: list[int] = []

    def add() -> None:
        buf = np.frombuffer(b"".join(held), np.uint8).astype(np.uint32)
        size = np.array([len(p) for p in held])
        # Where each byte's triplets are counted; those that the next piece starts with, and the padding, in a place of their own.
        slot = np.repeat(np.arange(len(held)) * BUCKETS, size)
        for back in range(1, OVERLAP + 1):
            slot[np.cumsum(size) - back] = len(held) * BUCKETS
        n, seen = len(buf) - OVERLAP, np.zeros((len(held) + 1) * BUCKETS, np.int64)
        slot = slot[:n]
        for k, (i, j) in enumerate(PATTERNS):
            h = ((buf[j : n + j] << np.uint32(8) | buf[i : n + i]) << np.uint32(8) | buf[:n]) + np.uint32(k << 24)
            h *= np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            h >>= np.uint32(24)
            seen += np.bincount(slot + h, minlength=len(seen))
        np.add.at(out, rows, seen[: len(held) * BUCKETS].reshape(len(held), BUCKETS))
        held.clear()
        rows.clear()

    waiting = 0
    for row, text in enumerate(texts):
        # Four bytes after the end, of no text, let the last triplets of a text count as they are.
        padded = text + b"\0" * OVERLAP if text else b""
        for s in range(0, max(0, len(padded) - OVERLAP), PIECE):
            piece = padded[s : s + PIECE + OVERLAP]
            held.append(piece)
            rows.append(row)
            waiting += len(piece)
            if waiting >= PIECE:
                add()
                waiting = 0
    if held:
        add()
    return out


def codes(texts: list[bytes]) -> np.ndarray:
    """A row a text: the length's code, then each bucket's quartile (0 to 3)."""
    n = _counts(texts)
    if not len(texts):
        return np.zeros((0, BUCKETS + 1), np.uint8)
    q = np.sort(n, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    quartile = (n[:, :, None] > q[:, None, :]).sum(axis=2)
    size = np.array([len(t) for t in texts], np.float64)
    length = np.where(size > 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(size, 1)))), 0)
    return np.column_stack([length, quartile]).astype(np.uint8)


def as_hex(c: np.ndarray) -> list[str]:
    """Digests of rows of codes."""
    two = c[:, 1:].reshape(len(c), BUCKETS // 4, 4)
    packed = (two << np.array([6, 4, 2, 0], np.uint8)).sum(axis=2).astype(np.uint8)
    return [row.tobytes().hex() for row in np.column_stack([c[:, 0], packed])]


def from_hex(digests: list[str]) -> np.ndarray:
    """Rows of codes of digests."""
    raw = np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(len(digests), BUCKETS // 4 + 1)
    two = (raw[:, 1:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
    return np.column_stack([raw[:, :1], two.reshape(len(digests), BUCKETS)])


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 less the difference of the codes over the most that codes as large could differ: 1 for equal ones, 0 to 1 always."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    length = np.minimum(np.abs(a[:, 0] - b[:, 0]), LENGTH_SPAN) * LENGTH_STEP
    differ = STEPS[np.abs(a[:, 1:] - b[:, 1:])].sum(axis=1) + length
    return 1.0 - differ / (STEPS[np.maximum(a[:, 1:], b[:, 1:])].sum(axis=1) + LENGTH_SPAN * LENGTH_STEP)


def fingerprints(docs: DataFrame, column: str = "text", out: str = "fingerprint") -> DataFrame:
    """`docs` with the digest of each whole text (null: as empty) in `out`; each row by itself, other columns stay."""

    @F.pandas_udf("string")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(as_hex(codes([(t or "").encode() for t in part])), dtype=object)

    return docs.withColumn(out, digest(F.col(column)))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two digests, 0 to 1; null if one is null."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        both = (x.notna() & y.notna()).to_numpy()
        found = np.full(len(x), np.nan)
        if both.any():
            found[both] = alike(from_hex(list(x[both])), from_hex(list(y[both])))
        return pd.Series(found).astype(object).where(both, None)

    return score(a, b)


#: Characters of text that are worked on at once.
BATCH_CHARS = 2 << 20
FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
HELD = f"{FOUND}, part long, first boolean, last boolean, text string"


def spliced(text: str, after: str) -> str:
    """The text with its last quarter (characters, rounded down) replaced by the first as many of `after`, or all of it."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _compared(ids: list, texts: list[str], after: list[str], own: np.ndarray, following: np.ndarray) -> dict[str, list]:
    edited = [spliced(t, a).encode() for t, a in zip(texts, after)]
    c = codes(edited)
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
        "fingerprint": as_hex(own),
        "edited_fingerprint": as_hex(c),
        "near_edited": alike(own, c).tolist(),
        "near_next": alike(own, following).tolist(),
    }


def _schema(named: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in named.split(", "))])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted partition against the one after it; the last row waits for the next partition, the first one keeps its text for the one before."""
    schema = _schema(HELD)
    waits = None  # id, text, codes, part, is the partition's first row

    def rows() -> Iterator[tuple[list, list[str], int]]:
        for batch in batches:
            size = pc.utf8_length(batch["text"]).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                to = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), BATCH_CHARS, "right")))
                yield batch["doc_id"][at:to].to_pylist(), batch["text"][at:to].to_pylist(), batch["part"][0].as_py()
                at = to

    for ids, texts, part in rows():
        own = codes([t.encode() for t in texts])
        starts = waits is None
        if waits is not None:
            ids, texts, own = [waits[0], *ids], [waits[1], *texts], np.vstack([waits[2], own])
        n = len(ids) - 1
        first = [False] * n
        if n and (starts or waits[3]):
            first[0] = True
        if n:
            out = _compared(ids[:n], texts[:n], texts[1:], own[:n], own[1:])
            out |= {"part": [part] * n, "first": first, "last": [False] * n, "text": [t if f else None for t, f in zip(texts, first)]}
            yield pa.RecordBatch.from_pydict(out, schema)
        waits = (ids[n], texts[n], own[n:], (starts or waits[3]) and n == 0, part)
    if waits is not None:
        none = dict.fromkeys(("edited_sha256", "edited_fingerprint", "near_edited", "near_next"), [None])
        out = {"doc_id": [waits[0]], "n_chars": [len(waits[1])], "fingerprint": as_hex(waits[2]), **none, "part": [waits[4]], "first": [waits[3]], "last": [True], "text": [waits[1]]}
        yield pa.RecordBatch.from_pydict(out, schema)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last rows of partitions against the first rows of the next ones, row by row."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pydict()
            yield pa.RecordBatch.from_pydict(_compared(row["doc_id"], row["text"], row["next_text"], from_hex(row["fingerprint"]), from_hex(row["next_fingerprint"])), _schema(FOUND))


def against_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (see `spliced`, with the next document's text), and their likeness.

    Next is the next by ascending id (nulls first; equal ids by a hash of the text, then anyhow), after the last the first.
    Null texts are empty. Texts move once, into ranges of ids; each range is gone through in order, and only its first and
    last rows (as many as there are ranges) meet those of other ranges. Columns other than id and text are not carried.
    """
    order = ["doc_id", "tie", "row"]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    part = F.spark_partition_id().cast("long").alias("part")
    held = written(rows.select("doc_id", "text", part).mapInArrow(given_back(_in_order), HELD), "fingerprints")
    # One number a partition that has rows, which is all the driver gets.
    parts = sorted(r[0] for r in held.filter("last").select("part").collect())
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, next_part long")
    first = held.filter("first").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    last = held.filter("last").select("doc_id", "text", "fingerprint", "part").join(follows, "part").join(first, "next_part")
    return held.filter("not last").select(*[c.split()[0] for c in FOUND.split(", ")]).unionByName(last.drop("part", "next_part").mapInArrow(_across, FOUND))


def op12_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and how near that one and the next document's are."""
    return against_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
