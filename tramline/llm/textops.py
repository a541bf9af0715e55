"""Byte-level text operations over Arrow string columns, vectorised with numpy."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at once; arrays of 8 bytes a text byte stay small. A longer document is one slice.
SLICE = 1 << 19
MULT = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64

_powers: dict[str, np.ndarray] = {}


def give_back() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def given_back(run):
    """`run` (batches -> batches), after which the worker gives freed memory back to the system; workers outlive their tasks."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return outer


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_table() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return mix64((np.arange(256, dtype=U64) + U64(1)) * U64(MULT))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n + 1, SLICE + 1)
        for key, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            a = np.full(size, b, U64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def running(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of byte value times BASE**position; two of them give the hash of any range."""
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(byte_table()[buf] * up[: len(buf)], out=out[1:])
    return out


def range_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges, from `running`: equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(c))
    return mix64((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(U64) * U64(MULT))


#: The prime of `guard`, and its base.
P31, B31 = (1 << 31) - 1, 1_664_525_989


def _powers31(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B31**i and B31**-i modulo P31 for i up to n."""
    if "up31" not in _powers or len(_powers["up31"]) <= n:
        size = max(n + 1, SLICE + 1)
        for key, b in (("up31", B31), ("down31", pow(B31, -1, P31))):
            a = np.ones(size, U64)
            k = 1
            while k < size:
                a[k : 2 * k] = a[: min(k, size - k)] * U64(pow(b, k, P31)) % U64(P31)
                k *= 2
            _powers[key] = a
    return _powers["up31"], _powers["down31"]


def guard(buf: np.ndarray):
    """Hashes of ranges (starts, ends) of `buf` modulo a prime: beside `range_hash` for what a power of two can't tell apart."""
    up, down = _powers31(len(buf) + 1)
    c = np.zeros(len(buf) + 1, U64)
    np.cumsum((byte_table() >> U64(34))[buf] * up[: len(buf)] % U64(P31), out=c[1:])
    return lambda starts, ends: (c[ends] - c[starts]) % U64(P31) * down[starts] % U64(P31)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hashes of the words (ranges of bytes): a state from the key and the length takes in eight bytes at a time and is mixed after each.

    Not linear in anything, so no sums of bytes or places can be solved for; words that collide can't be built beforehand
    for a key that is drawn at the time.
    """
    size = ends - starts
    h = mix64(size.astype(U64) * U64(MULT) + U64(key & 0xFFFFFFFFFFFFFFFF))
    if not len(starts):
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    at, left = starts.copy(), size.copy()
    going = np.arange(len(starts))
    while len(going):
        part = blocks[at]
        short = left < 8
        part[short] &= (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
        h[going] = mix64((h[going] ^ part) * U64(MULT) + U64(BASE))
        on = left > 8
        going, at, left = going[on], at[on] + 8, left[on] - 8
    return h


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with up to `limit` bytes, or one longer row. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def _separators() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t[buf]


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of bytes other than 0x20 and 0x09-0x0D; a word doesn't cross rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    w = ~_separators()[buf]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    before, after = np.empty_like(w), np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    after[-1], after[:-1] = False, w[1:]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def _shingled(buf: np.ndarray, offs: np.ndarray, k: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, edges, first word, words, starts, ends): each row's distinct shingles by their hash, with the words that the first of each is made of. `buf` has A-Z in lower case."""
    n = len(offs) - 1
    starts, ends, row = words(buf, offs)
    h = word_hashes(buf, starts, ends, key)
    count = np.bincount(row, minlength=n)
    vals, rows, first, many = [], [], [], []
    for m in range(1, k + 1):  # m words make a shingle: k, or fewer where the row has no more
        if len(h) < m:
            break
        ok = row[m - 1 :] == row[: len(row) - m + 1]
        if m < k:
            ok &= count[row[: len(row) - m + 1]] == m
        at = np.flatnonzero(ok)
        s = np.full(len(at), m, U64)
        for j in range(m):
            s = mix64(s * U64(MULT) + h[at + j])
        vals.append(s)
        rows.append(row[at])
        first.append(at)
        many.append(np.full(len(at), m))
    if not vals:
        return np.zeros(0, U64), np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), starts, ends
    v, r, f, c = (np.concatenate(x) for x in (vals, rows, first, many))
    o = np.argsort(r, kind="stable") if len(vals) > 1 else np.arange(len(r))
    edge = np.searchsorted(r[o], np.arange(n + 1))
    for i in np.flatnonzero(np.diff(edge) > 1).tolist():
        own = o[edge[i] : edge[i + 1]]
        o[edge[i] : edge[i + 1]] = own[np.argsort(v[own])]
    v, r, f, c = v[o], r[o], f[o], c[o]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[new], np.searchsorted(r[new], np.arange(n + 1)), f[new], c[new], starts, ends


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each row as sorted 64-bit hashes, one row after the other, and where each row's begin.

    A row with 1 to k - 1 words has its whole sequence as its one shingle; a row without words has none. A-Z are lower-cased.
    """
    return _shingled(lower_ascii(buf), offs, k, key)[:2]


#: Bytes of shingles' words that are laid out at once.
LAID_OUT = 1 << 20


def set_digests(buf: np.ndarray, offs: np.ndarray, k: int, key: int = 0) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """What `shingle_sets` gives, and for each row the SHA-256 of its distinct shingles' words, in the order of their hashes: rows of equal digest have equal sets, word by word."""
    buf = lower_ascii(buf)
    vals, edge, first, many, starts, ends = _shingled(buf, offs, k, key)
    made = [hashlib.sha256() for _ in range(len(edge) - 1)]
    # Every word of every shingle, and the byte after it: a space, or a line feed after a shingle's last.
    total = np.concatenate([[0], np.cumsum(many)])
    size = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts + 1, out=size[1:])
    upto = np.concatenate([[0], np.cumsum(size[first + many] - size[first])]) if len(first) else np.zeros(1, np.int64)
    padded = np.append(buf, np.uint8(0))
    kind = np.int32 if len(buf) < 1 << 30 else np.int64
    begin, long = starts.astype(kind), (ends - starts + 1).astype(kind)
    s = 0
    while s < len(first):
        e = max(s + 1, int(np.searchsorted(upto, upto[s] + LAID_OUT, "right")) - 1)
        lead = np.repeat((first[s:e] - (total[s:e] - total[s])).astype(kind), many[s:e])
        word = lead + np.arange(len(lead), dtype=kind)
        stop = np.cumsum(long[word], dtype=kind)  # where each word's last byte is, and one
        src = np.repeat(begin[word] - stop + long[word], long[word])
        src += np.arange(len(src), dtype=kind)
        out = padded[src]
        stop -= 1
        out[stop] = 0x20
        out[stop[total[s + 1 : e + 1] - total[s] - 1]] = 0x0A
        data = out.tobytes()
        for row in range(int(np.searchsorted(edge, s, "right")) - 1, int(np.searchsorted(edge, e, "left"))):
            a, b = max(int(edge[row]), s), min(int(edge[row + 1]), e)
            if a < b:
                made[row].update(data[upto[a] - upto[s] : upto[b] - upto[s]])
        s = e
    return vals, edge, [m.digest() if edge[i] < edge[i + 1] else b"" for i, m in enumerate(made)]
