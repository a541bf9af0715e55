"""SentencePiece encoding and decoding by suffix-array matching.

A batch of texts is escaped as the model asks (spaces as U+2581, one in front), and cut where no piece of the vocabulary
spans two neighbouring characters; no merge crosses such a cut. The distinct stretches are concatenated and indexed by a
suffix array as deep as the longest piece. Every piece is found by binary search as a range of suffixes; the ranges give
edges (start, end, piece), which are sorted by their end within the stretch and relaxed in that order, all stretches
together: an edge is taken if its piece may follow the last piece of what ends where it starts. For a BPE model that is the
case if the two pieces, merged from scratch, come out as those two; then the chain of such pieces is the encoding that
merging gives, so the ids equal the ones of the model's own library. Characters that the vocabulary lacks become their
UTF-8 bytes' pieces.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.textops import MULT, U64, given_back, mix64, slices

SPACE = "▁"
#: Bytes of text in a batch. One longer document is a batch of its own.
BATCH_BYTES = 3 << 19
#: Slots of the table of piece pairs, each for the last pair that fell in it.
SLOTS = 1 << 20


def read_vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind: 0 ordinary, 1 byte, 2 other) by id."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: 1 if m.is_byte(i) else 2 if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else 0
    return [(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.vocab_size())]


class Encoder:
    """Encodes and decodes batches of texts with one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float, int]]):
        self.size = len(vocabulary)
        self.score = {p: s for p, s, k in vocabulary if k == 0}
        ids = {p: i for i, (p, _, k) in enumerate(vocabulary) if k == 0}
        alphabet = sorted({c for p in ids for c in p} | {SPACE})
        if len(alphabet) >= 0xFFFF:
            raise ValueError("an alphabet of over 65534 characters does not fit 16 bits")
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1, dtype=np.uint16)
        self.code[0x20] = self.code[ord(SPACE)]
        # Characters of pieces that are no piece by themselves: they stay single, and are written as bytes.
        self.text = {i: p for p, i in ids.items()} | {self.size + k: c for k, c in enumerate(c for c in alphabet if c not in ids)}
        self.bytes_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(vocabulary) if k == 1}
        self.unknown = next((i for i, (p, _, k) in enumerate(vocabulary) if p == "<unk>"), 0)
        self.depth = 4 * (1 << max(0, (-(-max(map(len, ids), default=1) // 4) - 1).bit_length()))
        # Only pieces that merging makes of their own text can occur.
        self.find = np.array(sorted(i for i, p in self.text.items() if self.merge(p) == [p]), np.int64)
        self.length = np.zeros(self.size + len(alphabet), np.int64)
        for i, p in self.text.items():
            self.length[i] = len(p)
        pad = np.zeros((len(self.find), self.depth), np.uint16)
        for row, i in enumerate(self.find.tolist()):
            pad[row, : len(self.text[i])] = self.code[[ord(c) for c in self.text[i]]]
        full = np.where(np.arange(self.depth)[None, :] < self.length[self.find][:, None], pad, np.uint16(0xFFFF))
        self.low, self.high = self.packed(pad), self.packed(full)
        # Pairs of neighbouring characters within pieces, in a table that may say yes too often, never no.
        self.inside = np.zeros(1 << 20, bool)
        for p in ids:
            for a, b in zip(p, p[1:], strict=False):
                self.inside[self.slot(int(self.code[ord(a)]), int(self.code[ord(b)]))] = True
        self.keys, self.fits = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        # For decoding: the bytes of each id.
        out = [bytes([int(p[3:5], 16)]) if k == 1 else p.replace(SPACE, " ").encode() if k == 0 else b"" for p, _, k in vocabulary]
        self.out_len = np.array([len(b) for b in out], np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out = np.frombuffer(b"".join(out), np.uint8)

    @staticmethod
    def slot(a, b):
        return (a * 40_503 + b * 9_973) & 0xFFFFF

    @staticmethod
    def packed(rows: np.ndarray) -> np.ndarray:
        """Rows of 16-bit codes as 64-bit words of four."""
        r = rows.astype(U64).reshape(len(rows), -1, 4)
        return (r[:, :, 0] << U64(48)) | (r[:, :, 1] << U64(32)) | (r[:, :, 2] << U64(16)) | r[:, :, 3]

    def merge(self, text: str) -> list[str]:
        """The pieces that merging makes of a short text: best score first, leftmost on ties."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces stays as it is when merged from scratch."""
        key = left * len(self.length) + right
        at = (mix64(key.astype(U64)) & U64(SLOTS - 1)).astype(np.int64)
        hit = self.keys[at] == key
        out = self.fits[at] & hit
        miss = np.flatnonzero(~hit)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            a, b = np.divmod(new, len(self.length))
            got = np.array([self.merge((x := self.text[i]) + (y := self.text[j])) == [x, y] for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
            out[miss] = got[back]
            self.keys[at[miss]], self.fits[at[miss]] = key[miss], got[back]
        return out

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece in the codes, by suffix array and binary search."""
        n = len(text)
        pad = np.zeros(n + self.depth + 4, U64)
        pad[:n] = text
        word = (pad[:-3] << U64(48)) | (pad[1:-2] << U64(32)) | (pad[2:-1] << U64(16)) | pad[3:]
        order = np.argsort(word[:n], kind="stable")
        h = 4
        while h < self.depth:
            first = word[order] if h == 4 else key[order]
            rank = np.empty(n + h, np.int64)
            rank[n:] = -1
            rank[order] = np.cumsum(np.concatenate([[0], (first[1:] != first[:-1]).astype(np.int64)]))
            key = rank[:n] * (n + 1) + rank[h : n + h] + 1
            order = np.argsort(key, kind="stable")
            h *= 2

        def search(pattern: np.ndarray, past: bool) -> np.ndarray:
            """The first place in order whose suffix is not below the pattern (past: above it)."""
            lo, hi = np.zeros(len(pattern), np.int64), np.full(len(pattern), n)
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                at = order[np.minimum(mid, n - 1)]
                below, same = np.zeros(len(pattern), bool), np.ones(len(pattern), bool)
                for w in range(pattern.shape[1]):
                    x = word[np.minimum(at + 4 * w, n)]
                    below |= same & (x < pattern[:, w])
                    same &= x == pattern[:, w]
                if past:
                    below |= same
                lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
            return lo

        lo, hi = search(self.low, False), search(self.high, True)
        many = hi - lo
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return order[at], np.repeat(self.find, many)

    def encode_stretches(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each stretch of the codes (each followed by a code 0xFFFF), one after the other, and how many each has."""
        stretch = np.repeat(np.arange(len(starts)), sizes + 1)
        s, p = self.edges(text)
        e = s + self.length[p]
        rel = e - starts[stretch[s]]
        most = int(sizes.max())
        by = np.argsort(rel.astype(np.int16) if most < 32_000 else rel, kind="stable")
        s, p, e, rel = s[by], p[by], e[by], rel[by]
        cut = np.searchsorted(rel, np.arange(1, most + 2))
        last, back = np.full(len(text) + 1, -1, np.int64), np.zeros(len(text) + 1, np.int64)
        for k in range(most):
            g = slice(cut[k], cut[k + 1])
            prev = last[s[g]]
            ok = prev < 0
            if k:
                inner = np.flatnonzero(~ok)
                ok[inner] = self.may_follow(prev[inner], p[g][inner])
                ok &= (prev >= 0) | (s[g] == starts[stretch[s[g]]])
            at = e[g][ok]
            last[at], back[at] = p[g][ok], s[g][ok]
        # Ways back from all ends at once.
        cur, who, found = starts + sizes, np.arange(len(starts)), []
        while len(cur):
            found.append((who, last[cur]))
            cur = back[cur]
            live = cur > starts[who]
            cur, who = cur[live], who[live]
        who, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(who[::-1], kind="stable")
        return piece[::-1][by], np.bincount(who, minlength=len(starts))

    def encode(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts (UTF-8, joined; sizes: bytes of each), one after the other, and how many each has."""
        ends = np.cumsum(sizes)
        texts = [SPACE + data[e - n : e].decode("utf-8", "replace") if n else "" for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        chars = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        c = self.code[points]
        begin = np.cumsum(chars) - chars
        new = np.ones(len(c), bool)
        a, b = c[:-1].astype(np.int64), c[1:].astype(np.int64)
        new[1:] = ~self.inside[self.slot(a, b)] | (a == 0) | (b == 0)
        new[begin[chars > 0]] = True
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(c)))
        # One copy of each distinct stretch: by hash, then confirmed code by code. Codes of unknown characters are told apart by the character.
        up = np.multiply.accumulate(np.full(len(c), 0xD6E8FEB86659FD93, U64))
        down = np.multiply.accumulate(np.full(len(c), pow(0xD6E8FEB86659FD93, -1, 1 << 64), U64))
        mark = np.where(c == 0, points.astype(np.int64) + 0x10000, c)
        run = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(mark.astype(U64) + U64(MULT)) * up)])
        h = mix64((run[at + n] - run[at]) * down[at] + n.astype(U64) * U64(MULT))
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        rep = at[one][which]
        pos = np.arange(len(c)) - np.repeat(at, n)
        if (n != n[one][which]).any() or (mark[np.repeat(rep, n) + pos] != mark).any():
            one, which, rep = np.arange(len(at)), np.arange(len(at)), at  # two stretches share a hash: keep all
        m = n[one]
        starts = np.cumsum(m + 1) - (m + 1)
        text = np.full(int((m + 1).sum()), 0xFFFF, np.uint16)
        spot = np.repeat(starts - (np.cumsum(m) - m), m) + np.arange(m.sum())
        text[spot] = c[np.repeat(at[one] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        known = c[at[one]] != 0  # an unknown character is a stretch by itself
        text[starts[~known]] = 0xFFFF
        piece, count = self.encode_stretches(text, starts[known], m[known]) if known.all() else self._mixed(text, starts, m, known, points[at[one]])
        plain = piece < self.size
        if not plain.all():
            piece, count = self._spelled(piece, count)
        # From distinct stretches back to the texts.
        first = np.cumsum(count) - count
        k = count[which]
        ids = piece[np.repeat(first[which] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        total = np.concatenate([[0], np.cumsum(k)])
        edge = np.searchsorted(at, np.append(begin, len(c)))
        return ids.astype(np.int32), np.diff(total[edge])

    def _mixed(self, text, starts, m, known, point):
        """Stretches with unknown characters among them: those stand for themselves, as codes beyond the vocabulary."""
        keep = np.flatnonzero(known)
        # Known stretches are moved together, so that each is followed by its end mark.
        size = m[keep]
        to = np.cumsum(size + 1) - (size + 1)
        own = np.full(int((size + 1).sum()), 0xFFFF, np.uint16)
        idx = np.arange(size.sum())
        own[np.repeat(to - (np.cumsum(size) - size), size) + idx] = text[np.repeat(starts[keep] - (np.cumsum(size) - size), size) + idx]
        piece, count = self.encode_stretches(own, to, size) if len(keep) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        counts = np.ones(len(starts), np.int64)
        counts[keep] = count
        out = np.empty(counts.sum(), np.int64)
        first = np.cumsum(counts) - counts
        out[first[~known]] = -1 - point[~known].astype(np.int64)
        out[np.repeat(first[keep] - (np.cumsum(count) - count), count) + np.arange(count.sum())] = piece
        out[out < 0] = len(self.length) - out[out < 0]  # beyond all pieces: length + 1 + character
        return out, counts

    def _spelled(self, piece: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Single characters that are no piece, as the pieces of their bytes."""
        odd = np.flatnonzero(piece >= self.size)
        spell = {}
        for x in np.unique(piece[odd]).tolist():
            char = self.text[x] if x < len(self.length) else chr(x - len(self.length) - 1)
            spell[x] = [self.bytes_id.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass")] if self.bytes_id else [self.unknown]
        n = np.ones(len(piece), np.int64)
        n[odd] = [len(spell[x]) for x in piece[odd].tolist()]
        out = np.repeat(piece, n)
        at = np.cumsum(n) - n
        for x, ids in spell.items():
            where = at[piece == x]
            for j, i in enumerate(ids):
                out[where + j] = i
        owner = np.repeat(np.arange(len(count)), count)
        return out, np.bincount(owner, n, len(count)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts' bytes: pieces joined, the space in front taken off."""
        n = self.out_len[ids]
        pos = np.repeat(self.out_at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        data = self.out[pos].tobytes() if len(pos) else b""
        total = np.concatenate([[0], np.cumsum(n)])
        edge = total[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[s + 1 if data[s : s + 1] == b" " else s : e] for s, e in zip(edge, edge[1:], strict=False)]


def _encoder(vocabulary, tag: str) -> Encoder:
    """One encoder a worker process, whatever the number of its tasks."""
    kept = sys.modules.setdefault("_tramline_kept", types.ModuleType("_tramline_kept")).__dict__
    name = f"spm {tag}"
    if name not in kept:
        kept[name] = Encoder(vocabulary.value)
    return kept[name]


def _shipped(docs: DataFrame, path: str):
    """The vocabulary for the executors, and a name for it."""
    vocabulary = read_vocabulary(path)
    scores = [s for p, s, k in vocabulary if k == 0 and set(p) != {SPACE}]
    if len(set(scores)) < len(scores):
        raise ValueError("pieces that share a score make merging depend on their places; this is not a BPE model")
    return docs.sparkSession.sparkContext.broadcast(vocabulary), hashlib.sha256(repr(vocabulary).encode()).hexdigest()  # a vocabulary, not data


def _encoded(vocabulary, tag: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary, tag)
        for b in batches:
            texts = b.column(column)
            for i, j, buf, offs in slices(texts, BATCH_BYTES):
                data, sizes = buf.tobytes(), np.diff(offs)
                ids, counts = enc.encode(data, sizes)
                back = enc.decode(ids, counts)
                want = [data[s:e].replace(b"\xe2\x96\x81", b" ") for s, e in zip(offs.tolist(), offs[1:].tolist(), strict=False)]
                edge = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                null = texts.slice(i, j - i).is_null()
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(ids), mask=null) if null.true_count else pa.ListArray.from_arrays(pa.array(edge), pa.array(ids))
                same = pa.array([x == y for x, y in zip(back, want, strict=True)])
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns), lists, pa.array(counts), same], names=[*b.schema.names, "ids", "n_ids", "round_trip"])

    return run


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """The columns of `docs`, ids (array<int>), n_ids, round_trip (decoding gives the text back; U+2581 counts as a space).

    path: a SentencePiece BPE model without normalisation, as its library reads it on the driver. Null text: null ids, 0,
    true; empty text: no ids. Rows are taken one by one, so repeated rows agree. Columns of those names are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("ids", "n_ids", "round_trip")])
    fields = [*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return docs.mapInArrow(given_back(_encoded(*_shipped(docs, path), column)), T.StructType(fields))


def _decoded(vocabulary, tag: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary, tag)
        for b in batches:
            ids = b.column(column)
            flat, edge = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.array([0, *(len(x) if x.is_valid else 0 for x in ids)])
            text = [x.decode("utf-8", "replace") for x in enc.decode(flat, edge[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t if v else None for t, v in zip(text, ids.is_valid().to_pylist(), strict=True)], pa.string())], names=[*b.schema.names, "decoded"])

    return run


def decode(rows: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """The columns of `rows` and decoded: the text of each array of ids (null for null). Bytes that are no UTF-8 show as U+FFFD."""
    rows = rows.drop(*[c for c in rows.columns if c.lower() == "decoded"])
    return rows.mapInArrow(_decoded(*_shipped(rows, path), column), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


#: Where the model file is, unless said otherwise.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text."""
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), MODEL)
    return out.select("doc_id", "n_ids", "ids", "round_trip")
