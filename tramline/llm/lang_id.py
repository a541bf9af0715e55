"""Language ID by multilingual mixture inference.

A language's model is its distribution over letter trigrams (with word edges) in hashed bins. A document is a mixture:
each of its words comes from one language, with the likelihood of its trigrams. Expectation-maximisation estimates the
document's language proportions; of the nested sets of its largest languages the one with the best penalised likelihood
(half the logarithm of the number of words for each language more) stays, and the largest proportion in it is predicted.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.textops import MULT, U64, given_back, mix64, slices

#: Bins of trigrams. With one float32 a bin and language, the model has 256 KB a language.
BINS = 1 << 16
#: Labelled documents a language that the model is fitted on at most, about (drawn by hash; a bounded sample).
SAMPLE = 4000
#: Letters of a word that count together; a longer run of letters is several words.
LONGEST = 24
ROUNDS, SETTLED = 25, 2e-3


def _kept_between_tasks() -> dict:
    """A place in the worker process that outlives a task."""
    return sys.modules.setdefault("_tramline_kept", types.ModuleType("_tramline_kept")).__dict__


def _letters() -> np.ndarray:
    kept = _kept_between_tasks()
    if "letters" not in kept:
        kept["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return kept["letters"]


def word_bins(texts: bytes, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a run of texts (UTF-8, joined; counts: bytes of each): row of each word, its number among the distinct
    words, and for these: how often each occurs, the bins of all their trigrams, and where each word's begin."""
    ends = np.cumsum(counts)
    pieces = [texts[e - n : e].decode("utf-8", "replace").lower().replace("\0", " ") for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
    c = np.frombuffer("\0".join(pieces).encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[np.minimum(c, 0x10FFFF)] if len(c) else np.zeros(0, bool)
    edge = np.zeros(len(c) + 2, bool)
    edge[1:-1] = letter
    starts, stops = np.flatnonzero(edge[1:] & ~edge[:-1]), np.flatnonzero(~edge[1:] & edge[:-1])
    if ((stops - starts) > LONGEST).any():
        n = -(-(stops - starts) // LONGEST)
        base = np.repeat(starts, n) + LONGEST * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        stops = np.minimum(base + LONGEST, np.repeat(stops, n))
        starts = base
    breaks = np.cumsum(c == 0)
    rows = breaks[starts] if len(starts) else np.zeros(0, np.int64)
    # Hashes of the words, then one copy of each.
    up = np.multiply.accumulate(np.full(LONGEST, 0xD6E8FEB86659FD93, U64))
    n = stops - starts
    at = np.repeat(starts, n) + (within := np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    v = mix64(c[at].astype(U64) + U64(MULT)) * up[within]
    first = np.cumsum(n) - n
    h = np.add.reduceat(v, first) if len(n) else np.zeros(0, U64)
    _, one, which, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    s, m = starts[one], n[one]
    pos = np.repeat(s, m) + (k := np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
    x = c[pos].astype(U64)
    before = np.where(k > 0, c[np.maximum(pos - 1, 0)], 1).astype(U64)
    last = k == np.repeat(m, m) - 1
    after = np.where(last, 2, c[np.minimum(pos + 1, max(len(c) - 1, 0))] if len(c) else 0).astype(U64)
    bins = (mix64((before * U64(1 << 21) + x) * U64(1 << 21) + after + U64(MULT)) >> U64(48)).astype(np.int64) & (BINS - 1)
    return rows, which, times, bins, np.cumsum(m) - m


def _counted(langs: list[str]):
    """text, lang -> lang (its number), bin, n: summed over the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BINS))
        number = {x: i for i, x in enumerate(langs)}
        for b in batches:
            lang = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
            for i, _, buf, offs in slices(b.column("text")):
                rows, which, _, bins, first = word_bins(buf.tobytes(), np.diff(offs))
                if not len(rows):
                    continue
                size = np.diff(np.append(first, len(bins)))
                for k in np.unique(lang[i : i + len(offs) - 1]):
                    n = np.bincount(which[lang[i + rows] == k], minlength=len(first))
                    total[k] += np.bincount(bins, np.repeat(n, size), BINS)
        k, at = np.nonzero(total)
        for i in range(0, len(k), 50_000):
            j = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(k[j].astype(np.int32)), pa.array(at[j].astype(np.int32)), pa.array(total[k[j], at[j]])], names=["k", "bin", "n"])

    return run


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of the bins: BINS x languages) from docs (doc_id, text, lang; lang not null)."""
    sizes = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BINS, 0), np.float32)
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, sample / sizes[x]))) for x in langs])
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))) < share
    got = docs.filter(draw).select("text", "lang").mapInArrow(given_back(_counted(langs)), "k int, bin int, n double")
    got = got.groupBy("k", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most BINS rows a language
    table = np.full((BINS, len(langs)), 0.1)
    table[got["bin"].to_numpy(), got["k"].to_numpy()] += got["n"].to_numpy()
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def _mixture(pi: np.ndarray, like: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Proportions after expectation-maximisation from `pi` (documents x languages; zeros stay zero), for documents of n words each.

    A document takes part until it has settled, whatever the others do, so company changes nothing.
    """
    pi, live, x = pi.copy(), np.arange(len(n)), like
    for _ in range(ROUNDS):
        at = np.concatenate([[0], np.cumsum(n[live])[:-1]])
        r = np.repeat(pi[live], n[live], axis=0) * x
        r /= r.sum(1, keepdims=True) + 1e-30
        new = np.add.reduceat(r, at, axis=0) / n[live][:, None]
        move = np.abs(new - pi[live]).max(1) > SETTLED
        pi[live] = new
        if not move.any():
            break
        if not move.all():
            x, live = x[np.repeat(move, n[live])], live[move]
    return pi


def infer(rows: np.ndarray, like: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions n_rows x languages after selection, 0 outside the chosen set; number of words).

    like: for each word (in order of rows) its likelihoods, scaled to a maximum of 1. Candidate sets are the s largest
    languages of the mixture over all, for each s; each set of two or more gets its own expectation-maximisation.
    """
    k = like.shape[1]
    words = np.bincount(rows, minlength=n_rows)
    full = np.flatnonzero(words)
    out = np.zeros((n_rows, k), np.float32)
    if not len(full):
        return out, words
    n = words[full]
    pi = _mixture(np.full((len(full), k), 1 / k, np.float32), like, n)
    order = np.argsort(-pi, axis=1, kind="stable")
    best, chosen = np.full(len(full), -np.inf), np.zeros_like(pi)
    for s in range(1, k + 1):
        pick = pi[np.arange(len(full)), order[:, s - 1]] > (0 if s == 1 else 1e-3)
        ask = np.flatnonzero(pick)
        if not len(ask):
            break
        w = np.zeros((len(ask), k), np.float32)
        np.put_along_axis(w, order[ask, :s], np.take_along_axis(pi[ask], order[ask, :s], 1), 1)
        w /= w.sum(1, keepdims=True)
        own = like[np.repeat(pick, n)]
        if 1 < s < k:
            w = _mixture(w, own, n[ask])
        p = (np.repeat(w, n[ask], axis=0) * own).sum(1)
        at = np.concatenate([[0], np.cumsum(n[ask])[:-1]])
        value = np.add.reduceat(np.log(p + 1e-12, dtype=np.float64), at) - 0.5 * (s - 1) * np.log(n[ask] + 1.0)
        better = value > best[ask]
        best[ask[better]], chosen[ask[better]] = value[better], w[better]
    out[full] = chosen / chosen.sum(1, keepdims=True)
    return out, words


def _predicted(langs: list[str], table):
    """Adds lang_pred, score, lang_set and evidence to rows with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = table.value
        names = np.array([*langs, "und"], object)
        for b in batches:
            pred, score, shares, proof = [], [], [], []
            for _, _, buf, offs in slices(b.column("text")):
                n = len(offs) - 1
                rows, which, _, bins, first = word_bins(buf.tobytes(), np.diff(offs))
                best, top, pi, gain = np.full(n, len(langs)), np.zeros(n), np.zeros((n, len(langs))), np.zeros(n)
                if len(rows) and langs:
                    ll = np.add.reduceat(log_p[bins], first, axis=0)
                    like = np.exp(ll - ll.max(1, keepdims=True))
                    pi, words = infer(rows, like[which], n)
                    fit_ = ll.max(1)[which] + np.log((pi[rows] * like[which]).sum(1) + 1e-12)
                    grams = np.bincount(rows, np.diff(np.append(first, len(bins)))[which], n)
                    gain = np.where(words > 0, np.bincount(rows, fit_, n) / np.maximum(grams, 1) + np.log(BINS), 0.0)
                    best = np.where(words > 0, pi.argmax(1), len(langs))
                    top = np.where(words > 0, pi.max(1), 0.0)
                pred += names[best].tolist()
                score += np.minimum(top, 1.0).astype(float).tolist()
                proof += gain.tolist()
                shares += [[{"lang": langs[j], "share": float(p[j])} for j in np.flatnonzero(p)] for p in pi]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, kind), pa.array(proof, pa.float64())], names=[*b.schema.names, "lang_pred", "score", "lang_set", "evidence"])

    return run


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, learn: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The columns of `docs` (text and any others), lang_pred, score (the proportion of lang_pred), lang_set (array of lang, share) and
    evidence (mean log likelihood of a trigram under that mixture, over that of bins drawn at random; 0 or less: no language at all).

    learn: doc_id, text, lang; rows with a null among them teach nothing. Null text and text without a letter: `und`, 0,
    empty set, evidence 0; so is everything where nothing was learned. Each row is judged by itself, so repeated rows agree.
    Ties go to the language that sorts first. Columns of the four names made here are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score", "lang_set", "evidence")])
    learn = learn.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null")
    langs, log_p = fit(learn, sample)
    table = docs.sparkSession.sparkContext.broadcast(log_p)  # BINS * 4 bytes a language
    shares = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    fields = [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_set", shares), T.StructField("evidence", T.DoubleType())]
    return docs.mapInArrow(given_back(_predicted(langs, table)), T.StructType(fields))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document, from a model of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    out = identify(docs.select("doc_id", "text"), learn)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_set", "evidence")
