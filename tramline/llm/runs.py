"""Periodic runs in the word sequence of each document, by the method of Kolpakov and Kucherov.

A run is a maximal stretch with smallest period q and at least `exponent` periods and `least` words. Words that are too
rare in a stretch to be in any of its runs (each word of a run stands in it once a period) cut the stretch. What is
left goes through the method: a suffix automaton gives the factorisation (a factor is the longest stretch that also
starts earlier); Main's algorithm, two Z-arrays a border, finds the runs that cross or touch a border between factors;
runs strictly inside a factor are copied from the factor's earlier occurrence.

Borders that no run of this size can need are skipped. With f factors that start in or before [s + q, e] (a run from s
to e with period q), a factor that starts there reaches e, as it stands q earlier too; so at most two factors cover
[s + q, e], and the two at a border have at least (1 - 1 / exponent) * least words together. By the same argument a run
reaches no further left of its last border than twice those two factors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.textops import given_back
from tramline.session import fresh

#: Least words of a run, and least periods.
LEAST, EXPONENT = 24, 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = "array<struct<start bigint, length bigint, period bigint>>"


def factors(w: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, earlier start or -1) of the factors of w: the longest stretch that also starts earlier, or one new letter."""
    following: list[dict[int, int]] = [{}]
    link, longest, first_end = [-1], [0], [-1]
    last = 0
    for i, letter in enumerate(w):
        here = len(link)
        following.append({})
        link.append(0)
        longest.append(i + 1)
        first_end.append(i)
        p = last
        while p >= 0 and letter not in following[p]:
            following[p][letter] = here
            p = link[p]
        if p >= 0:
            q = following[p][letter]
            if longest[p] + 1 == longest[q]:
                link[here] = q
            else:
                twin = len(link)
                following.append(following[q].copy())
                link.append(link[q])
                longest.append(longest[p] + 1)
                first_end.append(first_end[q])
                while p >= 0 and following[p].get(letter) == q:
                    following[p][letter] = twin
                    p = link[p]
                link[q] = link[here] = twin
        last = here
    at, n = 0, len(w)
    while at < n:
        state, to, end = 0, at, -1
        while to < n:
            state = following[state][w[to]]
            if first_end[state] >= to:
                break
            end = first_end[state]
            to += 1
        size = to - at
        yield at, max(1, size), end - size + 1 if size else -1
        at += max(1, size)


def z_array(s: list[int]) -> np.ndarray:
    """For each place, how many letters from there on equal those from the beginning on."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return np.array(z, np.int64)


def _at_border(w: list[int], border: int, left: int, right: int, least: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of stretches of period p around the border that are long enough, extended as far as the period holds."""
    t, u = w[border - left : border], w[border : border + right]
    back = z_array(t[::-1] + [-1] + (t + u)[::-1])
    forth = z_array(u + [-1] + t + u)
    for sign, most in ((1, right), (-1, left)):
        p = np.arange(1, most + 1)
        if sign > 0:  # a period right of the border: t against itself moved by p, u against u from p on
            before, after = back[left + 1 + right - p], forth[p]
        else:  # a period left of the border
            before, after = back[p], forth[right + 1 + left - p]
        for k in np.flatnonzero(before + after + p >= np.maximum(least, exponent * p)):
            q = int(p[k])
            if sign > 0:
                s, e = border - int(before[k]), border + q + int(after[k]) - 1
            else:
                s, e = border - q - int(before[k]), border + int(after[k]) - 1
            while s > 0 and w[s - 1] == w[s - 1 + q]:
                s -= 1
            while e + 1 < len(w) and w[e + 1] == w[e + 1 - q]:
                e += 1
            yield s, e, q


def runs_of(w: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the runs of w, by start and period."""
    starts: dict[int, dict[int, int]] = {}  # start -> last place -> smallest period found

    def add(s: int, e: int, q: int) -> None:
        ends = starts.setdefault(s, {})
        ends[e] = min(q, ends.get(e, q))

    covers = least - least // exponent
    before = 0
    for at, size, source in [*factors(w), (len(w), 0, -1)]:
        if at and before + size >= covers:
            for found in _at_border(w, at, min(at, 2 * (before + size)), size, least, exponent):
                add(*found)
        if source >= 0 and size > least:
            for s in range(at + 1, at + size - least):
                for e, q in list(starts.get(s - at + source, {}).items()):
                    if e + at - source < at + size - 1:
                        add(s, e + at - source, q)
        before = size
    return sorted((s, e - s + 1, q) for s, ends in starts.items() for e, q in ends.items())


def stretches(ids: np.ndarray, least: int, exponent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, letters) of what is left when words that a stretch has fewer than `exponent` times cut it, until none is left that cuts, or too few words are."""
    waiting = [(0, ids)]
    while waiting:
        start, part = waiting.pop()
        if len(part) < least:
            continue
        _, letter, count = np.unique(part, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[letter] < exponent)
        if not len(rare):
            yield start, letter
            continue
        edges = np.concatenate([[-1], rare, [len(part)]])
        for k in np.flatnonzero(np.diff(edges) > least):
            waiting.append((start + int(edges[k]) + 1, part[edges[k] + 1 : edges[k + 1]]))


def word_runs(words: list[str], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a word sequence, by start and period."""
    if len(words) < least:
        return []
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(x, len(number)) for x in words])
    return sorted((start + s, size, q) for start, part in stretches(ids, least, exponent) for s, size, q in runs_of(part.tolist(), least, exponent))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for s, size, q in runs:
        keep[s + q : s + size] = False
    return [words[i] for i in np.flatnonzero(keep)]


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """`docs` with `runs` (start and length in words, smallest period; by start, then period) and `collapsed` (the words left, joined by one space).

    Words are what spaces and the controls 0x09 to 0x0D part, compared by their characters. Null and empty texts have no runs
    and collapse to the empty text; rows stand for themselves, so repeated rows, null ids and empty tables need no care;
    older columns named runs or collapsed are replaced, others stay. A text is worked on as a whole: about 0.6 KB a word of
    those stretches that have no rare word.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("runs", "collapsed")])
    (own,) = fresh(docs.columns, "words_of")
    made = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, left = [], []
            for value in batch[own]:
                words = WORD.findall(value.as_py() or "")
                found = word_runs(words, least, exponent)
                runs.append([{"start": s, "length": size, "period": q} for s, size, q in found])
                left.append(" ".join(collapsed(words, found)))
            names = [n for n in batch.schema.names if n != own]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(runs, made), pa.array(left, pa.string())], [*names, "runs", "collapsed"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"runs {RUNS}", "collapsed string"])
    return docs.withColumn(own, F.col(text)).mapInArrow(given_back(run), schema)


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` where one text in ten (by crc32 of the id) gets a periodic tail: from word a on, the p words from a repeat (see the query's contract)."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words, g, n, a, p = fresh(docs.columns, "words", "g", "n", "a", "p")
    chosen = docs.withColumn(words, F.when(h % 10 == 0, F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    chosen = chosen.withColumns({g: F.floor(h / 10), n: F.when(F.size(words) > 0, F.size(words))})
    chosen = chosen.withColumn(a, (F.col(g) % F.col(n)).cast("int"))
    left = F.col(n) - F.col(a)
    chosen = chosen.withColumn(p, (1 + F.floor(left / (3 + F.col(g) % 8))).cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, F.col(a) + 1, F.col(p)), F.ceil(left / F.col(p)).cast("int"))), F.lit(1), left)
    made = F.array_join(F.concat(F.slice(words, F.lit(1), F.col(a)), tail), " ")
    return chosen.withColumn(text, F.when(F.col(n).isNotNull(), made).otherwise(F.col(text))).drop(words, g, n, a, p)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Every document's runs, the one with most periods, and the text that is left without the repeats; one in ten documents gets a periodic tail first."""
    docs = planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = find_runs(docs).drop("text")
    # Greatest length / period, exactly: fractions are compared across; ties to the smaller start, then period.
    better = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"])  # noqa: E731  runs come by start, then period
    first = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("top", first).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
