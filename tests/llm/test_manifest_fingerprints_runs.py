"""Merkle manifest, document fingerprints and periodic runs against brute force; and the odd cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tramline.llm import fingerprints, merkle, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Path string, runs string, part string"
ODD = [
    (1, "The quick brown fox", "en", "a", 1, "x", "y", "z"), (2, None, None, None, None, None, None, None), (3, "", "", "a", 0, "y", None, None), (None, "no id here", "en", "b", 3, "z", "", ""), (None, None, None, "b", 3, "z", "", ""),
    (1, "The quick brown fox", "en", "a", 1, "x", "y", "z"), (1, "Another text", "en", "a", 1, "x", "y", "z"), (5, "Größe ß 漢字 🙂 end", "de", "c", 1, None, None, None), (6, "word " * 60_000, "en", "a", 9, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(nodes, fan):
    """Root, and each leaf's siblings and fold, by the definition."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = i // fan * fan
            path.append(("".join(level[run:i]), "".join(level[i + 1 : run + fan])))
            i //= fan
        paths.append(path)
    return levels[-1][0], paths


def brute_manifest(rows, fan):
    """Rows (group, order, leaf) -> {(group, order, leaf): [(subroot, root, path)]}."""
    groups = {}
    for g, o, d in rows:
        groups.setdefault(g, []).append((o is not None, o or 0, d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([x[2] for x in sorted(groups[g])], fan) for g in names}
    root, above = tree([built[g][0] for g in names], fan)
    out = []
    for k, g in enumerate(names):
        for (has, o, d), path in zip(sorted(groups[g]), built[g][1]):
            out.append((g, o if has else None, d, built[g][0], root, path + above[k]))
    return sorted(map(repr, out))


def got_manifest(df):
    return sorted(repr((r.lang, r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.path])) for r in df.collect())


@pytest.mark.parametrize(("sizes", "fan", "height", "top"), [([700, 1, 65, 8, 9], 8, 3, 4096), ([300, 1, 64, 27, 2], 3, 1, 8), ([2] * 40 + [30], 2, 1, 5), ([1] * 30, 8, 2, 4), ([1], 8, 3, 4)])
def test_manifests_equal_the_definition(spark, sizes, fan, height, top):
    """One round under the driver's tree, several, and more groups than the driver takes."""
    rows = [(None if k == 0 else f"g{k:02}", i * 3, sha(f"{k} {i}")) for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "lang string, doc_id long, leaf string").repartition(5)
    found = merkle.manifest(df, "lang", ["doc_id"], fan=fan, height=height, top=top)
    assert got_manifest(found) == brute_manifest(rows, fan)
    assert found.filter(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_manifest_of_odd_rows(odd, empty):
    """Null groups, null and repeated ids, null and very long texts, columns with the names that are made."""
    leaves = odd.withColumn("leaf", merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")))
    want = [(r[2], r[0], sha(encoded([r[0], r[3], r[2], r[4], r[1]]))) for r in ODD]
    found = merkle.manifest(leaves, "lang", ["doc_id"])
    assert got_manifest(found) == brute_manifest(want, 8)
    assert set(found.columns) == {"doc_id", "text", "lang", "source", "n_chars", "runs", "part", "leaf", "path", "subroot", "root"}
    none = merkle.manifest(empty.withColumn("leaf", F.lit("x")), "lang", ["doc_id"])
    assert none.count() == 0


def test_equal_rows_fill_more_than_one_range(spark):
    rows = [("en", 7, sha("same"))] * 4000
    found = merkle.manifest(spark.createDataFrame(rows, "lang string, doc_id long, leaf string").repartition(8), "lang", ["doc_id"])
    assert got_manifest(found) == brute_manifest(rows, 8)


def test_tampered_rows_do_not_verify(spark):
    got = {r.doc_id: r for r in merkle.op11_merkle_manifest(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        changed = zlib.crc32(str(d.doc_id).encode()) % 3 == 0 and re.search("[A-Z]", d.text or "") is not None
        assert got[d.doc_id].verified is not changed


def brute_codes(data):
    """A fingerprint's codes, triplet by triplet."""
    counts = [0] * fingerprints.BUCKETS
    padded = data + b"\0" * 4
    for i in range(len(data)):
        for k, (a, b) in enumerate(fingerprints.PATTERNS):
            h = padded[i] | padded[i + a] << 8 | padded[i + b] << 16
            h = (h + (k << 24)) * 0x9E3779B1 & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x85EBCA77 & 0xFFFFFFFF
            counts[h >> 24] += 1
    order = sorted(counts)
    cut = [order[len(order) * q // 4 - 1] for q in (1, 2, 3)]
    length = min(255, 1 + int(np.floor(8 * np.log2(len(data))))) if data else 0
    return [length, *[sum(c > q for q in cut) for c in counts]]


def test_codes_equal_a_count_triplet_by_triplet(monkeypatch):
    r = random.Random(2)
    texts = [b"", b"a", b"ab", bytes(r.randrange(256) for _ in range(300)), b"the cat sat on the mat " * 20, "漢字🙂".encode() * 50]
    want = [brute_codes(t) for t in texts]
    assert fingerprints.codes(texts).tolist() == want
    monkeypatch.setattr(fingerprints, "PIECE", 64)  # long texts are counted in pieces
    assert fingerprints.codes(texts).tolist() == want
    c = fingerprints.codes(texts)
    assert (fingerprints.from_hex(fingerprints.as_hex(c)) == c).all()


def test_likeness_is_bounded():
    r = np.random.default_rng(3)
    a, b = (np.column_stack([r.integers(0, 256, 200), r.integers(0, 4, (200, fingerprints.BUCKETS))]).astype(np.uint8) for _ in range(2))
    a[:5], b[5:9] = 0, 0
    assert (fingerprints.alike(a, a) == 1).all()
    assert ((x := fingerprints.alike(a, b)) >= 0).all() and (x <= 1).all() and np.array_equal(x, fingerprints.alike(b, a)) and (x[9:] < 1).all()


def brute_against_next(rows):
    """Rows (id, text) in order -> what the operator returns."""
    texts = [t or "" for _, t in rows]
    edited = [fingerprints.spliced(t, n) for t, n in zip(texts, texts[1:] + texts[:1])]
    c, e = (fingerprints.codes([t.encode() for t in x]) for x in (texts, edited))
    near, after = fingerprints.alike(c, e), fingerprints.alike(c, np.roll(c, -1, axis=0))
    return [(i, len(t), sha(d), f, g, x, y) for (i, _), t, d, f, g, x, y in zip(rows, texts, edited, fingerprints.as_hex(c), fingerprints.as_hex(e), near, after)]


def test_splicing_takes_characters():
    assert fingerprints.spliced("abcdefgh🙂", "漢字xyz") == "abcdefg漢字"
    assert fingerprints.spliced("abcdefgh", "z") == "abcdefz" and fingerprints.spliced("abc", "xyz") == "abc" and fingerprints.spliced("", "x") == ""


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_documents_against_the_next(spark, parts, monkeypatch):
    """Any partitioning, more partitions than rows of an id range, one row alone."""
    r = random.Random(parts)
    rows = [(i * 7, None if i % 9 == 4 else "".join(r.choice("abc 漢ß🙂") for _ in range(r.randrange(0, 80)))) for i in range(30)]
    mixed = r.sample(rows, len(rows))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for take in (mixed, mixed[:1]):
            got = sorted(map(tuple, fingerprints.against_next(spark.createDataFrame(take, "doc_id long, text string")).collect()))
            assert got == brute_against_next(sorted(take))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fingerprints_of_odd_rows(spark, odd, empty):
    """Null ids come first, equal ids in a fixed order; one result a row; older columns stay where rows keep them."""
    got = fingerprints.against_next(odd).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == sorted((r[0] or -1, len(r[1] or "")) for r in ODD)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.n_chars == 19}) == 1
    assert fingerprints.against_next(empty).count() == 0
    whole = fingerprints.fingerprints(odd, out="print")
    assert whole.columns == [*odd.columns, "print"]
    found = whole.select("text", "print", fingerprints.likeness(F.col("print"), F.lit(fingerprints.as_hex(fingerprints.codes([b""]))[0])).alias("x"), fingerprints.likeness(F.col("print"), F.lit(None).cast("string")).alias("none")).collect()
    assert all((r.x == 1) is (not r.text) and r.none is None for r in found)
    assert fingerprints.fingerprints(empty).count() == 0


def test_op12_equals_brute_force(spark):
    docs = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    got = sorted(map(tuple, fingerprints.op12_document_fingerprints(spark, SF).collect()))
    assert got == brute_against_next(docs)
    assert sum(r[5] > r[6] for r in got) >= 0.95 * len(got)


def brute_factors(w):
    out, i = [], 0
    while i < len(w):
        best = 0
        for j in range(i):
            k = 0
            while i + k < len(w) and w[j + k] == w[i + k]:
                k += 1
            best = max(best, k)
        out.append((i, max(1, best)))
        i += max(1, best)
    return out


def brute_runs(w, least, exponent):
    """Every period on its own; a stretch counts for its smallest one."""
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, size, q) for (s, size), q in out.items())


def periodic_words(r):
    k, n, w = r.choice([1, 2, 3, 5]), r.randrange(0, 70), []
    while len(w) < n:
        x = r.random()
        if w and x < 0.4:
            q = r.randint(1, min(7, len(w)))
            for _ in range(r.randint(1, 30)):
                w.append(w[-q])
        elif w and x < 0.7:
            s = r.randrange(len(w))
            for i in range(r.randint(1, 20)):
                w.append(w[s + i])
        else:
            w.append(r.randrange(k))
    return w


def test_runs_equal_brute_force():
    r = random.Random(4)
    for _ in range(800):
        w = periodic_words(r)
        assert [(at, size) for at, size, _ in runs.factors(w)] == brute_factors(w)
        assert all(source < 0 or (source < at and w[source : source + size] == w[at : at + size]) for at, size, source in runs.factors(w))
        for least, exponent in ((2, 2), (3, 3), (10, 2), (24, 3)):
            want = brute_runs(w, least, exponent)
            assert runs.runs_of(w, least, exponent) == want
            assert runs.word_runs([str(x) for x in w], least, exponent) == want


def brute_op13(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w, 24, 3)
    drop = {i for s, size, q in found for i in range(s + q, s + size)}
    top = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if found else None
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *best, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_op13_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = runs.op13_periodic_runs(spark, SF)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, got.collect())) == sorted(brute_op13(*d) for d in docs)


def test_runs_of_odd_rows(odd, empty):
    got = runs.find_runs(odd)
    assert set(got.columns) == {*odd.columns, "collapsed"}
    for r in got.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert [tuple(x) for x in r.runs] == brute_runs(w, 24, 3) if len(w) < 100 else [tuple(x) for x in r.runs] == [(0, 60_000, 1)]
        assert r.collapsed == (" ".join(w) if len(w) < 100 else "word")
    assert runs.find_runs(empty).count() == 0
    tails = runs.planted(odd).collect()
    assert [r.text for r in tails if r.doc_id is None] == ["no id here", None]
