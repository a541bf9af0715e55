"""Operators on texts against brute force, exact round trips and held-out rows; and the odd cases."""

import collections
import hashlib
import math
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tramline.llm import chat_format, lang_id, lm_score, minhash_dedup, mixing, queries, spm, suffix_dedup, textops, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LONG = "word " * 30_000
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1, "x"), (2, None, "en", None, None, None), (3, "", None, "a", 0, "y"), (None, "no id here at all", "en", "b", 3, "z"), (4, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1, "x"),
    (4, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1, "x"), (5, "!!! ... 123", "de", "b", 5, None), (6, LONG, "en", "a", 9, None), (7, "single", "en", "c", 1, None), (8, "Größe ß 漢字 🙂 \x00 end", "de", "c", 1, None), (9, " \t\n", "en", "c", 1, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(d, len(sets[i]), low.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_near_duplicates_against_all_pairs(spark):
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    base = [[words[i] for i in r.integers(0, 60, 40)] for _ in range(12)]
    rows = []
    for i in range(160):
        w = list(base[i % 12])
        for _ in range(int(r.integers(0, 9))):
            w[int(r.integers(0, len(w)))] = words[int(r.integers(0, 60))]
        rows.append((i, " ".join(w)))
    for k in (2, 5):
        got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k).toPandas()
        assert sorted(zip(got.doc_id, got.n_shingles, got.component_id)) == sorted(brute_components(rows, k))


def test_near_duplicates_on_odd_rows(odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(odd, 2).collect()]
    want = brute_components([(r[0], r[1]) for r in ODD], 2)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert minhash_dedup.near_duplicates(empty, 2).count() == 0
    one = minhash_dedup.one_of_each(odd, 2)
    assert one.columns == odd.columns and sorted(x for x in one.toPandas().doc_id.dropna()) == [1, 2, 3, 5, 6, 7, 8, 9]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_built_to_collide_stay_apart(spark):
    """Thue-Morse words collide under any polynomial hash modulo a power of two."""
    a = thue_morse(4096)
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, " ".join([a] * 3 + [b] * 3)), (4, " ".join([b] * 3 + [a] * 3)), (5, a.upper())]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).toPandas()
    assert sorted(zip(got.doc_id, got.n_shingles, got.component_id)) == sorted(brute_components(rows, 2))
    buf = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
    h = textops.word_hashes(buf, np.array([0, 4097, 8194]), np.array([4096, 8193, 12290]))
    assert h[0] == h[2] != h[1]
    g = textops.guard(buf)(np.array([0, 4097, 8194]), np.array([4096, 8193, 12290]))
    assert g[0] == g[2] != g[1]


# Two words built so that sums of a value for each byte and place agree.
SUMMED = (
    "aaaaabaaaababbbaaabbaaaabaababbbaabbababaaaabaabbabaabbaaaaaaaaabbaaaabbbbbbaabbbabbbbabaabaabbaaabaabbbabbbaaabbaabbaaabaabbbaabbabaaabbabbbaaabbabaaaabbabababababaaaababababaabaaabbaabaaabaaababbaaba",
    "aaabbbaaabaaabababaabbabbbaaaabaaaaabababaaababbabbaababaaaabbbbbaababbbbbaababbabaaaabaaababababbabbaababbbbbabbbbbbbaabbbaabbaabbabaaabaabbbbabbbbbbbbbbabbaaababbbbaaabbbbabbaabababbbbabaabb",
)


def test_words_with_equal_sums_stay_apart(spark):
    """Documents of such words share nothing: no class, no link, and every shingle counts."""
    a, b = SUMMED
    rows = [(1, a), (2, b), (3, f"{a} {b} {b} {a}"), (4, f"{b} {a} {b} {a}"), (5, f"{a} {a}"), (6, f"{b} {b}"), (7, a)]
    for k in (2, 5):
        got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k).toPandas()
        assert sorted(zip(got.doc_id, got.n_shingles, got.component_id)) == sorted(brute_components(rows, k))


def test_digests_tell_sets_word_by_word(monkeypatch):
    """Equal digests where the sets of words are equal and only there, whatever is laid out at once; counts are those of the sets."""
    r = np.random.default_rng(8)
    pool = ["a", "bb", "Ab", "\t", "longwordlongword1", "longwordlongword2", "x" * 8, "x" * 9, "ß"]
    texts = [" ".join(pool[i] for i in r.integers(0, len(pool), r.integers(0, 25))) for _ in range(400)] + [None, "", " \n"]
    monkeypatch.setattr(textops, "LAID_OUT", 150)
    for k in (1, 2, 5):
        sets, digests = {}, {}
        for i, j, buf, offs in textops.slices(pa.array(texts + texts[:50]), 3000):
            _, edge, made = textops.set_digests(buf, offs, k, 99)
            for q in range(i, j):
                s = frozenset(shingles((texts + texts[:50])[q], k))
                assert edge[q - i + 1] - edge[q - i] == len(s)
                assert sets.setdefault(made[q - i], s) == s and digests.setdefault(s, made[q - i]) == made[q - i]


def test_word_hashes_depend_on_key_length_and_every_byte():
    words = [b"", b"a", b"a\0", b"aaaaaaaa", b"aaaaaaaab", b"aaaaaaab", b"baaaaaaa", *(w.encode() for w in SUMMED)]
    buf, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    h = [textops.word_hashes(buf, ends - [len(w) for w in words], ends, key) for key in (1, 2)]
    assert len({*h[0].tolist(), *h[1].tolist()}) == 2 * len(words)
    again = np.concatenate([np.frombuffer(b"zz", np.uint8), buf])
    assert (textops.word_hashes(again, ends - [len(w) for w in words] + 2, ends + 2, 1) == h[0]).all()


def test_links_are_confirmed_on_words():
    a, b = "a b c d e f", "A b\tc d e x"
    assert minhash_dedup.word_shingles(b, 2) == {(b"a", b"b"), (b"b", b"c"), (b"c", b"d"), (b"d", b"e"), (b"e", b"x")}
    assert minhash_dedup.confirmed(a, b, 2, 66) and not minhash_dedup.confirmed(a, b, 2, 67) and not minhash_dedup.confirmed("", "", 2, 80)


def test_posterior_bounds_fall_with_the_miss_probability():
    assert all(a >= b for a, b in zip(minhash_dedup.needed_matches(0.8, 1e-3), minhash_dedup.needed_matches(0.8, 1e-6)))


def test_pruning_loses_no_more_links_than_banding():
    """Pairs at similarity exactly 0.8 dropped in any of the batches, summed exactly over the counts of matches."""
    n, alive, lost = minhash_dedup.BATCH, {0: 1.0}, 0.0
    step = [math.comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(n + 1)]
    for need in minhash_dedup.needed_matches(0.8):
        after = {}
        for m, p in alive.items():
            for i, v in enumerate(step):
                after[m + i] = after.get(m + i, 0.0) + p * v
        lost += sum(p for m, p in after.items() if m < need)
        alive = {m: p for m, p in after.items() if m >= need}
    assert lost <= (1 - 0.8**minhash_dedup.ROWS) ** minhash_dedup.BANDS



def brute_repeats(texts, n, keep_first):
    data = [(t or "").encode() for t in texts]
    first, seen = {}, collections.Counter()
    for d, b in enumerate(data):
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] += 1
            first.setdefault(b[i : i + n], (d, i))
    out = []
    for d, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            if first[w] != (d, i) if keep_first else seen[w] > 1:
                gone[i : i + n] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("length", [8, 24])
def test_repeats_against_every_window(spark, length, keep_first, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", 8)  # groups are split early, so small tables come that way too
    common = "a passage that many texts share word for word"
    rows = [(0, "ab" * 30), (1, "a" * 70), (2, None), (3, ""), (4, "ß" * 30), (5, "ab" * 15 + "tail")]
    rows += [(10 + i, f"{i * 7919} {common if i % 3 else common[:30]}{'é' * (i % 4)} {i % 5}") for i in range(60)]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), length, keep_first).orderBy("doc_id").collect()
    assert [bytes(r.kept) for r in got] == brute_repeats([t for _, t in rows], length, keep_first)


def test_lpf_equals_its_definition():
    r = np.random.default_rng(1)
    for n, depth in ((1, 3), (60, 5), (150, 9)):
        x = r.integers(0, 3, n)
        same = lambda i, j: next((k for k in range(depth) if max(i, j) + k >= n or x[i + k] != x[j + k]), depth)  # noqa: B023, E731
        assert suffix_dedup.longest_previous_factor(x, depth).tolist() == [max([0, *(same(i, j) for j in range(i))]) for i in range(n)]
        assert suffix_dedup.longest_previous_factor(x, depth, later=True).tolist() == [max([0, *(same(i, j) for j in range(i + 1, n))]) for i in range(n)]


def test_repeats_on_odd_rows(odd, empty):
    out = suffix_dedup.without_repeats(odd, 20)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert suffix_dedup.without_repeats(empty, 20).count() == 0
    got = {r.doc_id: r for r in suffix_dedup.repeated_spans(odd, 20).collect()}
    assert len(got[1].kept) == 0 and got[2].kept == b"" and got[8].spans == []


def test_op8_equals_brute_force(spark):
    got = suffix_dedup.op8_suffix_dedup(spark, SF).toPandas().sort_values("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    kept = brute_repeats(docs.text, 400, False)
    assert got.kept_sha256.tolist() == [hashlib.sha256(b).hexdigest() for b in kept]
    size = [len((t or "").encode()) for t in docs.text]
    assert got.n_bytes.tolist() == size and got.n_removed.tolist() == [n - len(b) for n, b in zip(size, kept)]
    assert [t or "" for t in got.text] == [b.decode("utf-8", "ignore") for b in kept]


def test_repeats_in_a_document_of_over_a_megabyte(spark):
    """Two grams of the passage have hashes that differ first in their 44th bit; which is the anchor must not depend on a document's length."""
    left, right = "hginlujcwsxbynxmixqcjxuplkyrgaxkufkdynfhyozqbomjukygshjlxvtligwo", "dexshygqeniaunoyhshdrichgycxdbebuiaokioospeoztccceeubhzandqzrodq"
    passage = left + ("filler " * 60)[:272] + right
    before = bytes(np.random.default_rng(5).integers(97, 123, 1_100_000, np.uint8)).decode()
    docs = spark.createDataFrame([(1, before + passage), (2, passage), (3, passage[1:])], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_dedup.repeated_spans(docs).select("doc_id", "spans").collect()}
    assert got == {1: [(1_100_000, 1_100_400)], 2: [(0, 400)], 3: []}


def test_helper_names_clash_with_nobody(odd, spark):
    """Further columns may have the names of results (replaced) or of helpers (kept)."""
    names = ["th", "k_id", "d_id", "d_th", "r_id", "r_th", "ranges", "r_n", "r_cdf", "r_source", "label", "a_id"]
    wide = odd.withColumns({n: F.lit(n) for n in names})
    one = minhash_dedup.one_of_each(wide, 2)
    assert one.columns == wide.columns and {r.th for r in one.collect()} == {"th"}
    spans = suffix_dedup.repeated_spans(wide.withColumn("spans", F.lit("old")), 20)
    assert {(r.th, r.ranges, r.r_id) for r in spans.collect()} == {("th", "ranges", "r_id")} and spans.columns.count("spans") == 1
    mixed = mixing.mix(wide.withColumn("copy", F.lit("old")))
    assert {(r.r_n, r.r_source) for r in mixed.collect()} <= {("r_n", "r_source")} and dict(mixed.dtypes)["copy"] == "int"
    assert dict(lang_id.identify(odd.withColumn("lang_pred", F.lit(1)), odd).dtypes)["lang_pred"] == "string"
    assert dict(spm.encode(odd.withColumn("ids", F.lit("old")), spm.MODEL).dtypes)["ids"].startswith("array")
    pages = spark.createDataFrame([(1, "http://a.b/c", "mine", "mine")], "page_id long, url string, b_host string, b_path string")
    rules = spark.createDataFrame([("b", "/", "block")], url_filters.RULES)
    assert [(r.b_host, r.b_path, r.verdict) for r in url_filters.judge(pages, rules).collect()] == [("mine", "mine", "block")]


def test_languages_are_judged_alone_as_in_company(spark):
    """The words' mixture of a document is the same whatever else is in the batch, and equals a plain EM."""
    r = np.random.default_rng(2)
    sizes = r.integers(1, 60, 40)
    like = r.random((sizes.sum(), 4)).astype(np.float32) ** 4 + 1e-6
    like[: sizes[0], 1:] *= 1e-4
    rows = np.repeat(np.arange(40), sizes)
    together, _ = lang_id.infer(rows, like, 40)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(40):
        own = like[edge[i] : edge[i + 1]]
        assert (lang_id.infer(np.zeros(sizes[i], int), own, 1)[0][0] == together[i]).all()
        plain = np.full(4, 0.25)
        for _ in range(lang_id.ROUNDS):
            new = (plain * own / (plain * own).sum(1, keepdims=True)).mean(0)
            done = np.abs(new - plain).max() <= lang_id.SETTLED
            plain = new
            if done:
                break
        assert np.allclose(lang_id._mixture(np.full((1, 4), 0.25, np.float32), own, sizes[i : i + 1])[0], plain, atol=1e-3)
        assert together[i].sum() == pytest.approx(1, abs=1e-5)


def test_languages_on_held_out_rows(spark):
    got = lang_id.op3_language_id(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_languages_on_odd_rows(odd, empty, spark):
    got = {r.doc_id: r for r in lang_id.identify(odd, odd).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[5].lang_pred == got[9].lang_pred == "und" and got[2].score == 0
    assert got[1].lang_pred == "en" and got[1].lang_set and got[1].extra == "x"
    assert {r.lang_pred for r in lang_id.identify(odd, empty).collect()} == {"und"}
    assert lang_id.identify(empty, odd).count() == 0


def test_mixtures_show_both_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pick = lambda lang: docs.filter(f"lang = '{lang}' and length(text) between 800 and 4000").orderBy("doc_id").first().text[:800]
    both = spark.createDataFrame([(1, pick("en") + " " + pick("de"))], "doc_id long, text string")
    found = lang_id.identify(both, docs).first()
    assert {s.lang for s in found.lang_set} == {"en", "de"} and 0.25 < found.score < 0.75


def test_poisson_rates_hit_their_means(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'x' as text", "case when id % 4 = 0 then 'a' when id % 4 = 1 then null else 'c' end as source")
    weights = spark.createDataFrame([("a", 0.5), (None, 0.5), ("zzz", 3.0)], "source string, weight double")
    got = {r.source: r["count"] for r in mixing.mix(docs, weights).groupBy("source").count().collect()}
    # 'zzz' is absent; a and null share all of 20,000; c has no weight.
    assert set(got) == {"a", None} and all(abs(n - 10_000) < 400 for n in got.values())
    rate = {r.source: r.rate for r in mixing.source_rates(docs, weights).collect()}
    assert rate["c"] == 0 and rate["a"] == pytest.approx(2.0)


def test_large_rates_do_not_underflow(spark):
    docs = spark.createDataFrame([(1, "t", "a"), (2, "t", "b")], "doc_id long, text string, source string")
    w = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    assert 1700 < mixing.mix(docs, w, out_share=1000.0).count() < 2300


def test_mixing_odd_rows(odd, empty):
    out = mixing.mix(odd, out_share=3.0)
    assert set(odd.columns) < set(out.columns) and out.count() > 0 and mixing.mix(empty).count() == 0
    twice = out.groupBy("doc_id", "copy").count().filter("doc_id = 4 and count <> 2")
    assert twice.count() == 0  # equal rows draw alike


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)


def test_ids_equal_the_library(library):
    import random

    enc = spm.Encoder(spm.read_vocabulary(spm.MODEL))
    r = random.Random(3)
    pieces = [p.replace("▁", " ") for p, _, k in spm.read_vocabulary(spm.MODEL) if k == 0]
    texts = ["", " ", "  a  b ", "é漢字🙂\x00", "=" * 90 + "a" * 40, "▁x", " " * 45 + "x"]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 9))) for _ in range(800)]
    texts += ["".join(r.choice("abcdethion .,\n-=") for _ in range(r.randint(1, 50))) for _ in range(800)]
    data = [t.encode() for t in texts]
    ids, n = enc.encode(b"".join(data), np.array([len(b) for b in data]))
    edge = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:])] == [library.encode(t) for t in texts]
    assert enc.decode(ids, n) == [t.replace("▁", " ").encode() for t in texts]


def test_op1_equals_the_library(spark, library):
    """The registered query on its whole table."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = spm.op1_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    assert all((r.ids or []) == library.encode(texts[r.doc_id] or "") and r.n_ids == len(r.ids or []) for r in rows)


def test_encoding_odd_rows(odd, empty, library):
    got = spm.encode(odd, spm.MODEL)
    rows = got.collect()
    assert all(r.round_trip for r in rows) and all(r.ids == (None if r.text is None else library.encode(r.text)) for r in rows)
    back = spm.decode(got, spm.MODEL).collect()
    assert all(r.decoded == r.text for r in back) and spm.encode(empty, spm.MODEL).count() == 0


def test_scores_of_odd_rows(odd, empty):
    got = lm_score.score(odd).toPandas()
    assert len(got) == len(ODD) and lm_score.score(empty).count() == 0
    assert got[got.n_words == 0].score.isna().all() and got[got.n_words > 0].score.notna().all()


def test_scores_do_not_depend_on_batches(spark, duck):
    """Many batches and parts of the n-gram space give what SQL gives, at every order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    want = duck.execute(queries.oracle_sql()["op4_lm_scoring"]).df().set_index("doc_id").score
    got = lm_score.score(docs, waves=3, batch_bytes=20_000).toPandas().set_index("doc_id").score
    assert (got - want.reindex(got.index)).abs().max() < 1e-6 and (got.isna() == want.reindex(got.index).isna()).all()
    one = lm_score.score(docs, order=1, batch_bytes=20_000).toPandas().set_index("doc_id").score
    assert (one < 0).sum() == one.notna().sum() and (one - got).abs().max() > 0.1


def test_the_count_table_equals_a_count(spark):
    rows = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (2, 0, 1)], "gram long, who long, n long")
    _, counts = lm_score.counted(rows)
    assert sorted(tuple(r) for r in counts.collect()) == [(1, 5, 2), (2, 1, 1)]


def test_counts_come_back_to_their_rows(spark):
    """What `shared` gives is the count table joined back, less the row's own; it reads its rows once."""
    rows = spark.createDataFrame([(i % 7 if i % 2 else 100 + i, i, 1 + i % 3) for i in range(60)], "gram long, who long, n long")
    dealt, counts = lm_score.counted(rows)
    want = dealt.join(counts.filter("batches > 1"), "gram").select("who", (F.col("total") - F.col("n")).alias("others"))
    got = lm_score.shared(rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 30
    assert "Join" not in got._jdf.queryExecution().toString()


def test_sorted_places_are_exact():
    """Also of hashes that differ in their last bits alone, and equal ones stay in their order."""
    r = np.random.default_rng(2)
    for x in (r.integers(0, 50, 3000), (1 << 60) + r.integers(0, 3, 3000), r.integers(0, 1 << 63, 3000), np.zeros(0), np.ones(1)):
        x = x.astype(np.uint64)
        assert (lm_score.in_order(x) == np.argsort(x, kind="stable")).all()


def test_packed_lists_come_back():
    r = np.random.default_rng(0)
    for u in (np.unique(r.integers(0, 1 << 62, 500).astype(np.uint64)), np.array([7], np.uint64), np.arange(300, dtype=np.uint64)):
        assert (lm_score.unpack_hashes(lm_score.pack_hashes(u)) == u).all()
    n = r.integers(0, 1000, 400)
    assert (lm_score.unpack_counts(lm_score.pack_counts(n)) == n).all()


def test_packed_lists_are_short():
    """Places some hundreds apart and counts that are mostly small take about as many bytes as they tell apart, not three."""
    r = np.random.default_rng(4)
    u = np.sort(r.choice(300_000, 2000, replace=False)).astype(np.uint64)
    n = np.minimum(r.zipf(2.0, 2000), 10_000)
    assert len(lm_score.pack_hashes(u)) + len(lm_score.pack_counts(n)) < 2.3 * 2000


def test_texts_are_cut_into_words_once():
    """What a batch keeps has no texts, only its words' hashes, and gives the n-grams of the texts."""
    texts = ["The cat the CAT sat", None, "", "sat the cat", "one"]
    table = pa.table({"doc_id": pa.array([5, 6, None, 8, 9], pa.int64()), "text": pa.array(texts)})
    got = lm_score._bundled(7)((pa.scalar(3),), table)
    assert got.column_names == ["batch", "docs", "vocabulary", "words"] and got.num_rows == 1
    docs, h, row = lm_score._unbundled(*[got.column(c)[0] for c in got.column_names[1:]])
    assert docs.to_pydict() == {"doc_id": [5, 6, None, 8, 9], "n_words": [5, 0, 0, 3, 1]} and row.tolist() == [0] * 5 + [3] * 3 + [4]
    split = [w for t in texts for w in (t or "").lower().split()]
    assert len(dict(zip(split, h.tolist(), strict=True))) == len(set(h.tolist())) == len(set(split))
    for m, own in enumerate(lm_score.grams(h, row, 3), 1):
        want = [tuple(split[i - m + 1 : i + 1]) if i >= m - 1 and row[i - m + 1] == row[i] else None for i in range(len(row))]
        assert len(set(zip(want, own.tolist(), strict=True))) == len(set(want)) == len(set(own.tolist())) and all((w is None) == (g == 0) for w, g in zip(want, own, strict=True))
    none = lm_score._bundled(7)((pa.scalar(4),), table.slice(1, 2))
    assert [len(x) for x in lm_score._unbundled(*[none.column(c)[0] for c in none.column_names[1:]])] == [2, 0, 0]


def test_what_a_batch_learns_comes_in_any_order(monkeypatch):
    """Rows of the join need no order, and a batch's may come in several parts."""
    monkeypatch.setattr(lm_score, "TOLD_ROWS", 40)
    r = np.random.default_rng(1)
    rows = [((b << 32) + p, int(r.integers(1, 600))) for b in (0, 3, 9) for p in range(50)]
    rows = [rows[i] for i in r.permutation(len(rows))]
    parts = [pa.RecordBatch.from_pydict({"who": pa.array([w for w, _ in rows[i : i + 15]], pa.int64()), "others": pa.array([n for _, n in rows[i : i + 15]], pa.int64())}) for i in range(0, len(rows), 15)]
    got = [x for t in lm_score._told(2)(iter([parts[0].slice(0, 0), *parts])) for x in t.to_pylist()]
    assert {x["wave"] for x in got} == {2} and len(got) > 3
    back = [((x["batch"] << 32) + int(p), int(n)) for x in got for p, n in zip(lm_score.unpack_hashes(x["places"]), lm_score.unpack_counts(x["others"]), strict=True)]
    assert sorted(back) == sorted(rows)


def test_the_last_step_holds_few_arrays_of_all_words():
    """At most 12 values of 8 bytes a word of the batch, so that a batch's scores fit beside the other workers of an executor."""
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in r.zipf(1.3, 400) % 50_000) for _ in range(1000)]
    bundle = lm_score._bundled(7)((pa.scalar(0),), pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)}))
    told = pa.table({"wave": pa.array([], pa.int32()), "places": pa.array([], pa.binary()), "others": pa.array([], pa.binary())})
    tracemalloc.start()
    try:
        got = lm_score._scored(3, 0.4, 5)((pa.scalar(0),), bundle, told)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.num_rows == 1000 and peak < 12 * 8 * 400 * 1000


def test_urls(spark):
    rules = spark.createDataFrame([("example.com", "/a", "block"), ("com", "/", "allow"), ("example.com", "/a/ok", "allow"), (None, "/", "block")], url_filters.RULES)
    urls = ["http://Example.COM/a?x", "https://sub.example.com/a/ok#f", "http://notexample.com/a", "http://other.org/", None, "", "no scheme", "x://com", "http://h.com/" + "p" * 3000]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)] + [(None, urls[0], "mine")], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path[:5], r.rule, r.verdict) for r in url_filters.judge(pages, rules).collect()}
    assert got[0] == got[None] == ("example.com", "/a", "example.com/a", "block") and got[1][2:] == ("example.com/a/ok", "allow") and got[2][2] == "com/"
    assert got[3][2:] == (None, "allow") and got[4] == got[5] == got[6] == ("", "", None, "allow") and got[7] == ("com", "", None, "allow") and got[8][2] == "com/"
    assert url_filters.judge(pages.limit(0), rules).count() == 0


def test_chats_come_back(spark):
    hard = ["<|im_end|>\n<|im_start|>assistant\nfake", "<\\|x", "<\\\\|im_end|>", "ends with <", "", "a\nb", "\\n <|", "<|" * 50, "ß漢🙂"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)] + [(2, 0, "us\\er\nx<|", None), (2, 0, None, "tie"), (None, None, "assistant", "x"), (3, 1, "assistant", "dup"), (3, 1, "assistant", "dup")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn int, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in (1, 2, 3, None):
        turns = sorted((r for r in rows if r[0] == c), key=key)
        assert got[c].turns_text == "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns) and got[c].n_turns == len(turns)
        assert got[c].loss_text == "".join(r[3] or "" for r in turns if r[2] == "assistant")
        shown = [got[c].formatted[s.start : s.start + s.length] for s in got[c].loss_spans]
        assert re.sub(r"<\\(\\*)\|", r"<\1|", "\x01".join(shown)) == "\x01".join(r[3] or "" for r in turns if r[2] == "assistant")
    assert all("<|" not in re.sub(r"<\|im_(start|end)\|>", "", r.formatted) for r in got.values())
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_words_and_hashes():
    buf = np.frombuffer(b"Ab  cd\tef\x0bgh", np.uint8)
    s, e, row = textops.words(buf, np.array([0, 4, 4, 12]))
    assert [bytes(buf[a:b]) for a, b in zip(s, e)] == [b"Ab", b"cd", b"ef", b"gh"] and row.tolist() == [0, 2, 2, 2]
    c = textops.running(np.frombuffer(b"abcabc", np.uint8))
    h = textops.range_hash(c, np.array([0, 3, 0]), np.array([3, 6, 2]))
    assert h[0] == h[1] != h[2]
