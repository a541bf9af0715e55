"""The pipeline's stages, one by one, and as a whole."""

import pytest
from conftest import SF


def test_stages_and_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tramline.session import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(10_001, "12345 !!!", "en", "src0", 9), (10_002, None, None, None, None)], docs.schema)
    copies = docs.filter("doc_id < 5").selectExpr("doc_id + 20000 as doc_id", "text", "lang", "source", "n_chars")
    docs = written(docs.unionByName(junk).unionByName(copies), "docs")
    columns = docs.columns
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) in (4, 5)
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        seen[name] = docs
        assert docs.columns == columns if name != names[-1] else set(columns) < set(docs.columns)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert not {10_001, 10_002} & ids(seen["language_id"])
    assert not any(i >= 20_000 for i in ids(seen["minhash_dedup"])) and {0, 1, 2, 3, 4} & ids(seen["minhash_dedup"])
    assert seen["suffix_dedup"].count() == seen["minhash_dedup"].count()
    assert seen["sentencepiece"].filter("not round_trip").count() == 0


def test_run_equals_a_brute_force_version(spark, tmp_path):
    """The whole pipeline on sixty documents, against each stage's definition."""
    import hashlib
    import math

    import sentencepiece
    from test_text_operators import brute_components, brute_repeats

    pipeline = pytest.importorskip("corpus_pipeline")
    from tramline.llm import lang_id, spm

    own = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) between 300 and 3000 and lang is not null").orderBy("doc_id").limit(40).collect()
    passage = own[0].text[:260]
    rows = [tuple(r) for r in own]
    rows += [(1000 + i, r.text.replace(" ", "  ", 1) + " end", r.lang, r.source, 0) for i, r in enumerate(own[5:15])]
    rows += [(2000 + i, f"{r.text[:200]} {passage} {r.text[200:400]}", r.lang, r.source, 0) for i, r in enumerate(own[20:26])]
    rows += [(3000, "1234 !!!", "en", "src0", 8), (3001, None, None, "src0", None), (3002, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).toPandas()

    kept = {r.doc_id for r in lang_id.identify(docs, docs).filter("lang_pred <> 'und' and evidence > 0").collect()}
    assert kept == {r[0] for r in rows} - {3000, 3001, 3002}  # every document with letters is clean
    rows = sorted(r for r in rows if r[0] in kept)
    first = {c for _, _, c in brute_components([(r[0], r[1]) for r in rows], 5)}
    rows = [r for r in rows if r[0] in first]
    assert len(rows) < len(kept)
    left = [b.decode("utf-8", "ignore") for b in brute_repeats([r[1] for r in rows], 200, True)]
    assert sum(len(a) < len(r[1]) for a, r in zip(left, rows)) >= 5
    size = {}
    for r, text in zip(rows, left):
        size[r[3]] = size.get(r[3], 0) + len(text) + 1
    whole, weight = sum(size.values()), {s: n**0.7 for s, n in size.items()}
    library = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    want = []
    for r, text in zip(rows, left):
        rate = weight[r[3]] / sum(weight.values()) * whole / size[r[3]]
        u = int(hashlib.md5(f"0|count|{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        n, p, below = 0, math.exp(-rate), math.exp(-rate)
        while below <= u:
            n += 1
            p *= rate / n
            below += p
        want += [(r[0], text, library.encode(text))] * n
    assert sorted((i, t, list(x)) for i, t, x in zip(got.doc_id, got.text, got.ids)) == sorted(want)
