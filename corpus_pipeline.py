"""A corpus pipeline over `documents`: language ID, near-dedup, repeated passages, mixing, SentencePiece ids.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents. run() applies them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import lang_id, minhash_dedup, mixing, spm, suffix_dedup
from tramline.session import fresh, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, or a mixture of languages, that the labelled ones teach: those go that have no letter, or whose trigrams no mixture explains better than chance."""
    made = ["lang_pred", "score", "lang_set", "evidence"]
    aside = {c: fresh([*docs.columns, *made], f"{c}_own")[0] for c in docs.columns if c.lower() in made}
    found = lang_id.identify(docs.withColumnsRenamed(aside), docs)
    return found.filter((F.col("lang_pred") != "und") & (F.col("evidence") > 0)).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8 or more)."""
    return minhash_dedup.one_of_each(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of byte strings of 200 or more."""
    return suffix_dedup.without_repeats(docs, 200)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to source weights of size ** 0.7, shuffled."""
    return mixing.mix(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids."""
    return spm.encode(docs, spm.MODEL)


STAGES = [
    ("language_id", language),
    ("minhash_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("source_mixing", mixed),
    ("sentencepiece", encoded),
]

#: Suffix arrays, mixtures and piece vocabularies are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
