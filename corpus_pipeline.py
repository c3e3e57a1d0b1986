"""Corpus preparation: each stage works on all rows that the stage before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written and read again before the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import bpe, decontaminate, langid, line_windows, simhash
from faultlens.operators.sizing import settle

WORDS = 5  # words in a shingle of near-duplicates
SIMILARITY = 0.8  # Jaccard similarity of the shingle sets from which two texts are near-duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learned from the labelled rows; rows it rejects (no letters, or a calibrated
    confidence below the threshold) go. A missing ``lang`` becomes the predicted language."""
    model = langid.fit(docs, "text", "lang", F.col("doc_id"))
    found = langid.predict(docs, model).filter(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; ``n_chars`` follows the text."""
    kept = line_windows.remove_repeats(docs)
    size = F.when(F.col("n_lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    return simhash.keep_representatives(docs, words=WORDS, similarity=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, encoded, decoded and compared with the text."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(docs, path, pattern)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", tokens),
]

ORACLE_SQL = None  # language ID, SimHash and BPE are beyond SQL; tests hold both dedup stages and the digests against plain code


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
