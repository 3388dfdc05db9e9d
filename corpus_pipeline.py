"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of documents.

Documents may hold nulls anywhere, repeat rows and ids, be empty or very long; the
tables may be empty and have further columns of any name. What a stage does then
is in its docstring, in full in its operator's.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, langid, linededup, mixing, simhash
from tallyspark.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language. Null and empty texts and those without a letter go, as all do where nothing is learned; repeats stay."""
    return langid.known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose templates recur, which stay in their first document.

    All rows stay, null texts as they are; rows of one id (all null ids together) count as one document. n_chars is counted again.
    """
    return linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the smallest doc_id; five-word shingles, similarity 0.8.

    Texts without a word (null, empty) are one group; of rows that repeat the smallest id one stays, the first by text; a null id stays only where its group has no other.
    """
    return simhash.one_of_each(docs, find=simhash.similar_documents, shingle_words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Those without a word are never taken; a null source is a source of its own; equal rows stand for each other."""
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; null text counts as empty, repeats each give a row."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("tokenise", tokenise),
]

#: Fingerprint linking, template clustering and pivotal rounding have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
