"""A training-data pipeline over documents: each stage works on all that the stage before it kept.

Stages, in order: a line-level quality classifier (rejected documents go), MinHash near-dedup on five-word shingles at a similarity of
0.8 (one document of each group stays), removal of repeated passages (texts shrink, documents stay), benchmark decontamination
(documents that hold test items go), BPE encoding (adds ids and n_tokens). All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from changeloom.llm import decontam, near_dup, quality, repeats, word_bpe
from changeloom.llm.common import discard, materialize, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs, n=5, percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.kept_text(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return word_bpe.encode_stage(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("passages", passage_dedup),
    ("decontaminate", decontaminate),
    ("bpe", encode),
]

#: A trained classifier and a tokenizer have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
