"""Corpus pipeline: from raw documents to token ids.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes what a stage returns to the shared folder and reads it
back for the next one. All stages but the last return the columns of ``documents``. An empty table gives an empty one at every
stage; very long texts are read whole; columns beside doc_id, text, lang and n_chars are passed on unread, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.byte_bpe import token_digests
from llm.common import cut, table
from llm.greedy_tiling import decontaminated
from llm.jaccard_join import one_of_each
from llm.quality_rules import passing
from llm.substring_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts among them. A null language is one of its own;
    repeated rows and rows with a null doc_id are each judged by their text."""
    return passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least doc_id; of rows that share a doc_id one. Texts
    without words and rows with a null doc_id are in no group and stay."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words or more that stand more than once are cut out; n_chars follows the text. No row goes: null and
    short texts stay as they are, and repeated rows, being copies of each other, lose what they share."""
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; repeated rows and rows with a null doc_id are each
    judged by their text."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of what they decode to, a row for each row; null and empty texts have no ids."""
    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", tokens),
]

#: No stage but the base counts can be said in SQL that runs on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
