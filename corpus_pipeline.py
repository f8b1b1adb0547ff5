"""The training-corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next one.

Documents of low quality go; of each group of near copies one stays; passages that occur twice or more are cut out; what
is left is packed into training sequences.  All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import ngramjoin, packing, quality, suffixes
from gleaner.llm.common import stored
from gleaner.sources.tables import table

NEAR_WORDS, NEAR_PERCENT = 5, 80
#: workers serve all stages in turn, so none may keep much for itself
KNOWN_WORDS = 150_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones outside the held-out fold."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at a Jaccard similarity of 0.8."""
    return ngramjoin.representatives(docs, NEAR_WORDS, NEAR_PERCENT)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that occur more than once."""
    return suffixes.cleaned(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): the places of all tokens in sequences of 4096."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), known_words=KNOWN_WORDS)


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("packing", pack)]
#: classifier weights, hashes of n-grams and token ids are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; the last one's rows are returned."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
