"""A corpus from raw documents to token ids, in stages.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns the table that the next one reads. All but the last return the columns of
documents. Rows without an id, repeated rows, extra columns and empty tables pass
through every stage; the order of training is that of the rows that the mix
returns, and so of its files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelake.llm import base, quality, sentencepiece_bpe, stages


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps; null and empty texts are judged as texts without words."""
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts, null and empty ones being equal: the row with the largest doc_id."""
    return stages.keep_one_copy(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of similar texts, the row with the least doc_id; texts without words are similar to none."""
    return stages.keep_one_of_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, once for each pass over their source; texts without words are in no pass."""
    return stages.in_training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of ids and of the decoded text of every row."""
    return sentencepiece_bpe.encoded_with_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", reject_poor),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("source mixing", mix),
    ("sentencepiece encoding", encode),
]

ORACLE_SQL = None  # components of similar texts, a trained classifier and a merge table are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = base.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
