"""Filters and orders of whole document tables, for pipelines: every row's columns are kept.

Null and empty texts are texts like others (without words, hence similar to none).
Rows may lack an id or share one: rows are told apart by all their columns, and
rows that are equal in all of them are interchangeable. Empty tables give empty
tables; columns beside doc_id, text and source are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ascii_lower, row_key
from .exact_dedup import dedup_groups
from .mixing import curriculum
from .ngram_join import similarity_components

_KEY = "row key of this table"


def keep_one_copy(docs: DataFrame) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows that also share the id, one. Texts are shuffled once here, to drop the others."""
    dropped = dedup_groups(docs).where(~F.col("kept")).select(F.col("doc_id").alias("dropped_id"), F.col("text_sha256").alias("dropped_sha"), "keep_id")
    repeated = dropped.where(F.col("dropped_id").eqNullSafe(F.col("keep_id"))).select("dropped_id", "dropped_sha")
    dropped = dropped.where(~F.col("dropped_id").eqNullSafe(F.col("keep_id"))).select("dropped_id", "dropped_sha")
    own = docs.withColumn("own_sha", F.sha2(ascii_lower(F.col("text")), 256))
    same = lambda of: own["doc_id"].eqNullSafe(of["dropped_id"]) & (own["own_sha"] == of["dropped_sha"])
    out = own.join(dropped, same(dropped), "left_anti")
    if repeated.limit(1).count():  # the row that stays is there several times
        out = out.dropDuplicates(["doc_id", "own_sha"])
    return out.select(docs.columns)


def _ids(docs: DataFrame) -> tuple[bool, bool]:
    """Whether any id is missing, and whether any occurs in several rows."""
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    missing, most = counts.agg(F.max(F.col("doc_id").isNull()), F.max(F.when(F.col("doc_id").isNotNull(), F.col("n")))).first()
    return bool(missing), (most or 0) > 1


def keep_one_of_similar(docs: DataFrame) -> DataFrame:
    """Of each component of similar documents the one with the least doc_id, or else one without an id.

    Rows that share the least id are told apart by a 64-bit hash of all their
    columns, of which the least stays; rows that are equal in all of them count as
    one, where ids are missing or repeated.
    """
    columns = docs.columns
    missing, repeated = _ids(docs)
    hashed = F.xxhash64(row_key(docs))
    if repeated:
        key = hashed
    else:  # rows without an id come after all others
        key = F.coalesce(F.col("doc_id").cast("long"), hashed.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))) if missing else F.col("doc_id").cast("long")
    docs = docs.withColumn(_KEY, key)
    if missing or repeated:
        docs = docs.dropDuplicates([_KEY])
    found = similarity_components(docs, _KEY)
    if repeated:  # components are named by hashes, and stand for their row of least (id, hash)
        ids = docs.select(F.col(_KEY).alias("key"), F.col("doc_id").alias("id"))
        of = found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).join(ids, "key")
        stays = of.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("x"))
        return docs.join(stays.select(F.col("x.key").alias(_KEY)), _KEY, "left_semi").select(columns)
    dropped = found.where("doc_id != component_id").select(F.col("doc_id").alias(_KEY))
    return docs.join(dropped, _KEY, "left_anti").select(columns)


def in_training_order(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, once for each pass over their source, sorted by training position.

    Every row has its own place in its source's stream and its own positions,
    also where ids are missing or repeated.
    """
    columns = docs.columns
    own = docs.withColumn(_KEY, row_key(docs))
    plan = curriculum(own, _KEY).select(F.col("doc_id").alias(_KEY), F.explode(F.filter(F.array("position", "position_2"), lambda p: p.isNotNull())).alias("at"))
    if any(_ids(docs)):
        own = own.dropDuplicates([_KEY])  # equal rows: each is sent to the places of all
    return own.join(plan, _KEY).orderBy("at", _KEY).select(columns)
