"""Exact deduplication by content-defined chunk recipes.

A text (A-Z lower-cased, null as empty) is cut where the hash of the last
``WINDOW`` bytes meets a condition, so equal texts are cut alike. Each distinct
chunk is moved once to verify that its identifier stands for one content; after
that a document is its ordered list of identifiers. Only these short lists are
compared, within groups of one digest; a group of any size is joined back in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .base import bound_batches, join_groups, materialise

WINDOW = 48
#: Mean and greatest bytes of a chunk.
MEAN, MOST = 4096, 65536
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Identifiers tried in turn: the second only if contents collide under the first.
_DIGESTS = (lambda b: xxhash.xxh3_128_digest(b), lambda b: hashlib.sha256(b).digest())
_CHUNKS, _RECIPES = "cid binary, body binary", "uid long, doc_id long, sha string, rid binary, recipe binary"


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text; depends on its bytes alone."""
    n = len(data)
    ends = np.zeros(0, np.int64)
    if n > WINDOW:
        sums, inverse = hashing.prefix_sums(data, hashing._TABLE)
        rolling = hashing.finalise((sums[WINDOW:] - sums[:-WINDOW]) * inverse[: n + 1 - WINDOW])
        ends = np.flatnonzero(rolling % np.uint64(MEAN) == 0) + WINDOW
    out, last = [], 0
    for e in [*ends.tolist(), n]:
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e > last:
            out.append(e)
            last = e
    return np.array(out, np.int64)


def _texts(batch: pa.RecordBatch, start: int) -> Iterator[tuple[int | None, bytes]]:
    for doc, text in zip(batch.column(0).slice(start, 256).to_pylist(), batch.column(1).slice(start, 256), strict=True):
        yield doc, text.as_buffer().to_pybytes().translate(_FOLD) if text.is_valid else b""


def _pieces(raw: bytes) -> Iterator[bytes]:
    last = 0
    for e in cuts(np.frombuffer(raw, np.uint8)).tolist():
        yield raw[last:e]
        last = e


def _chunks(digest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                bodies = {p: None for _, raw in _texts(batch, start) for p in _pieces(raw)}
                yield pa.RecordBatch.from_arrays([pa.array([digest(p) for p in bodies], pa.binary()), pa.array(list(bodies), pa.binary())], ["cid", "body"])

    return run


def _listed(digest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                docs = list(_texts(batch, start))
                lists = [b"".join([digest(p) for p in _pieces(raw)]) for _, raw in docs]  # identifiers are of one length
                columns = (range(uid, uid + len(docs)), [d for d, _ in docs], [hashlib.sha256(raw).hexdigest() for _, raw in docs], [xxhash.xxh3_128_digest(x) for x in lists], lists)
                uid += len(docs)
                types = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["uid", "doc_id", "sha", "rid", "recipe"])

    return run


def recipes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(uid, doc_id, sha, rid, recipe) of every row, recipes being lists of verified identifiers, rid their digest; uid tells rows apart.

    The chunks' bytes are shuffled once, less what is equal within a map task.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    for digest in _DIGESTS:
        contents = source.mapInArrow(_chunks(digest), _CHUNKS).groupBy("cid").agg(F.min("body").alias("a"), F.max("body").alias("b"))
        if contents.where("a != b").limit(1).count() == 0:
            return materialise(source.mapInArrow(_listed(digest), _RECIPES), "recipes")
    raise RuntimeError("two different chunks share a SHA-256")


def dedup_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, uid, keep_id, group_size, kept, text_sha256 for every row.

    Null and empty texts are equal. The row with the largest id stays; null ids
    come last, and of rows with the same id and text exactly one stays. An empty
    table gives no rows; other columns are ignored.
    """
    r = recipes(docs, id_column, text_column)
    best = F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("rank"), F.col("doc_id").alias("id"), "uid")).alias("best")
    groups = materialise(r.groupBy("rid").agg(best, F.count(F.lit(1)).alias("group_size"), (F.min("recipe") == F.max("recipe")).alias("equal")), "groups")
    key = "rid"
    if groups.where("not equal").limit(1).count():  # two lists share a digest: the lists themselves are the key
        key = "recipe"
        groups = materialise(r.groupBy(key).agg(best, F.count(F.lit(1)).alias("group_size")), "groups")
    out = join_groups(r.select("doc_id", "uid", "sha", key), groups.select(key, "best", "group_size"), [key], "group_size")
    return out.select("doc_id", "uid", F.col("best.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("sha").alias("text_sha256"))
