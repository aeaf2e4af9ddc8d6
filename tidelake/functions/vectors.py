"""Embeddings and scores, as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def usable(v: Column) -> Column:
    """Not null or empty, all numbers finite, not the zero vector."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & (norm(v) > 0), F.lit(False))


def normalized(v: Column) -> Column:
    """To length one; null where the vector is unusable."""
    return F.when(usable(v), F.transform(v, lambda x: x.cast("double") / norm(v)))


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x) / (norm(a) * norm(b))


def squash(score: Column) -> Column:
    """A score outside [0, 1] by the logistic function."""
    return F.when((score < 0) | (score > 1), 1 / (1 + F.exp(-F.greatest(F.lit(-709.0), F.least(F.lit(709.0), score))))).otherwise(score)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def shortened(text: Column, most: int = 2000) -> Column:
    return F.substring(text, 1, most)


def batch_number(position: Column, size: int) -> Column:
    return F.floor(position / size)


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (hash, model) of texts that the cache lacks."""
    return texts.dropDuplicates(["hash", "model"]).join(cache, ["hash", "model"], "left_anti")


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new rows in place of old ones of the same (hash, model)."""
    return cache.join(new, ["hash", "model"], "left_anti").unionByName(new)


def reorder(batches: DataFrame, items: str = "items") -> DataFrame:
    """Rows of (batch, array<struct(index, ...)>) as one row for each item, by its returned index."""
    return batches.select("batch", F.explode(items).alias("x")).select("batch", "x.*").orderBy("batch", "index")


#: Queries, and vectors, that one task scores at once at most on average; queries multiplied at once.
QUERIES, PIECE, BLOCK = 20_000, 20_000, 256
#: What a similarity by matrix product may be off.
SLACK = 1e-9


def _folded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up from the left as ``cosine`` does."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out = out + x[:, d] * y[:, d]
    return out


def _nearest_of_piece(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The k best of a piece for each of its queries.

        Of equal vectors the k + 1 least ids are enough, and each vector is multiplied
        once; those that come within SLACK of the k-th are scored again as ``cosine``
        does, so that ties are ties.
        """
        none = pd.DataFrame({"query_id": queries["query_id"].iloc[:0], "id": rows["id"].iloc[:0], "similarity": np.zeros(0)})
        if not len(queries) or not len(rows):
            return none
        rows = rows.sort_values("id", kind="stable")
        x, ids = np.stack(rows["embedding"].to_numpy()) + 0.0, rows["id"].to_numpy()
        _, first, which = np.unique(x.view(f"V{x.itemsize * x.shape[1]}")[:, 0], return_index=True, return_inverse=True)
        order = np.argsort(which, kind="stable")
        place = np.arange(len(order)) - np.searchsorted(which[order], which[order])
        order = order[place <= k]
        start = np.searchsorted(which[order], np.arange(len(first) + 1))
        x = x[first]
        size = np.sqrt(_folded(x, x))
        unit, out = x / size[:, None], [none]
        for at in range(0, len(queries), BLOCK):
            own = queries["query_id"].to_numpy()[at : at + BLOCK]
            q = np.stack(queries["query"].to_numpy()[at : at + BLOCK])
            length = np.sqrt(_folded(q, q))
            s = (q / length[:, None]) @ unit.T
            worst = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)] if len(first) > k else np.full(len(q), -np.inf)  # one may be the query itself
            i, j = np.nonzero(s >= worst[:, None] - SLACK)
            exact = _folded(q[i], x[j]) / (length[i] * size[j])
            copies = start[j + 1] - start[j]
            member = np.repeat(start[j] - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())
            found = pd.DataFrame({"query_id": np.repeat(own[i], copies), "id": ids[order[member]], "similarity": np.repeat(exact, copies)})
            found = found[found["query_id"] != found["id"]].sort_values(["query_id", "similarity", "id"], ascending=[True, False, True], kind="stable")
            out.append(found.groupby("query_id").head(k))
        return pd.concat(out)

    return run


def nearest(queries: DataFrame, base: DataFrame, k: int, buckets: int | None = None) -> DataFrame:
    """query_id, id, similarity: the k most similar of base for each query, exactly; of equally similar ones the least ids.

    Both sides are dealt into pieces; a task multiplies a piece of queries with a
    piece of base and keeps each query's best k, and the bests are merged. No pair
    is a row. Vectors that are not usable, or of another length than the query,
    have no similarity and are left out.
    """
    shaped = lambda df, c: df.where(usable(F.col(c))).withColumn(c, F.transform(c, lambda x: x.cast("double"))).withColumn("dims", F.size(c))
    buckets = buckets or max(16, -(-base.count() // PIECE))
    parts = max(1, -(-queries.count() // QUERIES))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    b = shaped(base.select("id", "embedding"), "embedding").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))).withColumn("part", span(parts))
    q = shaped(queries.select("query_id", "query"), "query").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).withColumn("bucket", span(buckets))
    keys = ("dims", "part", "bucket")
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(base.dtypes)['id']}, similarity double"
    found = q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(_nearest_of_piece(k), schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
