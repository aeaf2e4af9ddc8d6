"""The nearest past examples of a vector, by an index of coarse cells.

Centroids are fitted on a bounded sample; every vector is put into the cell of its
nearest centroid. A search scores the vectors of the cells nearest to the query.
Where the exact answer is asked for, the distance of the worst one found bounds
what any other cell may hold (a cell's vectors are within its radius), and the
cells that the bound does not rule out are scored too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import normalized
from .scratch import written

#: Vectors that centroids are fitted on at most, those of least hash; rounds of that fit.
SAMPLE, ROUNDS = 20_000, 10
#: Cells searched first; vectors of a cell that one task scores at once; queries multiplied at once.
PROBES, PIECE, BLOCK = 8, 20_000, 256


@dataclass
class Index:
    """rows: id, at, vector (of length one), cell, piece. For each cell its centroid, its radius and in how many pieces it is scored."""

    rows: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    pieces: np.ndarray


def _unit(vectors: DataFrame, id_column: str, vector_column: str, at: str | None) -> DataFrame:
    unit = normalized(F.col(vector_column))
    return vectors.select(F.col(id_column).cast("long").alias("id"), (F.col(at) if at else F.lit(None)).cast("double").alias("at"), unit.alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)))


def fit_centroids(rows: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of the ``sample`` vectors of least hash, which is all that the driver gets."""
    chosen = rows.select("vector", F.xxhash64("id", "vector").alias("h")).orderBy("h", "vector").limit(sample).collect()
    if not chosen:
        return np.zeros((0, 0))
    x = np.array([r.vector for r in chosen])
    centroids = x[: min(cells, len(x))].copy()
    for _ in range(rounds):
        near = _distances(x, centroids).argmin(1)
        for c in np.unique(near):
            centroids[c] = x[near == c].mean(0)
    return centroids


def _into_cells(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _distances(np.stack(pdf["vector"].to_numpy()), centroids)
                near = d.argmin(1)
                yield pdf.assign(cell=near.astype(np.int32), away=d[np.arange(len(d)), near])

    return run


def build(vectors: DataFrame, id_column: str = "id", vector_column: str = "embedding", at: str | None = None, cells: int = 64, sample: int = SAMPLE) -> Index:
    """An index of every usable vector (finite, not zero) that has an id. Vectors are compared by their direction; at names a column of times."""
    rows = _unit(vectors, id_column, vector_column, at)
    centroids = fit_centroids(rows, cells, sample)
    schema = "id long, at double, vector array<double>, cell int, away double"
    placed = written(rows.mapInPandas(_into_cells(centroids), schema), "cells") if len(centroids) else vectors.sparkSession.createDataFrame([], schema)
    radius, pieces = np.full(len(centroids), -1.0), np.zeros(len(centroids), np.int64)
    for r in placed.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # one row a cell
        radius[r.cell], pieces[r.cell] = r.radius, -(-r.n // PIECE)
    of_cell = F.element_at(F.array(*(F.lit(int(p)) for p in pieces)), F.col("cell") + 1) if len(centroids) else F.lit(1)
    return Index(placed.withColumn("piece", F.pmod(F.xxhash64("id"), of_cell)).drop("away"), centroids, radius, pieces)


def _probed(index: Index, probes: int, rest: bool):
    """The cells of each query: the nearest ones, or of the others those that its bound does not rule out. One row for each piece."""
    centroids, radius, pieces = index.centroids, index.radius, index.pieces

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            d = _distances(np.stack(pdf["query"].to_numpy()), centroids)
            order = np.argsort(np.where(pieces > 0, d, np.inf), axis=1, kind="stable")
            near = np.zeros(d.shape, bool)
            np.put_along_axis(near, order[:, :probes], True, 1)
            use = (~near & (d - radius <= pdf["bound"].to_numpy()[:, None] + 1e-9) if rest else near) & (pieces > 0)
            row, cell = np.nonzero(use)
            row, cell = np.repeat(row, pieces[cell]), np.repeat(cell, pieces[cell])
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1]))) if len(row) else np.zeros(0, bool)
            piece = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
            yield pdf[["query_id", "at", "query"]].iloc[row].assign(cell=cell.astype(np.int32), piece=piece)

    return run


def _scored(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The k best of a piece for each of its queries. Similarities are rounded, so that equal vectors are equally near."""
        out = [pd.DataFrame({"query_id": [], "id": [], "similarity": []}).astype({"query_id": "int64", "id": "int64"})]
        if len(queries) and len(rows):
            rows = rows.sort_values("id")
            x, ids, at = np.stack(rows["vector"].to_numpy()), rows["id"].to_numpy(), rows["at"].to_numpy(float)
            for first in range(0, len(queries), BLOCK):
                q = queries.iloc[first : first + BLOCK]
                own, then = q["query_id"].to_numpy(), q["at"].to_numpy(float)
                s = np.round(np.stack(q["query"].to_numpy()) @ x.T, 12)
                s[(ids == own[:, None]) | (~np.isnan(then[:, None]) & ~(at < then[:, None]))] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                found = np.take_along_axis(s, best, 1)
                r, c = np.nonzero(found > -np.inf)
                out.append(pd.DataFrame({"query_id": own[r], "id": ids[best[r, c]], "similarity": found[r, c]}))
        return pd.concat(out)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 3, id_column: str = "id", vector_column: str = "embedding", at: str | None = None, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """query_id, rank, id, similarity (cosine): the k nearest examples of each query, of equally near ones those of least id.

    A query is never its own example. With ``at``, only examples of an earlier time
    count. Queries without an id or a usable vector get no rows. exact=False
    scores the ``probes`` nearest cells; exact=True also all that could hold a
    nearer one. A query id should stand for one query.
    """
    schema = "query_id long, id long, similarity double"
    spark = queries.sparkSession
    if not len(index.centroids):
        return spark.createDataFrame([], schema + ", rank int").select("query_id", "rank", "id", "similarity")
    asked = _unit(queries, id_column, vector_column, at).withColumnsRenamed({"id": "query_id", "vector": "query"})
    cells = "query_id long, at double, query array<double>, cell int, piece long"
    score = lambda probed: probed.groupBy("cell", "piece").cogroup(index.rows.groupBy("cell", "piece")).applyInPandas(_scored(k), schema)
    found = score(asked.withColumn("bound", F.lit(None).cast("double")).mapInPandas(_probed(index, probes, False), cells))
    if exact:
        found = written(_best(found, k), "first")
        bounds = found.groupBy("query_id").agg(F.min("similarity").alias("s"), F.count(F.lit(1)).alias("n"))
        bound = F.when(F.col("n") == k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s")))).otherwise(float("inf"))
        again = asked.join(bounds, "query_id", "left").select("query_id", "at", "query", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
        found = found.select("query_id", "id", "similarity").union(score(again.mapInPandas(_probed(index, probes, True), cells)))
    return _best(found, k).select("query_id", "rank", "id", "similarity")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true examples (query_id, id) that were found; 1 where there are none."""
    hit = truth.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    r = hit.agg(F.count("hit").alias("hit"), F.count(F.lit(1)).alias("n")).first()
    return r.hit / r.n if r.n else 1.0


def calibrated(index: Index, queries: DataFrame, k: int = 3, id_column: str = "id", vector_column: str = "embedding", at: str | None = None, target: float = 0.95, sample: int = 200) -> int:
    """How many cells to probe, so that the share ``target`` of true examples is found for at most ``sample`` of the queries, those of least hash.

    Their exact examples are looked up; the cell of each has a place in the order
    in which its query probes cells, and the target's quantile of these places is
    the answer.
    """
    asked = queries.orderBy(F.xxhash64(F.col(id_column)), F.col(id_column)).limit(sample)
    truth = search(index, asked, k, id_column, vector_column, at, exact=True)
    rows = _unit(asked, id_column, vector_column, at).select(F.col("id").alias("query_id"), "vector")
    found = truth.join(rows, "query_id").join(index.rows.select("id", "cell"), "id").select("vector", "cell").collect()  # sample * k rows
    if not found:
        return PROBES
    d = _distances(np.array([r.vector for r in found]), index.centroids)
    d = np.where(index.pieces > 0, d, np.inf)
    place = (d < d[np.arange(len(d)), [r.cell for r in found]][:, None]).sum(1)
    return int(np.quantile(place, target, method="higher")) + 1
