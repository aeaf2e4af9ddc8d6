"""Clusters of vectors around integer centroids, by partial-distance search.

A vector's components become integers, so distances, sums and floors are exact and
every run gives the same centroids. A task searches a batch at a time: squared
differences are summed over the dimensions of highest variance first, a centroid
is given up once its partial sum is strictly above the distance to the best one
known, and what survives finishes all dimensions. Each round reads the vectors
again and sends one row for each cluster and task; only centroids, whose number is
a parameter, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bound_batches, materialise

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 40, 5, 64, 256
#: Dimensions summed before centroids are given up; vectors searched at once.
EDGES, ROWS = (8, 16, 32), 1024
_LONG = (1 << 63) - 1


def _limit(dimensions: int) -> int:
    """Components are kept within this, so that no squared distance leaves 63 bits."""
    return 1 << (62 - (dimensions - 1).bit_length()) // 2 - 1


def integers(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold that many finite components, and floor(SCALE * x) of these rows' components."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), dimensions), False)
    kept = column.filter(ok)
    x = kept.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(kept), dimensions)
    finite = np.isfinite(x).all(1)
    ok = ok.to_numpy(zero_copy_only=False)
    ok[np.flatnonzero(ok)[~finite]] = False
    most = float(_limit(dimensions))
    with np.errstate(over="ignore"):
        return ok, np.clip(np.floor(x[finite] * SCALE), -most, most).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of x, the first of equally near ones, and its squared distance."""
    x, c = x[:, order], centroids[:, order]
    edges = [*(e for e in EDGES if e < len(order)), len(order)]
    first = edges[0]
    partial = ((x[:, None, :first] - c[None, :, :first]) ** 2).sum(2)
    guess = partial.argmin(1)
    best = ((x - c[guess]) ** 2).sum(1)
    row, which = np.nonzero(partial <= best[:, None])
    d = partial[row, which]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        d = d + ((x[row, a:b] - c[which, a:b]) ** 2).sum(1)
        alive = d <= best[row]
        row, which, d = row[alive], which[alive], d[alive]
    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))  # the guess survives, so every row is there
    least = np.minimum.reduceat(d, start)
    hit = np.flatnonzero(d == np.repeat(least, np.diff(np.append(start, len(row)))))
    return which[hit[np.searchsorted(hit, start)]], least


def _batches(batches: Iterator[pa.RecordBatch], dimensions: int, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ok, x = integers(part.column(column), dimensions)
            if len(x):
                yield part.filter(pa.array(ok)), x


def _moments(dimensions: int):
    """Each partition's number of vectors, sums and sums of squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dimensions), np.zeros(dimensions)
        for _, x in _batches(batches, dimensions, 0):
            n, s, q = n + len(x), s + x.sum(0), q + (x.astype(float) ** 2).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [s], "q": [q]})

    return run


def _totals(centroids: np.ndarray, order: np.ndarray):
    """Each partition's number of vectors and componentwise sums by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, x in _batches(batches, centroids.shape[1], 0):
            cluster, _ = nearest(x, centroids, order)
            np.add.at(total, cluster, x)
            count += np.bincount(cluster, minlength=len(count))
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _assigned(centroids: np.ndarray, order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches(batches, centroids.shape[1], 1):
            cluster, distance = nearest(x, centroids, order)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def _starting(vectors: DataFrame, clusters: int, dimensions: int) -> np.ndarray:
    """The integer vectors of least digest of their id; of rows that share an id the least vectors come first."""
    usable = (F.size("embedding") == dimensions) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & usable).select(F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256).alias("h"), "embedding")
    found = [r.embedding for r in rows.orderBy("h", "embedding").limit(clusters).collect()]
    return integers(pa.array(found, pa.list_(pa.float64())), dimensions)[1]


def variance_order(vectors: DataFrame, dimensions: int) -> np.ndarray:
    """Dimensions by falling variance."""
    sums = [F.sum("n").alias("n"), *(F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in "sq" for i in range(dimensions))]
    m = vectors.select("embedding").mapInArrow(_moments(dimensions), "n long, s array<double>, q array<double>").agg(*sums).first()
    if not m.n:
        return np.arange(dimensions)
    return np.argsort([(m[f"s{i}"] / m.n) ** 2 - m[f"q{i}"] / m.n for i in range(dimensions)], kind="stable")


def centroids_of(vectors: DataFrame, clusters: int, rounds: int, dimensions: int, order: np.ndarray) -> np.ndarray:
    """Centroids after that many rounds; fewer than asked for where there are fewer vectors with an id."""
    centroids = _starting(vectors, clusters, dimensions)
    sums = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dimensions)]
    for _ in range(rounds if len(centroids) else 0):
        found = vectors.select("embedding").mapInArrow(_totals(centroids, order), "cluster int, n long, total array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), *sums)
        centroids = centroids.copy()
        for r in found.collect():  # one row a cluster
            centroids[r.cluster] = [r[f"t{i}"] // r.n for i in range(dimensions)]
    return centroids


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of that many finite components.

    Null vectors, those of another length and those with a null, NaN or infinite
    component are left out. Rows without an id are assigned but never start a
    centroid; rows that share an id are vectors like others. Where no vector has an
    id, and in an empty table, there are no centroids and no rows. Components
    beyond 2 ** 27 (for 64 dimensions) count as that bound, and inertias beyond
    the largest long as that one. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    source = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding"))
    order = variance_order(source, dimensions)
    centroids = centroids_of(source, clusters, rounds, dimensions, order)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    found = materialise(source.mapInArrow(_assigned(centroids, order), schema), "assigned")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(sums.values()), _LONG)
    facts = [(j, min(s, _LONG), total, hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, s in sums.items()]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster
