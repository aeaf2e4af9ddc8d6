import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidelake.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, n long"


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cs = [v for _, v in start[:k]]
    if not cs:
        return []
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((d2(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [[] for _ in cs]
        for _, v in kept:
            own[near(v)[1]].append(v)
        cs = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(own, cs, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    by = {j: sum(d for _, d, x in found if x == j) for j in range(len(cs))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, j, d, by[j], sum(by.values()), sha[j]) for i, d, j in found), key=str)


def result(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=str)


def vectors(n, dims, seed, spread=4):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(spread)]
    return [(i, [float(np.float32(c + r.gauss(0, 0.2))) for c in r.choice(centres)]) for i in range(n)]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", 1) for i, v in rows], schema).repartition(5)


@pytest.mark.parametrize(("dims", "k"), [(64, 12), (9, 5), (3, 40)])
def test_against_plain_search(spark, dims, k):
    rows = vectors(150, dims, dims)
    rows += [(1000 + i, v) for i, v in rows[:30]]  # ties
    rows += [(7, rows[0][1]), (None, rows[1][1]), (2000, None), (2001, []), (2002, rows[2][1][:-1]), (2003, [None, *rows[3][1][1:]]), (2004, [float("nan"), *rows[3][1][1:]]), (2005, [float("-inf"), *rows[3][1][1:]])]
    assert result(clustering.cluster(frame(spark, rows), clusters=k, rounds=3, dimensions=dims)) == brute(rows, k, 3, dims)


def test_empty_tables_and_missing_ids(spark):
    assert clustering.cluster(frame(spark, [])).collect() == []
    assert clustering.cluster(frame(spark, [(None, [0.5] * 64)])).collect() == []
    rows = [(1, [0.5] * 64)] * 3
    assert result(clustering.cluster(frame(spark, rows))) == brute(rows, 40, 5, 64)


def test_extreme_components_count_as_the_bound(spark):
    rows = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [float(1 << 19)] * 64)]
    got = {r.vec_id: r for r in clustering.cluster(frame(spark, rows, SCHEMA.replace("float", "double")), clusters=1, rounds=0).collect()}
    assert {r.distance for r in got.values()} == {0, 64 << 56} and got[1].distance == got[3].distance


def test_search_gives_up_centroids_without_changing_the_answer():
    r = np.random.default_rng(5)
    x, c = r.integers(-300, 300, (500, 64)), r.integers(-300, 300, (40, 64))
    c[7] = c[3]
    full = ((x[:, None] - c) ** 2).sum(2)
    for order in (np.arange(64), r.permutation(64)):
        which, d = clustering.nearest(x, c, order)
        assert (which == full.argmin(1)).all() and (d == full.min(1)).all()
    assert clustering.integers(pa.array([[0.1, None], None, [-0.001, 1.0]], pa.list_(pa.float32())), 2)[1].tolist() == [[-1, 256]]
