"""Similar names and vectors: copies cost rows, not pairs."""

import random
from collections import Counter
from functools import reduce
from math import sqrt
from operator import add, mul

import pytest
from pyspark.sql import functions as F

from tidelake.functions import text, vectors


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def cosine(a, b):
    """Added up from the left, as SQL does."""
    dot = lambda x, y: reduce(add, map(mul, x, y), 0.0)
    return dot(a, b) / (sqrt(dot(a, a)) * sqrt(dot(b, b)))


@pytest.mark.parametrize("buckets", [1, 5, None])
def test_nearest_makes_no_row_of_a_pair(spark, buckets):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(40)] + [(200 + i, [2 * x for x in rows[0][1]]) for i in range(3)]
    base = spark.createDataFrame([*rows, (300, None), (301, [0.0] * 6), (302, [1.0])], "id long, embedding array<double>")
    asked = base.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    found = vectors.nearest(asked, base, 3, buckets)
    assert "Join" not in plan(found)
    want = [(q, i) for q, x in rows if q % 5 == 0 for _, i in sorted((-cosine(x, y), i) for i, y in rows if i != q)[:3]]
    assert sorted((x.query_id, x.id) for x in found.collect()) == sorted(want)
    scored = {(x.query_id, x.id): x.similarity for x in found.collect()}
    by = dict(rows)
    assert all(scored[q, i] == cosine(by[q], by[i]) for q, i in want)
    assert vectors.nearest(asked, base.limit(0), 3).collect() == []


def likeness(a, b):
    grams = lambda t: Counter(t[i : i + 3] for i in range(max(1, len(t) - 2)))
    x, y = (grams(t.replace(" ", "").lower()) for t in (a, b))
    return sum(n * y[g] for g, n in x.items()) / (sqrt(sum(n * n for n in x.values())) * sqrt(sum(n * n for n in y.values())))


NAMES = ["blue anvil", "Blue  Anvil", "blue anvils", "old widget", "hot bolt", "ab", "hot bolts x"]


def named(spark, n, key, name):
    return spark.createDataFrame([(i, NAMES[i % len(NAMES)]) for i in range(n)] + [(5000, None), (5001, " ")], f"{key} long, {name} string")


def test_copies_of_names_are_asked_for_once(spark, monkeypatch):
    """700 copies of names against 700 are 6 forms against 6."""
    sizes, alike = [], text._alike
    monkeypatch.setattr(text, "_alike", lambda a, b, least: sizes.append((a.count(), b.count())) or alike(a, b, least))
    left, right = named(spark, 700, "a", "x"), named(spark, 700, "b", "y")
    got = sorted((r.a, r.rank, r.b) for r in text.top_names(left, right, "a", "x", "b", "y", 3).collect())
    want = []
    for i in range(700):
        best = sorted((-round(likeness(NAMES[i % 7], NAMES[j % 7]), 12), j) for j in range(21))
        want += [(i, rank, j) for rank, (s, j) in enumerate(best[:3], 1) if s]
    assert got == sorted(want) and sizes and all(a <= 6 and b <= 6 for a, b in sizes)
    one = text.top_names(left, right, "a", "x", "b", "y", 1, 0.9).collect()
    assert len(one) == 700 and all(r.rank == 1 for r in one)


def test_pairs_of_classes_and_their_members(spark):
    """pairs stand between classes; with the members they give all pairs."""
    left, right = named(spark, 70, "a", "x"), named(spark, 70, "b", "y")
    classes = text.similar_classes(left, right, "a", "x", "b", "y", 0.6)
    assert {(r.a, r.b) for r in classes.collect()} == {(i, j) for i in (0, 2, 3, 4, 5, 6) for j in (0, 2, 3, 4, 5, 6) if likeness(NAMES[i], NAMES[j]) >= 0.6}
    assert {(r.a, r["class"]) for r in text.members(left, "a", "x").collect()} == {(i, 0 if i % 7 == 1 else i % 7) for i in range(70)}
    whole = {(r.a, r.b) for r in text.similar_names(left, right, "a", "x", "b", "y", 0.6).collect()}
    assert whole == {(i, j) for i in range(70) for j in range(70) if likeness(NAMES[i % 7], NAMES[j % 7]) >= 0.6}


def test_classes_are_scored_in_pieces(spark, monkeypatch):
    """pieces of 2 against 2, few trigrams at once, copies once."""
    monkeypatch.setattr(text, "PIECE", 2)
    monkeypatch.setattr(text, "GRAMS", 3)
    left, right = named(spark, 70, "a", "x"), named(spark, 70, "b", "y")
    found = text.class_similarities(left, right, "a", "x", "b", "y").collect()
    one = (0, 2, 3, 4, 5, 6)
    want = {(i, j): round(likeness(NAMES[i], NAMES[j]), 12) for i in one for j in one if likeness(NAMES[i], NAMES[j])}
    assert {(r.a, r.b): round(r.similarity, 12) for r in found} == want
