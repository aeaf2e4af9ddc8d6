"""Pairs of topics: lists and pairs are not exchanged, and a task holds two groups of topics."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tidelake.functions import text
from tidelake.operators import network, pairs, topics


def test_pairs_are_named_where_they_are_counted(spark):
    """no exchange and no join of lists or pairs."""
    r = random.Random(4)
    docs = [{f"t{min(int(r.expovariate(0.1)), 50)}" for _ in range(20)} for _ in range(80)]
    lists = spark.createDataFrame([(sorted(s),) for s in docs], "topics array<string>")
    df = topics.cooccurrence_of_lists(lists, 3, 0.1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    found, n = {(x.a, x.b): x.n_ab for x in df.collect()}, Counter(t for s in docs for t in s)
    both = Counter(p for s in docs for p in combinations(sorted(s), 2))
    assert found == {(a, b): c for (a, b), c in both.items() if c >= 3 and np.log(c * 80 / (n[a] * n[b])) >= 0.1 - 1e-12}


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize(("block", "own"), [(1 << 21, 1000), (50, 1000), (50, 1), (1 << 21, 1)])
def test_square_counts_in_blocks(monkeypatch, same, block, own):
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "OWN", own)
    monkeypatch.setattr(pairs, "SPAN", block)
    r = random.Random(block + own)
    square, want = pairs.Square(same), Counter()
    packed = lambda lists: pairs.pack(np.concatenate([s := np.array([len(x) for x in lists]), pairs.steps(s, np.array([v for x in lists for v in x], np.int64))]))
    for docs in (40, 1, 25):
        x, y = ([sorted(r.sample(range(30), r.choice([0, 1, 2, 12]))) for _ in range(docs)] for _ in range(2))
        y = x if same else y
        want.update((a, b) for s, t in zip(x, y, strict=True) for a in s for b in t if a < b or not same)
        square.add(docs, memoryview(packed(x)), memoryview(packed(y)))
    least = np.array([1 + i % 3 for i in range(30)], float)
    got = {(a, b): n for part in square.pairs(30, least) for a, b, n in zip(*map(np.ndarray.tolist, part), strict=True)}
    assert got == {(a, b): n for (a, b), n in want.items() if n >= least[a]}


def test_groups_hold_about_as_many_occurrences(monkeypatch):
    monkeypatch.setattr(topics, "MASS", 1000)
    row = type("row", (), {})
    sizes = []
    for n, count in ((2, 3000), (50, 100), (4000, 1)):
        sizes.append(row())
        sizes[-1].n, sizes[-1].topics = n, count
    first = topics._groups(sizes, 2, 40)
    each = np.repeat([2, 50, 4000], [3000, 100, 1])
    assert first[0] == 0 and first[-1] == 3101 and (np.diff(first) > 0).all()
    assert all(each[a:b].sum() <= 1100 or b - a == 1 for a, b in zip(first[:-1], first[1:], strict=True))


def test_documents_of_several_rows_are_one(spark):
    rows = [(1, ["a", "b"]), (1, ["b", "c"]), (2, ["d"]), (None, ["e"]), (3, [])]
    found = topics.lists_by(spark.createDataFrame(rows, "doc long, topics array<string>"), "doc")
    assert sorted(sorted(r.topics) for r in found.collect()) == [[], ["a", "b", "c"], ["d"]]


def test_communities_of_topics_are_those_of_their_edges(spark, monkeypatch):
    """edges packed by cells, no exchange of edges; several cells, parts of cells, sums by table and by sorting."""
    r = random.Random(9)
    docs = [{f"{c}{min(int(r.expovariate(0.2)), 25)}" for _ in range(15)} | {f"x{r.randrange(8)}"} for c in "abc" for _ in range(60)] + [{"lone"}] * 4
    lists = spark.createDataFrame([(sorted(s),) for s in docs], "topics array<string>")
    edges = topics.cooccurrence_of_lists(lists, 3, 0.1).selectExpr("a", "b", "n_ab AS weight")
    for rounds, cells, table in ((12, 3, 1 << 23), (1, 1, 0)):
        monkeypatch.setattr(network, "EDGES", 40)
        monkeypatch.setattr(network, "LEAST_CELLS", cells)
        monkeypatch.setattr(network, "SUMS", table)
        found = network.communities_of_topics(topics.held(lists, 3, 0.1), rounds)
        want = {(x.node, x.community) for x in network.communities(edges, rounds).collect()}
        assert {tuple(x) for x in found.collect()} == want and len(want) > 20
    assert network.communities_of_topics(topics.held(lists.limit(0), 3, 0.1)).collect() == []


def test_few_topics_of_many_documents_are_not_one_task(spark):
    """25 topics are counted in parts, each of two groups' lists; documents without both are left out there."""
    r = random.Random(2)
    lists = spark.createDataFrame([(r.sample([f"b{i}" for i in range(25)], r.choice([1, 3, 5])),) for _ in range(400)], "topics array<string>")
    found = topics.held(lists, 1, -9.0)
    assert len(found.first) - 1 == topics.GROUPS
    rows = found.squares().select("g", "h").distinct().collect()
    assert len(rows) == topics.GROUPS * (topics.GROUPS + 1) // 2 and found.squares().rdd.getNumPartitions() >= len(rows)


def test_pieces_of_names_are_scored_in_tasks_of_their_own(spark, monkeypatch):
    """small pieces are not laid together in one task."""
    monkeypatch.setattr(text, "PIECE", 2)
    left, right = (spark.createDataFrame([(i, f"name {i}") for i in range(6)], f"{k} long, x string") for k in "ab")
    found = text.class_similarities(left, right, "a", "x", "b", "x")
    assert found.rdd.getNumPartitions() == 18 and found.count() == 36
