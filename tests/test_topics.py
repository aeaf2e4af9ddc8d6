import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidelake.operators import network, scratch, topics

MENTIONS = "k string, week long, speaker string, direction int, change double"


def test_burst_counts_empty_weeks_and_names_new_topics(spark):
    rows = [("a", w, "s", 0, None) for w in (0, 0, 3, 20, 20, 20)] + [("b", 18, "s", 0, None), (None, 20, "s", 0, None), ("a", None, "s", 0, None)]
    got = {(r.k, r.week): (r.n, r.mean, r.burst) for r in topics.weekly_burst(spark.createDataFrame(rows, MENTIONS), ["k"]).collect()}
    assert len(got) == 21 + 3 + 1
    assert got["a", 0] == (2, None, None)  # the table's first week has no past
    assert got["a", 3] == (1, 2 / 3, 1.5)  # three weeks are known
    assert got["a", 4][:2] == (0, 3 / 4)
    assert got["a", 20] == (3, 0.0, None)  # nothing in eight weeks
    assert got["b", 19] == (0, 1 / 8, 0.0)
    assert got[None, 20] == (1, 0.0, None)
    assert topics.weekly_burst(spark.createDataFrame([], MENTIONS), ["k"]).collect() == []


def test_signals_and_their_sketches(spark):
    r = random.Random(5)
    rows = [("a", r.randrange(6), f"s{r.randrange(3000)}", r.choice([1, -1, 0, None]), r.choice([None, 2.0, -3.0])) for _ in range(5000)]
    rows += [("b", 1, None, None, None), ("c", 1, "x", -1, None), ("c", 2, "x", 1, -1.5), ("c", 2, "y", 1, None)]
    df = spark.createDataFrame(rows, MENTIONS)
    got = {x.k: x for x in topics.signals(df, ["k"]).collect()}
    own = [x for x in rows if x[0] == "a"]
    up, down = sum(x[3] == 1 for x in own), sum(x[3] == -1 for x in own)
    assert (got["a"].n, got["a"].breadth, got["a"].up, got["a"].down) == (5000, len({x[2] for x in own}), up, down)
    assert got["a"].disagreement == min(up, down) / max(up, down)
    assert (got["a"].changes, got["a"].change_size) == (sum(x[4] is not None for x in own), sum(abs(x[4] or 0) for x in own))
    assert (got["b"].breadth, got["b"].disagreement, got["b"].change_size) == (0, 0.0, 0)
    assert (got["c"].breadth, got["c"].disagreement, got["c"].change_size) == (2, 0.5, 1.5)
    merged = {x.k: x.breadth_estimate for x in topics.merged(topics.signals(df, ["k", "week"]), ["k"]).collect()}
    assert abs(merged["a"] - got["a"].breadth) <= 4 * topics.relative_error() * got["a"].breadth and merged["c"] == 2


def pmi_brute(docs, least, floor):
    n, both = Counter(t for s in docs for t in s), Counter(p for s in docs for p in combinations(sorted(s), 2))
    out = {}
    for (a, b), c in both.items():
        pmi = math.log(c * len(docs) / (n[a] * n[b]))
        if c >= least and pmi >= floor - 1e-12:
            out[a, b] = (n[a], n[b], c, round(pmi, 9))
    return out


@pytest.mark.parametrize(("slices", "least", "floor"), [(128, 1, -99.0), (7, 2, 0.0), (1, 3, 0.7), (128, 2, math.log(2))])
def test_cooccurrence_loses_no_pair_to_its_bounds(spark, monkeypatch, slices, least, floor):
    monkeypatch.setattr(topics, "SLICE", slices)
    r = random.Random(slices)
    docs = [{f"t{min(int(r.expovariate(0.15)), 60)}" for _ in range(r.choice([1, 5, 40]))} | {"everywhere"} for _ in range(60)]
    rows = [(i, t) for i, s in enumerate(docs) for t in s] * 2 + [(None, "t1"), (3, None)]
    df = topics.cooccurrence(spark.createDataFrame(rows, "doc long, topic string").repartition(5), "doc", "topic", least, floor)
    got = {(x.a, x.b): (x.n_a, x.n_b, x.n_ab, round(x.pmi, 9)) for x in df.collect()}
    assert got == pmi_brute(docs, least, floor)
    if floor > 0:
        assert not any("everywhere" in k for k in got)


def test_cooccurrence_of_nothing(spark):
    assert topics.cooccurrence(spark.createDataFrame([], "doc long, topic string"), "doc", "topic").collect() == []


def halves(nodes, spark):
    df = spark.createDataFrame([(n,) for n in nodes], "n string")
    return {r.n: r.h for r in df.select("n", network.half(F.col("n")).alias("h")).collect()}


def propagate(edges, half, rounds):
    w = defaultdict(lambda: defaultdict(int))
    for a, b, x in edges:
        if a is not None and b is not None and a != b and x > 0:
            w[a][b] += x
            w[b][a] += x
    label = {n: n for n in w}
    quiet = 0
    for i in range(rounds):
        new = dict(label)
        for n in w:
            if half[n] == i % 2:
                sums = Counter()
                for m, x in w[n].items():
                    sums[label[m]] += x
                new[n] = min(sums, key=lambda c, s=sums, n=n: (-s[c], c != label[n], c))
        quiet = 0 if new != label else quiet + 1
        label = new
        if quiet == 2:
            break
    return label


def test_communities_of_cliques_hubs_and_ties(spark, monkeypatch):
    edges = [(f"{c}{i}", f"{c}{j}", 3) for c in "abc" for i, j in combinations(range(6), 2)] + [("a0", "b0", 1), ("b1", "c1", 1), ("x", "y", 2), ("y", "x", 1), ("z", "z", 5), (None, "a1", 4), ("q", "r", 0)]
    edges += [("hub", f"leaf{i}", 1) for i in range(300)]
    r = random.Random(8)
    edges += [(f"n{r.randrange(40)}", f"n{r.randrange(40)}", r.randrange(1, 4)) for _ in range(120)]
    df = spark.createDataFrame(edges, "a string, b string, weight long")
    half = halves({n for a, b, _ in edges for n in (a, b) if n}, spark)
    for heavy in (1000, 20):  # hubs by join, hubs by broadcast
        monkeypatch.setattr(scratch, "HEAVY", heavy)
        found = network.communities(df)
        got = {x.node: x.community for x in found.collect()}
        assert got == propagate(edges, half, network.ROUNDS)
    assert len({got[f"a{i}"] for i in range(6)}) == 1 and got["a0"] != got["c0"]
    assert network.modularity(df, found) > 0.4
    none = spark.createDataFrame([], "a string, b string, weight long")
    assert network.communities(none).collect() == [] and network.modularity(none, network.communities(none)) == 0.0


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("sc", (), {"applicationId": "app-x", "master": "spark://m:7077"})

    with pytest.raises(RuntimeError):
        scratch.root(Cluster)


def test_a_pair_is_one_row_however_many_documents_share_it(spark, monkeypatch):
    """ranges of topics, files of several batches; rows of pairs only from enough documents on."""
    monkeypatch.setattr(topics, "SLICE", 2)
    monkeypatch.setattr(topics, "BATCH", 50)
    made, counted = [], topics._counted

    def spied(n, least):
        made.append((n, least(8), least(40)))
        return counted(n, least)

    monkeypatch.setattr(topics, "_counted", spied)
    docs = [{f"t{(i + j * j) % 23}" for j in range(1 + i % 9)} for i in range(150)]
    df = topics.cooccurrence(spark.createDataFrame([(i, t) for i, s in enumerate(docs) for t in s], "doc long, topic string"), "doc", "topic", 4, 0.5)
    assert {(x.a, x.b): (x.n_a, x.n_b, x.n_ab, round(x.pmi, 9)) for x in df.collect()} == pmi_brute(docs, 4, 0.5)
    assert made and made[0][1:] == (4, math.ceil(math.exp(0.5) * 1600 / 150))


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(f"n{i:03}",) for i in range(100)], "node string").repartition(7)
    assert [(r.node, r.at) for r in scratch.numbered(df, "at", "node").orderBy("at").collect()] == [(f"n{i:03}", i) for i in range(100)]
