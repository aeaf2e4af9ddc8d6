import random

import numpy as np
import pytest
from util import awkward, frame, shingles

from tidelake.llm import hashing, ngram_join
from tidelake.llm.components import components
from tidelake.llm.stages import keep_one_of_similar


def brute(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted((d, len(x), find(d)) for d, x in sets)


def near_copies(n, seed, words=60, edits=3):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append((seed * 10000 + i, " ".join(w)))
    return out


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_awkward_rows(spark):
    rows = awkward()
    assert result(ngram_join.similarity_components(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("group", [2, 16])
def test_large_group_of_near_copies_of_borderline_similarity(spark, monkeypatch, group):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    rows = near_copies(60, 1) + near_copies(40, 2, edits=2) + near_copies(20, 3, words=20, edits=1) + [(99, None), (98, ""), (97, "one two")] + [(96, "One  two")]
    assert result(ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_cells_of_frequent_shingles_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 5)
    rows = near_copies(40, 4) + near_copies(12, 5)
    assert result(ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similarity_components(empty).collect() == []
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")]
    got = {(r.doc_id, r.component_id) for r in ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, None), (1, 1), (2, 1)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_component_stays(spark):
    rows = near_copies(10, 6, edits=1) + [(None, "x"), (7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {c for _, _, c in brute([x for x in rows if x[0] is not None])} | {None}
    assert {r.doc_id for r in keep_one_of_similar(docs).collect()} == want


@pytest.mark.parametrize("n", range(1, 6))
def test_one_text_of_a_few_words_has_one_shingle(n):
    words = np.arange(1, n + 1, dtype=np.uint64)
    found = list(hashing.shingles(words, np.array([0, n]), 5))
    assert [len(x) for x in found] == [1]


def test_the_least_id_stays_whatever_ids_are_repeated(spark):
    alike = [(i, "some words that all of these documents have in common, and enough of them") for i in range(1, 9)]
    for more in ([], [(900, "an unrelated text of six words"), (900, "and another one, unlike it too")], [(None, "a text of no document at all")], [(900, "x y"), (900, "z"), (None, alike[0][1])]):
        docs = spark.createDataFrame(alike + more, "doc_id long, text string")
        assert sorted(map(str, (r.doc_id for r in keep_one_of_similar(docs).collect()))) == sorted(map(str, [1] + [i for i, t in more if t != alike[0][1]]))
    twice = [(3, alike[0][1]), (3, alike[0][1] + "."), (3, "quite another text of seven words"), (7, alike[0][1])]
    kept = keep_one_of_similar(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [3, 3] and len({r.text for r in kept} - {twice[2][1]}) == 1


def mixed_family(n, seed):
    """Copies of one text with few to many edits, so that some are similar to most others, some to a few and many to none."""
    return [x for e in (1, 3, 5, 7, 9) for x in near_copies(n, seed, words=80, edits=e)]


def test_squares_of_a_mixed_group_form_few_pairs(spark, monkeypatch):
    rows = [(i, t) for i, (_, t) in enumerate(mixed_family(60, 8))]
    formed, links = [], ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda pairs, live: formed.append(pairs.count()) or links(pairs, live))
    docs = spark.createDataFrame(rows + [(3, rows[-1][1])], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in ngram_join.similarity_components(docs).collect()}
    want = brute(rows)
    parent = {d: c for d, _, c in want}
    tied = {parent[3], parent[len(rows) - 1]}  # 3 has two sets
    assert got == {(d, min(tied) if c in tied else c) for d, _, c in want}
    assert sum(formed[1:]) < 12 * len(rows)


def test_labels_meet_large_groups_by_document(spark, monkeypatch):
    """Groups grow past GROUP members all at once as a table grows, by one row for each shingle of each document's prefix."""
    rows = [(1000 * g + i, t) for g in range(4) for i, (_, t) in enumerate(near_copies(40, g, words=200))]
    docs, joined, lettered, runs = spark.createDataFrame(rows, "doc_id long, text string"), [], ngram_join._lettered, []
    monkeypatch.setattr(ngram_join, "_lettered", lambda m, labels: joined.append(m.count()) or lettered(m, labels))
    write = ngram_join.materialise

    def counted(df, name):
        out = write(df, name)
        if name == "runs":
            runs.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similarity_components(docs).collect())
    assert got == brute(rows)
    assert len(joined) == 3 and max(joined) <= 2 * len(rows)
    assert len(runs) == 2 and max(runs) < 10 * len(rows)


@pytest.mark.parametrize("square", [1, 7, 1000])
def test_runs_of_members_lose_no_pair(spark, monkeypatch, square):
    monkeypatch.setattr(ngram_join, "GROUP", 2)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    monkeypatch.setattr(ngram_join, "SQUARE", square)
    rows = [(i, t) for i, (_, t) in enumerate(mixed_family(8, 5))] + [(5000 + i, t) for i, (_, t) in enumerate(near_copies(12, 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similarity_components(docs).collect()) == brute(rows)
