import random

import numpy as np
import pytest
from util import awkward, frame, shingles

from tidelake.llm import minhash


def brute(rows):
    sets = [(r[0], shingles(r[1], 4)) for r in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted((d, len(x), find(d), d == find(d)) for d, x in sets)


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def near_copies(n, seed, words=80, edits=2):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append((seed * 10000 + i, " ".join(w)))
    return out


def test_awkward_rows(spark):
    rows = awkward()
    assert result(minhash.near_duplicates(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize(("side", "first"), [(1000, 6), (7, 6), (20, 1)])
def test_families_of_borderline_similarity(spark, monkeypatch, side, first):
    monkeypatch.setattr(minhash, "SIDE", side)
    monkeypatch.setattr(minhash, "FIRST", first)
    rows = near_copies(60, 1) + near_copies(40, 2, edits=3) + near_copies(20, 3, words=20, edits=1) + near_copies(25, 4, words=60, edits=2)
    rows += [(99, None), (98, ""), (97, "one two"), (96, "One  two"), (95, " ".join(f"w{i}" for i in range(4))), (94, "")]
    chain = [f"c{i}" for i in range(60)]
    rows += [(50000 + i, " ".join(chain[i : i + 40])) for i in range(0, 20, 2)]
    rows += [(60000 + i, x) for i, (_, x) in enumerate(rows[:30])]
    rows += [(1, rows[70][1]), (1, rows[130][1])]  # one id, two texts
    assert result(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty_tables_and_missing_ids(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, None, True), (1, 1, True), (2, 1, False)}


def test_estimates_follow_the_similarity():
    r = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        errors = []
        for _ in range(20):
            both = r.integers(0, (1 << 64) - 1, int(4000 * share), dtype=np.uint64)
            rest = r.integers(0, (1 << 64) - 1, (2, (4000 - len(both)) // 2), dtype=np.uint64)
            sig = [np.frombuffer(minhash.signature(minhash.minima(np.concatenate([both, x])))[0], np.uint64)[None] for x in rest]
            errors.append(minhash.likeness(minhash.equal_parts(*sig)[0]) - share)
        assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.2
    assert minhash.least_likeness() < 0.65 and (1 - 0.8**minhash.ROWS) ** minhash.BANDS <= minhash.MISS
    x = minhash.minima(np.arange(1, 2000, dtype=np.uint64))
    assert (x == np.minimum(minhash.minima(np.arange(1, 900, dtype=np.uint64)), minhash.minima(np.arange(900, 2000, dtype=np.uint64)))).all()


def test_similar_pairs_share_a_band():
    """Held-out recall of the bands on pairs of just the least similarity."""
    r = np.random.default_rng(2)
    for _ in range(300):
        both, rest = r.integers(1, 1 << 63, 800, dtype=np.uint64), r.integers(1, 1 << 63, (2, 100), dtype=np.uint64)
        x, y = (minhash.signature(minhash.minima(np.concatenate([both, z]))) for z in rest)
        assert (x[1] == y[1]).any() and minhash.likeness(minhash.equal_parts(np.frombuffer(x[0], np.uint64)[None], np.frombuffer(y[0], np.uint64)[None])[0]) >= minhash.least_likeness()


def test_bitmaps_reject_no_similar_pair():
    r = np.random.default_rng(3)
    kept = {0.8: 0, 0.6: 0}
    for share in kept:
        for n in [2, 5, 50, 400, 5000] * 20:
            both = int(2 * n * share / (1 + share)) + (share == 0.8)
            x = r.integers(0, 1 << 63, both, dtype=np.uint64)
            a, b = (np.concatenate([x, r.integers(0, 1 << 63, n - both, dtype=np.uint64)]) for _ in range(2))
            bits = []
            for s in (a, b):
                own = np.zeros(minhash.BITS_OF_SET, np.uint8)
                own[(s % np.uint64(minhash.BITS_OF_SET)).astype(int)] = 1
                bits.append(np.frombuffer(np.packbits(own).tobytes(), np.uint64)[None])
            kept[share] += bool(minhash._may_match(*bits, np.array([2 * n]))[0])
    assert kept[0.8] == 100 and kept[0.6] < 60
