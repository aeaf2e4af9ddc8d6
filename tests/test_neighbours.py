
import numpy as np
import pytest

from tidelake.operators import neighbours


def vectors(n, dims=8, seed=1, spread=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(spread, dims))
    return [(i, [float(x) for x in centres[r.integers(spread)] + r.normal(size=dims) * 0.3], r.integers(0, 50).item()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<double>, time long").repartition(4)


def brute(base, asked, k, at=False):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    usable = [(i, unit(v), t) for i, v, t in base if i is not None and v and all(np.isfinite(v)) and np.linalg.norm(v) > 0]
    out = []
    for i, v, t in asked:
        if i is None or not v or not np.linalg.norm(v) > 0:
            continue
        best = sorted((-round(float(unit(v) @ w), 12), j) for j, w, u in usable if j != i and (not at or u < t))[:k]
        out += [(i, r, j) for r, (_, j) in enumerate(best, 1)]
    return sorted(out)


def result(df):
    return sorted((r.query_id, r.rank, r.id) for r in df.collect())


@pytest.mark.parametrize("piece", [20_000, 7])
def test_exact_examples_whatever_the_cells(spark, monkeypatch, piece):
    monkeypatch.setattr(neighbours, "PIECE", piece)
    rows = vectors(240)
    rows += [(1000 + i, rows[i][1], 60) for i in range(20)]  # equally near
    rows += [(None, rows[0][1], 1), (2000, None, 1), (2001, [0.0] * 8, 1), (2002, [float("nan")] + [1.0] * 7, 1)]
    asked = [x for x in rows if x[0] is not None and x[0] % 6 == 0 and x[0] < 2001] + [(5000, rows[3][1], 30), (5001, None, 3)]
    base, q = frame(spark, rows), frame(spark, asked)
    index = neighbours.build(base, cells=12)
    assert result(neighbours.search(index, q, 3, probes=1, exact=True)) == brute(rows, asked, 3)
    timed = neighbours.build(base, at="time", cells=12)
    assert result(neighbours.search(timed, q, 4, at="time", probes=2, exact=True)) == brute(rows, asked, 4, at=True)


def test_recall_of_the_cells_probed(spark):
    rows = vectors(400, seed=3)
    base, q = frame(spark, rows), frame(spark, rows[::10])
    index = neighbours.build(base, cells=10, sample=100)  # fitted on a part, holding all
    assert index.rows.count() == 400
    probes = neighbours.calibrated(index, frame(spark, rows[5::10]), 3)
    truth = neighbours.search(index, q, 3, exact=True)
    assert 1 <= probes <= 10 and neighbours.recall(neighbours.search(index, q, 3, probes=probes), truth) >= 0.9
    assert neighbours.recall(neighbours.search(index, q, 3, probes=10), truth) == 1.0
    assert neighbours.recall(truth, truth.limit(0)) == 1.0


def test_nothing_to_find(spark):
    none = frame(spark, [])
    index = neighbours.build(none)
    assert neighbours.search(index, frame(spark, vectors(3)), 2).collect() == []
    some = neighbours.build(frame(spark, vectors(3)))
    assert neighbours.search(some, none, 2, exact=True).collect() == []
    assert len(neighbours.search(some, frame(spark, vectors(1)), 5, exact=True).collect()) == 2  # fewer than asked for
