import math
import random

import numpy as np

from tidelake.operators import ranking


def rows_of(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.gauss(0, 2), r.gauss(5, 1)
        out.append((i, x, y, 1.0, int(r.random() < 1 / (1 + math.exp(-(1.5 * x - 0.8 * (y - 5)))))))
    return out


SCHEMA = "id long, x double, y double, same double, picked int"


def plain(rows, rounds):
    """The same steps over all rows at once."""
    x = np.array([[a, b, c] for _, a, b, c, _ in rows])
    y = np.array([r[4] for r in rows], float)
    spread = x.std(0)
    z = (x - x.mean(0)) / np.where(spread == 0, 1, spread)
    w, b = np.zeros(3), 0.0
    for _ in range(rounds):
        e = y - 1 / (1 + np.exp(-(b + z @ w)))
        w, b = w + ranking.RATE * (z.T @ e / len(y) - ranking.PENALTY * w), b + ranking.RATE * e.mean()
    return w, b


def test_steps_against_plain_gradients(spark):
    rows = rows_of(400, 1)
    model = ranking.fit(spark.createDataFrame(rows, SCHEMA).repartition(6), ["x", "y", "same"], "picked", rounds=12)
    w, b = plain(rows, 12)
    assert np.allclose(model.weights, w) and math.isclose(model.intercept, b, abs_tol=1e-9) and model.weights[2] == 0


def test_held_out_rows_are_ranked(spark):
    rows = rows_of(3000, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    model = ranking.fit(df.where("id % 5 != 0"), ["x", "y"], "picked")
    held = df.where("id % 5 = 0").withColumn("score", model.score())
    got = ranking.judged(held, "picked").first()
    scores = [(r.score, r.picked) for r in held.collect()]
    yes, no = [s for s, p in scores if p], [s for s, p in scores if not p]
    auc = sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no))
    assert (got.n, got.picked) == (len(scores), len(yes))
    assert abs(got.auc - auc) < 1e-3 and got.auc > 0.85 and got.log_loss < 0.5


def test_missing_features_labels_and_rows(spark):
    rows = [(1, None, 1.0, 1.0, 1), (2, 2.0, None, 1.0, 0), (3, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = ranking.fit(df, ["x", "y"], "picked")
    assert all(r.s is not None and 0 < r.s < 1 for r in df.select(model.score().alias("s")).collect())
    none = ranking.fit(df.limit(0), ["x", "y"], "picked")
    assert none.weights == [0.0, 0.0]
    got = ranking.judged(df.limit(0).withColumn("score", none.score()), "picked").first()
    assert (got.n, got.auc, got.log_loss) == (0, None, None)
