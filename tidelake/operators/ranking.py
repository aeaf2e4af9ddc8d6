"""A logistic model that ranks rows by how likely they are to be picked, fitted by gradients that Spark adds up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, RATE, PENALTY = 25, 1.0, 1e-3
#: Scores are counted in so many steps when a model is judged.
STEPS = 10_000


@dataclass
class Model:
    """score = 1 / (1 + exp(-z)), z = intercept + the sum of weight * (feature - mean) / spread."""

    features: list[str]
    mean: list[float]
    spread: list[float]
    weights: list[float]
    intercept: float

    def z(self) -> Column:
        out = F.lit(self.intercept)
        for f, m, s, w in zip(self.features, self.mean, self.spread, self.weights, strict=True):
            out = out + F.lit(w) * _scaled(f, m, s)
        return out

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.z()))


def _scaled(feature: str, mean: float, spread: float) -> Column:
    """A feature in units of its spread; null is as good as the mean."""
    return F.coalesce((F.col(feature).cast("double") - mean) / spread, F.lit(0.0))


def fit(rows: DataFrame, features: list[str], label: str, rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """The model after that many steps along the mean gradient of the log likelihood, less penalty times the weights.

    Each step is one aggregation to a row of len(features) + 1 sums, whatever the
    number of rows; rows should be a written or cheap table. Rows without a label
    are left out. Features are scaled by mean and population deviation; a constant
    one keeps the weight 0. Without rows all weights are 0.
    """
    rows = rows.where(F.col(label).isNotNull())
    d = F.col(label).cast("double")
    numbers = [F.col(f).cast("double") for f in features]
    facts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(numbers)), *(F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(numbers))).first()
    mean = [facts[f"m{i}"] or 0.0 for i in range(len(features))]
    spread = [facts[f"s{i}"] or 1.0 for i in range(len(features))]
    model = Model(features, mean, spread, [0.0] * len(features), 0.0)
    for _ in range(rounds if facts.n else 0):
        error = d - model.score()
        sums = rows.agg(F.avg(error).alias("b"), *(F.avg(error * _scaled(f, m, s)).alias(f"g{i}") for i, (f, m, s) in enumerate(zip(features, mean, spread, strict=True)))).first()
        weights = [w + rate * (sums[f"g{i}"] - penalty * w) for i, w in enumerate(model.weights)]
        model = Model(features, mean, spread, weights, model.intercept + rate * sums.b)
    return model


def judged(scored: DataFrame, label: str, score: str = "score") -> DataFrame:
    """One row for rows that the fit has not seen: n, picked, auc, log_loss.

    auc is the chance that a picked row outranks another, ties counting half, with
    scores counted in STEPS steps: no sort of all rows, and no more than STEPS
    counts meet. It is null where one of the two kinds is missing.
    """
    rows = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(score)))
    step = F.least(F.lit(STEPS - 1), F.floor(F.col(score) * STEPS))
    counts = rows.groupBy(step.alias("step")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("yes"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("no"),
        F.sum(-F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("loss"),
    )
    found = sorted(tuple(r) for r in counts.collect())
    yes, no, loss = (sum(r[i] for r in found) for i in (1, 2, 3))
    below, pairs = 0, 0.0
    for _, y, n, _ in found:
        pairs += y * (below + n / 2)
        below += n
    row = (yes + no, yes, pairs / (yes * no) if yes and no else None, loss / (yes + no) if yes + no else None)
    return scored.sparkSession.createDataFrame([row], "n long, picked long, auc double, log_loss double")
