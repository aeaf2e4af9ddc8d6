"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (0) or abstain on each text. Expectation
maximisation over the counts of vote patterns in the whole corpus (at most
3**len(LABELLERS) patterns, whatever its size) estimates how often each labeller
gives each vote to good and to bad texts. The posterior of each pattern then
labels a bounded sample of documents, on which a linear scorer over hashed word
shapes is trained; the scorer judges every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .base import bound_batches, discard, materialise

#: Documents at most that the scorer is trained on, those of least id hash; hashed features; rounds of each fit.
SAMPLE, DIMENSIONS, EM_ROUNDS, FIT_ROUNDS = 8000, 4096, 200, 600
#: Documents scoring less are rejected.
THRESHOLD = 0.5
_LOWER, _UPPER, _DIGIT, _POINT, _SIGN, _GAP = range(6)
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _UPPER
_CLASS[48:58] = _DIGIT
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = _SIGN
_CLASS[[ord(c) for c in ".,;:'\"?-()"]] = _POINT
_CLASS[:33] = _GAP
_CLASS[127] = _GAP

#: Name, statistic, votes bad beyond, votes good up to; abstains between.
LABELLERS = (
    ("signs", 0, 0.35, 0.05),
    ("capitals", 1, 0.50, 0.30),
    ("repeats", 2, 0.30, 0.10),
    ("bars", 3, 0.20, 0.02),
    ("digits", 4, 0.40, 0.10),
    ("long words", 5, 0.20, 0.05),
    ("few words", 6, 0.90, 0.70),
    ("sign bytes", 7, 0.15, 0.03),
    ("doubled signs", 8, 0.30, 0.03),
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Per row: share of words with a sign, in capitals, equal to the one before, without letters or digits, with a digit, of over 30 bytes, seen before in the row; share of bytes that are signs; share of words ending in a doubled sign; and the hashed shapes (row, feature)."""
    rows = len(offsets) - 1
    h, starts, ends, first = hashing.words(data, offsets, lower=False)
    n = np.diff(first)
    if not len(h):
        return np.zeros((rows, len(LABELLERS))), (np.zeros(0, np.int64), np.zeros(0, np.int64))
    kind = _CLASS[data]
    of = np.repeat(np.arange(rows), n)

    def count(k):
        c = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == k, out=c[1:])
        return c[ends] - c[starts]

    size = ends - starts
    signs, upper, digits, points = count(_SIGN), count(_UPPER), count(_DIGIT), count(_POINT)
    lower = size - signs - upper - digits - points
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((h, of))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    flags = (signs > 0, (upper > 1) & (lower == 0), same, (lower + upper + digits) == 0, digits > 0, size > 30, again & (n[of] > 20))
    share = [np.bincount(of, f, rows) / np.maximum(n, 1) for f in flags]
    share.append(np.bincount(of, signs, rows) / np.maximum(np.bincount(of, size, rows), 1))
    doubled = (size > 1) & (kind[ends - 1] == _SIGN) & (data[ends - 1] == data[np.maximum(ends - 2, 0)])
    share = np.stack([*share, np.bincount(of, doubled, rows) / np.maximum(n, 1)], 1)
    shape = kind[starts].astype(np.int64) * 6 + kind[ends - 1]
    shape = ((shape * 3 + np.minimum(signs, 2)) * 2 + flags[1]) * 2 + (digits > 0)
    shape = (shape * 2 + same) * 4 + np.minimum(size // 5, 3)
    shape = shape * 2 + flags[3]
    before = np.zeros_like(shape)
    before[1:] = np.where(of[1:] == of[:-1], shape[:-1] + 1, 0)
    fold = lambda x, salt: (hashing.finalise(x.astype(np.uint64) + np.uint64(salt)) % np.uint64(DIMENSIONS - 1)).astype(np.int64) + 1
    return share, (np.concatenate([of, of]), np.concatenate([fold(shape, 1 << 40), fold(shape * (1 << 20) + before, 1 << 41)]))


def _vectors(rows: int, shapes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) with the root of a feature's share as value; feature 0 is the constant."""
    row, feature = shapes
    key, c = np.unique(row * DIMENSIONS + feature, return_counts=True)
    row, feature = key // DIMENSIONS, key % DIMENSIONS
    total = np.bincount(row, c, rows)
    return row, feature, np.sqrt(c / total[row])


def votes(share: np.ndarray) -> np.ndarray:
    """A pattern of votes in base 3: 0 abstains, 1 bad, 2 good."""
    out = np.zeros(len(share), np.int64)
    for _, k, bad, good in LABELLERS:
        out = out * 3 + np.where(share[:, k] > bad, 1, np.where(share[:, k] <= good, 2, 0))
    return out


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    for a, b, data, offsets in hashing.utf8_slices(column):
        share, shapes = statistics(data, offsets)
        yield a, b, share, shapes


def _survey(rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = batch.column(2).to_numpy(zero_copy_only=False) < rate
            for a, b, share, shapes in _slices(batch.column(1)):
                row, feature, value = _vectors(b - a, shapes)
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                vectors = [(feature[x:y].tolist(), value[x:y].tolist()) if keep else (None, None) for x, y, keep in zip(bounds[:-1], bounds[1:], chosen[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(votes(share)), pa.array([v[0] for v in vectors], pa.list_(pa.int32())), pa.array([v[1] for v in vectors], pa.list_(pa.float32()))], ["pattern", "feature", "value"])

    return run


def fit_labellers(counts: dict[int, int]) -> dict[int, float]:
    """The posterior of being good for each vote pattern.

    Each labeller knows one fault, so bad texts are a mixture of one class for
    each labeller; given its class, the votes of a text count as independent.
    """
    if not counts:
        return {}
    patterns = np.array(sorted(counts))
    weight = np.array([counts[p] for p in patterns.tolist()], float)
    n = len(LABELLERS)
    digits = np.stack([patterns // 3**k % 3 for k in range(n)][::-1], 1)
    bad = (digits == 1).astype(float)
    any_bad = bad.sum(1, keepdims=True)
    belongs = np.concatenate([np.where(any_bad > 0, 0.1, 0.95), np.where(any_bad > 0, 0.9 * bad / np.maximum(any_bad, 1), 0.05 / n)], 1)
    for _ in range(EM_ROUNDS):
        w = belongs * weight[:, None]
        log = np.log((w.sum(0) + 0.01) / (weight.sum() + 0.01 * (n + 1)))[None, :].repeat(len(patterns), 0)
        for k in range(n):
            p = np.stack([(w * (digits[:, k] == v)[:, None]).sum(0) for v in range(3)]) + 0.01
            log += np.log(p / p.sum(0))[digits[:, k]]
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - belongs).max() < 1e-9:
            break
        belongs = new
    return dict(zip(patterns.tolist(), belongs[:, 0].tolist(), strict=True))


def fit_scorer(samples: list[tuple[list[int], list[float], float]]) -> np.ndarray:
    """Weights of a logistic scorer of soft labels, by accelerated gradient descent; classes count alike."""
    weights = np.zeros(DIMENSIONS)
    if not samples:
        weights[0] = 5.0
        return weights
    row = np.repeat(np.arange(len(samples)), [len(s[0]) for s in samples])
    feature, value = (np.concatenate([np.array(s[k], float) for s in samples]) for k in (0, 1))
    feature = feature.astype(np.int64)
    target = np.array([s[2] for s in samples])
    share = np.clip(target.mean(), 0.01, 0.99)
    each = target * 0.7 / share + (1 - target) * 0.3 / (1 - share)
    look, before = weights.copy(), weights.copy()
    for t in range(FIT_ROUNDS):
        margin = np.bincount(row, look[feature] * value, len(samples)) + look[0]
        error = each * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target)
        gradient = np.bincount(feature, error[row] * value, DIMENSIONS) / len(samples) + 1e-5 * look
        gradient[0] += error.mean()
        weights = look - 2.0 * gradient
        look = weights + (t / (t + 3)) * (weights - before)
        before = weights
    return weights


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[dict[int, float], np.ndarray]:
    """(posterior of each vote pattern, weights of the scorer), learned from the texts alone."""
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    place = (F.xxhash64("doc_id", "text") / F.lit(2.0**64) + 0.5).alias("place")  # of the content too: ids may be missing or equal
    n = source.count()
    share = SAMPLE / max(n, 1)
    while True:
        made = materialise(source.select("doc_id", "text", place).mapInArrow(_survey(share), "pattern long, feature array<int>, value array<float>"), "quality")
        if share >= 1 or made.where("feature is not null").limit(1).count():
            break
        discard(made)
        share *= 64  # so many equal rows that none was taken: never train on nothing
    posterior = fit_labellers({r.pattern: r["count"] for r in made.groupBy("pattern").count().collect()})
    rows = made.where("feature is not null").limit(2 * SAMPLE).collect()  # about SAMPLE rows; the limit only guards the driver
    return posterior, fit_scorer([(r.feature, r.value, posterior[r.pattern]) for r in sorted(rows, key=lambda r: (r.pattern, r.feature, r.value))])


def scores(column: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, vote pattern) of each text."""
    score, pattern = np.zeros(len(column)), np.zeros(len(column), np.int64)
    for a, b, share, shapes in _slices(column):
        row, feature, value = _vectors(b - a, shapes)
        score[a:b] = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[feature] * value, b - a) + weights[0], -50, 50)))
        pattern[a:b] = votes(share)
    return score, pattern


def classify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score, posterior, keep of every row: the scorer's probability of a good text and that of its votes.

    Null and empty texts get the score of a text without words. Rows are kept one
    to one; other columns are ignored; an empty table gives no rows.
    """
    posterior, weights = fit(docs, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, pattern = scores(batch.column(1), weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array([posterior.get(p, 0.5) for p in pattern.tolist()], pa.float64()), pa.array(score >= THRESHOLD)], ["doc_id", "score", "posterior", "keep"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, posterior double, keep boolean")


def keep_good(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the classifier keeps; no shuffle.

    Null and empty texts are judged as texts without words. Rows without an id, or
    with another row's, are judged like others; an empty table gives an empty one.
    """
    _, weights = fit(docs, id_column, text_column)
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _ = scores(batch.column(at), weights)
            yield batch.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
