import os
import random

import numpy as np
import pytest
from util import awkward, frame

from tidelake.llm import quality

DATA = "/root/testdata/sf0.01"


def test_em_finds_rare_faults():
    good = int("2" * len(quality.LABELLERS), 3)
    signs, repeats = good - 3 ** (len(quality.LABELLERS) - 1), good - 3 ** (len(quality.LABELLERS) - 3)
    p = quality.fit_labellers({good: 10000, signs: 500, repeats: 20})
    assert p[good] > 0.95 and p[signs] < 0.2 and p[repeats] < 0.2
    assert quality.fit_labellers({}) == {}


def test_statistics_match_brute_force():
    import pyarrow as pa

    r = random.Random(2)
    texts = [" ".join(r.choice(["ab", "AB", "a1", "x&&&", "|", "é", "c."]) for _ in range(r.randint(0, 30))) for _ in range(50)] + ["", None]
    got = np.concatenate([share for _, _, share, _ in quality._slices(pa.array(texts))])
    for t, row in zip(texts, got, strict=True):
        w = (t or "").split(" ") if t else []
        n = max(1, len(w))
        assert abs(row[0] - sum("&" in x or "|" in x for x in w) / n) < 1e-9
        assert abs(row[2] - sum(a == b for a, b in zip(w, w[1:], strict=False)) / n) < 1e-9
        assert abs(row[3] - sum(x == "|" for x in w) / n) < 1e-9
        assert abs(row[8] - sum(x.endswith("&&") for x in w) / n) < 1e-9


def test_awkward_rows_keep_their_place(spark):
    docs = frame(spark)
    got = quality.classify(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in awkward()) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(frame(spark, [])).collect() == []
    kept = quality.keep_good(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString() and kept.count() == sum(r.keep for r in got)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_accuracy_on_labels_it_never_saw(spark):
    got = {r.doc_id: r.keep for r in quality.classify(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    labels = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.doc_id in got]
    assert sum(bool(q) == k for q, k in labels) / len(labels) > 0.97
    good = [k for q, k in labels if q]
    assert sum(good) / len(good) > 0.99


def test_rows_without_ids_are_judged_like_others(spark):
    r = random.Random(7)
    good = ["The river was calm and the people of the town walked along it to the market. " * 3 + f"It was day {i}." for i in range(300)]
    junk = ["&& | ## " * 40 + str(i) for i in range(300)]
    rows = [(i, t, *[None] * 8) for i, t in enumerate(good + junk)]
    r.shuffle(rows)
    with_ids = {x.text for x in quality.keep_good(frame(spark, rows)).select("text").collect()}
    without = {x.text for x in quality.keep_good(frame(spark, [(None, *x[1:]) for x in rows])).select("text").collect()}
    same = {x.text for x in quality.keep_good(frame(spark, [(3, *x[1:]) for x in rows])).select("text").collect()}
    assert with_ids == without == same
    copies = quality.classify(frame(spark, [(None, "the same words", *[None] * 8)] * 200)).collect()
    assert len(copies) == 200 and len({x.score for x in copies}) == 1
