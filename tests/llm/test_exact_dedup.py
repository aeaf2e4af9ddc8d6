import hashlib
from collections import defaultdict

import pytest
from util import SCHEMA, fold, frame

from tidelake.llm import exact_dedup
from tidelake.llm.stages import keep_one_copy


def test_groups_match_brute_force(spark):
    docs = frame(spark)
    rows, groups = docs.collect(), defaultdict(list)
    for r in rows:
        groups[fold(r.text)].append(r.doc_id)
    got = exact_dedup.dedup_groups(docs).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for g in got:
        ids = by_sha[g.text_sha256]
        assert g.keep_id == max(ids) and g.group_size == len(ids) and g.doc_id in ids
    assert sum(g.kept for g in got) == len(groups)


def test_empty_table_and_null_ids(spark):
    assert exact_dedup.dedup_groups(frame(spark, [])).collect() == []
    rows = [(None, "a", None, None, None, None, None, None, None, None), (None, "A", None, None, None, None, None, None, None, None), (3, "a", None, None, None, None, None, None, None, None)]
    got = exact_dedup.dedup_groups(frame(spark, rows)).collect()
    assert {g.keep_id for g in got} == {3} and sum(g.kept for g in got) == 1


def test_cuts_follow_content_and_are_bounded():
    import numpy as np

    r = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8)
    ends = exact_dedup.cuts(r)
    assert ends[-1] == len(r) and (np.diff(np.concatenate(([0], ends))) <= exact_dedup.MOST).all() and len(ends) > 10
    moved = exact_dedup.cuts(np.concatenate((np.zeros(1000, np.uint8), r)))
    assert len(set((moved - 1000).tolist()) & set(ends.tolist())) > 0.9 * len(ends)
    assert exact_dedup.cuts(np.zeros(0, np.uint8)).tolist() == []


def test_colliding_identifiers_are_found_out(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_DIGESTS", (lambda b: b"same", lambda b: hashlib.sha256(b).digest()))
    got = exact_dedup.dedup_groups(frame(spark)).collect()
    assert len({g.text_sha256 for g in got}) == sum(g.kept for g in got)


def test_keep_one_copy_returns_whole_rows(spark):
    docs = frame(spark)
    out = keep_one_copy(docs)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    texts = [fold(r.text) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({fold(r.text) for r in docs.collect()})


@pytest.mark.parametrize("n", [0, 1])
def test_tiny(spark, n):
    assert keep_one_copy(frame(spark).limit(n)).count() == n
    assert SCHEMA
