import random
import re
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F
from util import awkward, frame

from tidelake.llm import mixing
from tidelake.llm.stages import in_training_order


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def brute_targets(sizes):
    """The rule step by step: share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: Fraction((3, 1, 2)[i % 3]) for i, s in enumerate(names)}
    cap = {s: Fraction(2 * sizes[s]) for s in names}
    target, left, free = dict.fromkeys(names, Fraction(0)), Fraction(3 * sum(sizes.values()), 2), set(names)
    while left > 0 and free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = {s for s in free if target[s] + share[s] >= cap[s]}
        for s in over or free:
            add = cap[s] - target[s] if over else share[s]
            target[s] += add
            left -= add
        free -= over
        if not over:
            break
    return target


def test_targets_and_takings(spark):
    rows = awkward()
    got = mixing.curriculum(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want, taken = brute_targets(sizes), defaultdict(int)
    for g in got:
        assert g.source_size == sizes[g.source] and abs(g.target - float(want[g.source])) < 1e-6
        assert 0 <= g.taken <= 2 * g.size
        taken[g.source] += g.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    at = [g.position for g in got if g.position is not None]
    assert at == sorted(at) and all(0 <= p <= 1 for p in at)
    assert sorted((g.doc_id, g.taken, g.position or -1) for g in mixing.curriculum(frame(spark, rows).repartition(5)).collect()) == sorted((g.doc_id, g.taken, g.position or -1) for g in got)


def test_demand_follows_the_schedule(spark):
    """By time t a source of drift d has been trained on for (1 - d) t + d t^2 of its target."""
    rows = [(i, "w " * 10, "en", f"s{i % 3}", 1, "c", 1, 1, 1, True) for i in range(600)]
    got = mixing.curriculum(frame(spark, rows)).collect()
    for source, drift in (("s0", 0.5), ("s1", 0.0), ("s2", -0.5)):
        own = [g for g in got if g.source == source]
        early = sum(10 * sum(p is not None and p < 0.5 for p in (g.position, g.position_2)) for g in own)
        assert abs(early / own[0].target - ((1 - drift) / 2 + drift / 4)) < 0.03


def test_buckets_do_not_change_the_result(spark, monkeypatch):
    rows = awkward()
    want = sorted((g.doc_id, g.taken) for g in mixing.curriculum(frame(spark, rows)).collect())
    monkeypatch.setattr(mixing, "RANGE", 7)
    assert sorted((g.doc_id, g.taken) for g in mixing.curriculum(frame(spark, rows)).collect()) == want


def test_empty_tables(spark):
    assert mixing.curriculum(frame(spark, [])).collect() == []
    blank = [(i, None, "en", None, 0, "c", 1, 1, 1, True) for i in range(3)]
    assert {(g.taken, g.target, g.position) for g in mixing.curriculum(frame(spark, blank)).collect()} == {(0, 0.0, None)}


def test_stage_repeats_documents(spark):
    docs = frame(spark)
    out = in_training_order(docs)
    assert out.columns == docs.columns and out.count() > 0


def test_repeated_and_missing_ids_take_their_own_places(spark):
    r = random.Random(6)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(["w"] * r.randint(0, 20) + [str(i % 50)]), "en", r.choice(["a", "b", None]), i % 50, *["c"], 1, 2, 3, True) for i in range(120)]
    docs = frame(spark, rows + rows[:20])
    want = defaultdict(int)
    for x in mixing.source_targets(docs.select("source", mixing.text_size(F.col("text")).alias("size"))).collect():
        want[x.source] = x.target
    got = defaultdict(int)
    for x in in_training_order(docs).collect():
        got[x.source] += len(x.text.split())
    assert all(abs(got[s] - t) <= 21 for s, t in want.items())
    thin = mixing.curriculum(docs).collect()
    assert len(thin) == len(rows) + 20 and all(x.taken <= 2 * x.size for x in thin)
    for s, t in want.items():
        assert sum(x.taken for x in thin if x.source == s) == int(t + 0.5)
