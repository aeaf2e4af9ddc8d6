import random
import re
from collections import defaultdict
from itertools import permutations

from util import WORD, awkward, frame

from tidelake.llm import filter_audit

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(rows, labels):
    """Walks every document through every order."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    fails, out, sums = [], {}, defaultdict(int)
    for r in rows:
        text, w = r[1] or "", WORD.findall(r[1] or "")
        f = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": r[0] is not None and any(o[0] is not None and o[0] < r[0] and (o[1] or "") == text for o in rows),
        }
        fails.append((r[2] or "", r[0], {k for k, v in f.items() if v}))
    for part in {p for p, _, _ in fails}:
        for order in permutations("ABCDE"):
            own = [x for x in fails if x[0] == part]
            here = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in here if letter in x[2]]
                here = [x for x in here if letter not in x[2]]
                sums[part, letter] += len(gone)
                out[part, "".join(order), step] = (len(here), len(gone), sum(letter in x[2] for x in own) - len(gone), sum(x[2] == {letter} for x in own), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone))
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in rows}
    assert len(out) == len(rows)
    return out


def labels_of(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_awkward_rows(spark):
    rows = awkward()
    words = [f"w{i}" for i in range(300)]
    rows += [(4000, " ".join(words), "de", None, None, *rows[0][5:]), (4001, " ".join(words), "de", None, None, *rows[0][5:]), (4002, " ".join(words) + " $", "", None, None, *rows[0][5:]), (4003, " ".join(words).upper(), None, None, None, *rows[0][5:])]
    rows += [(None, " ".join(words), "de", None, None, *rows[0][5:]), (None, "", "fr", None, None, *rows[0][5:])]
    labels = [(0, 1, 0), (0, 0, 1), (5, 1, 1), (1000, 1, None), (3000, None, 1), (4001, 1, 1), (None, 1, 1), (99999, 1, 1)]
    assert result(filter_audit.audit(frame(spark, rows), labels_of(spark, labels))) == brute(rows, labels)


def test_least_id_of_a_text_decides_over_all_parts_and_repeated_ids(spark):
    r = random.Random(3)
    rows = [(r.randrange(12), f"text {r.randrange(4)} {'x ' * 250 if i % 3 else '%'}", r.choice(["a", "b", None])) for i in range(200)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(12)]
    labels = [(a, b, int(c)) for a, b, c in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    assert result(filter_audit.audit(docs, labels_of(spark, labels))) == brute(rows, labels)


def test_empty_tables(spark):
    none = labels_of(spark, [])
    assert filter_audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), none).collect() == []
    rows = [(1, None, None)]
    assert result(filter_audit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), none)) == brute(rows, [])


def test_other_filters_and_parts(spark):
    rows = [(i, f"{'long ' * (i % 3)}{i % 5}", "x", str(i % 2)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = result(filter_audit.audit(docs, labels_of(spark, []), "source", lambda t: {"A": ~t.contains("long"), "B": t.endswith("4")}))
    assert len(got) == 2 * 6 * 3
    assert got["0", "ABC", 1][:2] == (10, 5) and got["0", "CAB", 3][0] == got["0", "ABC", 3][0]
