import re

from util import awkward, fold, frame

from tidelake.llm import licenses

TEXTS = ["Released under the MIT License.", "x Apache License, Version 2.0 y apache license version 2", "CC BY-NC!", "no license here", licenses.TEMPLATES[2][1], licenses.TEMPLATES[6][1].replace("and/or", "or"), "This work is licensed under the GNU General Public License, really version 3.", None, "", "under the mit license " * 3000]


def rows():
    return awkward(3, 30) + [(5000 + i, t, "en", "s", 1, "c", 1, 1, 1, True) for i, t in enumerate(TEXTS)]


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        k = phrase.split()
        own = [i for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k]
        starts += own
        labels |= {label} if own else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def cover(text):
    """The greatest share of a template's k-grams on neighbouring diagonals, tried out at every place."""
    w, best = licenses.words_of(text or ""), set()
    for label, template in licenses.TEMPLATES:
        t = licenses.words_of(template)
        grams = {tuple(t[i : i + licenses.K]) for i in range(len(t) - licenses.K + 1)}
        for i in range(len(w)):
            own = {tuple(w[j : j + licenses.K]) for j in range(i, min(len(w), i + len(t) + licenses.DRIFT))}
            if len(grams & own) >= licenses.COVER * len(grams):
                best.add(label)
                break
    return best


def test_base_matches_brute_force(spark):
    got = licenses.license_labels(frame(spark, rows())).collect()
    found = sorted((str(g.doc_id), g.n_words, g.n_base, g.first_word or -1, g.last_word or -1, g.base_labels) for g in got)
    want = sorted((str(r[0]), n, k, a or -1, b or -1, labels) for r in rows() for n, k, a, b, labels in [base(r[1])])
    assert found == want
    assert all(0 <= g.score <= 1 and set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) for g in got)


def test_method_finds_templates_with_changes(spark):
    got = {r.doc_id: r for r in licenses.license_labels(frame(spark, rows())).collect()}
    for i, t in enumerate(TEXTS[:9]):
        found = set(filter(None, got[5000 + i].labels.split(",")))
        assert found == cover(t) | set(filter(None, base(t)[4].split(","))), t
    assert got[5005].labels == "gpl" and got[5006].labels == "gpl-3" and got[5003].labels == ""


def test_spans_and_empty(spark):
    _, spans = licenses.scan(frame(spark, rows()).where("doc_id = 5000"))
    assert [(s.label, s.first, s.last) for s in spans.collect()] == [("mit", 0, 4)]
    assert licenses.license_labels(frame(spark, [])).collect() == []


CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
NOTICES = [
    (CC.format("-NonCommercial"), "cc-by-nc"), (CC.format("-ShareAlike"), "cc-by-sa"), (CC.format(""), "cc-by"), (CC.format("-NoDerivatives"), ""), (CC.format("-NonCommercial-ShareAlike"), ""),
    ("Licensed under the Apache License 2.0.", "apache-2"), ("Licensed under the Apache Software License, Version 2.0.", "apache-2"), ("Licensed under the Apache License, Version 1.1.", ""),
    ("Released under the terms of the MIT License.", "mit"), ("Released under this MIT License.", "mit"), ("Released under the Foo License.", ""), ("released to all of them under the name of the mit", ""),
    (licenses.TEMPLATES[6][1].replace("GNU General", "GNU Lesser General"), ""), (f"{CC.format('-ShareAlike')} {CC.format('')}", "cc-by,cc-by-sa"),
]


def test_spans_are_verified_word_by_word(spark):
    rows = [(i, f"see {t} and more", *[None] * 8) for i, (t, _) in enumerate(NOTICES)]
    got = {r.doc_id: r for r in licenses.license_labels(frame(spark, rows)).collect()}
    assert [(t, got[i].labels) for i, (t, _) in enumerate(NOTICES)] == NOTICES
    _, spans = licenses.scan(frame(spark, rows[:3]))
    assert sorted((s.label, s.first, s.last, s.cover) for s in spans.collect()) == [("cc-by", 1, 13, 1.0), ("cc-by-nc", 1, 14, 1.0), ("cc-by-sa", 1, 14, 1.0)]
