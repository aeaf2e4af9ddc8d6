"""Small tables with everything awkward: nulls, empty and long texts, ties, repeats, clashing column names."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, n long, uid long, size long, kept boolean"


def fold(text):
    return (text or "").translate(_FOLD)


def awkward(seed=1, n=60):
    r = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "DELTA", "é", "the", "of", "naïve", "日本", "x1", "1.2.3.4", "a@b.co"]
    rows = []
    for i in range(n):
        base = [r.choice(words) for _ in range(r.randint(0, 40))]
        rows.append((i, " ".join(base), "en", r.choice(["s1", "s2", None, ""]), len(base)))
        if i % 5 == 0:
            rows.append((1000 + i, " ".join(base).upper(), "en", "s1", 1))
        if i % 7 == 0 and base:
            edited = list(base)
            edited[r.randrange(len(edited))] = "zeta"
            rows.append((2000 + i, "\t".join(edited), "en", "s3", 1))
    rows += [(3000, None, None, None, None), (3001, "", "en", "s1", 0), (3002, " \n ", "en", "s1", 3), (3003, "long " * 30000, "en", "s2", 150000), (3004, "w" * 70000, "en", "s2", 70000), (5, rows[5][1], "en", "s1", 1)]
    return [(*x, "clash", 7, 8, 9, True) for x in rows]


def frame(spark, rows=None, schema=SCHEMA):
    return spark.createDataFrame(awkward() if rows is None else rows, schema)


def shingles(text, k=5):
    w = WORD.findall(fold(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
