import hashlib
import re
import unicodedata

from util import awkward, frame

from tidelake.llm import fingerprints


def canonical(t):
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub(r"[\s\x85\xa0]+", " ", nfkc(nfkc(t).casefold())).strip(" ")


def distinct_rows():
    seen, out = set(), []
    for r in [*awkward(), (4000, "Straße ﬁ", "", "", 1, "", 1, 1, 1, True), (4001, "STRASSE  fi\n", "", "", 1, "", 1, 1, 1, True), (4002, "É Å", "", "", 1, "", 1, 1, 1, True), (4003, "é　Å", "", "", 1, "", 1, 1, 1, True)]:
        if r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


def check(rows, got):
    text = {r[0]: r[1] or "" for r in rows}
    ids, classes = sorted(text, reverse=True), {}
    for k, i in enumerate(ids):
        t, nxt, g = text[i], text[ids[(k + 1) % len(ids)]], got[i]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert classes.setdefault(g.fingerprint, canonical(t)) == canonical(t)
        assert classes.setdefault(g.edited_fingerprint, canonical(edited)) == canonical(edited)
        assert g.near_edited == float(canonical(t) == canonical(edited)) and g.near_next == float(canonical(t) == canonical(nxt))
    assert len({g.fingerprint for g in got.values()}) == len({canonical(t) for t in text.values()})


def test_against_brute_force(spark):
    rows = distinct_rows()
    check(rows, {r.doc_id: r for r in fingerprints.edited_fingerprints(frame(spark, rows)).collect()})


def test_colliding_digests_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "digest", lambda form: F.lpad(F.length(form).cast("string"), 32, "0"))
    rows = distinct_rows()
    got = fingerprints.edited_fingerprints(frame(spark, rows)).collect()
    form = {r[0]: canonical(r[1] or "") for r in rows}
    assert len({g.fingerprint for g in got}) == len(set(form.values()))


def test_groups(spark):
    rows = distinct_rows()
    got = {r.fingerprint: (r.group_size, r.first_id) for r in fingerprints.groups(fingerprints.edited_fingerprints(frame(spark, rows))).collect()}
    want = {}
    for r in rows:
        want.setdefault(canonical(r[1] or ""), []).append(r[0])
    assert sorted(got.values()) == sorted((len(v), min(v)) for v in want.values())


def test_predecessors_over_wide_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BITS", 2)
    ids = [-(2**60), -5, 0, 1, 2, 3, 17, 64, 1000, 2**61]
    got = {r.id: r.next for r in fingerprints.predecessors(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert got == {b: a for a, b in zip([ids[-1], *ids], ids, strict=False)}


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "a", *[None] * 8), (1, "b", *[None] * 8), (None, "Aa", *[None] * 8), (None, None, *[None] * 8)]
    assert len(fingerprints.edited_fingerprints(frame(spark, rows)).collect()) == 4
    assert fingerprints.edited_fingerprints(frame(spark, [])).collect() == []


def test_texts_are_dealt_out_once(spark, tmp_path, monkeypatch):
    frame(spark).write.parquet(f"{tmp_path}/d")
    plans, written = [], fingerprints.materialise

    def watched(df, name):
        if name == "edited":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return written(df, name)

    monkeypatch.setattr(fingerprints, "materialise", watched)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        fingerprints.edited_fingerprints(spark.read.parquet(f"{tmp_path}/d")).collect()
    finally:
        spark.conf.set(limit, before)
    assert plans and "ReusedExchange [doc_id" in plans[0]
