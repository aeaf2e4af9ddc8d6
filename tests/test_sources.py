import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidelake.functions import jsoncheck, jsontext, periods, text
from tidelake.sources import readers, sqlite
from tidelake.sources.config import SourceConfig

SCHEMA = {
    "type": "object", "required": ["page", "direction"],
    "properties": {
        "page": {"type": "integer"}, "value": {"type": "number"}, "sure": {"type": "boolean"}, "direction": {"type": "string", "enum": ["▲", "▼", "–"]},
        "rows": {"type": "array", "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "name": {"type": "string"}}}},
        "tags": {"type": "array", "items": {"type": "string", "enum": ["high", "med"]}},
    },
}


def answers(n, seed):
    r = random.Random(seed)
    one = lambda: r.choice([1, 2.5, 7.0, "p. 12", "$1,234%", "x", True, "true", None, "▲", "up", "MED", "high", {"n": 3}, [], {"n": "p. 4", "name": 5}, {"name": "z"}])
    out = []
    for _ in range(n):
        doc = {k: one() for k in ("page", "value", "sure", "direction", "rows", "tags") if r.random() < 0.8}
        if r.random() < 0.7:
            doc["rows"], doc["tags"] = [one() for _ in range(r.randrange(4))], [one() for _ in range(r.randrange(3))]
        out.append(doc)
    return out


def test_faults_as_columns_are_those_of_the_driver(spark):
    docs = answers(300, 1)
    rows = [(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)] + [(-1, "no json"), (-2, None), (-3, "[1]")]
    got = {r.i: r.f for r in spark.createDataFrame(rows, "i long, x string").select("i", jsoncheck.faults(F.col("x"), SCHEMA).alias("f")).collect()}
    assert (got[-1], got[-2], got[-3]) == (["not JSON"], ["not JSON"], ["not of type object"])
    clean = lambda f: f if "is not allowed" not in f else f.split(": ")[0]  # noqa: E731  (values are shown as JSON, not as Python does)
    for i, d in enumerate(docs):
        assert sorted(map(clean, got[i])) == sorted(map(clean, jsontext.validate(d, SCHEMA))), d


def test_repair_as_columns(spark):
    rows = [('{"page": "p. 12", "value": "$1,234%", "sure": "True", "direction": "up", "rows": [{"n": "7.0"}, {"name": "x"}, 3, {"n": 2, "name": 5}], "tags": ["HIGH", "none", "medium"]}',), ('{"page": 7.0, "value": 3, "direction": "sideways", "rows": {}}',), ("x",), ("[]",), (None,)]
    got = [r.v for r in spark.createDataFrame(rows, "x string").select(jsoncheck.repaired(F.col("x"), SCHEMA).alias("v")).collect()]
    a, b = got[0].asDict(True), got[1].asDict(True)
    assert a == {"page": 12, "value": 1234.0, "sure": True, "direction": "▲", "rows": [{"n": 7, "name": None}, {"n": 2, "name": "5"}], "tags": ["high", "med"]}
    assert b == {"page": 7, "value": 3.0, "sure": None, "direction": "sideways", "rows": None, "tags": None}
    assert got[2:] == [None, None, None]


@pytest.fixture
def file(tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE t (id INTEGER PRIMARY KEY, name VARCHAR(9), price REAL, dirty REAL, free, "odd name" INT)')
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", [(i * 3 - 50, f"n{i % 7}" if i % 5 else None, i / 4, "n.a." if i == 70 else i, [i, str(i), 0.5, b"b", None][i % 5], i) for i in range(200)])
        db.execute("CREATE TABLE none (a INT, b TEXT)")
        db.execute("CREATE TABLE pairs (a TEXT PRIMARY KEY, b INT) WITHOUT ROWID")
        db.execute("INSERT INTO pairs VALUES ('x', 1), ('y', 2)")
        db.execute("CREATE VIEW v AS SELECT 'd' AS dataset, name AS metric, 'e' AS entity, '2024' AS period, price AS value FROM t")
        db.execute("CREATE TABLE obs (dataset TEXT, metric TEXT, entity TEXT, period TEXT, value REAL)")
        db.execute("INSERT INTO obs SELECT 'd', 'm', 'e', '2024', id FROM t")
    return path


def test_a_table_is_read_in_ranges_with_declared_types(spark, file):
    df = sqlite.sqlite_table(spark, file, "t", parts=6)
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "price": "double", "dirty": "string", "free": "string", "odd name": "bigint"}
    rows = sorted(df.collect(), key=lambda r: r.id)
    assert df.rdd.getNumPartitions() == 6 and len(rows) == 200 and [r.id for r in rows] == [i * 3 - 50 for i in range(200)]
    assert (rows[70].dirty, rows[3].free, rows[2].free, rows[4].free) == ("n.a.", "b", "0.5", None)
    assert sqlite.sqlite_table(spark, file, "t", ["price", "odd name"]).columns == ["price", "odd name"]
    with pytest.raises(ValueError):
        sqlite.sqlite_table(spark, file, "t", ["nope"])
    with pytest.raises(ValueError):
        sqlite.sqlite_table(spark, file, "nope")
    assert sqlite.sqlite_table(spark, file, "none").collect() == []
    assert sorted(tuple(r) for r in sqlite.sqlite_table(spark, file, "pairs").collect()) == [("x", 1), ("y", 2)]


def test_filters_go_to_the_file_and_hold(spark, file):
    df = sqlite.sqlite_table(spark, file, "t", parts=3)
    all_rows = df.collect()
    for where in ("id > 100 AND name = 'n3'", "name IN ('n1', 'n2') AND price <= 20.5", "dirty = '5.0'", "name IS NOT NULL AND id < 0", "free = '0.5'", "`odd name` >= 7"):
        got = sorted(r.id for r in df.where(where).collect())
        want = sorted(r.id for r in spark.createDataFrame(all_rows, df.schema).where(where).collect())
        assert got == want and got, where
    seen = sqlite._Reader({"path": file, "table": "t", "ranges": "[]", "safe": '["id", "name"]'}, df.schema)
    kept = list(seen.pushFilters([sqlite.GreaterThan(("id",), 5), sqlite.In(("name",), ("a", "b")), sqlite.EqualTo(("free",), "x")]))
    assert len(kept) == 3 and len(seen.where) == 2 and seen.values == [5, "a", "b"]


def test_sources_are_read_in_parallel_where_they_are_tables(spark, file):
    source = SourceConfig(db=file, query="SELECT * FROM obs")
    assert readers.read_source(spark, source).rdd.getNumPartitions() > 1
    view = SourceConfig(db=file, query="SELECT * FROM v")
    assert readers.read_source(spark, view).where("value IS NOT NULL").count() == 200


def test_the_names_most_alike(spark):
    r = random.Random(4)
    names = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(r.randint(1, 4))) + str(i % 7)) for i in range(60)] + [(99, None), (98, "")]
    asked = [(i, names[i % 60][1][1:] + ("x" if i % 2 else "")) for i in range(40)] + [(50, "qqq"), (51, None), (52, "")]
    from tidelake.plans.ask import likeness

    want = []
    for i, a in asked:
        best = sorted((-round(likeness(a or "", b or ""), 12), j) for j, b in names if likeness(a or "", b or "") > 0)[:3]
        want += [(i, rank, j) for rank, (_, j) in enumerate(best, 1)]
    left, right = spark.createDataFrame(asked, "a long, x string"), spark.createDataFrame(names, "b long, y string")
    got = sorted((x.a, x.rank, x.b) for x in text.top_names(left, right, "a", "x", "b", "y", 3).collect())
    assert got == sorted(want)


def test_period_columns_and_their_twins_agree(spark):
    years, parts = ("2025", "25", "'25", "1999", "0000"), ("", "Q1", "q4", "Q5", "-3", ".12", "/13", "W1", "w53", "W54", "-W07", " Q2", "-Q3", "0", "Q", "00")
    texts = {y + p for y in years for p in parts} | {p + y for y in ("2025", "25", "'25") for p in ("Q1", "Q2 ", "q3-", "Q4'", "FY", "fy'", "3Q", "4q", "5Q")} | {"", " 2024 ", "x", "2024-", "20245"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", periods.normalize_period(F.col("t")).alias("p")).collect()
    assert {r.t: tuple(r.p) for r in rows} == {t: periods.parse(t) for t in texts}
