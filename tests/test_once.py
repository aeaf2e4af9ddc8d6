"""Steps that a row needs once are computed once."""

from pyspark.sql import functions as F

from tidelake.functions import jsoncheck, values
from tidelake.streaming import events

SCHEMA = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "number"}}}}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_value_is_matched_once(spark):
    """F9, F10, F13."""
    raw = ["(1,234.5%)", "　 7 ", "+nan", "-Inf", "(infinity)", "1_0", "x", "", None, " 1 2", "(％)", "１２"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string").select("i", values.normalize_value(F.col("t")).alias("x"))
    assert plan(df.select("x.status")).count("rlike") == 1
    got = {r.i: tuple(r.x) for r in df.collect()}
    inf = float("inf")
    assert [got[i][0] for i in range(len(raw))] == [-1234.5, 7.0, None, -inf, -inf, 10.0, None, None, None, 12.0, None, 12.0]
    assert [got[i][2] for i in (0, 2, 6, 7, 8)] == ["ok", "blank", "non_numeric", "blank", "blank"] and got[0][1] == "%"


def test_json_is_parsed_once(spark):
    """F8, F12."""
    df = spark.createDataFrame([('{"a": "p. 3", "b": [1, "x"]}',), ("no",), (None,)], "t string")
    mended, wrong = df.select(jsoncheck.repaired(F.col("t"), SCHEMA).alias("x")), df.select(jsoncheck.faults(F.col("t"), SCHEMA).alias("x"))
    assert plan(mended).count("parsejson(") == plan(wrong).count("parsejson(") == 1
    assert [None if r.x is None else (r.x.a, r.x.b) for r in mended.collect()] == [(3, [1.0]), None, None]
    assert [r.x for r in wrong.collect()] == [["a: not of type integer", "b: 1: not of type number"], ["not JSON"], ["not JSON"]]


def test_a_call_is_no_group_of_its_own(spark):
    """F11."""
    rows = [(c, i, t) for c in (1, 2, None) for i, t in enumerate(["a<th", "ink>b", None, "</think>c<"])]
    out = events.route_batch(spark.createDataFrame(rows[::-1], "call_id long, seq int, text string"))
    assert "inpandas" not in plan(out)
    assert {(r.call_id, r.kind, r.text) for r in out.collect()} == {(c, k, t) for c in (1, 2, None) for k, t in (("content", "ac<"), ("reasoning", "b"))}
