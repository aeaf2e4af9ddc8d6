import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidelake.functions import jsontext, periods, text, values, vectors


def model_value(raw):
    """A plain Python reading of the rules for one text."""
    if raw is None:
        return None, None, "blank"
    t = raw.strip()
    if t.casefold() in values.BLANKS:
        return None, None, "blank"
    sign, unit = 1, None
    if t.startswith("(") and t.endswith(")"):
        sign, t = -1, t[1:-1].strip()
    if t.endswith("%"):
        unit, t = "%", t[:-1]
    t = re.sub(r"[,\s]", "", t)
    if not t:
        return None, None, "blank"
    try:
        x = sign * float(t)
    except ValueError:
        return None, None, "non_numeric"
    return (None, None, "blank") if math.isnan(x) else (x + 0.0, unit, "ok")


def test_values_match_the_model_on_generated_texts(spark):
    r = random.Random(4)
    parts = ["1", "23", ",", ".", "(", ")", "%", "-", "+", " ", "e", "_", "n.a.", "abc", " ", "　", "0", "d", "f", "inf", "nan"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 5))) for _ in range(1500)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x.v for x in df.select("i", values.normalize_value(F.col("t")).alias("v")).collect()}
    for i, t in enumerate(texts):
        assert (got[i].value, got[i].unit, got[i].status) == model_value(t), t


def test_typed_values(spark):
    df = spark.createDataFrame([(True, 1, float("nan"), -0.0)], "b boolean, i int, n double, z double")
    row = df.select(*(values.normalize_typed(F.col(c), k).alias(c) for c, k in df.dtypes)).first()
    assert row.b.status == "non_numeric" and row.i.value == 1.0 and row.n.status == "blank"
    assert math.copysign(1, row.z.value) == 1


def test_period_columns_match_the_driver_twins(spark):
    r = random.Random(5)
    shapes = ["2025", "25", "Q3", "Q5", "3Q", "'", "-", " ", ".", "/", "FY", "fy", "W", "W05", "09", "13", "작년", ""]
    texts = ["".join(r.choices(shapes, k=r.randint(0, 4))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for x in df.select("t", periods.normalize_period(F.col("t")).alias("p"), periods.range_end_sort(F.col("t")).alias("u")).collect():
        assert tuple(x.p) == periods.parse(x.t) and x.u == periods.upper_bound(x.t), x.t


def test_period_of_dates_and_numbers(spark):
    df = spark.createDataFrame([(datetime.date(2024, 3, 15), 2024.0, 2024.5)], "d date, y double, h double")
    row = df.select(*(periods.normalize_period_typed(F.col(c), k)["period"].alias(c) for c, k in df.dtypes)).first()
    assert tuple(row) == ("2024-03", "2024", "2024-05")
    assert periods.parse(datetime.date(2024, 3, 15))[0] == "2024-03" and periods.parse(2024.0)[0] == "2024"


def test_upper_bounds_cover_finer_periods():
    for inner, outer in (("2025Q4", "2025"), ("2025-12", "2025"), ("2025W53", "2025"), ("2025-04", "2025Q2"), ("2025-06", "2025Q2")):
        assert periods.parse(outer)[1] <= periods.upper_bound(outer) and periods.parse(inner)[1] <= periods.upper_bound(outer)
    assert periods.parse("2025-07")[1] > periods.upper_bound("2025Q2")


def test_week_quarters_match_the_calendar(spark):
    rows = [(f"{y}W{w:02d}",) for y in range(2015, 2031) for w in range(1, 54)]
    df = spark.createDataFrame(rows, "p string")
    for x in df.select("p", periods.coarsen_period(F.col("p"), "quarter").alias("c")).collect():
        y, w = int(x.p[:4]), int(x.p[5:])
        try:
            want = f"{y}Q{(datetime.date.fromisocalendar(y, w, 1).month - 1) // 3 + 1}"
        except ValueError:
            want = None
        assert (x.c.period if x.c else None) == want
    with pytest.raises(ValueError):
        periods.coarsen_period(F.col("p"), "month")


def test_sentences_and_numbers(spark):
    t = "First sentence is long. Second one is long too!\r\n\r\nshort.\n \nThird   sentence\tstands here? Yes."
    row = spark.createDataFrame([(t,)], "t string").select(text.sentences(F.col("t")).alias("s"), text.numbers(F.lit("2024Q1 was -1,200.5% of 7")).alias("n")).first()
    assert row.s == ["First sentence is long.", "Second one is long too!", "Third sentence stands here?"]
    assert row.n == ["-1,200.5%", "7"]


def test_token_estimate_counts_scripts(spark):
    row = spark.createDataFrame([("한글ab𠀀",)], "t string").select(text.estimate_tokens(F.col("t"), 1.0).alias("n")).first()
    assert row.n == math.ceil(3 + 2 / 4)


def test_trigram_similarity(spark):
    a = spark.createDataFrame([(1, "Hello World"), (2, "ab"), (3, "")], "a long, x string")
    b = spark.createDataFrame([(1, "helloworld"), (2, "AB"), (3, "zzzz")], "b long, y string")
    got = {(r.a, r.b): round(r.similarity, 9) for r in text.similarities(a, b, "a", "x", "b", "y").collect()}
    assert got == {(1, 1): 1.0, (2, 2): 1.0}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [])], "i int, v array<float>")
    got = {r.i: r.n for r in df.select("i", vectors.normalized(F.col("v")).alias("n")).collect()}
    assert [round(x, 6) for x in got[1]] == [0.6, 0.8] and got[2] is None and got[3] is None and got[4] is None


def test_json_on_the_driver():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "d": {"type": "string", "enum": ["▲", "▼", "–"]}, "l": {"type": "array", "items": {"type": "number"}}}}
    mended = jsontext.mended({"a": "p. 12페이지", "d": "Up", "l": ["$1,234%", "x"]}, schema)
    assert mended == {"a": 12, "d": "▲", "l": [1234.0]} and jsontext.validate(mended, schema) == []
    assert jsontext.validate({}, schema) == ["lacks a"]
    assert jsontext.validate({"a": 1, "d": None}, schema) == [] and jsontext.validate({"a": None}, schema) == ["a: not of type integer"]
    assert jsontext.first_object('a {"x": "}"} b') == '{"x": "}"}' and jsontext.first_object("{") is None
