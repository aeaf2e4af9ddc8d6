import random

from pyspark.sql import functions as F

from tidelake.streaming import events


def test_router_does_not_depend_on_chunks():
    text, want = "a<think>b<c</think>d<th", {"content": "ad<th", "reasoning": "b<c"}
    r = random.Random(1)
    for _ in range(200):
        cuts = sorted(r.sample(range(len(text) + 1), 4))
        buffer, inside, found = "", False, {"content": "", "reasoning": ""}
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            out, buffer, inside = events.route(buffer, inside, text[a:b])
            for kind, t in out:
                found[kind] += t
        found["content"] += buffer
        assert found == want


def test_stateful_router_on_a_stream(spark, tmp_path):
    for i, part in enumerate(["x<thi", "nk>y</think>", "z"]):
        spark.createDataFrame([(1, i, part)], "call_id long, seq int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("call_id long, seq int, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.route_stream(stream).writeStream.outputMode("append").format("memory").queryName("routed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    found = {k: "".join(r.text for r in rows) for k, rows in ((k, spark.table("routed").where(F.col("kind") == k).collect()) for k in ("content", "reasoning"))}
    assert found == {"content": "xz", "reasoning": "y"}


def test_sse(spark):
    lines = ['data: {"choices":[{"delta":{"content":"hi"}}]}', "data: [DONE]", ": ping", "data: {bad", 'data: {"choices":[{"delta":{"reasoning":"r"},"finish_reason":"length"}]}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, line string")
    assert {(r.n, r.kind, r.text) for r in events.sse_events(df).collect()} == {(0, "content", "hi"), (4, "reasoning", "r"), (4, "error", "length")}


def test_a_call_marked_as_ended_gives_what_is_held(spark, tmp_path):
    schema = "call_id long, seq int, text string, last boolean"
    for i, (call, part, last) in enumerate([(1, "x<th", False), (2, "<think>y</t", False), (1, "en", False), (1, "<", True), (2, "", True)]):
        spark.createDataFrame([(call, i, part, last)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.route_stream(stream).writeStream.outputMode("append").format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    found = {}
    for r in spark.table("ended").collect():
        found[r.call_id, r.kind] = found.get((r.call_id, r.kind), "") + r.text
    assert found[2, "reasoning"] == "y</t" and sorted(found[1, "content"]) == sorted("x<then<")
