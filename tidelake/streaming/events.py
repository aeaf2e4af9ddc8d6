"""Streams: token streams of model calls with their hidden thoughts, and event-time windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<think>", "</think>"
_DELTA = "choices array<struct<delta: struct<content: string, reasoning_content: string, reasoning: string>, finish_reason: string>>, usage map<string, string>, error map<string, string>"


def sse_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines of server-sent events as rows of (kind, text): reasoning, content, usage, error, in the order of the line's parts.

    Lines other than ``data:`` ones, ``[DONE]`` and unreadable JSON give nothing;
    an answer cut at its length is an error.
    """
    body = F.regexp_extract(line, r"^data:\s*(.*)$", 1)
    parsed = lines.where(F.col(line).startswith("data:")).withColumn("body", body).where("body != '[DONE]'").withColumn("j", F.from_json("body", _DELTA, {"mode": "PERMISSIVE"}))
    choice = F.get(F.col("j.choices"), F.lit(0))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    cut = F.when(choice["finish_reason"] == "length", F.lit("length"))
    events = F.array(event("reasoning", F.coalesce(choice["delta"]["reasoning_content"], choice["delta"]["reasoning"])), event("content", choice["delta"]["content"]), event("usage", F.when(F.size("j.usage") > 0, F.to_json("j.usage"))), event("error", F.coalesce(F.when(F.size("j.error") > 0, F.to_json("j.error")), cut)))
    keep = [c for c in lines.columns if c != line]
    return parsed.select(*keep, F.explode(F.filter(events, lambda e: F.length(e["text"]) > 0)).alias("e")).select(*keep, "e.kind", "e.text")


def _cut(tag: str) -> re.Pattern:
    """A tag, or at the text's end what may become one."""
    return re.compile("|".join([re.escape(tag), *(re.escape(tag[:n]) + r"\Z" for n in range(len(tag) - 1, 0, -1))]))


_CUTS = {False: _cut(OPEN), True: _cut(CLOSE)}
_KIND = {False: "content", True: "reasoning"}


def route(held: str, inside: bool, chunk: str) -> tuple[list[tuple[str, str]], str, bool]:
    """(events, held, inside) after a chunk: text between think tags is reasoning, the rest content; what may be a tag's beginning is held for the next chunk."""
    text, at, out = held + chunk, 0, []
    while cut := _CUTS[inside].search(text, at):
        out.append((_KIND[inside], text[at : cut.start()]))
        if cut[0] not in (OPEN, CLOSE):
            return [e for e in out if e[1]], cut[0], inside
        at, inside = cut.end(), not inside
    return [e for e in [*out, (_KIND[inside], text[at:])] if e[1]], "", inside


def route_end(held: str, inside: bool) -> list[tuple[str, str]]:
    """What is still held when a call ends."""
    return [(_KIND[inside], held)] if held else []


def _routed(chunks, held: str, inside: bool) -> tuple[list[tuple[str, str]], str, bool]:
    out = []
    for text in chunks:
        events, held, inside = route(held, inside, text or "")
        out += events
    return out, held, inside


def route_batch(chunks: DataFrame) -> DataFrame:
    """call_id, kind, text: the chunks (call_id, seq, text) of each call routed and joined by kind. A call is a row, so Python's cost is that of its chunks, not of a group."""

    kind_of = dict(chunks.dtypes)["call_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kinds, texts = [], [], []
            for i, parts in enumerate(b.column(1).to_pylist()):
                out, held, inside = _routed(parts, "", False)
                out += route_end(held, inside)
                for k in _KIND.values():
                    if t := "".join(t for kind, t in out if kind == k):
                        at.append(i)
                        kinds.append(k)
                        texts.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["call_id", "kind", "text"])

    calls = chunks.groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("parts"))
    return calls.mapInArrow(run, f"call_id {kind_of}, kind string, text string")


def route_stream(chunks: DataFrame, idle: int | None = None) -> DataFrame:
    """route on a streaming DataFrame of (call_id, seq, text) and, if it is there, last: the open tag and the held text are each call's state.

    A call ends with a chunk marked as its last or, if idle is given, when nothing
    came for so many seconds; what is held is then sent out and its state is
    dropped. With idle, batches go on without data, so a query ends only when it is
    stopped.
    """
    marked = "last" in chunks.columns
    shaped = chunks.select("call_id", "seq", "text", (F.coalesce("last", F.lit(False)) if marked else F.lit(False)).alias("last"))

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, inside = state.get if state.exists else ("", False)
        out, over = [], state.hasTimedOut
        if not over:
            pdf = pd.concat(list(frames)).sort_values("seq")
            out, held, inside = _routed(pdf["text"], held, inside)
            over = bool(pdf["last"].any())
        if over:
            out += route_end(held, inside)
            if state.exists:
                state.remove()
        else:
            state.update((held, inside))
            if idle is not None:
                state.setTimeoutDuration(idle * 1000)
        yield pd.DataFrame([(key[0], k, t) for k, t in out], columns=["call_id", "kind", "text"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return shaped.groupBy("call_id").applyInPandasWithState(run, "call_id long, kind string, text string", "held string, inside boolean", "append", timeout)


def probe(events: DataFrame, start: str = "started_at", at: str = "at") -> DataFrame:
    """Per call the seconds to its first event, first reasoning, first content and end, and the kinds seen."""
    first = lambda kind: (F.min(F.when(F.col("kind") == kind, F.col(at))) - F.min(start)).alias(f"first_{kind}")
    return events.groupBy("call_id").agg((F.min(at) - F.min(start)).alias("first_byte"), first("reasoning"), first("content"), (F.max(at) - F.min(start)).alias("total"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes", *keys: str) -> DataFrame:
    """Counts and sums of events by event-time window; events later than that are dropped where events is a stream. An extra."""
    w = F.window("ts", length, slide or length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a user's events that are at most a gap apart. An extra."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", s.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two ISO texts, at least 0."""
    return F.greatest(F.lit(0), F.unix_timestamp(end, "yyyy-MM-dd'T'HH:mm:ss") - F.unix_timestamp(start, "yyyy-MM-dd'T'HH:mm:ss"))
