"""Metrics over call records and over claims extracted from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import value_in_sentences

# What a claim's type and direction may be.
CLAIM_TYPES = ("사실", "전망", "의견")
CLAIM_DIRECTIONS = ("▲", "▼", "–")


def level_stats(calls: DataFrame) -> DataFrame:
    """Per level: latency quantiles, successes, tokens, throughput, truncations, reasoning tokens.

    calls: level, ok, latency, wall, finish_reason, completion_tokens, reasoning_tokens. Quantiles interpolate linearly and are exact.
    """
    ok = F.col("ok")
    tokens = F.when(ok, F.coalesce("completion_tokens", F.lit(0)))
    r2 = lambda c: F.round(c, 2)
    return calls.groupBy("level").agg(
        r2(F.max("wall")).alias("wall_sec"), r2(F.median("latency")).alias("p50_latency_sec"), r2(F.percentile("latency", 0.9)).alias("p90_latency_sec"), r2(F.max("latency")).alias("max_latency_sec"),
        F.count_if(ok).alias("success_count"), F.count(F.lit(1)).alias("total_count"), F.coalesce(F.sum(tokens), F.lit(0)).alias("completion_tokens_sum"),
        r2(F.when(F.max("wall") > 0, F.coalesce(F.sum(tokens), F.lit(0)) / F.max("wall"))).alias("aggregate_tokens_per_sec"),
        r2(F.avg(F.when(ok & (F.col("latency") > 0), tokens / F.col("latency")))).alias("mean_call_tokens_per_sec"),
        F.count_if(ok & (F.col("finish_reason") == "length")).alias("truncated"),
        F.round(F.avg(F.when(ok, F.col("reasoning_tokens"))), 1).alias("reasoning_tokens_mean"), F.max(F.when(ok, F.col("reasoning_tokens"))).alias("reasoning_tokens_max"),
    )


def errors_by_class(calls: DataFrame) -> DataFrame:
    return calls.where("NOT ok").groupBy("level", "error_class").agg(F.count(F.lit(1)).alias("n"))


def error_class(status: Column, message: Column) -> Column:
    return F.when(status == 429, "429").when(status.between(500, 599), "5xx").when(status.isNull() & F.lower(message).contains("timed out"), "timeout").otherwise("other")


def best_level(stats: DataFrame, documents: int = 100) -> DataFrame:
    """The level of greatest throughput, and the minutes it would take for so many documents."""
    best = stats.agg(F.max_by(F.struct("level", "wall_sec"), F.struct("aggregate_tokens_per_sec", -F.col("level"))).alias("b"))
    return best.select("b.level", (F.ceil(F.lit(documents) / F.col("b.level")) * F.col("b.wall_sec") / 60).alias("minutes"))


def reasoning_tokens(usage: Column, reasoning: Column, content: Column) -> Column:
    """struct(tokens, estimated): the reported number, else by the length of the reasoning, else of what stands between think tags."""
    think = F.regexp_extract(content, r"(?is)<think(?:ing)?>(.*?)</think(?:ing)?>", 1)
    has = F.regexp_like(content, F.lit(r"(?is)<think(?:ing)?>.*?</think(?:ing)?>"))
    est = lambda c: F.greatest(F.lit(1), F.floor(F.length(c) / 3)).cast("long")
    reported = F.get_json_object(usage, "$.completion_tokens_details.reasoning_tokens").try_cast("long")
    return F.struct(F.coalesce(reported, F.when(F.length(reasoning) > 0, est(reasoning)), F.when(has, est(think))).alias("tokens"), (reported.isNull() & (F.coalesce(F.length(reasoning) > 0, F.lit(False)) | F.coalesce(has, F.lit(False)))).alias("estimated"))


def claim_counts(answers: DataFrame) -> DataFrame:
    """Per answer the claims, those with citations and with valid ones, with numbers and with numbers found in what they cite, and of valid type and direction.

    answers: id, claims array<struct<sids, value, type, direction>>, sentences map<sid, text>.
    """
    known = F.map_keys("sentences")
    cites = lambda c: F.coalesce(F.size(c["sids"]), F.lit(0)) > 0
    valid = lambda c: cites(c) & (F.size(F.array_except(c["sids"], known)) == 0)
    has_value = lambda c: F.coalesce((F.trim(c["value"]) != "") & (F.lower(F.trim(c["value"])) != "null"), F.lit(False))
    cited = lambda c: F.filter(F.transform(F.coalesce(c["sids"], F.array().cast("array<string>")), lambda s: F.element_at("sentences", s)), lambda s: s.isNotNull())
    enum = lambda c: F.coalesce(c["type"].isin(*CLAIM_TYPES) & c["direction"].isin(*CLAIM_DIRECTIONS), F.lit(False))
    n = lambda test: F.size(F.filter("claims", test)).cast("long")
    return answers.select("id", F.size("claims").cast("long").alias("claims"), n(cites).alias("sids_total"), n(valid).alias("sids_ok"), n(has_value).alias("numeric_total"), n(lambda c: has_value(c) & value_in_sentences(c["value"], cited(c))).alias("numeric_ok"), F.size("claims").cast("long").alias("enum_total"), n(enum).alias("enum_ok"))


def quality(answers: DataFrame) -> DataFrame:
    """One row of percentages over answers (truncated, json_ok, schema_ok and claim_counts' columns); truncated ones are only counted, and a percentage of nothing is null."""
    used = ~F.col("truncated")
    good = used & F.col("json_ok")
    pct = lambda a, b: F.round(F.when(b > 0, 100 * a / b), 1)
    s = lambda c: F.sum(F.when(good, F.col(c)))
    return answers.agg(
        F.count_if(used).alias("responses_total"), F.count_if("truncated").alias("truncated_excluded"), pct(F.count_if(good), F.count_if(used)).alias("json_parse_ok_pct"), pct(F.count_if(good & F.col("schema_ok")), F.count_if(good)).alias("schema_ok_pct"),
        F.round(F.avg(F.when(good, F.col("claims"))), 2).alias("avg_claims_count"), pct(s("sids_ok"), s("sids_total")).alias("sids_valid_pct"), pct(s("numeric_ok"), s("numeric_total")).alias("numeric_value_match_pct"), pct(s("enum_ok"), s("enum_total")).alias("enum_valid_pct"),
    )


def series_summary(points: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """Per series its first, last and greatest value, and the change from first to last with its percentage."""
    ends = points.groupBy(*keys).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.max(value).alias("peak"))
    return ends.withColumn("change", F.col("last") - F.col("first")).withColumn("pct", F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.abs("first") * 100))


def extreme_cells(cells: DataFrame) -> DataFrame:
    """The greatest and the least cell of a table of (row, col, value), the first in row-major order among equals."""
    return cells.agg(*(f(F.struct("row", "col", "value"), F.struct(F.col("value") * sign, "row", "col")).alias(n) for n, f, sign in (("min_cell", F.min_by, 1), ("max_cell", F.min_by, -1)))).select(*(F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in ("min_cell", "max_cell") for c in ("row", "col", "value")))


def last_turns(turns: DataFrame, k: int = 4) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def queue_position(jobs: DataFrame, job_id: int) -> DataFrame:
    """How many queued jobs stand up to a job's place; 0 if it is not queued."""
    queued = F.col("status") == "queued"
    return jobs.agg(F.when(F.count_if(queued & (F.col("id") == job_id)) > 0, F.count_if(queued & (F.col("id") <= job_id))).otherwise(F.lit(0)).alias("position"))


def queue_head(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'queued'").agg(F.min("id").alias("id"))


def round_robin(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Rows dealt in turn to n places."""
    return rows.withColumn("place", F.pmod(F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1, F.lit(n)).cast("long"))
