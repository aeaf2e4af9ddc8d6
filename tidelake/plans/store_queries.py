"""Registered queries that go through a store, a SQLite file or the question layer, all filled from the given tables."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scratch
from ..operators.store import Store
from ..sources.sqlite import sqlite_table
from . import ask, refresh
from . import views as v
from .suite import register


def _store(spark: SparkSession) -> Store:
    return Store(spark, scratch.new_path(spark, "store"))


def _brands(spark: SparkSession, d: str, raised: float) -> DataFrame:
    """The price of parts by brand and size, unlabelled; raised for the first ten sizes."""
    price = F.col("p_retailprice").cast("decimal(18,2)") + F.when(F.col("p_size") <= 10, raised).otherwise(0).cast("decimal(18,2)")
    rows = v.table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.sum(price).cast("double").alias("value"))
    return rows.select(F.lit("prices").alias("dataset"), F.lit("price").alias("metric"), F.col("p_brand").alias("entity"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("region"), F.lit("2024").alias("period"), "value")


_PRICES = "k AS (SELECT p_brand, p_size, count(*) AS parts FROM part GROUP BY 1, 2), n AS (SELECT count(*) AS n, count(*) FILTER (p_size <= 10) AS changed FROM k)"


@register("snapshot_reissue", f"""WITH {_PRICES} SELECT CAST(id AS BIGINT) AS id, CASE WHEN new THEN n ELSE 0 END AS rows, CASE WHEN new THEN 'ok' ELSE 'skipped_duplicate' END AS status,
  CAST(base AS BIGINT) AS baseline, CASE WHEN base IS NOT NULL THEN changed END AS changed, CASE WHEN base IS NOT NULL THEN 0 END AS added
  FROM n, (VALUES (1, true, NULL), (2, true, 1), (3, false, NULL), (4, true, 2)) t(id, new, base)""")
def _(spark, d):
    """A-B-B-A: content that was there before, but not last, is written again."""
    store = _store(spark)
    for raised in (0, 1, 1, 0):
        store.snapshot(_brands(spark, d, raised))
    field = lambda name: F.get_json_object("report", f"$.{name}").cast("long").alias(name)
    return store.table("loads").join(store.table("reports").withColumnRenamed("load_id", "id"), "id", "left").select("id", "rows", "status", field("baseline"), field("changed"), field("added"))


@register("store_ledger", f"""WITH {_PRICES} SELECT CAST(id AS BIGINT) AS id, 'prices' AS dataset, 'Prices' AS title, status, CASE WHEN id = 1 THEN n ELSE 0 END AS rows, CAST(error_length AS INTEGER) AS error_length
  FROM n, (VALUES (1, 'ok', NULL), (2, 'error', 2000), (3, 'skipped_duplicate', NULL)) t(id, status, error_length)""")
def _(spark, d):
    """Loads newest first with their dataset's title: one written, one failed, one skipped."""
    store = _store(spark)
    store.snapshot(_brands(spark, d, 0))
    store.write_error("prices", "", "no such column " * 200, "2026-01-01T00:00:00")
    store.write_skip("prices", "h", "", "", "2026-01-01T00:00:00")
    store.upsert_dataset("prices", "Prices")
    return store.list_loads("prices").join(store.table("datasets").withColumnRenamed("name", "dataset"), "dataset").select("id", "dataset", "title", "status", "rows", F.length("error").alias("error_length"))


def _filled(path: str) -> Callable:
    def run(batches: Iterator) -> Iterator:
        with closing(sqlite3.connect(path)) as db:
            db.execute("CREATE TABLE part (p_partkey INTEGER PRIMARY KEY, p_name TEXT, p_brand TEXT, p_size INT, p_retailprice REAL)")
            for pdf in batches:
                db.executemany("INSERT INTO part VALUES (?, ?, ?, ?, ?)", pdf.astype(object).itertuples(index=False))
                yield pdf[["p_partkey"]]
            db.commit()

    return run


@register("sqlite_scan", "SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_size > 25 AND p_brand IN ('Brand#3', 'Brand#14') AND p_retailprice < 1500")
def _(spark, d):
    """Parts in a SQLite file, scanned by ranges of row ids with the filters in the file. One task makes the file, in a folder that all executors see."""
    path = scratch.mounted(spark, scratch.new_path(spark, "part"))
    columns = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]
    v.table(spark, d, "part").select(columns).coalesce(1).mapInPandas(_filled(path), "p_partkey long").write.format("noop").mode("overwrite").save()
    found = sqlite_table(spark, path, "part", ["p_partkey", "p_brand", "p_size", "p_retailprice"])
    return found.where("p_size > 25 AND p_brand IN ('Brand#3', 'Brand#14') AND p_retailprice < 1500").drop("p_size")


_SHIPPED = "SELECT p_brand AS entity, year(l_shipdate) AS y, quarter(l_shipdate) AS q, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"


def _asked(spark: SparkSession, d: str, questions: list[str], rows: int) -> DataFrame:
    """The answers' cells: question, path of the answer, name of the row, column, value."""
    lines = v.table(spark, d, "lineitem").join(v.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    period = F.concat(F.year("l_shipdate").cast("string"), F.lit("Q"), F.quarter("l_shipdate").cast("string"))
    shipped = lines.groupBy(F.col("p_brand").alias("entity"), period.alias("period")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("value"))
    store = _store(spark)
    store.snapshot(shipped.select(F.lit("shipped").alias("dataset"), F.lit("quantity").alias("metric"), "entity", "period", "value"))
    assistant, cells = ask.Assistant(store), []
    for q in questions:
        out = assistant.ask(q)
        cells += [(q, out["path"], r[0] if rows else "", c, x) for r in out["rows"] for c, x in zip(out["columns"][rows:], r[rows:], strict=True) if x is not None]
    return spark.createDataFrame(cells, "question string, path string, entity string, column string, value double")


@register("ask_trend", f"WITH s AS ({_SHIPPED}) SELECT entity || ' 연도별 추이' AS question, 'rule' AS path, entity, CAST(y AS VARCHAR) AS column, sum(value) AS value FROM s WHERE entity IN ('Brand#7', 'Brand#8') GROUP BY entity, y")
def _(spark, d):
    return _asked(spark, d, ["Brand#7 연도별 추이", "Brand#8 연도별 추이"], 1)


@register("ask_compare", f"WITH s AS ({_SHIPPED}) SELECT 'Brand#7 Brand#8 1997년 1분기 비교' AS question, 'rule' AS path, entity, y || 'Q' || q AS column, value FROM s WHERE entity IN ('Brand#7', 'Brand#8') AND y = 1997 AND q = 1")
def _(spark, d):
    return _asked(spark, d, ["Brand#7 Brand#8 1997년 1분기 비교"], 1)


@register("level_report", f"""WITH {v.CALLS_SQL}, e AS (SELECT level, string_agg(error_class || '=' || n, ' ' ORDER BY n DESC, error_class) AS errors FROM (SELECT level, error_class, count(*) AS n FROM calls WHERE NOT ok GROUP BY 1, 2) GROUP BY 1)
  SELECT CAST(level AS VARCHAR) AS level, count(*) FILTER (ok) || '/' || count(*) AS done, CAST(coalesce(sum(completion_tokens) FILTER (ok), 0) AS VARCHAR) AS completion_tokens_sum, CAST(count(*) FILTER (ok AND finish_reason = 'length') AS VARCHAR) AS truncated, coalesce(any_value(errors), 'none') AS errors
  FROM calls LEFT JOIN e USING (level) GROUP BY level""")
def _(spark, d):
    return refresh.level_report(v.calls(spark, d)).select("level", "done", "completion_tokens_sum", "truncated", "errors")
