"""Observation views over a star schema, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import unpivot


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with its brand, region and priority; only the needed columns are read."""
    t = lambda n: table(spark, d, n)
    return (
        t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
        .join(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    )


_QUARTER = "concat(year(l_shipdate), 'Q', quarter(l_shipdate))"


def obs_sales(spark: SparkSession, d: str) -> DataFrame:
    """dataset sales: revenue and quantity by brand, region, quarter and priority."""
    money = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))
    base = sales_lines(spark, d).groupBy(F.col("p_brand").alias("entity"), F.col("r_name").alias("region"), F.expr(_QUARTER).alias("period"), F.col("o_orderpriority").alias("source"))
    wide = base.agg(F.sum(money).cast("double").alias("revenue"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))
    long = unpivot(wide, ["entity", "region", "period", "source"], {"revenue": "revenue", "quantity": "quantity"}, "metric")
    sort = F.concat(F.substring("period", 1, 4), F.lpad((F.substring("period", 6, 1).cast("int") * 3 - 2).cast("string"), 2, "0"), F.lit("00"))
    return long.select(F.lit(7).cast("long").alias("load_id"), F.lit(0).cast("long").alias("seq"), F.lit("sales").alias("dataset"), "metric", "entity", "region", "period", sort.alias("period_sort"), "source", "value", F.when(F.col("metric") == "revenue", "USD").otherwise("EA").alias("unit"))


LINES_SQL = """lines AS (
  SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
SALES_SQL = LINES_SQL + """,
wide AS (
  SELECT p_brand AS entity, r_name AS region, year(l_shipdate) || 'Q' || quarter(l_shipdate) AS period, o_orderpriority AS source,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
  FROM lines GROUP BY ALL),
sales AS (
  SELECT 'sales' AS dataset, metric, entity, region, period, left(period, 4) || lpad(CAST(CAST(period[6] AS INT) * 3 - 2 AS VARCHAR), 2, '0') || '00' AS period_sort, source, value, unit
  FROM (SELECT *, 'revenue' AS metric, revenue AS value, 'USD' AS unit FROM wide UNION ALL SELECT *, 'quantity', quantity, 'EA' FROM wide))"""


def obs_dirty(spark: SparkSession, d: str) -> DataFrame:
    """Raw source rows with values and periods as messy text."""
    q = F.col("l_quantity").cast("int").cast("string")
    k, p = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(9)), F.pmod(F.col("l_orderkey"), F.lit(10))
    value = F.concat(F.lit("1,2"), F.lpad(q, 2, "0"), F.lit(".5"))
    for i, v in enumerate((F.concat(F.lit("("), q, F.lit(".25)")), F.concat(q, F.lit(".5%")), F.lit("n.a."), F.lit("-"), F.lit(""), F.lit("abc"), q, F.concat(F.lit("  "), q, F.lit(" "))), 1):
        value = F.when(k == i, v).otherwise(value)
    y, n, m = F.year("l_shipdate").cast("string"), F.quarter("l_shipdate").cast("string"), F.month("l_shipdate").cast("string")
    s = F.substring(y, 3, 2)
    period = F.concat(y, F.lit("Q"), n)
    spellings = (F.concat(s, F.lit("Q"), n), F.concat(n, F.lit("Q"), s), F.concat(F.lit("Q"), n, F.lit(" "), y), F.concat(F.lit("FY"), s), F.concat(y, F.lit("."), m), F.concat(y, F.lit("-"), m), y, F.concat(F.lit("Q5 "), y), F.concat(F.lit(" "), y, F.lit("W0"), n, F.lit(" ")))
    for i, v in enumerate(spellings, 1):
        period = F.when(p == i, v).otherwise(period)
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), F.concat(F.lit("d"), F.col("l_linenumber").cast("string")).alias("dataset"), F.lit("m").alias("metric"), F.col("l_returnflag").alias("entity"), period.alias("period"), F.col("l_linestatus").alias("region"), value.alias("value"), F.lit("EA").alias("unit"))


# The same rows with what normalising must give, by construction of each case.
DIRTY_SQL = """dirty AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, 'd' || l_linenumber AS dataset, l_returnflag AS entity, l_linestatus AS region,
         (l_orderkey + l_linenumber) % 9 AS k, l_orderkey % 10 AS p, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS q,
         CAST(year(l_shipdate) AS VARCHAR) AS y, 2000 + year(l_shipdate) % 100 AS y2, quarter(l_shipdate) AS n, month(l_shipdate) AS m FROM lineitem),
normal AS (
  SELECT *, CASE k WHEN 0 THEN 1200 + q + 0.5 WHEN 1 THEN -(q + 0.25) WHEN 2 THEN q + 0.5 WHEN 7 THEN q WHEN 8 THEN q END AS value,
         CASE WHEN k = 2 THEN '%' ELSE 'EA' END AS unit, CASE WHEN k IN (3, 4, 5) THEN 'blank' WHEN k = 6 THEN 'non_numeric' ELSE 'ok' END AS status,
         CASE p WHEN 0 THEN y || 'Q' || n WHEN 1 THEN y2 || 'Q' || n WHEN 2 THEN y2 || 'Q' || n WHEN 3 THEN y || 'Q' || n WHEN 4 THEN CAST(y2 AS VARCHAR)
                WHEN 5 THEN y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') WHEN 6 THEN y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') WHEN 7 THEN y WHEN 8 THEN 'Q5 ' || y ELSE y || 'W0' || n END AS period,
         CASE p WHEN 0 THEN y || lpad(CAST(n * 3 - 2 AS VARCHAR), 2, '0') || '00' WHEN 1 THEN y2 || lpad(CAST(n * 3 - 2 AS VARCHAR), 2, '0') || '00'
                WHEN 2 THEN y2 || lpad(CAST(n * 3 - 2 AS VARCHAR), 2, '0') || '00' WHEN 3 THEN y || lpad(CAST(n * 3 - 2 AS VARCHAR), 2, '0') || '00' WHEN 4 THEN y2 || '0000'
                WHEN 5 THEN y || lpad(CAST(m AS VARCHAR), 2, '0') || '00' WHEN 6 THEN y || lpad(CAST(m AS VARCHAR), 2, '0') || '00' WHEN 7 THEN y || '0000' WHEN 8 THEN 'Q5 ' || y ELSE y || '000' || n END AS period_sort,
         p <> 8 AS ok FROM dirty)"""

LOADS_ROWS = (
    (1, "forecast", "h1", 0, "ok", None, "2026-07-01T00:00:00", "2026-07-01T00:00:09", "1996-01", "P19960100"),
    (2, "forecast", "h2", 0, "ok", None, "2026-08-01T00:00:00", "2026-08-01T00:00:09", "1996-02", "P19960200"),
    (3, "forecast", "", 0, "error", "bad", "2026-09-01T00:00:00", "2026-09-01T00:00:09", "1996-03", ""),
    (4, "forecast", "h4", 0, "ok", None, "2026-09-02T00:00:00", "2026-09-02T00:00:09", "1996-03", "P19960300"),
    (5, "forecast", "h4", 0, "skipped_duplicate", None, "2026-09-03T00:00:00", "2026-09-03T00:00:09", "1996-03", "P19960300"),
    (6, "forecast", "h6", 0, "ok", None, "2026-09-04T00:00:00", "2026-09-04T00:00:09", "1996-01", "P19960100"),
    (7, "sales", "h7", 0, "ok", None, "2026-09-05T00:00:00", "2026-09-05T00:00:09", "", ""),
    (8, "plain", "h8", 0, "ok", None, "2026-09-06T00:00:00", "2026-09-06T00:00:09", "", ""),
    (9, "plain", "h9", 0, "ok", None, "2026-09-07T00:00:00", "2026-09-07T00:00:09", "", ""),
)
LOADS_SQL = "loads(id, dataset, content_hash, rows, status, error, started_at, finished_at, version_label, version_sort) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"CAST({v} AS BIGINT)" if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in LOADS_ROWS) + ")"


def loads(spark: SparkSession) -> DataFrame:
    from ..schema import LOADS

    return spark.createDataFrame(list(LOADS_ROWS), LOADS)


LEDGER_SQL = """loads AS (
  SELECT o_orderkey AS id, o_orderpriority AS dataset, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m') END AS version_label,
         CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'P' || strftime(o_orderdate, '%Y%m') || '00' END AS version_sort,
         CASE WHEN o_orderkey % 7 = 0 THEN 'error' WHEN o_orderkey % 5 = 0 THEN 'skipped_duplicate' ELSE 'ok' END AS status FROM orders)"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger of loads out of orders: each is a load of its priority, labelled with its month or with nothing; some failed or were duplicates."""
    labelled = F.pmod(F.col("o_custkey"), F.lit(3)) != 0
    status = F.when(F.pmod(F.col("o_orderkey"), F.lit(7)) == 0, "error").when(F.pmod(F.col("o_orderkey"), F.lit(5)) == 0, "skipped_duplicate").otherwise("ok")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("dataset"), status.alias("status"),
        F.when(labelled, F.date_format("o_orderdate", "yyyy-MM")).otherwise("").alias("version_label"), F.when(labelled, F.concat(F.lit("P"), F.date_format("o_orderdate", "yyyyMM"), F.lit("00"))).otherwise("").alias("version_sort"),
    )


def obs_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Three versions of a forecast, the oldest issued again, with keys added and removed on the way; and two unversioned loads of another dataset."""
    base = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    month = F.date_format("o_orderdate", "yyyy-MM")
    base = base.where(month.isin("1996-01", "1996-02", "1996-03")).groupBy(month.alias("label"), F.col("p_brand").alias("entity"), F.col("l_returnflag").alias("region")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("value"))
    number = F.regexp_extract("entity", r"(\d+)$", 1).cast("int")
    base = base.where(F.pmod(number, F.lit(7)) != F.substring("label", 7, 1).cast("int"))
    row = lambda load, dataset, value: (F.lit(load).cast("long").alias("load_id"), F.lit(0).cast("long").alias("seq"), F.lit(dataset).alias("dataset"), F.lit("quantity").alias("metric"), "entity", "region", F.lit("1997").alias("period"), F.lit("19970000").alias("period_sort"), F.lit("model").alias("source"), value.alias("value"), F.lit("EA").alias("unit"))
    parts = [base.where(F.col("label") == label).select(*row(load, "forecast", F.col("value") + shift)) for load, label, shift in ((1, "1996-01", 0), (2, "1996-02", 0), (4, "1996-03", 0), (6, "1996-01", 5))]
    parts += [base.where("label = '1996-02'").select(*row(load, "plain", F.col("value") * times)) for load, times in ((8, 1), (9, 2))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


FORECAST_SQL = LOADS_SQL + """,
flines AS (SELECT strftime(o_orderdate, '%Y-%m') AS label, p_brand AS entity, l_returnflag AS region, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
fbase AS (
  SELECT label, entity, region, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value FROM flines
  WHERE label IN ('1996-01', '1996-02', '1996-03') AND CAST(regexp_extract(entity, '([0-9]+)$', 1) AS INT) % 7 <> CAST(label[7] AS INT) GROUP BY ALL),
obs AS (
  SELECT CAST(x.load_id AS BIGINT) AS load_id, x.dataset, 'quantity' AS metric, entity, region, '1997' AS period, '19970000' AS period_sort, 'model' AS source, value * x.times + x.shift AS value, 'EA' AS unit
  FROM fbase JOIN (VALUES (1, 'forecast', '1996-01', 1, 0), (2, 'forecast', '1996-02', 1, 0), (4, 'forecast', '1996-03', 1, 0), (6, 'forecast', '1996-01', 1, 5), (8, 'plain', '1996-02', 1, 0), (9, 'plain', '1996-02', 2, 0)) x(load_id, dataset, label, times, shift) ON fbase.label = x.label)"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Call records out of events."""
    e = table(spark, d, "events")
    kinds = ("429", "5xx", "timeout", "other")
    bad = F.pmod(F.col("event_id"), F.lit(11)) == 0
    return e.select(
        F.pmod(F.col("user_id"), F.lit(4)).cast("long").alias("level"), (~bad).alias("ok"), F.col("value").alias("latency"), F.lit(60.0).alias("wall"),
        F.when(F.pmod(F.col("event_id"), F.lit(7)) == 0, "length").otherwise("stop").alias("finish_reason"), F.length("props").cast("long").alias("completion_tokens"),
        F.when(F.pmod(F.col("event_id"), F.lit(3)) == 0, F.pmod(F.col("event_id"), F.lit(90))).cast("long").alias("reasoning_tokens"),
        F.when(bad, F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(F.col("event_id"), F.lit(4)) + 1).cast("int"))).alias("error_class"),
    )


CALLS_SQL = """calls AS (
  SELECT user_id % 4 AS level, event_id % 11 <> 0 AS ok, value AS latency, 60.0 AS wall, CASE WHEN event_id % 7 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
         length(props) AS completion_tokens, CASE WHEN event_id % 3 = 0 THEN event_id % 90 END AS reasoning_tokens,
         CASE WHEN event_id % 11 = 0 THEN ['429', '5xx', 'timeout', 'other'][event_id % 4 + 1] END AS error_class FROM events)"""
