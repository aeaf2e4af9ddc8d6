"""What there is: values and spans of every dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ledger
from .query import latest_observations

LISTS = {"metrics": "metric", "entities": "entity", "regions": "region", "sources": "source", "units": "unit"}


def values(rows: DataFrame) -> DataFrame:
    """Per dataset the sorted distinct non-blank values of each dimension, and the periods of least and greatest sort key.

    Values are made distinct by partial aggregation before any list is built.
    """
    cells = rows.select("dataset", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("v")) for n, c in LISTS.items()))).alias("x")).select("dataset", "x.name", "x.v").where("v != ''").distinct()
    lists = cells.groupBy("dataset").pivot("name", list(LISTS)).agg(F.array_sort(F.collect_list("v")))
    seq = F.col("seq") if "seq" in rows.columns else F.lit(0)
    span = rows.groupBy("dataset").agg(F.min_by("period", F.struct("period_sort", seq)).alias("period_from"), F.max_by("period", F.struct(F.col("period_sort"), -seq)).alias("period_to"))
    empty = F.array().cast("array<string>")
    return span.join(lists, "dataset", "left").select("dataset", *(F.coalesce(n, empty).alias(n) for n in LISTS), "period_from", "period_to")


def catalog(obs: DataFrame, loads: DataFrame, datasets: DataFrame) -> DataFrame:
    """A row for each dataset: name, title, values and span of its latest load, its version labels, its last load of any status."""
    labels = ledger.labels(loads).groupBy("dataset").agg(F.transform(F.array_sort(F.collect_list(F.struct("version_sort", "version_label"))), lambda x: x["version_label"]).alias("version_labels"))
    last = loads.groupBy("dataset").agg(F.max_by(F.struct("id", "status", "started_at", "rows", "version_label"), "id").alias("last_load"))
    found = values(latest_observations(obs, loads))
    empty = F.array().cast("array<string>")
    out = datasets.withColumnRenamed("name", "dataset").join(found, "dataset", "left").join(labels, "dataset", "left").join(last, "dataset", "left")
    return out.select(F.col("dataset").alias("name"), "title", "updated_at", *(F.coalesce(n, empty).alias(n) for n in LISTS), "period_from", "period_to", F.coalesce("version_labels", empty).alias("version_labels"), "last_load").orderBy("name")


def merged(catalogs: DataFrame) -> DataFrame:
    """All datasets as one: united lists, and the least and greatest period as text."""
    return catalogs.agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(n)))).alias(n) for n in LISTS), F.min("period_from").alias("period_from"), F.max("period_to").alias("period_to"))


def top_entity(rows: DataFrame) -> DataFrame:
    """The entity of the greatest total; the first in query order among equals."""
    total = rows.where("entity != ''").groupBy("entity").agg(F.sum("value").alias("total"), F.min(F.struct("period_sort", "metric", "entity", "region", "source")).alias("first"))
    return total.orderBy(F.desc("total"), "first").limit(1).select("entity", "total")


def missing(requested: DataFrame, present: DataFrame, column: str = "entity") -> DataFrame:
    """Requested values that are not present."""
    return requested.select(column).distinct().join(present.select(column).distinct(), column, "left_anti")
