"""Questions to the ledger of loads; the ledger is thin, observations are never read here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ok_loads(loads: DataFrame) -> DataFrame:
    return loads.where("status = 'ok'")


def _first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def latest_loads(loads: DataFrame) -> DataFrame:
    """Per dataset the ok load of the highest version_sort, then id."""
    return _first(ok_loads(loads), ["dataset"], F.desc("version_sort"), F.desc("id"))


def latest_per_label(loads: DataFrame) -> DataFrame:
    """Per dataset and label the newest ok load: the last re-issue."""
    return _first(ok_loads(loads), ["dataset", "version_label"], F.desc("id"))


def labels(loads: DataFrame) -> DataFrame:
    """dataset, version_label, version_sort of all labels, oldest first."""
    return ok_loads(loads).where("version_label != ''").groupBy("dataset", "version_label").agg(F.min("version_sort").alias("version_sort")).orderBy("dataset", "version_sort", "version_label")


def previous_loads(loads: DataFrame) -> DataFrame:
    """dataset, version_sort, id (newest of that sort), previous_sort, previous_id: the next lower version_sort and its newest load."""
    newest = ok_loads(loads).groupBy("dataset", "version_sort").agg(F.max("id").alias("id"))
    w = Window.partitionBy("dataset").orderBy("version_sort")
    return newest.withColumn("previous_sort", F.lag("version_sort").over(w)).withColumn("previous_id", F.lag("id").over(w))


def baseline(loads: DataFrame, dataset: str, version_sort: str) -> int | None:
    """The load to compare a new one with: the newest of the same version_sort, else of the next lower."""
    own = ok_loads(loads).where((F.col("dataset") == dataset) & (F.col("version_sort") <= version_sort))
    row = own.agg(F.max_by("id", F.struct("version_sort", "id")).alias("id")).first()
    return row.id if row else None


def previous(loads: DataFrame, dataset: str, version_sort: str) -> int | None:
    """The newest load of the next lower version_sort."""
    own = ok_loads(loads).where((F.col("dataset") == dataset) & (F.col("version_sort") < version_sort))
    return own.agg(F.max_by("id", F.struct("version_sort", "id")).alias("id")).first().id


def newest_of_label(loads: DataFrame, dataset: str, label: str) -> int | None:
    return ok_loads(loads).where((F.col("dataset") == dataset) & (F.col("version_label") == label)).agg(F.max("id").alias("id")).first().id


def latest_id(loads: DataFrame, dataset: str) -> int | None:
    row = latest_loads(loads.where(F.col("dataset") == dataset)).select("id").first()
    return row.id if row else None


def resolve_version(loads: DataFrame, dataset: str, version) -> int | None:
    """A load id for "latest", a load id, or a label; "label:x" names a label that looks like a number. None for "all"."""
    if version in (None, "latest"):
        return latest_id(loads, dataset)
    if version == "all":
        return None
    text = str(version)
    if not text.startswith("label:"):
        try:
            load_id = int(text)
        except ValueError:
            pass
        else:
            if not loads.where((F.col("id") == load_id) & (F.col("dataset") == dataset)).limit(1).count():
                raise ValueError(f"{dataset} has no load {load_id}")
            return load_id
    found = newest_of_label(loads, dataset, text.removeprefix("label:"))
    if found is None:
        raise ValueError(f"no such version: {version!r}")
    return found


def catalog_version(loads: DataFrame) -> DataFrame:
    """One short hash of all datasets' latest loads."""
    pairs = latest_loads(loads).agg(F.array_sort(F.collect_list(F.struct("dataset", "id"))).alias("p"))
    text = F.concat_ws(",", F.transform("p", lambda x: F.concat_ws(":", x["dataset"], x["id"].cast("string"))))
    return pairs.select(F.substring(F.sha2(text, 256), 1, 16).alias("catalog_version"))
