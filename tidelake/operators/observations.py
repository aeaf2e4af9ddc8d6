"""Normalising source rows into observations, and comparing loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import normalize_period_typed
from ..functions.values import clean_text, normalize_typed, relative_change
from ..schema import DIM_FIELDS

#: Changes and keys listed in a report.
TOP, LISTED = 10, 50


def normalize_rows(df: DataFrame, version_column: str | None = None, seq: str | None = None) -> DataFrame:
    """dataset, version_label, the dimensions, period_sort, period_ok, value, unit, status and seq of every source row.

    A "%" overrides the row's unit. seq orders rows that share a key: a column of
    the source if one is named, else the scan order.
    """
    kinds = dict(df.dtypes)
    dim = lambda c: clean_text(F.col(c), kinds[c]) if c in kinds else F.lit("")
    value, period = normalize_typed(F.col("value"), kinds["value"]), normalize_period_typed(F.col("period"), kinds["period"])
    label = dim(version_column) if version_column else F.lit("")
    out = df.select(dim("dataset").alias("dataset"), label.alias("version_label"), *(dim(c).alias(c) for c in ("metric", "entity", "region", "source")), dim("unit").alias("own_unit"), value.alias("v"), period.alias("p"), (F.col(seq) if seq else F.monotonically_increasing_id()).cast("long").alias("seq"))
    return out.select("seq", "dataset", "version_label", "metric", "entity", "region", F.col("p.period").alias("period"), F.col("p.period_sort").alias("period_sort"), "source", F.col("v.value").alias("value"), F.coalesce("v.unit", "own_unit").alias("unit"), F.col("v.status").alias("status"), F.col("p.ok").alias("period_ok"))


def kept(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'ok'").drop("status", "period_ok")


def ingest_stats(rows: DataFrame) -> DataFrame:
    """Per (dataset, version_label): rows kept, rows dropped by reason, unparsed periods of kept rows, and exact distinct counts.

    Rows are first added up by key, which combines before the shuffle; distinct
    values are counted over the keys.
    """
    ok = F.col("status") == "ok"
    groups = ("dataset", "version_label")
    keys = rows.groupBy(*groups, *DIM_FIELDS).agg(F.count_if(ok).alias("n"), F.count_if(F.col("status") == "blank").alias("blank"), F.count_if(F.col("status") == "non_numeric").alias("wrong"), F.count_if(ok & ~F.col("period_ok")).alias("unparsed"))
    distinct = [F.count_distinct(F.when(F.col("n") > 0, F.col(c))).alias(n) for c, n in (("metric", "metrics"), ("entity", "entities"), ("period", "periods"), ("source", "sources"))]
    return keys.groupBy(*groups).agg(F.sum("n").alias("rows"), F.sum("blank").alias("dropped_blank"), F.sum("wrong").alias("dropped_non_numeric"), F.sum("unparsed").alias("unparsed_periods"), *distinct, F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("duplicate_keys"))


def last_values(rows: DataFrame, keys: list[str] | tuple[str, ...] = DIM_FIELDS) -> DataFrame:
    """The last value of each key, by seq; the greatest of equal seq."""
    return rows.groupBy(*keys).agg(F.max_by("value", F.struct("seq", "value")).alias("value"))


def fingerprint() -> Column:
    """An aggregate that is equal for equal multisets of rows, in any order: count and two sums of row hashes.

    It is made of partial sums, so a load of any size is hashed without being gathered.
    """
    cells = [*DIM_FIELDS, "value", "unit"]
    sums = [F.sum(F.xxhash64(F.lit(salt), *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cells)).cast("decimal(38,0)")).cast("string") for salt in (1, 7)]
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256)


def content_hashes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset", "version_label").agg(fingerprint().alias("content_hash"))


def compare_sides(rows: DataFrame, keys: list[str] | tuple[str, ...] = DIM_FIELDS) -> DataFrame:
    """keys, old, new, change (added, removed, changed or same) of rows with value, seq and ``new`` (whose side they are of): last values by key, in one shuffle."""
    last = lambda own: F.max_by(F.when(own, F.col("value")), F.when(own, F.struct("seq", "value")))
    new = F.col("new")
    sides = rows.groupBy(*keys).agg(last(~new).alias("old"), last(new).alias("new"), F.count_if(~new).alias("n_old"), F.count_if(new).alias("n_new"))
    change = F.when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("same")
    return sides.select(*keys, "old", "new", change.alias("change"))


def compare(old: DataFrame, new: DataFrame, keys: list[str] | tuple[str, ...] = DIM_FIELDS) -> DataFrame:
    """compare_sides of two tables."""
    side = lambda df, is_new: df.select(*keys, "value", "seq", F.lit(is_new).alias("new"))
    return compare_sides(side(old, False).union(side(new, True)), keys)


def change_counts(compared: DataFrame) -> DataFrame:
    return compared.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")))


def with_relative(changed: DataFrame) -> DataFrame:
    return changed.withColumn("relative", relative_change(F.col("old"), F.col("new")))


def top_changes(compared: DataFrame, n: int = TOP) -> DataFrame:
    """The changes of greatest relative size; ties by key."""
    keys = [c for c in compared.columns if c not in ("old", "new", "change")]
    return with_relative(compared.where("change = 'changed'")).orderBy(F.desc("relative"), *keys).limit(n)


def top_by_group(rows: DataFrame, group: str, order: list, n: int, parts: int = 64) -> DataFrame:
    """The first n rows of each group; the best of parts of a group are found first, so that no large group is sorted in one task."""
    best = lambda df, *by: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    return best(best(rows.withColumn("_part", part), group, "_part").drop("_part"), group)


def listed(compared: DataFrame, change: str, n: int = LISTED) -> DataFrame:
    keys = [c for c in compared.columns if c not in ("old", "new", "change")]
    return compared.where(F.col("change") == change).select(*keys).orderBy(*keys).limit(n)


def with_seq(df: DataFrame, *order: str) -> DataFrame:
    """Rows numbered in a given order within each partition of it; for small tables and tests."""
    return df.withColumn("seq", F.row_number().over(Window.orderBy(*order)).cast("long"))
