"""History of a cell over versions, and differences between versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import percent_change, relative_change
from . import ledger

TOP = 20


def history(obs: DataFrame, loads: DataFrame, dataset: str, metric: str, entity: str, period: str, source: str | None = None) -> DataFrame:
    """Values of one cell, oldest first: a point for each ok load, or for each label's last re-issue if any load is labelled.

    The re-issue is chosen before the cell is looked up, so a label whose last
    re-issue lacks the cell has no point. The period is matched as stored.
    """
    own = ledger.ok_loads(loads).where(F.col("dataset") == dataset)
    if own.where("version_label != ''").limit(1).count():
        own = ledger.latest_per_label(own.where("version_label != ''"))
    cell = obs.where((F.col("dataset") == dataset) & (F.col("metric") == metric) & (F.col("entity") == entity) & (F.col("period") == period))
    if source is not None:
        cell = cell.where(F.col("source") == source)
    points = cell.join(own.select(F.col("id").alias("load_id"), "version_label", "version_sort", "started_at", "finished_at"), "load_id")
    return points.orderBy("version_sort", "load_id", "region", "source", "seq").select("version_label", "load_id", "started_at", "finished_at", "value", "unit", "region", "source")


def differences(obs: DataFrame, from_id: int, to_id: int, group_by: list[str]) -> DataFrame:
    """group_by, old, new, diff, pct, relative, changed of all keys of two loads: one scan of both, no join.

    Nulls count as zero in a key's sum; a key that a load lacks is null on that side.
    """
    side = lambda i: F.when(F.count_if(F.col("load_id") == i) > 0, F.sum(F.when(F.col("load_id") == i, F.coalesce("value", F.lit(0.0)))))
    both = obs.where(F.col("load_id").isin(from_id, to_id)).groupBy(*group_by).agg(side(from_id).alias("old"), side(to_id).alias("new"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select(*group_by, "old", "new", (zero("new") - zero("old")).alias("diff"), percent_change(F.col("old"), zero("new")).alias("pct"), relative_change(zero("old"), zero("new")).alias("relative"), (F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new"))).alias("changed"))


def ranked(diffs: DataFrame, rank: str = "abs", top: int = TOP) -> DataFrame:
    """The keys of greatest absolute or relative change, unchanged ones left out; ties by key."""
    if rank not in ("abs", "rel"):
        raise ValueError(f"rank must be abs or rel: {rank!r}")
    keys = [c for c in diffs.columns if c not in ("old", "new", "diff", "pct", "relative", "changed")]
    moved = diffs.where(F.col("old").isNull() | F.col("new").isNull() | F.col("changed"))
    size = F.abs("diff") if rank == "abs" else F.col("relative")
    return moved.orderBy(F.desc(size), *keys).limit(max(0, top)).select(*keys, "old", "new", "diff", "pct")


def totals(diffs: DataFrame) -> DataFrame:
    """Counts over all keys."""
    return diffs.agg(F.count_if("changed").alias("changed"), F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"), F.count(F.lit(1)).alias("total_keys"))


def version_diff(obs: DataFrame, loads: DataFrame, dataset: str, from_version=None, to_version="latest", group_by: list[str] | None = None, rank: str = "abs", top: int = TOP, **filters) -> tuple[DataFrame, DataFrame]:
    """(ranked rows, totals) between two versions of a dataset; from_version is the next lower one by default."""
    from .query import filtered

    to_id = ledger.resolve_version(loads, dataset, to_version)
    if to_id is None:
        raise ValueError("the dataset has no load")
    if from_version is None:
        key = loads.where(F.col("id") == to_id).select("version_sort").first()
        from_id = ledger.previous(loads, dataset, key.version_sort) if key else None
    else:
        from_id = ledger.resolve_version(loads, dataset, from_version)
    if from_id is None:
        raise ValueError("there is no previous version")
    own = filtered(obs.where((F.col("dataset") == dataset) & F.col("load_id").isin(from_id, to_id)), None, **filters)
    diffs = differences(own, from_id, to_id, group_by or ["entity"])
    return ranked(diffs, rank, top), totals(diffs)
