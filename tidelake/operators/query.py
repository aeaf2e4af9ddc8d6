"""Filter, roll up and pivot observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.periods import coarsen_period, parse, upper_bound
from ..schema import CELL_CAP, ROW_CAP
from . import ledger

COLUMNS = ("metric", "entity", "region", "period", "period_sort", "source", "value", "unit")
ORDER = ("period_sort", "metric", "entity", "region", "source")


class TooMany(ValueError):
    """A result beyond the caps."""


def one_of(column: str, values: list | None) -> Column:
    return F.col(column).isin(*values) if values else F.lit(True)


def in_periods(period_from=None, period_to=None) -> Column:
    """Bounds as literals, so that they reach the scan."""
    test = F.lit(True)
    if period_from:
        test &= F.col("period_sort") >= parse(period_from)[1]
    if period_to:
        test &= F.col("period_sort") <= upper_bound(period_to)
    return test


def filtered(obs: DataFrame, dataset: str | None = None, metrics=None, entities=None, regions=None, sources=None, period_from=None, period_to=None) -> DataFrame:
    own = obs if dataset is None else obs.where(F.col("dataset") == dataset)
    return own.where(one_of("metric", metrics) & one_of("entity", entities) & one_of("region", regions) & one_of("source", sources) & in_periods(period_from, period_to))


def rollup(rows: DataFrame, level: str, agg: str = "sum") -> DataFrame:
    """Values summed or averaged by coarser periods; rows that cannot be coarsened keep theirs and join that group.

    The unit is that of the group's first row in query order.
    """
    if agg not in ("sum", "avg"):
        raise ValueError(f"agg must be sum or avg: {agg!r}")
    coarse = coarsen_period(F.col("period"), level)
    seq = F.col("seq") if "seq" in rows.columns else F.lit(0)
    out = rows.select("metric", "entity", "region", "source", "value", "unit", F.struct(*ORDER, seq.alias("seq")).alias("at"), F.coalesce(coarse, F.struct(F.col("period").alias("period"), F.col("period_sort").alias("period_sort"))).alias("c"))
    out = out.groupBy("metric", "entity", "region", F.col("c.period").alias("period"), "source").agg(F.min_by("c.period_sort", "at").alias("period_sort"), getattr(F, agg)("value").alias("value"), F.min_by("unit", "at").alias("unit"))
    return out.select(*COLUMNS)


def query_observations(obs: DataFrame, loads: DataFrame, dataset: str, metrics=None, entities=None, regions=None, sources=None, period_from=None, period_to=None, version="latest", level: str | None = None, agg: str = "sum") -> DataFrame:
    """Observations of one version ("latest", a load id or label) or of "all", filtered, perhaps rolled up, in canonical order.

    The version is resolved to a load id beforehand, so that the scan reads its partition alone.
    """
    load_id = ledger.resolve_version(loads, dataset, version)
    own = obs.where(F.col("dataset") == dataset)
    if version != "all":
        own = own.where(F.col("load_id") == F.lit(load_id if load_id is not None else -1))
    rows = filtered(own, None, metrics, entities, regions, sources, period_from, period_to)
    if level:
        return rollup(rows, level, agg).orderBy(*ORDER)
    return rows.orderBy(*ORDER, "seq").select(*COLUMNS)


def latest_observations(obs: DataFrame, loads: DataFrame) -> DataFrame:
    """Observations of each dataset's latest load; the ledger's side has a row for each dataset."""
    return obs.join(ledger.latest_loads(loads).select(F.col("id").alias("load_id")), "load_id", "left_semi")


def fetch(df: DataFrame, cap: int = ROW_CAP) -> list:
    """The rows, if they are at most cap; one more is asked for and nothing is counted."""
    rows = df.limit(cap + 1).collect()
    if len(rows) > cap:
        raise TooMany(f"more than {cap} rows")
    return rows


def to_wide(rows: DataFrame, row_dims: list[str], col_dims: list[str], cap: int = CELL_CAP) -> DataFrame:
    """Long to wide: a row for each key of row_dims, a column for each of col_dims, headed by the key joined with " / ".

    Cells that collide keep the last in canonical order. Columns stand in time if
    they are periods, else by text; missing dimensions are blank. The cells are
    computed once, in long form; a result of more cells than the cap is refused, and
    a smaller one is small enough to be laid out by the driver.
    """
    dim = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    r = [dim(c).alias(f"r{i}") for i, c in enumerate(row_dims)]
    head = F.concat_ws(" / ", *map(dim, col_dims)) if col_dims else F.lit("")
    time = F.col("period_sort") if col_dims == ["period"] else F.lit("")
    seq = F.col("seq") if "seq" in rows.columns else F.lit(0)
    base = rows.select(*r, head.alias("head"), time.alias("time"), "value", F.struct(*(F.col(c) for c in ORDER if c in rows.columns), seq.alias("seq")).alias("at"))
    keys = [f"r{i}" for i in range(len(row_dims))]
    cells = base.groupBy(*keys, "head").agg(F.max_by("value", "at").alias("value"), F.min("time").alias("time")).limit(cap + 1).collect()
    times: dict[str, str | None] = {}
    lines: dict[tuple, dict[str, object]] = {}
    for c in cells:
        lines.setdefault(tuple(c[k] for k in keys), {})[c["head"]] = c["value"]
        times[c["head"]] = min((t for t in (times.get(c["head"]), c["time"]) if t is not None), default=None)
    if len(cells) > cap or len(lines) * len(times) > cap:
        raise TooMany(f"more than {cap} cells")
    heads = sorted(times, key=lambda h: (times[h] is not None, times[h] or "", h))
    kind = base.schema["value"].dataType
    schema = T.StructType([*(T.StructField(f"r{i}", T.StringType()) for i in range(len(keys))), *(T.StructField(f"c{i}", kind) for i in range(len(heads)))])
    rows_out = [(*line, *(found.get(h) for h in heads)) for line, found in sorted(lines.items())]
    return rows.sparkSession.createDataFrame(rows_out, schema).coalesce(1).toDF(*row_dims, *(h or "value" for h in heads))
