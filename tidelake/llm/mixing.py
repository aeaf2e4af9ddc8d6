"""Mixing sources to target weights along a time-varying curriculum.

Sources get targets by weight, filled like vessels up to a cap. A source's
weight drifts over training time t in [0, 1] as 1 + drift * (2t - 1); the
integral of that schedule, scaled to the target, is its cumulative token demand
D(t). Within a source the documents stand in a fixed pseudo-random order, so a
document that starts at token c of its source's stream is trained on at
D^-1(c). Documents are then range-sorted by that position. The streams' running
sums are taken range by range, so neither a large source nor an id that many rows
share is gathered in one task. DataFrame operations only; just one thin row for
each document is ever shuffled.
"""

from __future__ import annotations

from functools import reduce
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialise

#: Weights of the sources in code-point order, repeating, and their drifts over time.
WEIGHTS, DRIFTS = (3, 1, 2), (0.5, 0.0, -0.5)
#: Targets share NUM / DEN of all sizes; none is above CAP times its source's size.
NUM, DEN, CAP = 3, 2, 2
#: Rows of one range of the running sums, on average at most.
RANGE = 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n, weight, drift, target of every source of sizes (source, size); one row for each source.

    The level L of the fill solves sum(min(CAP * size, L * weight)) = NUM / DEN * total;
    a source is capped exactly if what it takes to raise the level to its own
    cap is there. All sums are exact; a target is rounded once.
    """
    unit = lcm(*WEIGHTS)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("k", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("k") + 1).cast("long"))
    s = s.withColumn("drift", F.element_at(F.array(*map(F.lit, DRIFTS)), F.col("k") + 1))
    s = s.withColumn("cap", CAP * F.col("source_size")).withColumn("level", F.col("cap") * (F.lit(unit) / F.col("weight")).cast("long"))
    upto, whole = Window.orderBy("level").rangeBetween(Window.unboundedPreceding, 0), Window.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    big = lambda c: F.col(c).cast("decimal(38,0)")
    s = s.select("*", F.sum("cap").over(upto).alias("under"), F.sum("weight").over(upto).alias("w_under"), F.sum("weight").over(whole).alias("w_all"), F.sum("source_size").over(whole).alias("total"))
    s = s.withColumn("capped", DEN * (big("under") * F.col("weight") + big("cap") * (F.col("w_all") - F.col("w_under"))) <= NUM * big("total") * F.col("weight"))
    s = s.withColumn("cap_sum", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole)).withColumn("w_rest", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(whole))
    shared = (F.col("weight") * (NUM * F.col("total") - DEN * F.col("cap_sum"))).cast("double") / (DEN * F.greatest("w_rest", F.lit(1))).cast("double")
    return s.select("source", "source_size", "n", "weight", "drift", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def _time(offset: Column, target: Column, drift: Column) -> Column:
    """D^-1: the time at which so many tokens of the target have been asked for."""
    u, b = offset / target, 1 - drift
    return F.when(drift == 0, u).otherwise((F.sqrt(b * b + 4 * drift * u) - b) / (2 * drift))


def curriculum(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, taken, position, position_2 of every row, sorted by position.

    A null text has no words and a null source is a source of its own, the last
    one. ``taken`` counts words of both passes over the source; the document at
    the target's end is taken in part, so a source's takings are its target
    rounded. Positions are null for passes not taken. Rows that share an id stand
    together in the order, by size and content; equal rows get places of their
    own, and rows without a position stand last. An empty table gives no rows;
    other columns are ignored.
    """
    text, ident = F.col(text_column).cast("string"), F.col(id_column)
    thin = materialise(
        docs.select(ident.alias("doc_id"), F.col(source_column).cast("string").alias("source"), text_size(text).alias("size"), F.xxhash64(text).alias("content"), F.monotonically_increasing_id().alias("place")).withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "sizes"
    )
    order = ("key", "doc_id", "size", "content", "place")  # equal rows are told apart by their place alone
    ranges = max(1, -(-thin.count() // RANGE))
    ranged = materialise(thin.repartitionByRange(ranges, F.col("source").asc_nulls_last(), *order).withColumn("range", F.spark_partition_id()), "ranges")
    targets = source_targets(thin).select(F.col("source").alias("s"), "source_size", "target", "drift")
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    sums = sums.withColumn("before", F.sum("sum").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    sums = sums.join(targets, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("range").alias("r"), F.coalesce("before", F.lit(0)).alias("before"), "source_size", "target", "drift")
    within = Window.partitionBy("source", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("size").over(within))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    start = F.col("before") + F.col("upto") - F.col("size")
    goal = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    passes = [start + k * F.col("source_size") for k in range(CAP)]
    taken = reduce(lambda a, b: a + b, [F.greatest(F.lit(0), F.least(F.col("size"), goal - p)) for p in passes])
    times = [F.when((F.col("size") > 0) & (p < goal), _time(p.cast("double"), F.col("target"), F.col("drift"))) for p in passes]
    out = placed.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), times[0].alias("position"), times[1].alias("position_2"))
    return out.orderBy(F.col("position").asc_nulls_last(), F.xxhash64("doc_id"), "doc_id", "size")
