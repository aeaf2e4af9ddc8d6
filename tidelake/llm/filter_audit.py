"""How filters over documents interact: every order of applying them, audited from one histogram of failure masks.

1. Native expressions give each document a mask, one bit for each filter that it
   fails. The bits of the conditions depend on the text alone.
2. Rows are counted by (text digest, part, mask, id) and then by (text digest,
   part, mask), where the least id and its counts are kept as well; the least id
   of each text over the whole table then settles which rows are duplicates. Both
   steps combine before their shuffle, so a text that a third of all rows share
   costs each task one row, and no text is shuffled.
3. A part's rows fall into 2 ** filters cells. All orders are read off these
   cells: a filter removes, at its step, what fails it and none before it.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACES = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    """The words of a text that is not blank."""
    return F.split(F.btrim(text, F.lit(_SPACES)), f"[{_SPACES}]+")


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions by letter, of a text that is not null."""
    words = _words(text)
    blank = F.btrim(text, F.lit(_SPACES)) == ""
    return {
        "A": blank | (F.size(words) < 200),
        "B": ~blank & (100 * F.size(F.array_distinct(words)) < 50 * F.size(words)),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def _marks(labels: DataFrame) -> DataFrame:
    """Whether any row of an id marks it as good, or as toxic."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def mask_histogram(docs: DataFrame, labels: DataFrame, part: str = "lang", failing=conditions) -> DataFrame:
    """part, mask, n, good, toxic of every mask that occurs; bits count from the first condition, the last bit tells duplicates.

    A row is a duplicate if a row of a smaller id has the identical text, null and
    empty texts being identical; rows without an id are none and make none. A null
    part counts as the empty string. Labels of repeated ids are joined by "any".
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the digest stands for the text: 256 bits
    thin = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = failing(F.col("text"))
    mask = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(bits.values())), F.lit(0))
    thin = thin.select("id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("sha"))
    rows = thin.groupBy("sha", "part", "mask", "id").agg(F.count(F.lit(1)).alias("n")).join(_marks(labels), "id", "left")
    of = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))))
    unnamed = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    texts = rows.groupBy("sha", "part", "mask").agg(F.sum("n").alias("n"), of(F.col("good")).alias("good"), of(F.col("toxic")).alias("toxic"), least.alias("least"), unnamed.alias("unnamed"))
    first = texts.groupBy("sha").agg(F.min("least.id").alias("first"))
    # a row of (text, part) is split into what passes the duplicate filter and the rest
    held = F.coalesce(F.col("least.id") == F.col("first"), F.lit(False))
    passed = F.struct(
        F.col("mask"),
        (F.col("unnamed") + F.when(held, F.col("least.n")).otherwise(0)).alias("n"),
        F.when(held, F.col("least.n") * F.col("least.good")).otherwise(0).alias("good"),
        F.when(held, F.col("least.n") * F.col("least.toxic")).otherwise(0).alias("toxic"),
    )
    met = texts.join(first, "sha").select("part", "mask", "n", "good", "toxic", passed.alias("p"))
    rest = F.struct((F.col("mask") + F.lit(1 << len(bits))).alias("mask"), *((F.col(c) - F.col(f"p.{c}")).alias(c) for c in ("n", "good", "toxic")))
    cells = met.select("part", F.explode(F.array("p", rest)).alias("x")).where("x.n > 0").select("part", "x.*")
    return cells.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def _orders(letters: str) -> list[tuple[str, int, int, int]]:
    """Every order with each of its steps: (order, step, the filter's bit, the bits applied before)."""
    out = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def audit_orders(histogram: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step with the counts of that step, for every part of a mask histogram and every order of the filters.

    kept: rows after the step; removed: rows it removes; redundant: rows that fail
    its filter but are gone already; unique_fails: rows that fail this filter alone;
    good_lost, toxic_lost: marked rows it removes; shapley: what its filter removes,
    summed over all orders, for a row that fails k filters falls to each of them
    in one of k orders. A histogram without rows gives none.
    """
    k = len(letters)
    total = factorial(k)
    one = lambda c, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0))
    cells = F.array(*(F.struct(F.lit(m).alias("mask"), F.lit(total // bin(m).count("1") if m else 0).alias("share"), *(one(c, m).alias(c) for c in ("n", "good", "toxic"))) for m in range(1 << k)))
    steps = F.explode(F.from_json(F.lit(_json(_orders(letters))), "array<struct<filter_order:string,step:int,bit:int,before:int>>"))
    wide = histogram.groupBy("part").agg(cells.alias("cells")).select("part", "cells", steps.alias("s")).select("part", "cells", "s.*")

    def total_of(value: str, where: str) -> Column:
        return F.expr(f"aggregate(cells, 0L, (t, c) -> t + CASE WHEN {where} THEN {value} ELSE 0L END)")

    fails, gone = "(c.mask & bit) != 0", "(c.mask & before) != 0"
    return wide.select(
        "part", "filter_order", "step",
        total_of("c.n", "(c.mask & (before | bit)) = 0").alias("kept"),
        total_of("c.n", f"{fails} AND NOT {gone}").alias("removed"),
        total_of("c.n", f"{fails} AND {gone}").alias("redundant"),
        total_of("c.n", "c.mask = bit").alias("unique_fails"),
        total_of("c.good", f"{fails} AND NOT {gone}").alias("good_lost"),
        total_of("c.toxic", f"{fails} AND NOT {gone}").alias("toxic_lost"),
        total_of("c.n * c.share", fails).alias("shapley"),
    )


def _json(orders: list[tuple[str, int, int, int]]) -> str:
    return "[" + ",".join(f'{{"filter_order":"{o}","step":{s},"bit":{b},"before":{x}}}' for o, s, b, x in orders) + "]"


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", failing=conditions) -> DataFrame:
    """The audit of all orders of the given conditions and the duplicate filter; other columns are ignored, an empty table gives no rows.

    failing maps a text column to conditions by letter; the duplicate filter has the
    letter that follows. Null texts are empty ones, ids may be null or repeated.
    """
    letters = "".join(failing(F.lit("")))
    return audit_orders(mask_histogram(docs, labels, part, failing), letters + chr(ord(letters[-1]) + 1))
