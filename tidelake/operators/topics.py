"""Signals of what matters: bursts, breadth, changed and divided judgement of topics, and topics that occur together.

A mention is a row with a topic's key columns, a week (a whole number, see
``week_of``), who speaks and which way (1 up, -1 down, else neither).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement
from math import exp, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import Square, packed_documents
from .scratch import apart, numbered, written

#: Weeks of the baseline.
WEEKS = 8
#: Size of the sketches of distinct speakers (log2 of their registers).
SKETCH = 12
#: Documents in a row of the packed lists; groups of topics at least and at most; occurrences in a group, about.
SLICE, GROUPS, MOST_GROUPS, MASS = 2048, 8, 40, 1 << 23
#: Pairs in an Arrow batch, about.
BATCH = 200_000


def week_of(day: Column) -> Column:
    """The number of the week that starts on a Monday, week 0 holding 1970-01-05."""
    return F.floor(F.datediff(day.cast("date"), F.lit("1970-01-05").cast("date")) / 7)


def weekly_burst(mentions: DataFrame, keys: list[str], weeks: int = WEEKS) -> DataFrame:
    """keys, week, n, mean, burst for every key and every week from its first to the table's last.

    mean is that of the given number of weeks before; weeks without mentions count
    0, weeks before the table's first do not count. burst is n / mean, null where
    nothing came before (a new topic). Mentions without a week are left out; null
    keys are keys. Mentions are counted before they are dealt out, so a hot topic
    is as many rows as it has weeks.
    """
    counts = mentions.where("week IS NOT NULL").groupBy(*keys, "week").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "weeks")
    first, last = counts.agg(F.min("week"), F.max("week")).first()
    grid = counts.groupBy(*keys).agg(F.min("week").alias("since")).select(*keys, F.explode(F.sequence("since", F.lit(last or 0).cast("long"))).alias("week"), F.lit(0).cast("long").alias("n"))
    dense = counts.unionByName(grid).groupBy(*keys, "week").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(*keys).orderBy("week").rangeBetween(-weeks, -1)
    held = F.least(F.lit(weeks), F.col("week") - F.lit(first or 0))
    mean = F.when(held > 0, F.coalesce(F.sum("n").over(before), F.lit(0)) / held)
    return dense.withColumn("mean", mean).select(*keys, "week", "n", "mean", F.when(F.col("mean") > 0, F.col("n") / F.col("mean")).alias("burst"))


def signals(mentions: DataFrame, keys: list[str], size: int = SKETCH) -> DataFrame:
    """keys with n, breadth, speakers, up, down, disagreement, changes, change_size.

    breadth is the exact number of distinct speakers; speakers is a sketch of them
    that merges with others (``merged``). disagreement is the smaller of up and down
    over the larger: 1 if opinion is evenly divided, 0 if all agree or none has one.
    changes counts the mentions with a ``change``, change_size adds up how large they
    are. Null speakers are not counted.
    """
    one = lambda x: F.sum(F.when(x, 1).otherwise(0)).alias
    first = mentions.groupBy(*keys, "speaker").agg(
        F.count(F.lit(1)).alias("n"), one(F.col("direction") > 0)("up"), one(F.col("direction") < 0)("down"), F.count("change").alias("changes"), F.sum(F.abs("change")).alias("change_size")
    )
    out = first.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count("speaker").alias("breadth"), F.hll_sketch_agg(F.col("speaker").cast("string"), size).alias("speakers"),
        F.sum("up").alias("up"), F.sum("down").alias("down"), F.sum("changes").alias("changes"), F.coalesce(F.sum("change_size"), F.lit(0)).alias("change_size"),
    )
    return out.withColumn("disagreement", F.when(F.greatest("up", "down") > 0, F.least("up", "down") / F.greatest("up", "down")).otherwise(0.0))


def merged(signals_of_parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys with breadth_estimate: the speakers of several parts (weeks, files, regions) without a second look at mentions."""
    return signals_of_parts.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("speakers")).alias("breadth_estimate"))


def relative_error(size: int = SKETCH) -> float:
    """The standard error of a merged estimate, as a part of the true number."""
    return 1.04 / sqrt(1 << size)


class Least:
    """How many of all documents two topics share at least, called with the number of documents of the rarer one; the other is as frequent at least."""

    def __init__(self, docs: int, min_docs: int, min_pmi: float):
        self.docs, self.min_docs, self.min_pmi = docs, max(1, min_docs), min_pmi

    def __call__(self, n):
        return np.maximum(self.min_docs, np.ceil(exp(self.min_pmi) * n * n / self.docs * (1 - 1e-9)))

    def pmi(self, both: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
        return np.log(both * float(self.docs) / (n_x * n_y))


class Held:
    """The topics that may be in a pair, numbered rare first (``kept``: topic, n, rank), and the documents' lists of them (``lists``), packed by groups of ranks that begin at ``first``."""

    def __init__(self, kept: DataFrame, lists: DataFrame, first: np.ndarray, least: Least):
        self.kept, self.lists, self.first, self.least = kept, lists, first, least

    def squares(self) -> DataFrame:
        """g, h, rank, n, topic, docs, x, y: in a partition, the names and lists of two groups g <= h. No table is dealt out for that: a task reads the columns of its groups."""
        ends, parts = self.first, []
        for g, h in combinations_with_replacement(range(len(ends) - 1), 2):
            names = self.kept.where(F.col("rank").between(int(ends[g]), int(ends[g + 1]) - 1) | F.col("rank").between(int(ends[h]), int(ends[h + 1]) - 1))
            names = names.selectExpr("rank", "n", "topic", "CAST(NULL AS INT) AS docs", "CAST(NULL AS BINARY) AS x", "CAST(NULL AS BINARY) AS y")
            lists = self.lists.select(F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast(self.kept.schema["topic"].dataType), "docs", f"p{g}", f"p{h}")
            parts.append(names.union(lists).coalesce(1).select(F.lit(g).alias("g"), F.lit(h).alias("h"), "*"))
        return apart(parts, names.where("rank < 0").select(F.lit(-1), F.lit(-1), "*"))


def _groups(sizes: list, least: int, most: int) -> np.ndarray:
    """The first ranks of groups whose topics occur about equally often together, and the number of ranks; sizes: documents and how many topics have so many."""
    n = np.repeat([r.n for r in sizes], [r.topics for r in sizes]).astype(np.int64)
    if not len(n):
        return np.zeros(1, np.int64)
    groups = min(max(least, -(-int(n.sum()) // MASS)), most)
    number = (np.cumsum(n) - n) // -(-int(n.sum()) // groups)
    return np.array([0, *(np.flatnonzero(np.diff(number)) + 1), len(n)], np.int64)


def held(lists: DataFrame, min_docs: int = 2, min_pmi: float = 0.0) -> Held:
    """Of documents' ``topics``, arrays without repeats and nulls. They are read twice, and no row of a topic in a document is dealt out: topics are told by hashes of 64 bits among which no two are equal."""
    spark = lists.sparkSession
    all_ = lists.where(F.size("topics") > 0).select("topics")
    counts = all_.select(F.explode(F.concat("topics", F.array(F.lit(None).cast(all_.schema["topics"].dataType.elementType)))).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "counts")
    total = counts.where("topic IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts, seed = counts.where("topic IS NOT NULL"), 0
    while counts.groupBy(F.xxhash64(F.lit(seed), "topic").alias("code")).agg(F.count(F.lit(1)).alias("same")).where("same > 1").limit(1).count():
        seed += 1
    least = Least(total, min_docs, min_pmi)
    kept = numbered(counts.where((F.col("n") >= min_docs) & (F.col("n") <= F.lit(total * exp(-min_pmi) * (1 + 1e-12)))), "rank", "n", "topic")
    first = _groups(kept.groupBy("n").agg(F.count(F.lit(1)).alias("topics")).orderBy("n").collect(), GROUPS, MOST_GROUPS)
    codes = kept.select("rank", F.xxhash64(F.lit(seed), "topic").alias("code")).toArrow().sort_by("rank").column("code").to_numpy()
    codes = spark.sparkContext.broadcast(codes)
    schema = ", ".join(["docs int", *(f"p{g} binary" for g in range(len(first) - 1))])
    hashed = all_.select(F.transform("topics", lambda t: F.xxhash64(F.lit(seed), t)).alias("codes"))
    return Held(kept, written(hashed.mapInArrow(packed_documents(codes, first, SLICE), schema), "lists"), first, least)


def squares_of(batches: Iterator[pa.RecordBatch], first: np.ndarray, least: Least) -> Iterator[tuple]:
    """A square of ``Held.squares`` when it is whole: g, h, topics and their numbers of documents of both, and its pairs with these in batches. One square is in memory at a time."""
    names, square, now = [], None, None

    def done():
        g, h = now
        table = pa.Table.from_batches(names).combine_chunks() if names else None
        rank = table.column("rank").to_numpy()
        order = np.argsort(rank)
        table, rank = table.take(pa.array(order)), rank[order]
        sides = [table.slice(lo := int(np.searchsorted(rank, first[k])), int(np.searchsorted(rank, first[k + 1])) - lo) for k in now]
        topics, n = zip(*((t.column("topic").combine_chunks(), t.column("n").to_numpy()) for t in sides), strict=True)

        def pairs():
            xs, size = [], 0
            for part in square.pairs(len(n[1]), least(n[0])):
                xs.append(part)
                size += len(part[0])
                if size > BATCH:
                    yield good(xs)
                    xs, size = [], 0
            if xs:
                yield good(xs)

        def good(parts):
            x, y, both = (np.concatenate(c) for c in zip(*parts, strict=True))
            pmi = least.pmi(both, n[0][x], n[1][y])
            use = pmi >= least.min_pmi - 1e-12
            return x[use], y[use], both[use].astype(np.int64), pmi[use]

        return g, h, topics, n, pairs()

    for b in batches:
        if not b.num_rows:
            continue
        at = (b.column(0)[0].as_py(), b.column(1)[0].as_py())
        if at != now:
            if now:
                yield done()
            names, square, now = [], Square(at[0] == at[1]), at
        rows = b.select(["rank", "n", "topic"]).filter(pc.is_valid(b.column("rank")))
        if rows.num_rows:
            names.append(rows)
        for docs, x, y in zip(*(b.column(c) for c in ("docs", "x", "y")), strict=True):
            if docs.is_valid:
                square.add(docs.as_py(), memoryview(x.as_buffer()), memoryview(y.as_buffer()))
    if now:
        yield done()


def _counted(first: np.ndarray, least: Least):
    """tx, ty, nx, ny, n_ab, pmi of the pairs of the squares, tx not more frequent than ty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, topics, n, pairs in squares_of(batches, first, least):
            for x, y, both, pmi in pairs:
                yield pa.RecordBatch.from_arrays([topics[0].take(pa.array(x)), topics[1].take(pa.array(y)), *map(pa.array, (n[0][x], n[1][y], both, pmi))], names=["tx", "ty", "nx", "ny", "n_ab", "pmi"])

    return run


def cooccurrence(mentions: DataFrame, doc: str, topic: str, min_docs: int = 2, min_pmi: float = 0.0) -> DataFrame:
    """a, b, n_a, n_b, n_ab, pmi of the pairs of topics, a < b, that at least min_docs documents share, with a PMI of at least min_pmi.

    pmi = ln(n_ab * N / (n_a * n_b)) over the N documents with any topic; a topic
    counts once a document. Two bounds leave topics out before any pair is made,
    and lose none that qualifies: n_ab <= n_a, so topics of fewer documents than
    min_docs go; and n_ab <= min(n_a, n_b), hence pmi <= ln(N / max(n_a, n_b)), so
    the more frequent topics go too: those that every other document holds are the
    ones that would make most pairs. Null topics and documents are left out.
    """
    once = mentions.where(F.col(doc).isNotNull() & F.col(topic).isNotNull()).groupBy(doc).agg(F.collect_set(topic).alias("topics"))
    return cooccurrence_of_lists(written(once.select("topics"), "topics"), min_docs, min_pmi)


def lists_by(rows: DataFrame, doc: str) -> DataFrame:
    """topics, one array for each document, of rows of a document and an array without repeats: only those of documents with several rows meet. Null documents are left out."""
    rows = rows.where(F.col(doc).isNotNull())
    several = written(rows.groupBy(doc).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(doc), "several")
    if not several.limit(1).count():
        return rows.select("topics")
    met = rows.join(several, doc, "left_semi").groupBy(doc).agg(F.array_distinct(F.flatten(F.collect_list("topics"))).alias("topics"))
    return rows.join(several, doc, "left_anti").select("topics").union(met.select("topics"))


def cooccurrence_of_lists(lists: DataFrame, min_docs: int = 2, min_pmi: float = 0.0) -> DataFrame:
    """``cooccurrence`` of documents' ``topics``, arrays without repeats and nulls.

    What is left of the topics is numbered, rare first, and dealt into groups that
    occur about equally often. The lists are written once, packed, a column for each
    group, and a task counts the pairs of two groups: it reads these two columns and
    the groups' topics, and for one topic of the first at a time it counts those of
    the second in its documents. So a pair is counted whole in one place, becomes a
    row only if it is frequent enough, and has its names there: neither lists nor
    pairs are exchanged.
    """
    found = held(lists, min_docs, min_pmi)
    kind = dict(found.kept.dtypes)["topic"]
    schema = f"tx {kind}, ty {kind}, nx long, ny long, n_ab long, pmi double"
    if len(found.first) == 1:
        named = lists.sparkSession.createDataFrame([], schema)
    else:
        named = found.squares().mapInArrow(_counted(found.first, found.least), schema)
    less = F.col("tx") < F.col("ty")
    pick = lambda one, other, c: F.when(less, F.col(one)).otherwise(F.col(other)).alias(c)
    return named.select(pick("tx", "ty", "a"), pick("ty", "tx", "b"), pick("nx", "ny", "n_a"), pick("ny", "nx", "n_b"), "n_ab", "pmi")
