"""Intermediate tables in the folder that the driver and all executors share, and joins that a hot key does not gather in one task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more than this part of all rows are joined by broadcast; there are fewer than HEAVY of them.
HEAVY = 1000
_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of the session's own in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not found:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidelake-")
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def mounted(spark: SparkSession, path: str) -> str:
    """A path of the shared folder as one that open() takes, its folder made; an error where the folder is no mounted one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() != "file":
        raise RuntimeError(f"a file needs a shared folder that is mounted, not one of {fs.getScheme()}")
    fs.mkdirs(p.getParent())
    return fs.makeQualified(p).toUri().getPath()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table that lost executors do not take with them; its lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a written table."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with the place (int, from 0) of each row in an order, written: rows are numbered in the pieces of a sort, whose sizes are added up."""
    at, piece = F.col("_at"), F.shiftright("_at", 33)
    pieces = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    sizes = sorted((r.piece, r["count"]) for r in pieces.groupBy(piece.alias("piece")).count().collect())  # one row a piece
    starts = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "_piece long, _start long"))
    number = (F.col("_start") + at.bitwiseAND(F.lit((1 << 33) - 1))).cast("int")
    return written(pieces.withColumn("_piece", piece).join(first, "_piece").select(*df.columns, number.alias(name)), "numbered")


def join_hot(rows: DataFrame, facts: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the other columns of facts, which has each key once and the number of its rows in ``size``; rows of no key are left out.

    The keys of more than a HEAVY-th of all rows go by broadcast, the rest by an
    ordinary join. Both tables are read twice and should be written ones.
    """
    total = facts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    heavy = F.col(size) * HEAVY > max(total, HEAVY * HEAVY)
    more = [c for c in facts.columns if c != key]
    met = rows.join(F.broadcast(facts.where(heavy)), key, "left")
    rest = met.where(F.col(size).isNull()).select(rows.columns).join(facts.where(~heavy), key)
    return met.where(F.col(size).isNotNull()).select(*rows.columns, *more).union(rest.select(*rows.columns, *more))


def apart(parts: list[DataFrame], none: DataFrame) -> DataFrame:
    """The union of parts of one partition each, one partition each. Spark lays the partitions of a union together where all its parts have one; ``none``, which has no rows and is read from files, keeps it from that."""
    parts = [*parts, none]
    while len(parts) > 1:
        parts = [a.union(parts[i + 1]) if i + 1 < len(parts) else a for i, a in list(enumerate(parts))[::2]]
    return parts[0]
