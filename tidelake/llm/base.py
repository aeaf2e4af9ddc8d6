"""Shared helpers: scratch tables in the cluster's shared folder, and document reading."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_BATCH, _DEFAULTS = "spark.sql.execution.arrow.maxBytesPerBatch", ("64m", "64MB", "67108864", "67108864b")
#: Groups of more than this part of all rows are joined by broadcast.
HEAVY = 1000
_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a folder of its own in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not root:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidelake-")
    return root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few bytes, if the session has Spark's default: executors hold batches of whole texts several times over outside the heap."""
    if spark.conf.get(_BATCH, None) in _DEFAULTS:
        spark.conf.set(_BATCH, "4m")


def give_back() -> None:
    """Hand freed memory of a worker process back to the system, where the C library can: workers outlive their tasks and would hold it through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing will read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows with the columns of their group, where one group may hold any share of all rows; rows of no group are left out.

    groups has each key once, with the number of its rows in ``size``, and should be
    a written table. Groups of over a HEAVY-th of all rows, fewer than HEAVY of them
    therefore, are broadcast; the rest is joined by key.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    heavy = F.col(size) * HEAVY > max(total, HEAVY * HEAVY)
    more = [c for c in groups.columns if c not in keys]
    met = rows.join(F.broadcast(groups.where(heavy)), keys, "left")
    rest = met.where(F.col(size).isNull()).select(rows.columns).join(groups.where(~heavy), keys)
    return met.where(F.col(size).isNotNull()).select(*rows.columns, *more).union(rest.select(*rows.columns, *more))


def row_key(df: DataFrame) -> Column:
    """128 bits of hash over all columns: rows of equal key are the same row repeated."""
    columns = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    flags = F.concat(*(F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in df.columns))
    return F.concat_ws("-", *(F.hex(F.xxhash64(F.lit(seed), flags, *columns)) for seed in (1, 2)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text):
    """Lower-case A-Z only, as a Column; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
