"""Scans and sinks: SQL views and queries, SQLite files, text folders, JSON."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import REQUIRED_COLUMNS
from .config import ConfigError, SourceConfig
from .sqlite import PAGE, is_table, opened, quoted, sqlite_table


def rename_columns(df: DataFrame, rename: dict[str, str]) -> DataFrame:
    """With columns renamed; two columns of one name are refused."""
    names = [rename.get(c, c) for c in df.columns]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ConfigError(f"columns occur twice: {sorted(twice)}")
    return df.toDF(*names)


def check_columns(df: DataFrame, version_column: str | None = None) -> DataFrame:
    needed = [*REQUIRED_COLUMNS, *([version_column] if version_column else [])]
    if missing := [c for c in needed if c not in df.columns]:
        raise ConfigError(f"the source lacks columns: {missing}")
    return df


_WHOLE = re.compile(r"\s*SELECT\s+\*\s+FROM\s+([A-Za-z0-9_]+)\s*;?\s*", re.I)


def read_source(spark: SparkSession, source: SourceConfig) -> DataFrame:
    """The source's rows, renamed and checked; nothing is read yet where Spark can run the query itself. A whole SQLite table is scanned in parallel."""
    if not source.db:
        df = spark.sql(source.sql)
    else:
        whole = _WHOLE.fullmatch(source.sql)
        parallel = whole is not None and is_table(source.db, whole[1])
        df = sqlite_table(spark, source.db, whole[1]) if parallel else sqlite_query(spark, source.db, source.sql)
    return check_columns(rename_columns(df, source.rename), source.version_column)


def sqlite_query(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Rows of a query or view on a SQLite file opened read-only: integers, reals or, where a column holds anything else, text.

    One task finds the types and one reads the rows, a page at a time, as the order
    of a query's rows is not known; the driver only learns the columns' names. The
    file must be readable where the tasks run. Tables are better read by
    ``sqlite.sqlite_table``.
    """
    with opened(path) as db:
        names = [c[0] for c in db.execute(f"SELECT * FROM ({query}) LIMIT 0").description]
    tests = ", ".join(f"max(typeof({q}) NOT IN ('integer', 'null')), max(typeof({q}) NOT IN ('integer', 'real', 'null')), count({q})" for q in map(quoted, names))

    def ask(batches: Iterator) -> Iterator:
        import pandas as pd

        for _ in batches:
            with opened(path) as own:
                yield pd.DataFrame({"found": [[int(x or 0) for x in own.execute(f"SELECT {tests} FROM ({query})").fetchone()]]})

    found = spark.range(0, 1, 1, 1).mapInPandas(ask, "found array<long>").first().found
    kinds = ["string" if not found[3 * i + 2] or found[3 * i + 1] else "double" if found[3 * i] else "long" for i in range(len(names))]
    make = [{"string": str, "double": float, "long": int}[k] for k in kinds]

    def pages(batches: Iterator) -> Iterator:
        import pandas as pd

        for _ in batches:
            with opened(path) as own:
                cursor = own.execute(query)
                while page := cursor.fetchmany(PAGE):
                    cells = [[None if v is None else m(v) for m, v in zip(make, r, strict=True)] for r in page]
                    yield pd.DataFrame(cells, columns=names, dtype=object)

    return spark.range(0, 1, 1, 1).mapInPandas(pages, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of the .md and .txt files of a folder, by name; a byte-order mark is dropped."""
    files = spark.read.option("pathGlobFilter", "*.{md,txt,MD,TXT}").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text")).orderBy("path")


def union_sources(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    """UNION ALL of tables brought to the same columns; what one lacks is empty text."""
    shaped = [df.select(*(F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns)) for df in frames]
    return reduce(lambda a, b: a.unionByName(b), shaped)


def unpivot(df: DataFrame, keys: list[str], periods: dict[str, str], period: str = "period", value: str = "value") -> DataFrame:
    """Wide to long: one row for each key and column, the column named by its period."""
    long = df.unpivot(keys, list(periods), "column", value)
    names = F.create_map(*(F.lit(x) for pair in periods.items() for x in pair))
    return long.withColumn(period, names[F.col("column")]).drop("column")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
