"""A scan of a SQLite table in parallel, as a Spark data source: ranges of row ids, chosen columns, filters in the file."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Rows that a task reads at once.
PAGE = 50_000
_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> closing:
    """The file, read-only."""
    return closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


def affinity(declared: str) -> str:
    """SQLite's rules for a declared type: long, double, text, or any for what may hold values of every kind."""
    d = declared.upper()
    if "INT" in d:
        return "long"
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return "text"
    return "double" if any(x in d for x in ("REAL", "FLOA", "DOUB")) else "any"


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table = options["path"], options["table"]
        self.ranges, self.safe = json.loads(options["ranges"]), set(json.loads(options["safe"]))
        self.names, self.kinds = schema.names, [{"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in schema.fields]
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters that the file can apply go there; Spark applies all of them again."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.safe:
                column = quoted(name) + " COLLATE BINARY"
                if isinstance(f, IsNotNull):
                    self.where.append(f"{quoted(name)} IS NOT NULL")
                elif isinstance(f, In) and all(isinstance(x, (int, float, str)) for x in f.value):
                    self.where.append(f"{column} IN ({', '.join('?' * len(f.value))})")
                    self.values += f.value
                elif type(f) in _COMPARE and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                    self.where.append(f"{column} {_COMPARE[type(f)]} ?")
                    self.values.append(f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        return [_Range(*r) for r in self.ranges]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where.append("rowid BETWEEN ? AND ?")
            values += [partition.low, partition.high]
        sql = f"SELECT {', '.join(map(quoted, self.names))} FROM {quoted(self.table)}" + (" WHERE " + " AND ".join(where) if where else "")
        make = [{"string": _text, "double": float, "long": int}[k] for k in self.kinds]
        with opened(self.path) as db:
            cursor = db.execute(sql, values)
            while page := cursor.fetchmany(PAGE):
                columns = [[None if v is None else m(v) for v in column] for m, column in zip(make, zip(*page, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, self.kinds, strict=True)], self.names)


def _text(v) -> str:
    return v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


class SqliteTable(DataSource):
    """Use ``sqlite_table``, which finds the types and ranges."""

    @classmethod
    def name(cls) -> str:
        return "tidelake_sqlite"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def _ranges(db: sqlite3.Connection, table: str, parts: int) -> list[list[int | None]]:
    """Ranges of row ids of about equal width; one for a table without row ids. The ends are looked up, not searched for."""
    try:
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(table)}").fetchone()
    except sqlite3.OperationalError:
        return [[None, None]]
    if low is None:
        return []
    step = -(-(high - low + 1) // parts)
    return [[a, min(a + step - 1, high)] for a in range(low, high + 1, step)]


def _misfits(spark: SparkSession, path: str, table: str, numbers: dict[str, str], ranges: list) -> set[str]:
    """The columns declared as numbers that hold anything else, asked for range by range in tasks."""
    if not numbers or not ranges:
        return set()
    tests = ", ".join(f"max(typeof({quoted(n)}) NOT IN ({', '.join(repr(t) for t in (('integer', 'null') if k == 'long' else ('integer', 'real', 'null')))}))" for n, k in numbers.items())

    def ask(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for low, high in zip(pdf["low"], pdf["high"], strict=True):
                where = "" if pd.isna(low) else f" WHERE rowid BETWEEN {int(low)} AND {int(high)}"
                with opened(path) as db:
                    found = db.execute(f"SELECT {tests} FROM {quoted(table)}{where}").fetchone()
                yield pd.DataFrame({"name": [n for n, f in zip(numbers, found, strict=True) if f]}, dtype=object)

    asked = spark.createDataFrame([tuple(r) for r in ranges], "low long, high long").repartition(len(ranges))
    return {r.name for r in asked.mapInPandas(ask, "name string").distinct().collect()}


def is_table(path: str, name: str) -> bool:
    with opened(path) as db:
        return db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", [name]).fetchone() is not None


def sqlite_table(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """The rows of a SQLite table, read in ranges of row ids by as many tasks.

    Types are those declared (integers, reals, else text); a number column that
    holds anything else, which SQLite allows, is text. Only the columns named are
    read. Filters on columns of one kind are applied in the file. The file must be
    readable where tasks run; the driver reads its schema and the ends of its ids.
    """
    parts = parts or spark.sparkContext.defaultParallelism
    with opened(path) as db:
        declared = {r[1]: affinity(r[2] or "") for r in db.execute(f"PRAGMA table_info({quoted(table)})")}
        if not declared:
            raise ValueError(f"no such table: {table}")
        if unknown := [c for c in columns or () if c not in declared]:
            raise ValueError(f"{table} lacks columns: {unknown}")
        ranges = _ranges(db, table, parts)
    kinds = {c: declared[c] for c in columns or declared}
    odd = _misfits(spark, path, table, {c: k for c, k in kinds.items() if k in ("long", "double")}, ranges)
    schema = ", ".join(f"`{c.replace('`', '``')}` {k if k in ('long', 'double') and c not in odd else 'string'}" for c, k in kinds.items())
    safe = [c for c, k in kinds.items() if k != "any" and c not in odd]
    spark.dataSource.register(SqliteTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    if not ranges:
        return spark.createDataFrame([], schema)
    return spark.read.format(SqliteTable.name()).option("schema", schema).option("path", path).option("table", table).option("ranges", json.dumps(ranges)).option("safe", json.dumps(safe)).load().select(*(F.col("`" + c.replace("`", "``") + "`") for c in kinds))
