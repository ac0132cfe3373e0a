"""Tables as immutable values, and the namespaces that hold them.

A stored table is a list of Parquet segments and a tail of rows that were
inserted since.  Its columns have field names of their own in the segments, so
adding, dropping and renaming a column touches no data: a segment without the
field gets the value that the column was added with.  A change makes a new
value of the table; whoever holds the old one still reads it.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import EngineError
from quern.functions.expressions import SPARK_TYPES
from quern.plans import ast

RID = "_rid"  # arrival order
# Rows of a tail before it is written as a segment.
TAIL_ROWS = 10_000

_versions = itertools.count(1)


@dataclass(frozen=True)
class StoredColumn:
    name: str
    type: str
    field: str
    size: int = 0
    primary: bool = False
    unique: bool = False
    not_null: bool = False
    has_default: bool = False
    default: Any = None
    fill: Any = None  # in segments that were written before the column was

    @property
    def shown(self) -> str:
        """The column as a schema listing shows it."""
        text = f"{self.name} " + (f"varchar({self.size})" if self.type == ast.TEXT and self.size else self.type)
        if self.primary:
            text += " primary key"
        else:
            text += " not null" * self.not_null + " unique" * self.unique
        return text + " default" * self.has_default


@dataclass(frozen=True)
class Segment:
    path: str
    fields: tuple[str, ...]
    rows: int


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[StoredColumn, ...]
    check: ast.Condition | None = None
    segments: tuple[Segment, ...] = ()
    tail: list[tuple[int, dict[str, Any]]] = field(default_factory=list)  # shared by versions; each sees `tailed` rows
    tailed: int = 0
    next_rid: int = 0
    next_field: int = 0
    slots: int = 0  # rows ever placed since the last VACUUM
    sources: tuple[tuple[str, int], ...] = ()  # streams that feed the table, with the last batch of each
    version: int = field(default_factory=lambda: next(_versions))
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)

    stored = True

    def changed(self, **changes) -> Table:
        return replace(self, version=next(_versions), **changes)

    def column(self, name: str) -> StoredColumn:
        for column in self.columns:
            if column.name.lower() == name.lower():
                return column
        raise EngineError(302, name)

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.segments) + self.tailed

    def appended(self, row: dict[str, Any]) -> Table:
        tail = self.tail if len(self.tail) == self.tailed else self.tail[: self.tailed]
        tail.append((self.next_rid, row))
        return self.changed(tail=tail, tailed=self.tailed + 1, next_rid=self.next_rid + 1, slots=self.slots + 1)

    def first(self, rows: int) -> Table:
        """The table with no more segments than hold its first rows; segments are in arrival order."""
        kept, n = [], 0
        for segment in self.segments:
            if n >= rows:
                return replace(self, segments=tuple(kept), tail=[], tailed=0)
            kept.append(segment)
            n += segment.rows
        return replace(self, tailed=min(self.tailed, max(0, rows - n)))

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(RID, T.LongType()), *(T.StructField(c.field, SPARK_TYPES[c.type]) for c in self.columns)])

    def fields_frame(self, spark: SparkSession) -> DataFrame:
        """All rows: RID, and the columns by their fields."""
        parts = []
        for fields, segments in itertools.groupby(self.segments, lambda s: s.fields):  # one scan for all that have the same fields
            there = T.StructType([f for f in self.schema() if f.name == RID or f.name in fields])
            frame = spark.read.schema(there).parquet(*(s.path for s in segments))
            fills = {c.field: F.lit(c.fill).cast(SPARK_TYPES[c.type]) for c in self.columns if c.field not in fields}
            parts.append(frame.select(RID, *(fills.get(c.field, F.col(c.field)).alias(c.field) for c in self.columns)))
        if self.tailed or not parts:
            rows = [(rid, *(row.get(c.field, c.fill) for c in self.columns)) for rid, row in self.tail[: self.tailed]]
            parts.append(spark.createDataFrame(rows, self.schema()))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """All rows: RID, and the columns by their names."""
        return self.fields_frame(spark).toDF(RID, *(c.name for c in self.columns))


@dataclass(frozen=True)
class ExternalTable:
    """A DataFrame under a name: read only, in no particular order."""

    name: str
    data: DataFrame
    columns: tuple[StoredColumn, ...]

    stored = False
    check = None

    def frame(self, spark: SparkSession) -> DataFrame:
        return self.data

    def column(self, name: str) -> StoredColumn:
        return Table.column(self, name)


class FileTable:
    """A read-only table whose files are looked at when it is first asked for."""

    stored = False
    check = None

    def __init__(self, name: str, read: Callable[[], DataFrame]):
        self.name, self._read = name, read

    @functools.cached_property
    def _table(self) -> ExternalTable:
        return external(self.name, self._read())

    @property
    def columns(self) -> tuple[StoredColumn, ...]:
        return self._table.columns

    def frame(self, spark: SparkSession) -> DataFrame:
        return self._table.data

    def column(self, name: str) -> StoredColumn:
        return Table.column(self, name)


def external(name: str, data: DataFrame) -> ExternalTable:
    """A DataFrame as a table: whole numbers, floats, texts and dates go by their types, timestamps as dates.

    Columns of other types can be passed on, not compared.
    """
    columns, picked = [], []
    for f in data.schema:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ByteType | T.ShortType | T.IntegerType):
            kind, column = ast.INT, column.cast("int")
        elif isinstance(f.dataType, T.LongType):
            kind = ast.LONG
        elif isinstance(f.dataType, T.FloatType | T.DoubleType | T.DecimalType):
            kind, column = ast.FLOAT, column.cast("double")
        elif isinstance(f.dataType, T.StringType):
            kind = ast.TEXT
        elif isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            kind, column = ast.DATE, column.cast("date")
        else:
            kind = ast.OTHER
        columns.append(StoredColumn(f.name, kind, f.name))
        picked.append(column.alias(f.name))
    return ExternalTable(name, data.select(picked), tuple(columns))


@dataclass(frozen=True)
class IndexDef:
    name: str
    table: str
    column: str  # its field


@dataclass(frozen=True)
class Namespace:
    name: str
    tables: dict[str, Table | ExternalTable] = field(default_factory=dict)
    indexes: tuple[IndexDef, ...] = ()

    def table(self, name: str) -> Table | ExternalTable:
        found = self.tables.get(name.lower())
        if found is None:
            raise EngineError(300, name)
        return found

    def writable(self, name: str) -> Table:
        table = self.table(name)
        if not table.stored:
            raise EngineError(501, f"{name} is read only")
        return table

    def with_table(self, table: Table | ExternalTable) -> Namespace:
        return replace(self, tables={**self.tables, table.name.lower(): table})

    def without_table(self, name: str) -> Namespace:
        low = name.lower()
        return replace(self, tables={k: v for k, v in self.tables.items() if k != low}, indexes=tuple(i for i in self.indexes if i.table.lower() != low))


@dataclass(frozen=True)
class Catalog:
    """All namespaces: one immutable value, so that a transaction is a reference to an old one."""

    namespaces: dict[str, Namespace] = field(default_factory=lambda: {"main": Namespace("main")})

    def namespace(self, name: str) -> Namespace:
        found = self.namespaces.get(name.lower())
        if found is None:
            raise EngineError(311, name)
        return found

    def with_namespace(self, space: Namespace) -> Catalog:
        return Catalog({**self.namespaces, space.name.lower(): space})

    def without_namespace(self, name: str) -> Catalog:
        return Catalog({k: v for k, v in self.namespaces.items() if k != name.lower()})
