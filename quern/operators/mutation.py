"""INSERT, UPDATE, DELETE and VACUUM as new versions of a table, with its constraints."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import EngineError, from_spark
from quern.functions.conditions import Conditions
from quern.functions.expressions import SPARK_TYPES, strict
from quern.functions.rows import holds
from quern.operators.storage import SegmentStore
from quern.plans import ast
from quern.plans.binder import BoundColumn, Scope, bend, type_of
from quern.plans.select import SelectPlanner, filtered
from quern.sources.catalog import RID, TAIL_ROWS, Namespace, StoredColumn, Table

# Rows of a table whose unique values the driver may remember; beyond that each insert asks the table.
REMEMBERED_ROWS = 1_000_000


class UniqueValues:
    """The values of unique columns, remembered on the driver for tables of bounded size."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.seen: dict[str, tuple[int, dict[str, set[Any]]]] = {}

    def taken(self, table: Table, column: StoredColumn, value: Any) -> bool:
        if table.rows > REMEMBERED_ROWS:
            field = F.col(column.field)
            return not table.fields_frame(self.spark).where(field == F.lit(value).cast(SPARK_TYPES[column.type])).isEmpty()
        version, values = self.seen.get(table.uid, (-1, {}))
        if version != table.version:
            unique = [c.field for c in table.columns if c.unique]
            if table.segments:
                rows = table.fields_frame(self.spark).select(unique).collect()  # at most REMEMBERED_ROWS
                values = {f: {r[f] for r in rows if r[f] is not None} for f in unique}
            else:
                tail = [row for _, row in table.tail[: table.tailed]]
                values = {f: {row[f] for row in tail if row.get(f) is not None} for f in unique}
            self.seen[table.uid] = (table.version, values)
        return value in values[column.field]

    def added(self, before: Table, after: Table, row: dict[str, Any]) -> None:
        version, values = self.seen.get(before.uid, (-1, {}))
        if version == before.version:
            for field, seen in values.items():
                if row.get(field) is not None:
                    seen.add(row[field])
            self.seen[after.uid] = (after.version, values)


class Mutations:
    def __init__(self, spark: SparkSession, store: SegmentStore, unique: UniqueValues):
        self.spark, self.store, self.unique = spark, store, unique

    # ---- INSERT

    def row(self, table: Table, statement: ast.Insert) -> dict[str, Any]:
        """The row by fields, with defaults filled in."""
        if statement.columns:
            columns = []
            for name in statement.columns:
                column = table.column(name)
                if column in columns:
                    raise EngineError(305, name)
                columns.append(column)
        else:
            columns = list(table.columns)
        if len(columns) != len(statement.values):
            raise EngineError(304)
        given = {c.field: bend(v, c.type).value for c, v in zip(columns, statement.values, strict=True)}
        for column in table.columns:
            if column.field not in given:
                if not column.has_default and column.not_null:
                    raise EngineError(316, column.name)
                given[column.field] = column.default
        return given

    def insert(self, table: Table, statement: ast.Insert) -> tuple[Table, dict[str, Any]]:
        """(new version, the row by fields): no Spark job, unless the row's uniqueness asks for one."""
        row = self.row(table, statement)
        self.check_row(table, row)
        out = table.appended(row)
        self.unique.added(table, out, row)
        return (self.store.settled(out) if out.tailed >= TAIL_ROWS else out), row

    def check_row(self, table: Table, row: dict[str, Any]) -> None:
        for column in table.columns:
            value = row[column.field]
            if value is None:
                if column.not_null:
                    raise EngineError(411, column.name)
                continue
            if column.size and len(value.encode()) > column.size:
                raise EngineError(414, column.name)
            if column.unique and self.unique.taken(table, column, value):
                raise EngineError(412, column.name)
        if table.check is not None and holds(table.check, {c.name.lower(): row[c.field] for c in table.columns}) is False:
            raise EngineError(413)

    # ---- UPDATE and DELETE

    def scope(self, table: Table) -> Scope:
        return Scope([BoundColumn(table.name, c.name, c.type, c.field, 0) for c in table.columns], True)

    def conditions(self, space: Namespace, scope: Scope) -> Conditions:
        return SelectPlanner(self.spark, space, False).conditions(scope)

    def touched(self, space: Namespace, table: Table, where: ast.Condition | None) -> DataFrame:
        """The rows that a statement is about."""
        frame = table.fields_frame(self.spark)
        return frame if where is None else filtered(frame, self.conditions(space, self.scope(table)), where)

    def delete(self, space: Namespace, table: Table, statement: ast.Delete) -> tuple[Table, int]:
        if statement.where is None:
            return table.changed(segments=(), tail=[], tailed=0), table.rows
        frame = table.fields_frame(self.spark)
        keep = filtered(frame, _Kept(self.conditions(space, self.scope(table))), statement.where)
        out = self.store.rewritten(table, keep)
        return (table, 0) if out.rows == table.rows else (out, table.rows - out.rows)

    def update(self, space: Namespace, table: Table, statement: ast.Update) -> tuple[Table, int]:
        """All rows are made and checked before any is written; changed rows move to the end."""
        scope = self.scope(table)
        assigned: dict[str, Column] = {}

        def bind(name: str) -> tuple[Column, str]:
            found = scope.resolve(name)
            return F.col(found.id), found.type

        for name, expr in statement.assignments:
            column = table.column(name)
            if column.field in assigned:
                raise EngineError(305, name)
            if isinstance(expr, ast.Literal):
                expr = bend(expr, column.type)
                value = F.lit(expr.value)
            else:
                type_ = type_of(expr, scope)
                if type_ not in (column.type, ast.NULL) and not (type_ == ast.INT and column.type == ast.LONG):
                    raise EngineError(303)
                value = strict(expr, bind)[0]
            assigned[column.field] = value.cast(SPARK_TYPES[column.type])
        rows = self.touched(space, table, statement.where)
        made = rows.select(RID, *(assigned.get(c.field, F.col(c.field)).alias(c.field) for c in table.columns))
        # One pass makes the rows and counts them; they are few or many, so they are written and not collected.
        changed = self.store.write(table, made)
        if not changed.rows:
            self.store.drop(changed.path)
            return table, 0
        made = self.spark.read.schema(made.schema).parquet(changed.path)
        try:
            return self.placed(table, made, [c for c in table.columns if c.field in assigned]), changed.rows
        finally:
            self.store.drop(changed.path)

    def placed(self, table: Table, made: DataFrame, assigned: list[StoredColumn]) -> Table:
        """The table with changed rows in place of their old ones, once they have passed the constraints."""
        self.check_rows(table, made, assigned)
        rest = table.fields_frame(self.spark).join(made.select(RID), RID, "left_anti")
        low, high, n = made.agg(F.min(RID), F.max(RID), F.count(F.lit(1))).first()
        place = made.withColumn(RID, F.col(RID) - F.lit(low) + F.lit(table.next_rid))  # after all others, in their order
        out = self.store.rewritten(table, rest.unionByName(place), table.next_rid + high - low + 1)
        return out.changed(slots=table.slots + n)

    def check_rows(self, table: Table, made: DataFrame, assigned: list[StoredColumn]) -> None:
        """The first violation in the order of rows, then columns, then a column's rules, then the table's CHECK."""
        found: list[Column] = []  # (place, code) of each rule that a row can break on its own
        stored = table.fields_frame(self.spark)
        clash = None

        def broken(condition: Column, place: int, code: int) -> Column:
            return F.when(condition, F.struct(F.lit(place).alias("place"), F.lit(code).alias("code")))

        for at, column in enumerate(table.columns):
            value = F.col(column.field)
            if column.not_null:
                found.append(broken(value.isNull(), 3 * at, 411))
            if column.size:
                found.append(broken(F.octet_length(value) > column.size, 3 * at + 1, 414))
            if column.unique and column in assigned:
                # a value that another row has, before the statement or after it
                others = stored.select(F.col(RID).alias("_other"), F.col(column.field).alias("_value"))
                before = made.join(others, (made[column.field] == others["_value"]) & (made[RID] != others["_other"])).select(RID)
                twice = made.where(value.isNotNull()).groupBy(column.field).agg(F.count(F.lit(1)).alias("_n"), F.max(RID).alias(RID)).where("_n > 1").select(RID)
                both = before.union(twice).select(RID, F.struct(F.lit(3 * at + 2).alias("place"), F.lit(412).alias("code")).alias("first"))
                clash = both if clash is None else clash.union(both)
        if table.check is not None:
            scope = self.scope(table)
            condition = self.conditions(Namespace(""), scope).column(table.check)
            found.append(broken(~condition, 3 * len(table.columns), 413))
        bad = made.select(RID, F.coalesce(*found).alias("first")).where("first is not null") if found else None
        if clash is not None:
            bad = clash if bad is None else bad.union(clash)
        first = None if bad is None else bad.agg(F.min(F.struct(RID, "first"))).first()[0]
        if first is not None:
            raise EngineError(first["first"]["code"])

    def vacuum(self, table: Table, by: str | None = None) -> Table:
        """Everything in one segment, in the order of an index if there is one; old versions go with whoever holds them."""
        return self.store.compacted(table, by).changed(slots=table.rows)


class _Kept:
    """Conditions turned round: the rows for which a DELETE's condition isn't TRUE."""

    def __init__(self, inner: Conditions):
        self.inner, self.before = inner, inner.before

    def column(self, node: ast.Condition, top: bool = False) -> Column:
        return ~F.coalesce(self.inner.column(node), F.lit(False))


def guarded(run):
    """A statement's work, with Spark's errors as the engine's."""
    try:
        return run()
    except EngineError:
        raise
    except Exception as error:
        known = from_spark(error)
        if known is None:
            raise
        raise known from error
