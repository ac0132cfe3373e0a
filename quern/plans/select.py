"""SELECT as a DataFrame plan: joins, filter, projection or aggregation, HAVING, DISTINCT, ORDER BY, LIMIT.

The plan is declared; which join, which exchange and which scan it takes is
left to Catalyst and adaptive execution.  With `arrival` set, rows come in the
order in which they were stored wherever the statement doesn't say otherwise;
that costs a sort, so it is off for tables from elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import EngineError
from quern.functions.conditions import Conditions
from quern.functions.expressions import SPARK_TYPES, strict
from quern.plans import ast
from quern.plans.binder import NUMBERS, BoundColumn, Scope, type_of
from quern.sources.catalog import RID, ExternalTable, Namespace, Table


@dataclass
class Planned:
    frame: DataFrame  # columns o0, o1, ...
    headers: list[str]
    types: list[str]

    @property
    def named(self) -> DataFrame:
        return self.frame.select([F.col(f"o{i}").alias(h) for i, h in enumerate(self.headers)])


def filtered(frame: DataFrame, conditions: Conditions, condition: ast.Condition) -> DataFrame:
    """The rows for which the condition is TRUE."""
    conditions.before.clear()
    column = conditions.column(condition, True)
    names = list(conditions.before)
    if names:
        frame = frame.withColumns({name: value for name, (value, _) in conditions.before.items()})
    return frame.filter(column).drop(*names)


@dataclass
class _Output:
    """What the select list makes: columns o0, o1, ... and hidden ones for the order of arrival."""

    frame: DataFrame
    headers: list[str]
    types: list[str]
    hidden: list[str]
    sources: list[BoundColumn | None] = field(default_factory=list)  # of outputs that are bare columns
    exprs: list[ast.Expr] = field(default_factory=list)


class SelectPlanner:
    def __init__(self, spark: SparkSession, space: Namespace, arrival: bool):
        self.spark, self.space, self.arrival = spark, space, arrival
        self.ids = 0

    def plan(self, select: ast.Select, outer: Scope | None = None) -> Planned:
        frame, scope, arrival = self.sources(select, outer)
        if select.where is not None:
            frame = filtered(frame, self.conditions(scope), select.where)
        grouped = select.group or any(isinstance(i.expr, ast.Aggregate) for i in select.items)
        if select.having is not None and not grouped:
            raise EngineError(309)
        out = self.aggregated(select, frame, scope, arrival) if grouped else self.projected(select, frame, scope, arrival)
        if select.having is not None:
            out.frame = self.having(out, select.having, scope)
        if select.distinct:
            outputs = [f"o{i}" for i in range(len(out.headers))]
            if out.hidden:
                out.frame, out.hidden = out.frame.groupBy(*outputs).agg(_first(out.hidden)), ["h"]
            else:
                out.frame = out.frame.distinct()
        keys = [self.order_key(out, order, scope) for order in select.order]
        if keys or out.hidden:
            out.frame = out.frame.orderBy(*keys, *out.hidden)
        if select.limit is not None:
            out.frame = out.frame.limit(select.limit)
        return Planned(out.frame.select([f"o{i}" for i in range(len(out.headers))]), out.headers, out.types)

    # ---- FROM

    def sources(self, select: ast.Select, outer: Scope | None) -> tuple[DataFrame, Scope, list[str]]:
        """(joined frame, its names, hidden columns of arrival)."""
        tables: list[Table | ExternalTable] = [self.space.table(s.table) for s in select.sources]
        names = [s.alias or t.name for s, t in zip(select.sources, tables, strict=True)]
        if len({n.lower() for n in names}) < len(names):
            raise EngineError(314)
        plain = len(tables) == 1 and select.sources[0].alias is None
        arrival = [] if not (self.arrival and all(t.stored for t in tables)) else [f"r{self.ids}_{k}" for k in range(len(tables))]
        bound: list[BoundColumn] = []
        frames: list[DataFrame] = []
        for k, (table, name) in enumerate(zip(tables, names, strict=True)):
            columns = [BoundColumn(name, c.name, c.type, f"c{self.ids}_{k}_{i}", k) for i, c in enumerate(table.columns)]
            picked = [F.col(f"`{c.name}`").alias(c.id) for c in columns]
            if arrival:
                picked.append(F.col(RID).alias(arrival[k]))
            frames.append(self.rows(table, select).select(picked))
            bound += columns
        self.ids += 1
        scope = Scope(bound, plain, outer)
        frame = frames[0]
        for k, source in enumerate(select.sources[1:], 1):
            upto = scope.upto(k + 1)
            if source.kind == "left":
                frame = self.left_join(frame, frames[k], upto, source.on, k)
            else:
                frame = frame.crossJoin(frames[k])
                if source.on is not None:  # which Catalyst makes the join's condition
                    frame = filtered(frame, self.conditions(upto), source.on)
        return frame, scope, arrival

    def rows(self, table: Table | ExternalTable, select: ast.Select) -> DataFrame:
        """A table's rows; where nothing but a LIMIT chooses among them, those of the first segments that have enough."""
        plain = len(select.sources) == 1 and select.where is None and not (select.order or select.distinct or select.group)
        if table.stored and plain and select.limit is not None and not any(isinstance(i.expr, ast.Aggregate) for i in select.items):
            return table.first(select.limit).frame(self.spark)
        return table.frame(self.spark)

    def left_join(self, left: DataFrame, right: DataFrame, scope: Scope, on: ast.Condition, k: int) -> DataFrame:
        conditions = self.conditions(scope)
        column = conditions.column(on, True)
        names = list(conditions.before)
        for name, (value, expr) in conditions.before.items():  # left sides of IN (SELECT ...) go where their columns are
            sides = {scope.resolve(n).source == k for n in _names(expr)}
            if len(sides) > 1:
                raise EngineError(501, "IN (SELECT ...) over columns of both sides of a LEFT JOIN")
            if sides == {True}:
                right = right.withColumn(name, value)
            else:
                left = left.withColumn(name, value)
        return left.join(right, column, "left").drop(*names)

    def conditions(self, scope: Scope) -> Conditions:
        def bind(name: str) -> tuple[Column, str]:
            found = scope.resolve(name)
            return F.col(found.id), found.type

        def subquery(select: ast.Select) -> tuple[DataFrame, list[str]]:
            planned = SelectPlanner(self.spark, self.space, self.arrival and select.limit is not None).nested(select, scope, self)
            return planned.frame, planned.types

        return Conditions(bind, subquery, lambda e: type_of(e, scope))

    def nested(self, select: ast.Select, scope: Scope, parent: SelectPlanner) -> Planned:
        self.ids = parent.ids
        out = self.plan(select, scope)
        parent.ids = self.ids
        return out

    # ---- the select list

    def projected(self, select: ast.Select, frame: DataFrame, scope: Scope, arrival: list[str]) -> _Output:
        items = select.items or tuple(ast.Item(ast.Name(f"{c.qualifier}.{c.name}")) for c in scope.columns)

        def bind(name: str) -> tuple[Column, str]:
            found = scope.resolve(name)
            return F.col(found.id), found.type

        columns, headers, types, sources = [], [], [], []
        for i, item in enumerate(items):
            types.append(type_of(item.expr, scope))
            columns.append(strict(item.expr, bind)[0].alias(f"o{i}"))
            source = scope.resolve(item.expr.text) if isinstance(item.expr, ast.Name) else None
            sources.append(source)
            headers.append(item.alias or (scope.header(source) if source else ast.label(item.expr)))
        out = frame.select(*columns, *arrival)
        return _Output(out, headers, types, arrival, sources, [i.expr for i in items])

    def aggregated(self, select: ast.Select, frame: DataFrame, scope: Scope, arrival: list[str]) -> _Output:
        if not select.items:
            raise EngineError(306)
        keys = [scope.resolve(name) for name in select.group]

        def bind(name: str) -> tuple[Column, str]:
            found = scope.resolve(name)
            return F.col(found.id), found.type

        aggregates, outputs, headers, types, sources = [], [], [], [], []
        for i, item in enumerate(select.items):
            if isinstance(item.expr, ast.Aggregate):
                column, type_ = self.aggregate(item.expr, scope, bind)
                aggregates.append(column.alias(f"a{i}"))
                outputs.append(F.col(f"a{i}").alias(f"o{i}"))
                headers.append(item.alias or ast.label(item.expr))
                sources.append(None)
            else:
                source = scope.resolve(item.expr.text) if isinstance(item.expr, ast.Name) else None
                if source is None:
                    type_of(item.expr, scope)
                    raise EngineError(306)
                if source not in keys:
                    raise EngineError(306)
                type_ = source.type
                outputs.append(F.col(source.id).alias(f"o{i}"))
                headers.append(item.alias or scope.header(source))
                sources.append(source)
            types.append(type_)
        hidden = ["h"] if arrival and keys else []
        if hidden:
            aggregates.append(_first(arrival))
        ids = list(dict.fromkeys(k.id for k in keys))
        grouped = frame.groupBy(*ids)
        frame = grouped.agg(*aggregates) if aggregates else frame.select(*ids).distinct()
        return _Output(frame.select(*outputs, *hidden), headers, types, hidden, sources, [i.expr for i in select.items])

    def aggregate(self, item: ast.Aggregate, scope: Scope, bind) -> tuple[Column, str]:
        if item.inner is None:
            return F.count(F.lit(1)), ast.LONG
        type_ = type_of(item.inner, scope)
        if item.function in ("sum", "avg") and type_ not in (*NUMBERS, ast.NULL) or type_ == ast.OTHER:
            raise EngineError(303)
        value = strict(item.inner, bind)[0]
        match item.function:
            case "count":
                return F.count(value), ast.LONG
            case "sum":
                wide = ast.FLOAT if type_ == ast.FLOAT else ast.LONG
                return F.sum(value.cast(SPARK_TYPES[wide])), wide
            case "avg":
                return F.avg(value.cast(T.DoubleType())), ast.FLOAT
        return {"min": F.min, "max": F.max}[item.function](value), type_

    # ---- over the finished list

    def having(self, out: _Output, condition: ast.Condition, scope: Scope) -> DataFrame:
        def bind(name: str) -> tuple[Column, str]:
            at = self.output(out, ast.Name(name), scope)
            return F.col(f"o{at}"), out.types[at]

        def types(expr: ast.Expr) -> str:
            return type_of(expr, labels)

        def subquery(select: ast.Select) -> tuple[DataFrame, list[str]]:
            planned = SelectPlanner(self.spark, self.space, False).nested(select, scope, self)
            return planned.frame, planned.types

        labels = _Labels(bind)
        return filtered(out.frame, Conditions(bind, subquery, types, loose=True), _over_labels(condition))

    def order_key(self, out: _Output, order: ast.Order, scope: Scope) -> Column:
        column = F.col(f"o{self.output(out, order.term, scope)}")
        return column.desc_nulls_last() if order.descending else column.asc_nulls_first()

    def output(self, out: _Output, term: ast.Expr, scope: Scope) -> int:
        """The output that a term of ORDER BY or HAVING names: its label, the end of a header, or what it was made from."""
        text = term.text if isinstance(term, ast.Name) else ast.label(term)
        low = text.lower()
        found = [i for i, h in enumerate(out.headers) if h.lower() == low]
        if not found:
            found = [i for i, h in enumerate(out.headers) if "." in h and h.lower().rsplit(".", 1)[1] == low]
        if not found:
            found = [i for i, e in enumerate(out.exprs) if ast.label(e).lower() == low]
        if not found and isinstance(term, ast.Name):
            names = scope.find(text)
            found = [i for i, s in enumerate(out.sources) if s is not None and s in names]
        if not found:
            raise EngineError(302, text)
        if len(found) > 1:
            raise EngineError(313, text)
        return found[0]


def _first(arrival: list[str]) -> Column:
    """When a group's first row came; of one table a plain number, so that hash aggregation stays possible."""
    return F.min(arrival[0] if len(arrival) == 1 else F.struct(*arrival)).alias("h")


class _Labels:
    """Labels of the select list as names, for type checks."""

    def __init__(self, bind):
        self.bind = bind

    def resolve(self, name: str):
        return BoundColumn("", name, self.bind(name)[1], "", 0)


def _over_labels(node):
    """A HAVING condition with its aggregates as names of the outputs that they label."""
    match node:
        case ast.Aggregate():
            return ast.Name(ast.label(node))
        case ast.Negate(inner):
            return ast.Negate(_over_labels(inner))
        case ast.Binary(op, left, right):
            return ast.Binary(op, _over_labels(left), _over_labels(right))
        case ast.Compare(op, left, right):
            return ast.Compare(op, _over_labels(left), right if isinstance(right, ast.Select) else _over_labels(right))
        case ast.IsNull(inner, negated):
            return ast.IsNull(_over_labels(inner), negated)
        case ast.Like(inner, pattern, negated):
            return ast.Like(_over_labels(inner), pattern, negated)
        case ast.InList(inner, values, negated):
            return ast.InList(_over_labels(inner), tuple(map(_over_labels, values)), negated)
        case ast.InSelect(inner, select, negated):
            return ast.InSelect(_over_labels(inner), select, negated)
        case ast.And(left, right):
            return ast.And(_over_labels(left), _over_labels(right))
        case ast.Or(left, right):
            return ast.Or(_over_labels(left), _over_labels(right))
        case ast.Not(inner):
            return ast.Not(_over_labels(inner))
    return node


def _names(expr: ast.Expr) -> list[str]:
    match expr:
        case ast.Name(text):
            return [text]
        case ast.Negate(inner):
            return _names(inner)
        case ast.Binary(_, left, right):
            return _names(left) + _names(right)
    return []
