"""Conditions as boolean Columns, with three-valued logic; an error inside a comparison makes it UNKNOWN."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import EngineError
from quern.functions.expressions import Bind, tolerant
from quern.plans import ast
from quern.plans.binder import NUMBERS, bend_pair, same_family

_names = itertools.count(1)


def unknown() -> Column:
    return F.lit(None).cast("boolean")


def compare(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def like(value: Column, pattern: str) -> Column:
    """LIKE without an escape: one that the pattern doesn't have is named."""
    escape = next(c for c in map(chr, range(1, 0x110000)) if c not in pattern and c not in "%_")
    return F.like(value, F.lit(pattern), F.lit(escape))


@dataclass
class Conditions:
    """Builds the Column of a condition.

    `bind` gives a name's column and type, `plan` the DataFrame of a subquery
    and its only column's type.  `before` collects columns that must be there
    before the filter: the left sides of IN (SELECT ...).  `loose` is for
    HAVING, where numbers of any type compare and other types never match.
    """

    bind: Bind
    plan: Callable[[ast.Select], tuple[DataFrame, list[str]]]
    types: Callable[[ast.Expr], str]
    loose: bool = False
    before: dict[str, tuple[Column, ast.Expr]] = field(default_factory=dict)

    def column(self, node: ast.Condition, top: bool = False) -> Column:
        """`top` says that only rows for which the condition is TRUE matter, so that UNKNOWN may be FALSE."""
        match node:
            case ast.And(left, right):
                return self.column(left, top) & self.column(right, top)
            case ast.Or(left, right):
                return self.column(left) | self.column(right)
            case ast.Not(inner):
                return ~self.column(inner)
            case ast.Compare(op, left, ast.Select() as select):
                return self.scalar(op, left, select)
            case ast.Compare(op, left, right):
                return self.comparison(op, left, right)
            case ast.IsNull(inner, negated):
                self.types(inner)
                value, failed, _ = tolerant(inner, self.bind)
                out = value.isNotNull() if negated else value.isNull()
                return out if failed is None else F.when(failed, unknown()).otherwise(out)
            case ast.Like(inner, pattern, negated):
                if self.types(inner) not in (ast.TEXT, ast.NULL):
                    raise EngineError(303)
                out = like(tolerant(inner, self.bind)[0], pattern)
                return ~out if negated else out
            case ast.InList(inner, values, negated):
                out = self.any_of(inner, values)
                return ~out if negated else out
            case ast.InSelect(inner, select, negated):
                return self.member(inner, select, negated, top)
            case ast.Exists(select, negated):
                out = self.plan(select)[0].exists()
                return ~out if negated else out
        raise TypeError(node)

    def comparison(self, op: str, left: ast.Expr, right: ast.Expr) -> Column:
        types = self.types(left), self.types(right)
        if self.loose and all(t in NUMBERS for t in types):
            return compare(op, tolerant(left, self.bind)[0], tolerant(right, self.bind)[0])
        try:
            left, right = bend_pair(left, right, *types)
        except EngineError as error:
            if self.loose and error.code == 303:
                return unknown()
            raise
        return compare(op, tolerant(left, self.bind)[0], tolerant(right, self.bind)[0])

    def any_of(self, inner: ast.Expr, values: tuple[ast.Expr, ...]) -> Column:
        """IN over values: as one set where they are literals, else as equalities."""
        type_ = self.types(inner)
        bent = []
        for value in values:
            other = self.types(value)
            if other == ast.NULL:
                bent.append(ast.Literal(None, type_))
            else:
                a, b = bend_pair(inner, value, type_, other)
                bent.append(b if a == inner else value)
                if a != inner:
                    return self._equalities(inner, values)
        if all(isinstance(v, ast.Literal) for v in bent):
            return tolerant(inner, self.bind)[0].isin([tolerant(v, self.bind)[0] for v in bent])
        return self._equalities(inner, values)

    def _equalities(self, inner: ast.Expr, values: tuple[ast.Expr, ...]) -> Column:
        out = None
        for value in values:
            one = unknown() if self.types(value) == ast.NULL else self.comparison("=", inner, value)
            out = one if out is None else out | one
        return out

    def _comparable(self, inner: ast.Expr, other: str) -> ast.Expr:
        """The left side of a comparison with a subquery's column; numbers of all types compare."""
        type_ = self.types(inner)
        if same_family(type_, other) or ast.NULL in (type_, other) or (type_ in NUMBERS and other in NUMBERS):
            return inner
        if isinstance(inner, ast.Literal):
            return bend_pair(inner, ast.Name(""), type_, other)[0]
        raise EngineError(303)

    def scalar(self, op: str, left: ast.Expr, select: ast.Select) -> Column:
        frame, types = self.plan(select)
        if len(types) != 1:
            raise EngineError(322)
        left = self._comparable(left, types[0])
        return compare(op, tolerant(left, self.bind)[0], frame.scalar())

    def member(self, inner: ast.Expr, select: ast.Select, negated: bool, top: bool) -> Column:
        """[NOT] IN (SELECT ...): a semi or anti join on equality, and what NULLs on either side add to it.

        The join is a plain one, so that neither side has to be broadcast.
        """
        frame, types = self.plan(select)
        if len(types) != 1:
            raise EngineError(322)
        inner = self._comparable(inner, types[0])
        value = tolerant(inner, self.bind)[0]
        if self.types(inner) == ast.NULL:
            value = value.cast(frame.schema[0].dataType)
        name, there = f"_left_{next(_names)}", F.col(f"`{frame.columns[0]}`")
        self.before[name] = (value, inner)
        found = frame.where(there == F.col(name).outer()).exists()
        if top and not negated:
            return found
        # -1 for an empty set, 1 for one with a NULL
        nulls = frame.agg(F.coalesce(F.max(there.isNull().cast("int")), F.lit(-1))).scalar()
        if top:
            return ~found & ((nulls == -1) | (F.col(name).isNotNull() & (nulls == 0)))
        out = F.when(found, F.lit(True)).when(nulls == -1, F.lit(False)).when(F.col(name).isNull() | (nulls == 1), unknown()).otherwise(F.lit(False))
        return ~out if negated else out
