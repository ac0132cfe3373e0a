"""Arithmetic as Columns: strict, where an error fails the query, and tolerant, where it makes the value NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import EngineError
from quern.plans import ast

SPARK_TYPES = {ast.INT: T.IntegerType(), ast.LONG: T.LongType(), ast.FLOAT: T.DoubleType(), ast.TEXT: T.StringType(), ast.DATE: T.DateType(), ast.NULL: T.StringType()}

# What a name stands for: (column, type).
Bind = Callable[[str], tuple[Column, str]]


def literal(value: ast.Literal) -> Column:
    return F.lit(value.value).cast(SPARK_TYPES[value.type])


def wider(left: str, right: str) -> str:
    types = (left, right)
    return ast.FLOAT if ast.FLOAT in types else ast.LONG if ast.LONG in types else ast.INT


def strict(expr: ast.Expr, bind: Bind) -> tuple[Column, str]:
    """(column, type); overflow and division by zero fail the query when a row meets them."""
    match expr:
        case ast.Name(text):
            return bind(text)
        case ast.Literal():
            return literal(expr), expr.type
        case ast.Negate(inner):
            value, type_ = strict(inner, bind)
            return (value if type_ == ast.NULL else -value), type_
        case ast.Binary(op, left, right):
            a, left_type = strict(left, bind)
            b, right_type = strict(right, bind)
            type_ = wider(left_type, right_type)
            a, b = a.cast(SPARK_TYPES[type_]), b.cast(SPARK_TYPES[type_])
            if op == "%" and type_ == ast.FLOAT:
                raise EngineError(303)
            if op == "/" and type_ != ast.FLOAT:
                return F.call_function("div", a, b).cast(SPARK_TYPES[type_]), type_
            if op == "%":  # the least integer by -1 overflows, as its quotient does
                return F.when(b == -1, -a * 0).otherwise(a % b), type_
            return {"+": a.__add__, "-": a.__sub__, "*": a.__mul__, "/": a.__truediv__}[op](b), type_
    raise EngineError(303)


def tolerant(expr: ast.Expr, bind: Bind) -> tuple[Column, Column | None, str]:
    """(column, whether it failed, type); the column is NULL where arithmetic fails.

    The second is None where nothing can fail.
    """
    match expr:
        case ast.Name(text):
            column, type_ = bind(text)
            return column, None, type_
        case ast.Literal():
            return literal(expr), None, expr.type
        case ast.Negate(inner):
            value, failed, type_ = tolerant(inner, bind)
            if type_ == ast.NULL:
                return value, failed, type_
            out = F.try_subtract(F.lit(0).cast(SPARK_TYPES[type_]), value) if type_ != ast.FLOAT else -value
            return out, _failed([failed], [value], out) if type_ != ast.FLOAT else failed, type_
        case ast.Binary(op, left, right):
            a, a_failed, left_type = tolerant(left, bind)
            b, b_failed, right_type = tolerant(right, bind)
            type_ = wider(left_type, right_type)
            spark = SPARK_TYPES[type_]
            a, b = a.cast(spark), b.cast(spark)
            if type_ == ast.FLOAT:
                none = F.lit(None).cast(spark)
                out = {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b), "%": none}[op]
                if op in "+-*":
                    return out, _either(a_failed, b_failed), type_
            elif op == "/":
                whole = F.call_function("div", a, F.nullif(b, F.lit(0).cast(spark)))
                out = F.when(b == -1, F.try_subtract(F.lit(0).cast(spark), a)).otherwise(whole.cast(spark))
            elif op == "%":
                out = F.when(b == -1, F.try_subtract(F.lit(0).cast(spark), a) * 0).otherwise(F.try_mod(a, b))
            else:
                out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
            return out, _failed([a_failed, b_failed], [a, b], out), type_
    raise EngineError(303)


def _either(*failed: Column | None) -> Column | None:
    out = None
    for one in failed:
        if one is not None:
            out = one if out is None else out | one
    return out


def _failed(inner: list[Column | None], operands: list[Column], out: Column) -> Column:
    own = out.isNull()
    for operand in operands:
        own = own & operand.isNotNull()
    return _either(*inner, own)
