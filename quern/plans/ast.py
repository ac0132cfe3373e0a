"""Syntax trees of statements, and how they are spelled back."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

# ---- types -----------------------------------------------------------------

INT, LONG, FLOAT, TEXT, DATE, NULL, OTHER = "int", "bigint", "float", "text", "date", "null", "other"


# ---- expressions -------------------------------------------------------------


@dataclass(frozen=True)
class Name:
    text: str


@dataclass(frozen=True)
class Literal:
    value: int | float | str | datetime.date | None
    type: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Negate:
    inner: Expr


@dataclass(frozen=True)
class Aggregate:
    function: str
    inner: Expr | None  # None: count(*)


Expr = Name | Literal | Binary | Negate | Aggregate


# ---- conditions --------------------------------------------------------------


@dataclass(frozen=True)
class Compare:
    op: str
    left: Expr
    right: Expr | Select


@dataclass(frozen=True)
class IsNull:
    inner: Expr
    negated: bool


@dataclass(frozen=True)
class Like:
    inner: Expr
    pattern: str
    negated: bool


@dataclass(frozen=True)
class InList:
    inner: Expr
    values: tuple[Expr, ...]
    negated: bool


@dataclass(frozen=True)
class InSelect:
    inner: Expr
    select: Select
    negated: bool


@dataclass(frozen=True)
class Exists:
    select: Select
    negated: bool


@dataclass(frozen=True)
class And:
    left: Condition
    right: Condition


@dataclass(frozen=True)
class Or:
    left: Condition
    right: Condition


@dataclass(frozen=True)
class Not:
    inner: Condition


Condition = Compare | IsNull | Like | InList | InSelect | Exists | And | Or | Not


# ---- statements --------------------------------------------------------------


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Source:
    table: str
    alias: str | None
    kind: str  # "first", "comma", "inner", "left"
    on: Condition | None = None


@dataclass(frozen=True)
class Order:
    term: Expr
    descending: bool


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]  # empty: *
    sources: tuple[Source, ...]
    distinct: bool = False
    where: Condition | None = None
    group: tuple[str, ...] = ()
    having: Condition | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    size: int = 0  # of varchar, in bytes
    primary: bool = False
    unique: bool = False
    not_null: bool = False
    has_default: bool = False
    default: Literal | None = None
    checks: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]
    check: Condition | None


@dataclass(frozen=True)
class CreateIndex:
    index: str
    table: str
    column: str


@dataclass(frozen=True)
class Drop:
    kind: str  # table, index, database
    name: str


@dataclass(frozen=True)
class CreateDatabase:
    name: str


@dataclass(frozen=True)
class Use:
    name: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, Expr], ...]
    where: Condition | None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Condition | None


@dataclass(frozen=True)
class Vacuum:
    table: str


@dataclass(frozen=True)
class Alter:
    table: str
    action: str  # add, drop, rename column, rename
    column: ColumnDef | None = None
    name: str = ""
    to: str = ""


@dataclass(frozen=True)
class Transaction:
    action: str  # begin, commit, rollback


Statement = Select | CreateTable | CreateIndex | Drop | CreateDatabase | Use | Insert | Update | Delete | Vacuum | Alter | Transaction


# ---- spelling ----------------------------------------------------------------


def number(value: float) -> str:
    """A double as results show it, with six significant digits."""
    return f"{value:g}"


def label(expr: Expr) -> str:
    """An expression spelled back without blanks, nested ones in parentheses."""
    match expr:
        case Name(text):
            return text
        case Literal(None, _):
            return "NULL"
        case Literal(value, _) if isinstance(value, float):
            return number(value)
        case Literal(value, _):
            return str(value)
        case Negate(inner):
            return "-" + _nested(inner)
        case Binary(op, left, right):
            return f"{_nested(left)}{op}{_nested(right)}"
        case Aggregate(function, inner):
            return f"{function}({'*' if inner is None else label(inner)})"
    raise TypeError(expr)


def _nested(expr: Expr) -> str:
    return f"({label(expr)})" if isinstance(expr, Binary) else label(expr)


def spell(node: Expr | Condition) -> str:
    """A CHECK's condition as text that parses to the same tree."""
    match node:
        case Literal(value, _) if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        case Literal(value, _) if isinstance(value, datetime.date):
            return f"'{value.isoformat()}'"
        case Literal(value, _) if isinstance(value, float):
            return f"{value:.17f}".rstrip("0") + "0"
        case Literal(value, _):
            return "NULL" if value is None else str(value)
        case Name(text):
            return text
        case Negate(inner):
            return f"(- {spell(inner)})"
        case Binary(op, left, right):
            return f"({spell(left)} {op} {spell(right)})"
        case Compare(op, left, right):
            return f"{spell(left)} {op} {spell(right)}"
        case IsNull(inner, negated):
            return f"{spell(inner)} is {'not ' * negated}NULL"
        case Like(inner, pattern, negated):
            return f"{spell(inner)} {'not ' * negated}like {spell(Literal(pattern, TEXT))}"
        case InList(inner, values, negated):
            return f"{spell(inner)} {'not ' * negated}in ({', '.join(map(spell, values))})"
        case And(left, right):
            return f"({spell(left)} and {spell(right)})"
        case Or(left, right):
            return f"({spell(left)} or {spell(right)})"
        case Not(inner):
            return f"(not {spell(inner)})"
    raise TypeError(node)


def renamed(node, old: str, new: str):
    """The tree with a column's name changed."""
    match node:
        case Name(text):
            return Name(new) if text.lower() == old.lower() else node
        case Negate(inner):
            return Negate(renamed(inner, old, new))
        case Binary(op, left, right):
            return Binary(op, renamed(left, old, new), renamed(right, old, new))
        case Compare(op, left, right):
            return Compare(op, renamed(left, old, new), renamed(right, old, new))
        case IsNull(inner, negated):
            return IsNull(renamed(inner, old, new), negated)
        case Like(inner, pattern, negated):
            return Like(renamed(inner, old, new), pattern, negated)
        case InList(inner, values, negated):
            return InList(renamed(inner, old, new), tuple(renamed(v, old, new) for v in values), negated)
        case And(left, right):
            return And(renamed(left, old, new), renamed(right, old, new))
        case Or(left, right):
            return Or(renamed(left, old, new), renamed(right, old, new))
        case Not(inner):
            return Not(renamed(inner, old, new))
    return node


def conjunction(conditions: list[Condition]) -> Condition | None:
    out: Condition | None = None
    for condition in conditions:
        out = condition if out is None else And(out, condition)
    return out
