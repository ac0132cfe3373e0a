"""The relational operators as a fluent API over the same trees that SQL text parses to."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from quern.plans import ast
from quern.plans.parser import Parser
from quern.session import Session


def _condition(text: str) -> ast.Condition:
    parser = Parser(text)
    return parser.condition(labels=True)


def _items(texts: tuple[str, ...]) -> tuple[ast.Item, ...]:
    return tuple(Parser(f"select {t} from t").statement().items[0] for t in texts)


@dataclass(frozen=True)
class Query:
    """`Query(session, "orders").where("o_totalprice > 10.0").group_by("o_custkey").agg("count(*) n")`."""

    session: Session
    table: str
    alias: str | None = None
    tree: ast.Select | None = None

    @property
    def _tree(self) -> ast.Select:
        return self.tree or ast.Select((), (ast.Source(self.table, self.alias, "first"),))

    def _with(self, **changes) -> Query:
        return replace(self, tree=replace(self._tree, **changes))

    def join(self, table: str, on: str, alias: str | None = None, how: str = "inner") -> Query:
        return self._with(sources=(*self._tree.sources, ast.Source(table, alias, how, _condition(on))))

    def cross(self, table: str, alias: str | None = None) -> Query:
        return self._with(sources=(*self._tree.sources, ast.Source(table, alias, "comma")))

    def where(self, condition: str) -> Query:
        both = [c for c in (self._tree.where, _condition(condition)) if c is not None]
        return self._with(where=ast.conjunction(both))

    def select(self, *items: str) -> Query:
        return self._with(items=_items(items))

    agg = select

    def group_by(self, *names: str) -> Query:
        return self._with(group=names)

    def having(self, condition: str) -> Query:
        return self._with(having=_condition(condition))

    def distinct(self) -> Query:
        return self._with(distinct=True)

    def order_by(self, *terms: str) -> Query:
        orders = tuple(Parser(f"select * from t order by {t}").statement().order[0] for t in terms)
        return self._with(order=orders)

    def limit(self, n: int) -> Query:
        return self._with(limit=n)

    def frame(self) -> DataFrame:
        return self.session.select(self._tree).frame
