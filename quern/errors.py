"""Error codes and their texts."""

from __future__ import annotations

# The codes and texts that users of the dialect see.
TEXTS: dict[int, str] = {
    100: "unknown token",
    101: "unterminated string literal",
    103: "integer literal out of range",
    200: "not a valid statement",
    201: "expected FROM",
    202: "expected a table name",
    203: "expected a column name",
    204: "expected a column type",
    205: "unbalanced parentheses",
    206: "unexpected tokens after statement",
    208: "expected VALUES",
    209: "expected a number or a quoted string",
    210: "expected a comparison operator",
    211: "expected BY after GROUP or ORDER",
    212: "unknown function",
    213: "expected NULL after IS",
    214: "expected ON",
    215: "expected SET",
    216: "expected = in a SET assignment",
    219: "expected KEY after PRIMARY",
    220: "expected a positive length in varchar(n)",
    222: "expected the keyword table",
    223: "expected the keyword to",
    300: "no such table",
    301: "table already exists",
    302: "no such column",
    303: "type mismatch",
    304: "wrong number of values",
    305: "duplicate column name",
    306: "column must appear in GROUP BY or an aggregate",
    307: "index already exists",
    308: "no such index",
    309: "HAVING requires GROUP BY or an aggregate",
    310: "database already exists",
    311: "no such database",
    312: "the default database cannot be dropped",
    313: "column name matches more than one table",
    314: "the same table is listed twice in FROM",
    316: "a column with no value and no default",
    317: "not a date: expected 'YYYY-MM-DD'",
    318: "cannot drop the only column of a table",
    319: "unique, primary key and check are not supported on a new column",
    320: "cannot drop a column from a table with a check constraint",
    321: "a subquery may not refer to a column of the outer query",
    322: "a subquery used here must return exactly one column",
    400: "table is full",
    408: "a transaction is already open",
    409: "no transaction is open",
    410: "nothing to roll back to: this session has no database file",
    411: "NULL in a NOT NULL column",
    412: "duplicate value in a unique column",
    413: "row fails the table's CHECK",
    414: "text is longer than the column allows",
    415: "division by zero",
    417: "a subquery compared with an operator must return one row",
    501: "error",
    600: "cannot open the database file",
    601: "not a database file, or it is truncated",
    602: "database file version not supported",
    603: "failed writing the database file",
    604: "a page failed its checksum: the database file is damaged",
    605: "the client went quiet",
}


class EngineError(Exception):
    """A refused statement; `code` says why."""

    def __init__(self, code: int, detail: str = ""):
        self.code, self.detail = code, detail
        super().__init__(f"error {code}: {TEXTS.get(code, 'error')}" + (f" ({detail})" if detail else ""))

    @property
    def line(self) -> str:
        """As a script's output shows it."""
        return f"error {self.code}: {TEXTS.get(self.code, 'error')}"


# What Spark says when a row meets an error that the dialect has a code for.
_RUNTIME = (
    ("SCALAR_SUBQUERY_TOO_MANY_ROWS", 417),
    ("DIVIDE_BY_ZERO", 415),
    ("REMAINDER_BY_ZERO", 415),
    ("ARITHMETIC_OVERFLOW", 103),
    ("CAST_OVERFLOW", 103),
    ("BINARY_ARITHMETIC_OVERFLOW", 103),
    ("VALUE_OUT_OF_RANGE", 103),
    ("FAILED_READ_FILE", 604),
)


def from_spark(error: Exception) -> EngineError | None:
    """The engine's error for one that Spark raised while rows were read, if there is one."""
    text = str(error)
    for name, code in _RUNTIME:
        if name in text:
            return EngineError(code)
    return None
