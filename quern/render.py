"""Results as text."""

from __future__ import annotations

import datetime
from typing import Any

from quern.plans.ast import number


def cell(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return number(value)
    if isinstance(value, datetime.date):
        return value.isoformat()
    return str(value)


def grid(headers: list[str], rows: list[tuple]) -> str:
    """A header line, a line for each row, and the number of rows."""
    lines = [" | ".join(headers), *(" | ".join(map(cell, row)) for row in rows)]
    return "\n".join([*lines, f"({len(rows)} row{'' if len(rows) == 1 else 's'})"])
