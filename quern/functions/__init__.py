"""Expressions and conditions as Columns, and on single rows."""
