"""Operators for building training corpora from tables of documents.

Nothing else in the library imports this subpackage.  Each operator lives in
one module with a general interface; `queries` holds the thin `opN_<name>`
queries and their SQL.
"""
