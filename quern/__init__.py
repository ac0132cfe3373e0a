"""A SQL engine for a small, strictly typed dialect, planned as Spark DataFrames."""

import importlib

_HOMES = {"Engine": "quern.session", "Session": "quern.session", "Result": "quern.session", "EngineError": "quern.errors"}
__all__ = list(_HOMES)


def __getattr__(name: str):
    if name in _HOMES:  # loaded when asked for: workers of the corpus operators don't need them
        return getattr(importlib.import_module(_HOMES[name]), name)
    raise AttributeError(name)
