"""Registered queries over the test tables, each next to the SQL that must give the same rows."""

from importlib import import_module

from .registry import ORACLES, QUERIES

for _name in ("datasets", "scoring", "text", "models", "explanations", "search", "runs", "files"):
    try:
        import_module(f"{__name__}.{_name}")
    except ModuleNotFoundError as e:
        if e.name != f"{__name__}.{_name}":
            raise

__all__ = ["ORACLES", "QUERIES"]
