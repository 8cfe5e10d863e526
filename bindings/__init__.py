"""Operators bound to the given tables, each with an equivalent SQL text where one exists."""

from importlib import import_module

from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

for _m in ("manifest", "geometry", "spatial", "expression", "masks", "texture", "sampling", "scoring", "models", "files"):
    import_module(f"{__name__}.{_m}")
