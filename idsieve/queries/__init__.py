"""Registered queries; importing the modules fills the registry."""

from importlib import import_module

from idsieve.queries.registry import ORACLE, QUERIES

MODULES = ("text", "mrz", "images", "intake", "vectors", "evidence", "cases", "jobs", "streams")

for _name in MODULES:
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLE", "QUERIES"]
