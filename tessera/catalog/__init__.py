"""Bindings of the operators to the given tables, with check SQL."""

from importlib import import_module

MODULES = ("text", "web", "chunks", "companies", "calls", "facts", "profiles")

for _module in MODULES:
    import_module(f"tessera.catalog.{_module}")

from tessera.catalog.registry import ORACLES, QUERIES  # noqa: E402

__all__ = ["ORACLES", "QUERIES"]
