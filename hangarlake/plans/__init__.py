"""Queries over the tables, each with the operators it exercises in its docstring, and their SQL."""

from __future__ import annotations

from importlib import import_module

from hangarlake.plans.registry import QUERIES, SQL

MODULES = ("texts", "insights", "graph", "groups", "ranking", "cases", "systems", "annotation", "advice")


def _load() -> None:
    for name in MODULES:
        import_module(f"hangarlake.plans.{name}")


def queries() -> dict:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return SQL
