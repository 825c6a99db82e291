"""A registry of named queries and the SQL that states the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ["problems", "programs", "texts", "graphs", "scores", "samples", "pipelines", "prose", "hybrid", "readers"]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        """Decorator: register a ``(spark, sf_dir) -> DataFrame`` under ``name``."""

        def add(f: Callable) -> Callable:
            if name in self.queries:
                raise ValueError(f"two queries named {name}")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add


query = Registry()


def load() -> Registry:
    for module in MODULES:
        importlib.import_module(f"gleaner.plans.{module}")
    return query
