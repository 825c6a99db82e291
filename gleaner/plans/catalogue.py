"""All core queries by name, gathered from the modules that define them."""

from __future__ import annotations

from gleaner.plans import registry


def queries() -> dict:
    return dict(registry.load().queries)


def oracle_sql() -> dict[str, str]:
    return dict(registry.load().sql)
