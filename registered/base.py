"""How a query and its SQL are registered."""

from __future__ import annotations

from collections.abc import Callable


def registrar() -> tuple[dict, Callable]:
    """An empty register of ``name: (query, SQL or None)`` and the decorator that fills it."""
    held: dict = {}

    def register(name: str, sql: str | None) -> Callable:
        def keep(query: Callable) -> Callable:
            held[name] = (query, sql)
            return query

        return keep

    return held, register
