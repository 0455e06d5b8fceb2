"""Registry of the queries of one plan module."""

from __future__ import annotations

from collections.abc import Callable


class Plan:
    """Queries by name, and the SQL that checks them where there is any."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        """Register a function as the query of its own name."""

        def register(function: Callable) -> Callable:
            self.queries[function.__name__] = function
            if sql is not None:
                self.oracle[function.__name__] = sql
            return function

        return register
