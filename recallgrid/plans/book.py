"""Collects queries and their SQL."""

from __future__ import annotations


class Book:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return keep
