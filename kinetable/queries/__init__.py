"""Registered queries: a Spark callable over the test tables and, where SQL can state it, the same query in SQL."""

from __future__ import annotations

import importlib

MODULES = ["clouds", "clips_q", "matching", "tracks", "skinning", "trees", "meshes"]


class Registry:
    def __init__(self) -> None:
        self.spark: dict = {}
        self.sql: dict = {}

    def query(self, name: str, sql: str | None = None):
        def add(fn):
            if name in self.spark:
                raise ValueError(f"query {name} registered twice")
            self.spark[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn
        return add


REGISTRY = Registry()
query = REGISTRY.query


def load() -> Registry:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return REGISTRY
