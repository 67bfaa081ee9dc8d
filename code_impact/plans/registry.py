"""Named queries and the SQL each is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from code_impact.sources.fixture_sql import FIXTURES
from code_impact.sources.tables import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _views(text: str) -> list[str]:
    """Fixture views a text uses, dependencies first."""
    found: list[str] = []
    for name, body in FIXTURES.items():
        if re.search(rf"\b(?:FROM|JOIN) {name}\b", text):
            for inner in [*_views(body), name]:
                if inner not in found:
                    found.append(inner)
    return found


def with_views(body: str) -> str:
    """Put the fixture views a query uses in front of it. ``body`` is a SELECT, or ``WITH`` parts and a SELECT."""
    body = body.strip()
    parts = [f"{name} AS ({FIXTURES[name].strip()})" for name in _views(body)]
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join([*parts, body[len("WITH RECURSIVE") :].strip()])
    if body.upper().startswith("WITH"):
        return "WITH " + ",\n".join([*parts, body[len("WITH") :].strip()])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def query(name: str, oracle: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return register
