"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from civicspark.plans.tables import FIXTURES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_fixtures(sql: str) -> str:
    """Prepend the fixture views a statement names, as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in FIXTURES:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(FIXTURES[name])
                needed.append(name)

    visit(sql)
    body = sql.strip()
    recursive = re.match(r"WITH\s+RECURSIVE\s+", body, re.IGNORECASE)
    plain = re.match(r"WITH\s+", body, re.IGNORECASE)
    head = [f"{name} AS ({FIXTURES[name].strip()})" for name in needed]
    if recursive or plain:
        body = body[(recursive or plain).end():]
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*head, body])
    return ("WITH " + ",\n".join(head) + "\n" + body) if head else body


def query(name: str, sql: str | None = None):
    """Register a ``Tables -> DataFrame`` function, with the SQL it must equal."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return build

    return register
