"""Registry of queries: a Spark plan over the catalogue, and a DuckDB twin where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallyshop.sources.retail_views import VIEWS
from tallyshop.sources.tables import Catalog


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Catalog], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}

# SQL of marts that several oracles share; they may use views and earlier marts.
ORACLE_MARTS: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of the catalogue as query ``name``."""

    def register(build: Callable[[Catalog], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, oracle)
        return build

    return register


def r6(sql: str) -> str:
    """Oracle text of a double rounded to six decimals."""
    return f"round(cast({sql} AS double), 6)"


def money(sql: str) -> str:
    """Oracle text of an exact decimal rounded to two decimals, shown as double."""
    return f"cast(round({sql}, 2) AS double)"


def big(sql: str) -> str:
    """Oracle text of an integer sum (DuckDB sums to 128 bits)."""
    return f"cast({sql} AS bigint)"


def _definitions() -> dict[str, str]:
    views = {name: re.sub(r"\{(\w+)\}", r"\1", sql) for name, sql in VIEWS.items()}
    return {**views, **ORACLE_MARTS}


def oracle_text(query: Query) -> str | None:
    """Full DuckDB statement: the views and marts the query names, then the query."""
    if query.oracle is None:
        return None
    definitions = _definitions()

    def used(sql: str) -> list[str]:
        return [n for n in re.findall(r"\b[rm]_\w+\b", sql) if n in definitions]

    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for dependency in used(definitions[name]):
            if dependency != name:
                visit(dependency)
        needed.append(name)

    for name in used(query.oracle):
        visit(name)
    body = query.oracle.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{name} AS ({definitions[name].strip()})" for name in needed)
    if re.match(r"(?i)with\s", body):
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"

