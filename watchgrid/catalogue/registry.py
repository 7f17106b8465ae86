"""Registry of runnable queries and, where SQL can say it, their oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.catalogue.prelude import PRELUDE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_prelude(body: str) -> str:
    """Prefix the shared tables that a query mentions, directly or through others."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, sql in PRELUDE.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(sql)

    visit(body)
    parts = [f"{n} AS ({PRELUDE[n]})" for n in PRELUDE if n in needed]
    body = body.strip()
    if not parts:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register a query under its operator name, with its DuckDB counterpart."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_prelude(sql)
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and widen integers so that both engines print alike."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = F.round(c, digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind == "boolean":
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)
