"""Named queries and the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from visiontables.plans import fixture_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; fx_* views named in ``oracle`` become CTEs."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return add


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it uses, directly or through other views."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in re.findall(r"\bfx_[a-z_]+\b", text):
            if view in fixture_sql.VIEWS and view not in needed:
                visit(fixture_sql.VIEWS[view])
                if view not in needed:
                    needed.append(view)

    visit(sql)
    ctes = [f"{v} AS ({fixture_sql.VIEWS[v]})" for v in needed]
    body = sql.strip()
    recursive = bool(re.match(r"(?is)with\s+recursive\b", body))
    if body[:4].lower() == "with":
        body = re.sub(r"(?is)^with\s+(recursive\s+)?", "", body)
        parts = ", ".join(ctes + [""]) if ctes else ""
        return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{body}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
