"""Registered queries: a Spark plan over the given tables, and where SQL can say it, the same in plain SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spoor.catalog import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)``; views named in ``sql`` are put in front of it as common table expressions."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(views.Tables(spark, sf_dir))

        run.__doc__ = fn.__doc__
        run.__module_tag__ = fn.__module__.rsplit(".", 1)[-1]
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in views.SQL:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(views.SQL[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({views.SQL[n].strip()})" for n in needed)
    body = sql.strip()
    if re.match(r"(?i)with recursive\b", body):
        return f"WITH RECURSIVE {ctes},\n{body[len('with recursive'):].strip()}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"
