"""Named queries with their equivalent SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firmlens.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[list[str], str]] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")


        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = bigint_counts(sql)
        return fn

    return register


def cte(name: str, uses: str, sql: str) -> None:
    CTES[name] = (uses.split(), sql)


def sql_with(uses: str, body: str) -> str:
    """Prefix ``body`` with the common table expressions it needs, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for dep in CTES[name][0]:
            add(dep)
        ordered.append(name)

    for name in uses.split():
        add(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        parts.append(body[5:])
        return "WITH " + ",\n".join(parts)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def bigint_counts(sql: str) -> str:
    """Spell ``count_if(cond)`` as a plain count, which is BIGINT in every engine."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        cond = sql[at + len("count_if("):end - 1]
        sql = f"{sql[:at]}count(CASE WHEN {cond} THEN 1 END){sql[end:]}"
    return sql


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of ``rnd``."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
