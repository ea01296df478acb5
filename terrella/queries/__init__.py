"""Registered queries of the spatial operators, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrella.queries import formats, matching, selections, shapes, tables, tools

_PARTS = (selections, matching, shapes, formats, tools)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q for part in _PARTS for n, (q, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: tables.WITH + sql for part in _PARTS for n, (_, sql) in part.QUERIES.items() if sql}
