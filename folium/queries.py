"""Registered queries of the library's own operators, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folium.catalog import documents, layout, packages, structure, trees, values

ALL = [*documents.CATALOG, *layout.CATALOG, *packages.CATALOG, *structure.CATALOG, *trees.CATALOG, *values.CATALOG]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, query, _ in ALL}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in ALL if sql}
