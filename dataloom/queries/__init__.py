"""Every operator as a named query over the given tables, with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dataloom.queries import (
    charts, cleaning, hard_inputs, large_inputs, pairs_runs, preview_sources, profiling, validation,
    versions_catalog,
)
from dataloom.queries.tables import Tables

_MODULES = (
    preview_sources, profiling, validation, charts, cleaning, versions_catalog, pairs_runs,
    hard_inputs, large_inputs,
)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build):
        return lambda spark, sf_dir: build(Tables(spark, sf_dir))

    return {name: bound(build) for m in _MODULES for name, (build, _) in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {
        name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None
    }
