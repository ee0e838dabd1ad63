"""First look at a table: rows, schema, projections.

Spark tables have no row order, so operators that mean "first" or "last" take a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from dataloom.functions.columns import quoted, row_hash


def head(df: DataFrame, key: list[str], n: int = 10) -> DataFrame:
    return df.orderBy(*[quoted(k).asc() for k in key]).limit(n)


def tail(df: DataFrame, key: list[str], n: int = 10) -> DataFrame:
    return df.orderBy(*[quoted(k).desc() for k in key]).limit(n)


def sample(df: DataFrame, key: list[str], n: int = 10, seed: int = 0) -> DataFrame:
    """Exactly min(n, rows) rows, the same ones for the same seed."""
    by_hash = row_hash(df, key, seed)
    return df.orderBy(by_hash, *[quoted(k) for k in key]).limit(n)


def schema_table(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def raw_records(df: DataFrame, key: list[str], n: int = 5, fmt: str = "csv") -> DataFrame:
    """First n rows as CSV lines or JSON objects, one text per row."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown record format {fmt!r}; csv or json")
    fields = F.struct(*[quoted(c) for c in df.columns])
    text = F.to_csv(fields) if fmt == "csv" else F.to_json(fields)
    keys = [quoted(k) for k in key]
    return df.orderBy(*keys).limit(n).select(
        F.row_number().over(Window.orderBy(*keys)).alias("line"), text.alias("record")
    )


def sort_by(df: DataFrame, x: str) -> DataFrame:
    """Rows by x, and by the other columns where x is equal: a value that most rows share
    is then spread over several sort partitions."""
    others = [
        f.name for f in df.schema if f.name != x and not isinstance(f.dataType, T.MapType)
    ]
    return df.orderBy(quoted(x), *[quoted(o) for o in others])


def xy(df: DataFrame, x: str, y: str, z: str | None = None, color: str | None = None) -> DataFrame:
    """Points of a scatter chart: x, y and, when asked for, z and color."""
    given = {"x": x, "y": y, "z": z, "color": color}
    return df.select(*[quoted(c).alias(n) for n, c in given.items() if c is not None])


def scatter_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    if not 3 <= len(columns) <= 5:
        raise ValueError("a scatter matrix takes 3 to 5 columns")
    return df.select(*[quoted(c) for c in columns])
