"""Attach a one-row aggregate to every row without a join.

The row arrives as an uncorrelated scalar subquery: Spark runs it once, ships a
single struct, and a filter on it still reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dataloom.functions.columns import quoted


def as_struct(one_row: DataFrame) -> Column:
    fields = [quoted(c) for c in one_row.columns]
    return one_row.select(F.struct(*fields).alias("row")).scalar()


def with_row(df: DataFrame, one_row: DataFrame, name: str = "_stats") -> DataFrame:
    return df.withColumn(name, as_struct(one_row))
