"""Long form of a table: one row per (column, value).

Statistics over many columns become one grouped aggregate with map-side combine,
so the shuffle holds one row per column and task instead of one plan per column.
Inside, a column is its place in a list of names: grouping billions of rows by a small
number is several times faster than by a name. ``named`` puts the names back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from dataloom.functions.columns import canonical_json, epoch_micros, is_datetime, is_numeric, quoted
from dataloom.plans.shared import stored


def _stacked(df: DataFrame, columns: dict[int, Column], value: str) -> DataFrame:
    """(column, value) rows of the given columns, missing values left out."""
    cells = [x for i, c in columns.items() for x in (F.lit(i), c)]
    return df.select(F.stack(F.lit(len(columns)), *cells).alias("column", value)).filter(
        F.col(value).isNotNull()
    )


def named(df: DataFrame, names: list[str]) -> DataFrame:
    """Column places replaced by column names."""
    return df.withColumn("column", F.get(F.array(*[F.lit(n) for n in names]), F.col("column")))


def numeric_long(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value double), missing values left out."""
    if not names:
        return df.sparkSession.createDataFrame([], "column int, value double")
    columns = {i: quoted(n).cast("double") for i, n in enumerate(names)}
    return _stacked(df, columns, "value")


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "bigint"
    if is_datetime(dtype):
        # Days, or microseconds: several times cheaper than texts.
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    return "string"


def frequencies(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, value fields, h1, h2, n): how often each value of each column occurs.

    Columns are stacked by type family, so no number is turned into text. Of a text 128
    bits of hash (h1, h2) are grouped, so that profiling a corpus shuffles some bytes per
    distinct text instead of the corpus. Hot values meet in the map-side combine.
    """
    names = list(names or df.columns)
    families: dict[str, dict[int, Column]] = {}
    for i, name in enumerate(names):
        family = _family(df.schema[name].dataType)
        families.setdefault(family, {})[i] = _as_family(df, name, family)
    parts = []
    for family, members in families.items():
        long = _stacked(df, members, "value")
        nothing = F.lit(None)
        if family == "string":
            long = _digested(long)
        else:
            long = long.withColumns({
                "h1": nothing.cast("bigint"), "h2": nothing.cast("bigint")
            })
        counted = long.groupBy("column", "value", "h1", "h2").agg(F.count("*").alias("n"))
        parts.append(counted.select(
            "column",
            *[
                (F.col("value") if f == family else nothing).cast(f).alias(f"{f}_value")
                for f in ("bigint", "double")
            ],
            "h1", "h2", "n",
        ))
    return reduce(DataFrame.unionAll, parts)


def text_key(text: Column) -> list[Column]:
    """128 bits of hash that stand for a text in two columns."""
    return [F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)]


def _digested(long: DataFrame) -> DataFrame:
    h1, h2 = text_key(F.col("value"))
    return long.select("column", F.lit(None).cast("string").alias("value"), h1.alias("h1"), h2.alias("h2"))


def first_texts(df: DataFrame, names: list[str], order_by: list[str], k: int) -> DataFrame:
    """(column, text): the first k texts of each column in the given order, in one pass; a
    rank limit keeps k rows per column and task before the shuffle."""
    keys = [F.col(f"k{i}") for i in range(len(order_by))]
    cells = [x for i, n in enumerate(names) for x in (F.lit(i), quoted(n))]
    long = df.select(
        *[quoted(k).alias(f"k{i}") for i, k in enumerate(order_by)], F.stack(F.lit(len(names)), *cells).alias("column", "text")
    ).filter("text is not null")
    first = Window.partitionBy("column").orderBy(*keys)
    return long.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("column", "text")


def _as_family(df: DataFrame, name: str, family: str):
    dtype = df.schema[name].dataType
    if family == "string" and isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return canonical_json(quoted(name), dtype)
    if family == "bigint" and isinstance(dtype, T.DateType):
        return F.unix_date(quoted(name)).cast("bigint")
    if family == "bigint" and isinstance(dtype, T.TimestampType):
        return F.unix_micros(quoted(name))
    if family == "bigint" and isinstance(dtype, T.TimestampNTZType):
        return epoch_micros(quoted(name))
    return quoted(name).cast(family)


def spread(one_row: DataFrame, groups: dict[str, dict[str, str]], key: str = "column") -> DataFrame:
    """Turn a one-row wide aggregate into one row per group.

    ``groups`` maps a key value to {output field: column of the wide row}.
    """
    fields = list(next(iter(groups.values())))
    rows = [
        F.struct(F.lit(g).alias(key), *[quoted(cols[f]).alias(f) for f in fields])
        for g, cols in groups.items()
    ]
    return one_row.select(F.inline(F.array(*rows)))


def numeric_of(df: DataFrame, names: list[str] | None, booleans: bool = False) -> list[str]:
    """The given names, or all numeric ones of the table."""
    chosen = [f.name for f in df.schema if is_numeric(f.dataType, booleans)]
    if names is None:
        return chosen
    wrong = [n for n in names if n not in chosen]
    if wrong:
        raise ValueError(f"not numeric: {', '.join(wrong)}")
    return list(names)
