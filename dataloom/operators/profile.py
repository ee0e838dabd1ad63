"""Column profiles: missing, distinct, numeric statistics, frequent values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from dataloom.functions.columns import (
    canonicalise, datetime_columns, missing, numeric_columns, quoted, row_hash, text_columns,
)
from dataloom.plans.heavy import top_texts
from dataloom.plans.long_form import frequencies, named, numeric_long, numeric_of, spread
from dataloom.plans.one_row import as_struct
from dataloom.plans.quantiles import ACCURACY, column_quantiles
from dataloom.plans.shared import stored

# Thresholds of the text and category detection.
LONG_TEXT = 100
TEXT_SHARE = 0.5
CATEGORY_SHARE = 0.1

MIB = 1024 * 1024


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column, missing, missing_pct): one wide aggregate, no shuffle of rows."""
    return _missing_and_rows(df).drop("rows")


def _missing_and_rows(df: DataFrame) -> DataFrame:
    df = canonicalise(df)
    total = df.agg(
        F.count("*").alias("rows"),
        *[F.coalesce(F.sum(missing(c)), F.lit(0)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    groups = {c: {"missing": f"m{i}", "rows": "rows"} for i, c in enumerate(df.columns)}
    return spread(total, groups).select(
        "column", "missing", (F.try_divide("missing", "rows") * 100).alias("missing_pct"), "rows"
    )


def missing_only(df: DataFrame) -> DataFrame:
    return missing_by_column(df).filter("missing > 0")


def missing_cells(df: DataFrame) -> DataFrame:
    df = canonicalise(df)
    cells = reduce(Column.__add__, [missing(c) for c in df.columns])
    return df.agg(F.coalesce(F.sum(cells), F.lit(0)).alias("missing_cells"))


def _copies(df: DataFrame, **sums: Column) -> DataFrame:
    """(copies) per distinct row, grouped on a 128-bit digest instead of the row itself.

    The shuffle then carries some bytes per distinct row and task, also for tables of
    long texts; equal rows meet in the map-side combine. ``sums`` are numbers of a row
    that are added up in the same pass.
    """
    df = canonicalise(df)
    digest = [row_hash(df, seed=1).alias("h1"), row_hash(df, seed=2).alias("h2")]
    rows = df.select(*digest, *[c.alias(n) for n, c in sums.items()])
    return rows.groupBy("h1", "h2").agg(F.count("*").alias("copies"), *[F.sum(n).alias(n) for n in sums])


def row_totals(df: DataFrame, **sums: Column) -> DataFrame:
    """One row from one pass: rows, duplicate_rows, and the sums of the given numbers."""
    zero = F.lit(0)
    return _copies(df, **sums).agg(
        F.coalesce(F.sum("copies"), zero).alias("rows"), F.coalesce(F.sum(F.col("copies") - 1), zero).alias("duplicate_rows"),
        *[F.coalesce(F.sum(n), zero).alias(n) for n in sums],
    )


def cells_missing(df: DataFrame) -> Column:
    """Missing cells of a row."""
    return reduce(Column.__add__, [missing(c) for c in df.columns])


def duplicate_count(df: DataFrame) -> DataFrame:
    return _copies(df).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows")
    )


def _width(dtype: T.DataType) -> int | None:
    """Bytes of a value of a fixed-width type; None where the length varies."""
    fixed = {
        T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
        T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8,
        T.TimestampNTZType: 8, T.DecimalType: 16,
    }
    return fixed.get(type(dtype))


def _variable_bytes(field: T.StructField) -> Column:
    value, dtype = quoted(field.name), field.dataType
    if isinstance(dtype, T.ArrayType) and _width(dtype.elementType):
        return F.array_size(value) * _width(dtype.elementType)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        value = F.to_json(value)
    return F.octet_length(value)


def _bytes(df: DataFrame) -> Column:
    widths = [_width(f.dataType) for f in df.schema]
    size = F.lit(sum(w for w in widths if w)).cast("long")
    for field, width in zip(df.schema, widths):
        if width is None:
            size = size + F.coalesce(_variable_bytes(field), F.lit(0))
    return size


def estimated_mb(df: DataFrame, rows: bool = False) -> DataFrame:
    """Logical size: fixed widths plus the bytes of every text, in MiB; with ``rows`` their
    number, too."""
    counted = [F.count("*").alias("rows")] if rows else []
    return df.agg((F.coalesce(F.sum(_bytes(df)), F.lit(0)) / MIB).alias("estimated_mb"), *counted)


def type_histogram(df: DataFrame) -> DataFrame:
    rows = [(f.dataType.simpleString(),) for f in df.schema]
    types = df.sparkSession.createDataFrame(rows, "type string")
    return types.groupBy("type").agg(F.count("*").alias("columns"))


def distinct_by_column(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, unique_values), missing values not counted."""
    df = canonicalise(df)
    if approximate:
        one = df.agg(*[
            F.approx_count_distinct(quoted(c)).alias(f"d{i}") for i, c in enumerate(df.columns)
        ])
        return spread(one, {c: {"unique_values": f"d{i}"} for i, c in enumerate(df.columns)})
    return _distinct(frequencies(df), df.columns)


def _distinct(counted: DataFrame, names: list[str]) -> DataFrame:
    counts = counted.groupBy("column").agg(F.count("*").alias("unique_values"))
    return _every_column(names, counts, {"unique_values": F.lit(0).cast("long")})


def _every_column(names: list[str], table: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """One row per name from a table by column place, also for columns without values."""
    every = table.sparkSession.createDataFrame(
        [(i, n) for i, n in enumerate(names)], "column int, name string"
    )
    # One row per column of the schema on both sides.
    joined = every.join(F.broadcast(table), "column", "left")
    return joined.select(
        F.col("name").alias("column"), *[F.coalesce(F.col(n), d).alias(n) for n, d in defaults.items()]
    )


def _moments() -> dict[str, Column]:
    return {
        "count": F.count("*"), "mean": F.avg("_v"), "std": F.stddev_samp("_v"),
        "min": F.min("_v"), "max": F.max("_v"),
    }


def numeric_profile(
    df: DataFrame, columns: list[str] | None = None, accuracy: int = ACCURACY
) -> DataFrame:
    """(column, min, max, mean, median, std) of numeric and boolean columns."""
    df = canonicalise(df)
    names = numeric_of(df, columns, booleans=True)
    long = numeric_long(_booleans_as_int(df, names), names)
    table = column_quantiles(long, {"median": 0.5}, accuracy, _moments())
    empty = {n: F.lit(None).cast("double") for n in ("min", "max", "mean", "median", "std")}
    return _every_column(names, table, empty)


def _booleans_as_int(df: DataFrame, names: list[str]) -> DataFrame:
    flags = [n for n in names if isinstance(df.schema[n].dataType, T.BooleanType)]
    return df.withColumns({n: quoted(n).cast("int") for n in flags}) if flags else df


def describe(
    df: DataFrame, columns: list[str] | None = None, accuracy: int = ACCURACY
) -> DataFrame:
    """The eight usual statistics, one row per numeric column."""
    df = canonicalise(df)
    names = numeric_of(df, columns)
    long = numeric_long(df, names)
    table = column_quantiles(long, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, accuracy, _moments())
    empty: dict[str, Column] = {"count": F.lit(0).cast("long")}
    empty |= {
        n: F.lit(None).cast("double") for n in ("mean", "std", "min", "q25", "q50", "q75", "max")
    }
    return _every_column(names, table, empty)


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """(value, n) by falling count, ties by value; the first k or all."""
    counted = (
        canonicalise(df.select(quoted(column).alias("value")))
        .filter("value is not null")
        .groupBy("value")
        .agg(F.count("*").alias("n"))
    )
    ordered = counted.orderBy(F.desc("n"), F.asc("value"))
    return ordered.limit(k) if k else ordered


def likely_categorical(df: DataFrame) -> DataFrame:
    """Text columns, their distinct share of the rows, and whether it is below a tenth."""
    texts = df.select(*[quoted(c) for c in text_columns(df)])
    rows = as_struct(df.agg(F.count("*").alias("rows"))).getField("rows")
    share = F.try_divide("unique_values", "rows")
    return (
        distinct_by_column(texts)
        .withColumn("rows", rows)
        .select(
            "column", "unique_values", share.alias("distinct_share"),
            F.coalesce(share < CATEGORY_SHARE, F.lit(False)).alias("likely_categorical"),
        )
    )


def top_values(
    df: DataFrame, columns: list[str] | None = None, k: int = 5, counted: DataFrame | None = None
) -> DataFrame:
    """(column, value, n, rank): the k most frequent values of each text column; of
    equally frequent ones the smallest. ``counted``, if there is one, holds the stored
    ``frequencies`` of all columns of the table."""
    names = columns or text_columns(df)
    if counted is not None:
        place = F.array_position(F.array(*[F.lit(df.columns.index(n)) for n in names]), F.col("column"))
        counted = counted.select((place.cast("int") - 1).alias("column"), "h1", "h2", "n").filter("column >= 0")
    top = named(top_texts(df, names, k, counted), names)
    return top.select("column", F.col("string_value").alias("value"), "n", "rank")


def column_info(df: DataFrame, accuracy: int = ACCURACY) -> DataFrame:
    """One row per column: type, missing, distinct, numeric statistics, frequent values."""
    df = canonicalise(df)
    types = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)],
        "position int, column string, type string",
    )
    report = types.join(F.broadcast(_missing_and_rows(df)), "column")
    # One table of frequencies gives the distinct counts and the frequent values.
    counted = stored(frequencies(df).select("column", "h1", "h2", "n"), "frequencies")
    report = report.join(F.broadcast(_distinct(counted, df.columns)), "column")
    numeric = numeric_columns(df, booleans=True)
    texts = text_columns(df)
    if numeric:
        report = report.join(
            F.broadcast(numeric_profile(df, numeric, accuracy)), "column", "left"
        )
    else:
        report = report.withColumns({
            n: F.lit(None).cast("double") for n in ("min", "max", "mean", "median", "std")
        })
    if texts:
        # At most five entries per column.
        pairs = F.array_sort(F.collect_list(F.struct("rank", "value", "n")))
        tops = top_values(df, texts, counted=counted).groupBy("column").agg(
            F.concat_ws(", ", F.transform(
                pairs, lambda p: F.concat(p["value"], F.lit(": "), p["n"].cast("string"))
            )).alias("top_values")
        )
        report = report.join(F.broadcast(tops), "column", "left")
    else:
        report = report.withColumn("top_values", F.lit(None).cast("string"))
    share = F.try_divide("unique_values", "rows")
    return report.withColumn(
        "likely_categorical",
        F.when(F.col("type") == "string", F.coalesce(share < CATEGORY_SHARE, F.lit(False))),
    ).drop("rows")


def dataset_info(df: DataFrame) -> DataFrame:
    """One summary row: shape, missing cells, duplicates, size."""
    df = canonicalise(df)
    return row_totals(df, missing_cells=cells_missing(df), bytes=_bytes(df)).select(
        "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "missing_cells",
        (F.col("bytes") / MIB).alias("estimated_mb"), "duplicate_rows",
    )


def detect_format(df: DataFrame) -> DataFrame:
    """One row, one word: text, time_series, mixed, numeric, categorical or generic."""
    texts = text_columns(df)
    if datetime_columns(df):
        tabular = "time_series"
    elif numeric_columns(df):
        tabular = "mixed" if texts else "numeric"
    else:
        tabular = "categorical" if texts else "generic"
    lengths = [F.avg(F.length(quoted(c))) for c in texts]
    long_texts = reduce(
        Column.__add__,
        [F.coalesce((m > LONG_TEXT).cast("int"), F.lit(0)) for m in lengths],
        F.lit(0),
    )
    mostly_text = long_texts / max(len(df.columns), 1) > TEXT_SHARE
    return df.agg(F.when(mostly_text, "text").otherwise(tabular).alias("format"))


def pair_stats(df: DataFrame) -> DataFrame:
    """Number of examples and mean input length (one decimal, half to even)."""
    return df.agg(
        F.count("*").alias("examples"),
        F.bround(F.avg(F.length("input")), 1).alias("mean_input_length"),
        (F.count("*") < 5).alias("small_dataset"),
    )

