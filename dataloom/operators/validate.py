"""Data quality, type suggestions and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dataloom.functions.columns import canonicalise, quoted, text_columns
from dataloom.functions.parsing import looks_numeric, parse_datetime
from dataloom.operators.profile import cells_missing, missing_by_column, row_totals
from dataloom.plans.long_form import first_texts, named, numeric_long, spread
from dataloom.plans.one_row import with_row
from dataloom.plans.quantiles import ACCURACY, column_quantiles

# Limits and words of the quality report.
GOOD_BELOW, WARNING_BELOW = 5, 20
PARSE_SHARE = 0.8
ADVICE = "Consider imputing or removing this column"


def quality_metrics(df: DataFrame) -> DataFrame:
    df = canonicalise(df)
    base = row_totals(df, missing=cells_missing(df))

    def percent(part: str, whole: Column) -> Column:
        return F.coalesce(F.try_divide(F.col(part), whole) * 100, F.lit(0.0))

    total = F.col("rows") * len(df.columns)
    lost = F.col("missing_pct") + F.col("duplicate_pct")
    return (
        base.withColumn("cells", total)
        .withColumn("missing_pct", percent("missing", F.col("cells")))
        .withColumn("duplicate_pct", percent("duplicate_rows", F.col("rows")))
        .select(
            "rows", "cells", F.col("missing").alias("missing_cells"), "missing_pct",
            (100 - F.col("missing_pct")).alias("completeness"),
            "duplicate_rows", "duplicate_pct",
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - lost)).alias("quality_score"),
        )
    )


def missing_status(df: DataFrame) -> DataFrame:
    """Columns with missing values: count, percent (2 decimals, half to even), status."""
    percent = F.bround("missing_pct", 2)
    return missing_by_column(df).filter("missing > 0").select(
        "column", "missing", percent.alias("percentage"),
        F.when(percent < GOOD_BELOW, "Good")
        .when(percent < WARNING_BELOW, "Warning")
        .otherwise("Critical").alias("status"),
    )


def completeness_check(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    gap = F.col("missing_pct") / 100
    return missing_by_column(df).filter(1 - gap < threshold).select(
        "column",
        F.format_string("%.2f%%", (1 - gap) * 100).alias("completeness"),
        F.format_string("%.2f%%", gap * 100).alias("missing"),
        F.lit(ADVICE).alias("recommendation"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """The second and later copies of every repeated row.

    Copies are equal in all columns, so a row seen n times is written n - 1 times from
    its count: the copies meet in the map-side combine and never in one task.
    """
    df = canonicalise(df)
    counted = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("_copies"))
    return _repeat(counted.filter("_copies > 1"), F.col("_copies") - 1, df.columns)


_CHUNK = 10_000


def _repeat(df: DataFrame, times: Column, columns: list[str]) -> DataFrame:
    """Each row ``times`` times; a very frequent row is first cut into chunks that are
    spread over the tasks."""
    fields = [quoted(c) for c in columns]
    chunks = (
        df.withColumn("_times", times)
        .withColumn("_chunk", F.explode(
            F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / _CHUNK))
        ))
        .withColumn("_size", F.least(
            F.lit(_CHUNK).cast("long"), F.col("_times") - F.col("_chunk") * _CHUNK
        ))
        # A fixed key, not round robin: a lost task is redone with the same rows.
        .repartition(*fields, "_chunk")
    )
    return chunks.select(*fields, F.explode(F.sequence(F.lit(1), F.col("_size").cast("int")))).drop(
        "col"
    )


def type_suggestions(
    df: DataFrame, sample_rows: int | None = None, order_by: list[str] | None = None
) -> DataFrame:
    """Text columns of which more than 80 % of the values read as number or as date.

    All rows count by default; ``sample_rows`` with ``order_by`` looks at the first
    non-missing values of each column only.
    """
    names = text_columns(df)
    if sample_rows is not None:
        if not order_by:
            raise ValueError("sample_rows needs order_by")
        values, numbers, dates = _parse_counts("text", 0)
        counts = named(first_texts(df, names, order_by, sample_rows).groupBy("column").agg(
            values.alias("values"), numbers.alias("numbers"), dates.alias("dates")
        ), names)
    else:
        wide = df.agg(*[c for i, n in enumerate(names) for c in _parse_counts(n, i)])
        counts = spread(wide, {
            n: {"values": f"n{i}", "numbers": f"num{i}", "dates": f"dat{i}"}
            for i, n in enumerate(names)
        })
    share_numbers = F.try_divide("numbers", "values")
    share_dates = F.try_divide("dates", "values")
    suggestion = F.when(share_numbers > PARSE_SHARE, "numeric").when(
        share_dates > PARSE_SHARE, "datetime"
    )
    return counts.withColumn("suggested_type", suggestion).filter(
        "suggested_type is not null"
    ).select("column", F.lit("string").alias("current_type"), "suggested_type")


def _parse_counts(name: str, i: int) -> list[Column]:
    text = quoted(name)
    return [
        F.count(text).alias(f"n{i}"),
        F.count_if(looks_numeric(text)).alias(f"num{i}"),
        F.count_if(parse_datetime(text).isNotNull()).alias(f"dat{i}"),
    ]


def iqr_bounds(
    df: DataFrame, columns: list[str], factor: float = 1.5, accuracy: int = ACCURACY
) -> DataFrame:
    """(column, q1, q3, lower, upper)"""
    long = numeric_long(canonicalise(df), columns)
    quartiles = named(column_quantiles(long, {"q1": 0.25, "q3": 0.75}, accuracy), columns)
    reach = (F.col("q3") - F.col("q1")) * factor
    return quartiles.withColumns({"lower": F.col("q1") - reach, "upper": F.col("q3") + reach})


def _with_iqr(df: DataFrame, column: str, factor: float) -> tuple[DataFrame, Column]:
    df = canonicalise(df)
    bounds = iqr_bounds(df, [column], factor).select("lower", "upper")
    value = quoted(column).cast("double")
    rows = with_row(df, bounds)
    outside = (value < F.col("_stats.lower")) | (value > F.col("_stats.upper"))
    return rows, F.coalesce(outside, F.lit(False))


def outliers_iqr(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Rows strictly outside the quartile bounds, with both bounds."""
    rows, outside = _with_iqr(df, column, factor)
    return rows.filter(outside).select(
        *[quoted(c) for c in df.columns],
        F.col("_stats.lower").alias("lower_bound"), F.col("_stats.upper").alias("upper_bound"),
    )


def outliers_zscore(df: DataFrame, column: str, factor: float = 3.0) -> DataFrame:
    """Rows with |z| above ``factor``; z uses the population deviation, the reported
    bounds the sample deviation."""
    df = canonicalise(df)
    value = quoted(column).cast("double")
    stats = df.agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("pop"),
        F.stddev_samp(value).alias("samp"),
    )
    z = F.try_divide(value - F.col("_stats.mean"), F.col("_stats.pop"))
    return with_row(df, stats).withColumn("z", z).filter(F.abs("z") > factor).select(
        *[quoted(c) for c in df.columns], "z",
        (F.col("_stats.mean") - factor * F.col("_stats.samp")).alias("lower_bound"),
        (F.col("_stats.mean") + factor * F.col("_stats.samp")).alias("upper_bound"),
    )


def outlier_report(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """One row: how many outliers, which share of all rows, between which bounds."""
    rows, outside = _with_iqr(df, column, factor)
    return rows.agg(
        F.count_if(outside).alias("outliers"),
        (F.try_divide(F.count_if(outside), F.count("*")) * 100).alias("outlier_pct"),
        F.max("_stats.lower").alias("lower_bound"), F.max("_stats.upper").alias("upper_bound"),
    )


def flag_outliers(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    rows, outside = _with_iqr(df, column, factor)
    return rows.withColumn("is_outlier", outside).drop("_stats")

