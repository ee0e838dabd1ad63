"""Duplicates, missing values and extreme values.

Each step takes its statistics from one aggregate and applies them in one projection;
columns that fail a step's missing-share test stay as they are, decided at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dataloom.functions.columns import canonicalise, numeric_columns, quoted, text_columns
from dataloom.plans.heavy import top_texts
from dataloom.plans.long_form import numeric_long
from dataloom.plans.one_row import with_row
from dataloom.plans.quantiles import column_quantiles
from dataloom.plans.shared import stored

# Limits of the cleaning rules.
IMPUTE_LIMIT = 0.2
CLIP_LIMIT = 0.1
NO_MODE = "Unknown"


def dedupe(df: DataFrame) -> DataFrame:
    return canonicalise(df).dropDuplicates()


def _share_missing(names: list[str]) -> list[Column]:
    return [
        F.coalesce(F.avg(quoted(n).isNull().cast("int")), F.lit(0.0)).alias(f"share{i}")
        for i, n in enumerate(names)
    ]


def _by_column(df: DataFrame, names: list[str], fields: list[str]) -> DataFrame:
    """One row of statistics from one row per column."""
    return df.agg(*[
        F.max(F.when(F.col("column") == i, F.col(f))).alias(f"{f}{i}")
        for i in range(len(names)) for f in fields
    ])


def _medians(df: DataFrame, names: list[str]) -> DataFrame:
    flags = {f.name for f in df.schema if f.dataType.simpleString() == "boolean"}
    ready = df.select(*[
        (quoted(n).cast("int") if n in flags else quoted(n)).alias(n) for n in names
    ])
    found = column_quantiles(numeric_long(ready, names), {"median": 0.5})
    return _by_column(found, names, ["median"])


def _modes(df: DataFrame, names: list[str]) -> DataFrame:
    """The most frequent text of each column, the smallest of equally frequent ones."""
    modes = top_texts(df, names, 1)
    return _by_column(modes.withColumnRenamed("string_value", "mode"), names, ["mode"])


def _fills(
    df: DataFrame, numeric: list[str], texts: list[str], max_missing: float
) -> DataFrame:
    """One row: per column the value for its gaps, NULL where too many are missing."""
    names = numeric + texts
    one = df.agg(*_share_missing(names))
    if numeric:
        one = with_row(one, _medians(df, numeric), "_median")
    if texts:
        one = with_row(one, _modes(df, texts), "_mode")

    def fill(i: int) -> Column:
        if i < len(numeric):
            value = F.col(f"_median.median{i}")
        else:
            value = F.coalesce(F.col(f"_mode.mode{i - len(numeric)}"), F.lit(NO_MODE))
        return F.when(F.col(f"share{i}") <= max_missing, value).alias(f"fill{i}")

    return one.select(*[fill(i) for i in range(len(names))])


def _filled(
    df: DataFrame, numeric: list[str], texts: list[str], fills: list[Column]
) -> list[Column]:
    value_of = dict(zip([*numeric, *texts], fills))
    flags = {f.name for f in df.schema if f.dataType.simpleString() == "boolean"}

    def column(name: str) -> Column:
        if name not in value_of:
            return quoted(name)
        value = quoted(name).cast("int") if name in flags else quoted(name)
        kind = "double" if name in numeric else "string"
        return F.coalesce(value.cast(kind), value_of[name].cast(kind)).alias(name)

    return [column(c) for c in df.columns]


def _impute(df: DataFrame, numeric: list[str], texts: list[str], max_missing: float) -> DataFrame:
    names = numeric + texts
    if not names:
        return df
    rows = with_row(df, _fills(df, numeric, texts, max_missing), "_fill")
    fills = [F.col(f"_fill.fill{i}") for i in range(len(names))]
    return rows.select(*_filled(df, numeric, texts, fills))


def impute_median(df: DataFrame, max_missing: float = IMPUTE_LIMIT) -> DataFrame:
    """Fill numeric and boolean columns with their median, as doubles."""
    df = canonicalise(df)
    return _impute(df, numeric_columns(df, booleans=True), [], max_missing)


def impute_mode(df: DataFrame, max_missing: float = IMPUTE_LIMIT) -> DataFrame:
    df = canonicalise(df)
    return _impute(df, [], text_columns(df), max_missing)


def clip_iqr(
    df: DataFrame, max_missing: float = CLIP_LIMIT, factor: float = 1.5,
    columns: list[str] | None = None,
) -> DataFrame:
    """Move values beyond the quartile bounds onto the bounds; numbers become doubles."""
    df = canonicalise(df)
    names = numeric_columns(df) if columns is None else columns
    if not names:
        return df
    found = column_quantiles(numeric_long(df, names), {"q1": 0.25, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * factor
    bounds = found.select(
        "column", (F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi")
    )
    limits = with_row(df.agg(*_share_missing(names)), _by_column(bounds, names, ["lo", "hi"]))
    limits = limits.select(*[
        F.when(F.col(f"share{i}") <= max_missing, F.col(f"_stats.{f}{i}")).alias(f"{f}{i}")
        for i in range(len(names)) for f in ("lo", "hi")
    ])

    def clipped(name: str) -> Column:
        if name not in names:
            return quoted(name)
        i, value = names.index(name), quoted(name).cast("double")
        # greatest and least skip NULL: no bound, no change.
        capped = F.greatest(F.least(value, F.col(f"_bound.hi{i}")), F.col(f"_bound.lo{i}"))
        return F.when(value.isNotNull(), capped).alias(name)

    return with_row(df, limits, "_bound").select(*[clipped(c) for c in df.columns])


def clean(df: DataFrame) -> DataFrame:
    """dedupe, then fill missing values, then clip: shares and bounds are taken after
    the step before. The deduplicated table is written once and read by every pass; one
    row of fill values is fetched.

    Booleans are filled as numbers but, as they were not numbers before, not clipped.
    """
    once = stored(dedupe(df), "deduplicated")
    numeric, texts = numeric_columns(once, booleans=True), text_columns(once)
    filled = once
    if numeric or texts:
        fills = [F.lit(v) for v in _fills(once, numeric, texts, IMPUTE_LIMIT).first()]
        filled = once.select(*_filled(once, numeric, texts, fills))
    return clip_iqr(filled, columns=numeric_columns(once))
