"""New columns: pair features, indicators, row aggregates, scaled and log columns."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row, functions as F

from dataloom.functions.columns import canonicalise, free_names, numeric_columns, quoted, text_columns
from dataloom.plans.one_row import with_row
from dataloom.plans.shared import stored
from dataloom.plans.smallest import smallest_texts

# Limits and name endings of the generated columns. Five columns are paired
# where none are named; MAX_CATEGORIES is the default of a parameter and an error, not a cut.
PAIR_COLUMNS = 5
LOW_CARDINALITY = 10
MAX_CATEGORIES = 1_000
PRODUCT, RATIO = "product", "ratio"
SCALED, NORMALIZED, LOG = "scaled", "normalized", "log"


def _double(name: str) -> Column:
    return quoted(name).cast("double")


def _pairs(df: DataFrame, columns: list[str] | None) -> list[tuple[str, str]]:
    names = numeric_columns(df)[:PAIR_COLUMNS] if columns is None else columns
    return list(combinations(names, 2))


def _product(a: str, b: str) -> dict[str, Column]:
    return {f"{a}_{b}_{PRODUCT}": _double(a) * _double(b)}


def _ratio(a: str, b: str) -> dict[str, Column]:
    """A zero denominator gives a missing value."""
    return {f"{a}_{b}_{RATIO}": F.try_divide(_double(a), _double(b))}


def _with_pairs(df: DataFrame, columns: list[str] | None, makers) -> DataFrame:
    made = [(n, c) for a, b in _pairs(df, columns) for make in makers for n, c in make(a, b).items()]
    return _added(canonicalise(df), made)


def _added(df: DataFrame, made: list[tuple[str, Column]]) -> DataFrame:
    """The table with the new columns; a name in use gets an ending, nothing is replaced."""
    names = free_names(df, [n for n, _ in made])
    return df.withColumns({n: c for n, (_, c) in zip(names, made)}) if made else df


def pair_products(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Products of the named columns, or of the first five numeric ones, two at a time."""
    return _with_pairs(df, columns, [_product])


def pair_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _with_pairs(df, columns, [_ratio])


def pair_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Product and ratio of each pair, both from the given columns."""
    return _with_pairs(df, columns, [_product, _ratio])


def _categories(df: DataFrame, names: list[str], most: int) -> dict[str, list[str] | None]:
    """The sorted values of each column; None of columns with more than ``most``.

    A task sends at most ``most + 1`` different values of a column, however many rows and
    values it has met; values of columns that have too many do not come to the driver.
    """
    if not names:
        return {}
    few = stored(smallest_texts(df, names, most + 1), "categories")
    sizes = few.groupBy("column").agg(F.count("*").alias("n")).collect()
    over = [r["column"] for r in sizes if r["n"] > most]
    found: dict[str, list[str] | None] = {n: None if i in over else [] for i, n in enumerate(names)}
    for row in few.filter(~F.col("column").isin(over)).collect():
        found[names[row["column"]]].append(row["value"])
    return {n: None if values is None else sorted(values) for n, values in found.items()}


def _indicators(name: str, values: list[str]) -> list[tuple[str, Column]]:
    return [(f"{name}_{v}", F.coalesce(quoted(name) == v, F.lit(False))) for v in values]


def _low_card_indicators(df: DataFrame, max_card: int) -> list[tuple[str, Column]]:
    found = _categories(df, text_columns(df), max_card)
    return [c for n, values in found.items() if values is not None for c in _indicators(n, values[1:])]


def one_hot_low_card(df: DataFrame, max_card: int = LOW_CARDINALITY) -> DataFrame:
    """Indicators of text columns with few values; the first value gets none and the
    source column stays. A missing value is false everywhere. A name that is in use, also
    by another value in other case, gets an ending ``_2, _3, ...``."""
    return _added(df, _low_card_indicators(df, max_card))


def one_hot_all(df: DataFrame, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """Each text column replaced by one indicator per value, values in sorted order.

    The number of columns follows the data, so more than ``max_categories`` is an error.
    """
    names = text_columns(df)
    if not names:
        return df
    found = _categories(df, names, max_categories)
    if None in found.values() or sum(map(len, found.values())) > max_categories:
        raise ValueError(f"more than {max_categories} categories would make as many columns")
    # The names of the replaced columns become free.
    rest = df.drop(*[quoted(n) for n in names])
    made = [c for n, values in found.items() for c in _indicators(n, values)]
    return df.select(
        *[quoted(c) for c in rest.columns], *[c.alias(n) for n, (_, c) in zip(free_names(rest, [n for n, _ in made]), made)]
    )


def row_aggregates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Sum, mean and sample deviation across the numeric columns of each row."""
    df = canonicalise(df)
    names = numeric_columns(df) if columns is None else columns
    if len(names) < 3:
        return df
    zero = F.lit(0.0)

    def total(terms: list[Column]) -> Column:
        return reduce(Column.__add__, terms)

    present, sums, mean, deviation = free_names(df, ["_present", "sum_numeric", "mean_numeric", "std_numeric"])
    rows = df.withColumns({
        sums: total([F.coalesce(_double(n), zero) for n in names]),
        present: total([quoted(n).isNotNull().cast("int") for n in names]),
    }).withColumn(mean, F.try_divide(quoted(sums), quoted(present)))
    squares = total([
        F.coalesce((_double(n) - quoted(mean)) * (_double(n) - quoted(mean)), zero) for n in names
    ])
    spread = F.when(quoted(present) > 1, F.sqrt(F.try_divide(squares, quoted(present) - 1)))
    return rows.withColumn(deviation, spread).drop(present)


def engineer(df: DataFrame) -> DataFrame:
    """Pair features, indicators, row aggregates - all from the original columns."""
    names = numeric_columns(df)
    indicators = _low_card_indicators(df, LOW_CARDINALITY)
    return row_aggregates(_added(pair_features(df), indicators), names)


def _scale_statistics(df: DataFrame, names: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), *[
        c for i, n in enumerate(names) for c in (
            F.avg(_double(n)).alias(f"mean{i}"), F.stddev_pop(_double(n)).alias(f"sd{i}"),
            F.min(_double(n)).alias(f"min{i}"), F.max(_double(n)).alias(f"max{i}"),
            F.count(quoted(n)).alias(f"count{i}"),
        )
    ])


def _standard(name: str, mean: Column, sd: Column) -> Column:
    centred = _double(name) - mean
    return F.when(sd == 0, F.when(centred.isNotNull(), 0.0)).otherwise(F.try_divide(centred, sd))


def _minmax(name: str, low: Column, high: Column) -> Column:
    above = _double(name) - low
    return F.when(high == low, F.when(above.isNotNull(), 0.0)).otherwise(
        F.try_divide(above, high - low)
    )


def scale_standard(df: DataFrame) -> DataFrame:
    """(x - mean) / population deviation; a constant column gives 0."""
    df = canonicalise(df)
    names = numeric_columns(df)
    rows = with_row(df, _scale_statistics(df, names))
    return _added(rows, [
        (f"{n}_{SCALED}", _standard(n, F.col(f"_stats.mean{i}"), F.col(f"_stats.sd{i}")))
        for i, n in enumerate(names)
    ]).drop("_stats")


def scale_minmax(df: DataFrame) -> DataFrame:
    """(x - min) / (max - min); a constant column gives 0."""
    df = canonicalise(df)
    names = numeric_columns(df)
    rows = with_row(df, _scale_statistics(df, names))
    return _added(rows, [
        (f"{n}_{NORMALIZED}", _minmax(n, F.col(f"_stats.min{i}"), F.col(f"_stats.max{i}")))
        for i, n in enumerate(names)
    ]).drop("_stats")


def _all_positive(names: list[str], stats: Row) -> list[str]:
    return [
        n for i, n in enumerate(names)
        if stats["rows"] and stats[f"count{i}"] == stats["rows"] and stats[f"min{i}"] > 0
    ]


def log_positive(df: DataFrame) -> DataFrame:
    """Natural log of columns whose values are all present and above 0.

    Which columns exist depends on the data, so one row of statistics is fetched.
    """
    df = canonicalise(df)
    names = numeric_columns(df)
    if not names:
        return df
    stats = _scale_statistics(df, names).first()
    return _added(df, [(f"{n}_{LOG}", F.ln(_double(n))) for n in _all_positive(names, stats)])


def transform(df: DataFrame, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """Log, standard-scaled and min-max columns, then every text column as indicators.

    One pass fetches one row of statistics; one projection writes all new columns.
    """
    df = canonicalise(df)
    names = numeric_columns(df)
    if names:
        stats = _scale_statistics(df, names).first()

        def known(field: str, i: int) -> Column:
            return F.lit(stats[f"{field}{i}"]).cast("double")

        at = list(enumerate(names))
        added = [(f"{n}_{LOG}", F.ln(_double(n))) for n in _all_positive(names, stats)]
        added += [(f"{n}_{SCALED}", _standard(n, known("mean", i), known("sd", i))) for i, n in at]
        added += [(f"{n}_{NORMALIZED}", _minmax(n, known("min", i), known("max", i))) for i, n in at]
        df = _added(df, added)
    return one_hot_all(df, max_categories)
