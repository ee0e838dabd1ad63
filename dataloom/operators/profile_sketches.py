"""Column profiles that grow by merging.

A table's profile is kept as sketches, one small row a column: HyperLogLog for distinct
values, KLL for quantiles, theta for what is new in later rows; counts, moments and
extremes are exact. Rows that come later are sketched alone and merged, so old rows are
not read again. ``profile.column_info`` stays the exact way.

Errors, of a single sketch and of any merge: distinct values 0.8 % (one standard error, HLL
of 2^14 registers; theta of 2^14 entries), the rank of a quantile 0.7 % (99 of 100 times, KLL of k = 400).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dataloom.functions.columns import canonical_json, canonicalise, missing, numeric_columns, quoted
from dataloom.plans.long_form import spread

HLL_BITS = 14
THETA_BITS = 14
KLL_K = 400

SKETCHES = (
    "name string, position int, data_type string, rows long, missing long, n long, mean double, m2 double, min double, "
    "max double, distinct_sketch binary, new_sketch binary, quantile_sketch binary"
)


def _hashed(df: DataFrame, name: str) -> Column:
    """64 bits of a value's hash; NULL of a missing value."""
    value, dtype = quoted(name), df.schema[name].dataType
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        value = canonical_json(value, dtype)
    return F.when(quoted(name).isNotNull(), F.xxhash64(value))


def sketch_rows(df: DataFrame) -> DataFrame:
    """The sketches of every column (``SKETCHES``), from one pass that shuffles sketches only."""
    df = canonicalise(df)
    numeric = set(numeric_columns(df, booleans=True))
    aggregates, groups = [F.count("*").alias("rows")], {}
    nothing = [F.lit(None).cast("double").alias("none_d"), F.lit(None).cast("binary").alias("none_b")]
    for i, field in enumerate(df.schema):
        name = field.name
        key = _hashed(df, name)
        made = {
            "missing": F.coalesce(F.sum(missing(name)), F.lit(0)),
            "distinct_sketch": F.hll_sketch_agg(key, HLL_BITS), "new_sketch": F.theta_sketch_agg(key, THETA_BITS),
        }
        if name in numeric:
            value = (quoted(name).cast("int") if isinstance(field.dataType, T.BooleanType) else quoted(name)).cast("double")
            made |= {
                "n": F.count(value), "mean": F.avg(value), "m2": F.var_pop(value) * F.count(value), "min": F.min(value),
                "max": F.max(value), "quantile_sketch": F.kll_sketch_agg_double(value, KLL_K),
            }
        else:
            made["n"] = F.count(quoted(name))
        aggregates += [c.alias(f"{n}{i}") for n, c in made.items()]
        groups[name] = {"rows": "rows", **{n: f"{n}{i}" for n in made}}
    one = df.agg(*aggregates).select("*", *nothing)
    empty = {"mean": "none_d", "m2": "none_d", "min": "none_d", "max": "none_d", "quantile_sketch": "none_b"}
    table = spread(one, {n: {**empty, **fields} for n, fields in groups.items()}, "name")
    kinds = df.sparkSession.createDataFrame(
        [(f.name, i, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "name string, position int, data_type string"
    )
    # One row a column on both sides.
    rows = kinds.join(F.broadcast(table), "name")
    return rows.select(*[quoted(f.split(" ")[0]).cast(f.split(" ")[1]) for f in SKETCHES.split(", ")])


def merged(sketches: DataFrame) -> DataFrame:
    """One row of sketches for each column from those of several parts. A column that a
    part does not have counts as missing in none of its rows."""
    parts = F.collect_list(F.struct("n", "mean", "m2"))
    found = sketches.groupBy("name").agg(
        F.min("position").alias("position"), F.max("data_type").alias("data_type"), F.sum("rows").alias("rows"),
        F.sum("missing").alias("missing"), F.sum("n").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))).alias("mean"),
        parts.alias("parts"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.theta_union_agg("new_sketch").alias("new_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )
    # Squares are added around the common mean, so that large values lose nothing.
    known = F.filter("parts", lambda p: p["mean"].isNotNull())
    squares = F.aggregate(known, F.lit(0.0), lambda total, p: total + p["m2"] + p["n"] * F.pow(p["mean"] - F.col("mean"), F.lit(2)))
    m2 = F.when(F.col("mean").isNotNull(), squares)
    return found.withColumn("m2", m2).select(*[f.split(" ")[0] for f in SKETCHES.split(", ")])


def profile_of(sketches: DataFrame) -> DataFrame:
    """``column_info``'s numbers from one row of sketches a column: ``column, type, rows,
    missing, missing_pct, unique_values, min, max, mean, median, std``; ``unique_values`` and
    ``median`` are estimates, the median is a value of the column."""
    has_numbers = F.col("mean").isNotNull()
    return sketches.select(
        F.col("name").alias("column"), F.col("data_type").alias("type"), "rows", "missing",
        (F.try_divide("missing", "rows") * 100).alias("missing_pct"),
        F.coalesce(F.hll_sketch_estimate("distinct_sketch"), F.lit(0)).alias("unique_values"), "min", "max", "mean",
        F.when(has_numbers, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(0.5))).alias("median"),
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"),
    )


def new_values(old: DataFrame, new: DataFrame) -> DataFrame:
    """(column, new_values): about how many different values of the new rows the old ones
    do not have, from the sketches of both."""
    pairs = new.select("name", F.col("new_sketch").alias("later")).join(old.select("name", F.col("new_sketch").alias("before")), "name", "left")
    beyond = F.theta_sketch_estimate(F.theta_difference("later", "before"))
    return pairs.select(F.col("name").alias("column"), F.when(F.col("before").isNull(), F.theta_sketch_estimate("later")).otherwise(beyond).alias("new_values"))


def sketched(parts: list[DataFrame]) -> DataFrame:
    """The merged sketches of several tables."""
    return merged(reduce(DataFrame.unionByName, [sketch_rows(p) for p in parts]))
