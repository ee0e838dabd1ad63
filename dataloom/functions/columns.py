"""Column classes and the one rule about missing values.

A float column may hold both NULL and NaN. Every operator treats the two alike,
so the first step is always ``canonicalise``: NaN becomes NULL, -0.0 becomes 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def quoted(name: str) -> Column:
    """Column by exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType, booleans: bool = False) -> bool:
    return isinstance(dtype, T.NumericType) or (booleans and isinstance(dtype, T.BooleanType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame, booleans: bool = False) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType, booleans)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_datetime(f.dataType)]


def columns_of(df: DataFrame, kind: str) -> DataFrame:
    """Only the columns of one class: numeric, non_numeric, text or datetime."""
    numeric = set(numeric_columns(df))
    names = {
        "numeric": [c for c in df.columns if c in numeric],
        "non_numeric": [c for c in df.columns if c not in numeric],
        "text": text_columns(df),
        "datetime": datetime_columns(df),
    }
    if kind not in names:
        raise ValueError(f"unknown column class {kind!r}; one of {sorted(names)}")
    return df.select(*[quoted(c) for c in names[kind]])


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def canonicalise(df: DataFrame) -> DataFrame:
    """NaN to NULL and -0.0 to 0.0 in every float column; other columns untouched."""
    floats = [f for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.withColumns({
        f.name: F.nanvl(quoted(f.name), F.lit(None).cast(f.dataType))
        + F.lit(0.0).cast(f.dataType)
        for f in floats
    })


def missing(name: str) -> Column:
    """1 where the (canonicalised) column has no value, else 0."""
    return quoted(name).isNull().cast("long")


def null_mask(names: list[str]) -> Column:
    """A short text telling which columns are NULL.

    Spark's row hash skips NULLs, so (NULL, 1) and (1, NULL) hash alike without it.
    """
    return F.concat(*[F.when(quoted(n).isNull(), "1").otherwise("0") for n in names])


def row_hash(df: DataFrame, names: list[str] | None = None, seed: int = 0) -> Column:
    """64-bit hash of a row. NULLs count at every depth of nested columns."""
    names = list(names or df.columns)
    parts = [p for n in names for p in _hashable(quoted(n), df.schema[n].dataType)]
    return F.xxhash64(F.lit(seed), null_mask(names), *parts)


def _hashable(value: Column, dtype: T.DataType) -> list[Column]:
    """What of a value is hashed, so that unequal values differ in it and equal ones agree.

    The hash passes over NULLs inside arrays and structs, so their places are added: by
    a mask where the elements are flat, else by JSON, which writes them.
    """
    if isinstance(dtype, T.ArrayType) and not _nested(dtype.elementType):
        plain = canonical_value(value, dtype)
        return [F.size(value), F.transform(plain, lambda x: x.isNull()), plain]
    if isinstance(dtype, T.StructType) and not any(_nested(f.dataType) for f in dtype.fields):
        fields = [canonical_value(value[f.name], f.dataType) for f in dtype.fields]
        return [value.isNull(), *[p for f in fields for p in (f.isNull(), f)]]
    return [canonical_json(value, dtype)] if _nested(dtype) else [value]


def canonical_json(value: Column, dtype: T.DataType) -> Column:
    """JSON of a nested value, the same for equal values: see ``canonical_value``."""
    return F.to_json(canonical_value(value, dtype), {"ignoreNullFields": "false"})


def canonical_value(value: Column, dtype: T.DataType) -> Column:
    """The value with NaN as NULL and -0.0 as 0.0 at every depth, and with maps, whose
    entries have no order, as entries sorted by key."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.nanvl(value, F.lit(None).cast(dtype)) + F.lit(0.0).cast(dtype)
    if not _nested(dtype):
        return value
    if isinstance(dtype, T.ArrayType):
        if not _holds_floats_or_maps(dtype.elementType):
            return value
        return F.transform(value, lambda x: canonical_value(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        entry = lambda e: F.named_struct(
            F.lit("key"), canonical_value(e["key"], dtype.keyType), F.lit("value"), canonical_value(e["value"], dtype.valueType)
        )
        return F.array_sort(F.transform(F.map_entries(value), entry))
    fields = [x for i, f in enumerate(dtype.fields) for x in (F.lit(f"f{i}"), canonical_value(value[f.name], f.dataType))]
    return F.when(value.isNotNull(), F.named_struct(*fields))


def _holds_floats_or_maps(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_floats_or_maps(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_floats_or_maps(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.FloatType, T.DoubleType, T.MapType))


def _nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.StructType, T.MapType))


def free_names(df: DataFrame, wanted: list[str], taken: list[str] = ()) -> list[str]:
    """The wanted names, those already in use with the first free ending ``_2, _3, ...``.

    Names are compared as the session does, by default without case; a new column thus
    never replaces one of the table's or another new one.
    """
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    form = (lambda n: n) if exact else str.lower
    used = {form(n) for n in [*df.columns, *taken]}
    found = []
    for name in wanted:
        own, number = name, 1
        while form(own) in used:
            number += 1
            own = f"{name}_{number}"
        used.add(form(own))
        found.append(own)
    return found


def fixed(value: Column, digits: int) -> Column:
    """Rounded double without a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def epoch_micros(moment: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    time = (F.hour(moment) * 3600 + F.minute(moment) * 60).cast("long") * 1_000_000
    seconds = (F.extract(F.lit("SECOND"), moment) * 1_000_000).cast("long")
    days = F.datediff(moment.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400_000_000 + time + seconds
