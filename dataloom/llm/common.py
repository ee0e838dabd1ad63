"""Columns by place, whole rows by key, and texts in byte form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The white space that separates words.
WHITE_SPACE = "\\x20\\x09-\\x0D"


def by_place(df: DataFrame) -> DataFrame:
    """The frame with columns ``c0, c1, ...``: extra columns may then have any names,
    also names that an operator uses itself, or one name twice."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """The place name of ``name`` in ``by_place(df)``."""
    return f"c{df.columns.index(name)}"


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names: ``picked(docs, id="doc_id", text="text")``."""
    placed = by_place(df)
    return placed.select(*[F.col(place(df, old)).alias(new) for new, old in columns.items()])


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def hash_share(key: Column, wanted: int, of: int) -> Column:
    """Whether a key is in a sample of about ``wanted`` of ``of`` keys, by its hash alone.

    The rows are chosen where they are; an ordered limit would bring ``wanted`` rows of
    every partition to one place.
    """
    steps = 1 << 40
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(steps)) < F.lit(min(steps, steps * wanted // max(1, of)))


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """NULL-safe equality of column pairs."""
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def rows_of(docs: DataFrame, keys: dict[str, Column], kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose keys stand in ``kept``, each key once.

    ``keys`` computes the key columns on ``by_place(docs)``; ``kept`` has the same
    columns and ``n_rows``, the rows of ``docs`` with that key. Only rows whose key
    occurs again take part in the second shuffle that leaves one of them.
    """
    placed = by_place(docs)
    wanted = kept.select(*[F.col(k).alias(f"kept_{k}") for k in keys], "n_rows")
    keyed = placed.withColumns({f"key_{k}": c for k, c in keys.items()})
    found = keyed.join(
        wanted.hint("shuffle_hash"),
        same(keyed, wanted, [(f"key_{k}", f"kept_{k}") for k in keys]),
    )
    single = found.where("n_rows = 1").select(*placed.columns)
    if kept.where("n_rows > 1").isEmpty():
        return single.toDF(*docs.columns)
    again = found.where("n_rows > 1").dropDuplicates([f"key_{k}" for k in keys])
    return single.unionByName(again.select(*placed.columns)).toDF(*docs.columns)
