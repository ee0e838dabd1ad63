"""Row positions and running sums over a whole table in a given order.

A window without PARTITION BY would move the table into one task. Here the table is
sorted by range partitions, each row takes its number inside its partition, and only
one row per partition (its size and sums) is accumulated and sent back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from dataloom.functions.columns import quoted
from dataloom.plans.shared import checkpoint

# monotonically_increasing_id: partition number above bit 33, row number below.
_ROW_BITS = 33


def _sorted_partitions(df: DataFrame, order: list[str | Column]) -> DataFrame:
    numbered = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    # Written once: both uses below must see the same partition bounds.
    return checkpoint(
        numbered.withColumn("_part", F.shiftright("_id", _ROW_BITS)).withColumn(
            "_row", F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        ).drop("_id")
    )


def _before(parts: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Per partition the totals of all earlier partitions (as many rows as partitions)."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_part").agg(*[c.alias(n) for n, c in totals.items()])
    return F.broadcast(sums.select(
        "_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in totals]
    ))


def with_position(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """Add the 0-based position in ``order``; the order must be total."""
    parts = _sorted_partitions(df, order)
    before = _before(parts, {"_rows": F.count("*")})
    return (
        parts.join(before, "_part")
        .withColumn(name, F.col("_rows") + F.col("_row"))
        .drop("_part", "_row", "_rows")
    )


def with_running(
    df: DataFrame, order: list[str | Column], value: str
) -> tuple[DataFrame, DataFrame]:
    """Add ``position``, ``run_sum`` and ``run_count`` of the finite values so far; and,
    as one row, the totals ``n``, ``sum`` and ``seen``."""
    parts = _sorted_partitions(df, order)
    running = T.StructType(
        parts.schema.fields
        + [T.StructField("_sum", T.DoubleType()), T.StructField("_seen", T.LongType())]
    )

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = 0.0, 0
        for batch in batches:
            # An infinite value has no part in a mean: one would undo all later sums.
            finite = batch[value].where(np.isfinite(batch[value]))
            sums = total + finite.fillna(0.0).cumsum()
            counts = seen + finite.notna().cumsum()
            if len(batch):
                total, seen = float(sums.iloc[-1]), int(counts.iloc[-1])
            yield batch.assign(_sum=sums, _seen=counts.astype("int64"))

    finite = F.when(F.abs(quoted(value)) < float("inf"), quoted(value))
    total = F.coalesce(F.sum(finite), F.lit(0.0))
    before = _before(parts, {"_rows": F.count("*"), "_sums": total, "_counts": F.count(finite)})
    totals = parts.agg(F.count("*").alias("n"), total.alias("sum"), F.count(finite).alias("seen"))
    rows = (
        parts.mapInPandas(accumulate, running)
        .join(before, "_part")
        .withColumns({
            "position": F.col("_rows") + F.col("_row"),
            "run_sum": F.col("_sums") + F.col("_sum"),
            "run_count": F.col("_counts") + F.col("_seen"),
        })
        .drop("_part", "_row", "_rows", "_sums", "_counts", "_sum", "_seen")
    )
    return rows, totals
