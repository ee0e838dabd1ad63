"""The smallest different texts of columns, a bounded number of rows from each task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from dataloom.functions.columns import quoted


def smallest_texts(df: DataFrame, names: list[str], most: int) -> DataFrame:
    """(column, value): of each named text column, by its place in ``names``, the ``most``
    smallest different texts.

    A task keeps and sends at most ``most`` texts of a column, however many it meets and
    however often; repeats across tasks are dropped before the last ranking.
    """
    if not names:
        return df.sparkSession.createDataFrame([], "column int, value string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array | None] = [None] * len(names)
        for batch in batches:
            for i in range(len(names)):
                found = pc.unique(batch.column(i).cast(pa.large_string())).drop_null()
                if held[i] is not None:
                    if len(held[i]) >= most:
                        found = found.filter(pc.less(found, held[i][-1]))
                    if not len(found):
                        continue
                    found = pc.unique(pa.concat_arrays([held[i], found]))
                held[i] = found.take(pc.array_sort_indices(found)[:most])
        for i, values in enumerate(held):
            if values is not None and len(values):
                place = pa.array([i] * len(values), pa.int32())
                yield pa.RecordBatch.from_arrays([place, values.cast(pa.string())], ["column", "value"])

    own = df.select(*[quoted(n).alias(f"c{i}") for i, n in enumerate(names)])
    first = Window.partitionBy("column").orderBy("value")
    different = own.mapInArrow(run, "column int, value string").distinct()
    return different.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most).drop("rank")
