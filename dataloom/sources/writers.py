"""Writing datasets: snapshots, CSV, JSON Lines, published splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_snapshot(df: DataFrame, path: str) -> None:
    """An immutable Parquet folder; an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def publish(df: DataFrame, path: str, split: str | None = None) -> str:
    """A dataset others can load by split; the table's own ``split`` column is used
    unless one name is given for all rows."""
    if split is not None:
        df = df.withColumn("split", F.lit(split))
    if "split" not in df.columns:
        raise ValueError("a split column or a split name is needed")
    df.write.mode("errorifexists").partitionBy("split").parquet(path)
    return path
