"""Tables that only grow, kept under one folder; one writer at a time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


class AppendOnly:
    """Rows are appended, readers take the last state of each id. A removal is a row in a
    table of tombstones."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    @staticmethod
    def _following(rows: DataFrame, column: str) -> int:
        return (rows.agg(F.max(column)).first()[0] or 0) + 1
