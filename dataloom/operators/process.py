"""One entry point for the preparation steps, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from dataloom.operators.clean import clean
from dataloom.operators.features import engineer, transform

# Operation names.
CLEANING = "Data Cleaning"
ENGINEERING = "Feature Engineering"
TRANSFORMATION = "Data Transformation"
CUSTOM = "Custom Processing"

Step = Callable[[DataFrame], DataFrame] | list[str]

_BUILT_IN: dict[str, Callable[[DataFrame], DataFrame]] = {
    CLEANING: clean,
    ENGINEERING: engineer,
    TRANSFORMATION: transform,
}


def process(df: DataFrame | None, operation: str, custom: Step | None = None) -> DataFrame:
    """Run a named step. A custom step is a function of the table or a list of SQL
    expressions to select; code text is not run."""
    if df is None:
        raise ValueError("no dataset given")
    if operation in _BUILT_IN:
        return df.transform(_BUILT_IN[operation])
    if operation == CUSTOM and custom:
        return df.transform(custom) if callable(custom) else df.selectExpr(*custom)
    raise ValueError(f"unsupported operation: {operation}")
