"""The dataset catalog: profiles of known datasets, look-ups, updates, search.

Tables only grow: an update appends a new state, a removal appends a tombstone, and
readers take the last state of each id.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dataloom.functions.columns import quoted
from dataloom.operators.profile import column_info, estimated_mb
from dataloom.operators.profile_sketches import SKETCHES, merged, profile_of, sketch_rows
from dataloom.operators.runs import Runs
from dataloom.operators.versions import VersionStore
from dataloom.plans.append_only import AppendOnly
from dataloom.plans.states import latest_state, without_removed

DATASETS = (
    "id int, name string, description string, format string, rows long, columns int, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, source string, source_url string, "
    "additional_data string, current_version_id string"
)
COLUMNS = (
    "id int, dataset_id int, name string, data_type string, missing_values long, "
    "missing_percentage double, unique_values long, min_value double, max_value double, "
    "mean_value double, median_value double, std_value double"
)
_PARTS = f"dataset_id int, part int, {SKETCHES}"

# What the search shows for absent fields.
NO_DESCRIPTION, NO_AUTHOR = "No description available", "Unknown"


def with_columns_of(datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """Datasets joined with their column profiles."""
    right = columns.select(
        F.col("dataset_id").alias("_owner"), F.col("name").alias("column"),
        *[quoted(c) for c in columns.columns if c not in ("id", "dataset_id", "name")],
    )
    return datasets.join(right, datasets["id"] == right["_owner"]).drop("_owner")


def by_id(datasets: DataFrame, dataset_id: int) -> DataFrame:
    return datasets.filter(F.col("id") == dataset_id)


def by_name(datasets: DataFrame, name: str) -> DataFrame:
    """The first dataset (lowest id) of that name."""
    return datasets.filter(F.col("name") == name).orderBy("id").limit(1)


def search(catalog: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Entries with the tag ``query``, most downloaded first."""

    def text_or(name: str, default: str) -> Column:
        return F.coalesce(F.nullif(quoted(name), F.lit("")), F.lit(default)).alias(name)

    return (
        catalog.filter(F.array_contains("tags", query))
        .select(
            "id", F.element_at(F.split("id", "/"), -1).alias("name"),
            text_or("description", NO_DESCRIPTION), text_or("author", NO_AUTHOR),
            "tags", "downloads",
        )
        .orderBy(F.desc("downloads"), "id")
        .limit(limit)
    )


def profile_rows(df: DataFrame) -> DataFrame:
    """``column_info`` in the shape of the column table, without ids."""
    info = column_info(df)
    return info.select(
        F.col("column").alias("name"), F.col("type").alias("data_type"),
        F.col("missing").alias("missing_values"), F.col("missing_pct").alias("missing_percentage"),
        "unique_values",
        *[F.col(c).alias(f"{c}_value") for c in ("min", "max", "mean", "median", "std")],
    )


class Catalog(AppendOnly):
    """Datasets, their columns, versions, training jobs and logs under one folder.

    A dataset owns the rest: once removed, its columns, versions, jobs and logs are no
    longer seen. ``create_version`` and ``delete_version`` keep the dataset's pointer to
    its current version.
    """

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        self.store = VersionStore(spark, f"{self.root}/versions")
        self.runs = Runs(spark, f"{self.root}/runs")

    def _events(self) -> DataFrame:
        return self._table("datasets", DATASETS + ", seq long")

    def _removed(self) -> DataFrame:
        return self._table("removed", "id int")

    def datasets(self) -> DataFrame:
        state = latest_state(self._events(), "id", ["seq"]).drop("seq")
        return without_removed(state, self._removed(), {"id": "id"})

    def columns(self, dataset_id: int | None = None) -> DataFrame:
        rows = without_removed(
            self._table("dataset_columns", COLUMNS), self._removed(), {"dataset_id": "id"}
        )
        return rows if dataset_id is None else rows.filter(F.col("dataset_id") == dataset_id)

    def _next(self, column: str) -> int:
        return (self._events().agg(F.max(column)).first()[0] or 0) + 1

    def store_profile(
        self, df: DataFrame, name: str, description: str | None = None,
        source: str | None = None, source_url: str | None = None, fmt: str = "parquet",
        now: dt.datetime | None = None,
    ) -> int:
        """Profile a table and append its dataset row and column rows; returns the id."""
        now = now or dt.datetime.now()
        dataset_id, seq = self._next("id"), self._next("seq")
        # One pass for both numbers.
        size = estimated_mb(df, rows=True).first()
        rows = size["rows"]
        details = {
            "dtypes": {f.name: f.dataType.simpleString() for f in df.schema}, "memory_usage": size["estimated_mb"],
        }
        profile = profile_rows(df)
        order = {c: i for i, c in enumerate(df.columns)}
        place = F.create_map(*[F.lit(x) for c, i in order.items() for x in (c, i + 1)])
        # Columns first: a dataset row then always finds its columns.
        self._append("dataset_columns", profile.select(
            place[F.col("name")].alias("id"), F.lit(dataset_id).alias("dataset_id"),
            *profile.columns,
        ))
        self._append("datasets", self.spark.createDataFrame([(
            dataset_id, name, description or f"Dataset {name}", fmt, rows, len(df.columns),
            now, now, source, source_url, json.dumps(details), None, seq,
        )], DATASETS + ", seq long"))
        return dataset_id

    def append_profile(self, dataset_id: int, rows: DataFrame) -> None:
        """Sketch rows that were added to a dataset; the rows before them are not read.
        The first call may hold all rows of the dataset."""
        parts = self._table("dataset_sketches", _PARTS)
        part = (parts.filter(F.col("dataset_id") == dataset_id).agg(F.max("part")).first()[0] or 0) + 1
        own = [F.lit(dataset_id).alias("dataset_id"), F.lit(part).alias("part")]
        self._append("dataset_sketches", sketch_rows(rows).select(*own, "*"))

    def merged_profile(self, dataset_id: int) -> DataFrame:
        """The profile of all rows that were sketched, from their sketches alone."""
        parts = without_removed(self._table("dataset_sketches", _PARTS), self._removed(), {"dataset_id": "id"})
        return profile_of(merged(parts.filter(F.col("dataset_id") == dataset_id).drop("dataset_id", "part")))

    def update(self, dataset_id: int, now: dt.datetime | None = None, **changes) -> bool:
        """Append the dataset's row with some fields changed; unknown fields are ignored."""
        current = by_id(self.datasets(), dataset_id).first()
        if current is None:
            return False
        fields = current.asDict()
        fields |= {k: v for k, v in changes.items() if k in fields and k != "id"}
        fields["updated_at"] = now or dt.datetime.now()
        self._append("datasets", self.spark.createDataFrame(
            [(*fields.values(), self._next("seq"))], DATASETS + ", seq long"
        ))
        return True

    def versions(self) -> DataFrame:
        """The manifest of versions whose dataset is there."""
        return without_removed(self.store.manifest(), self._removed(), {"dataset_id": "id"})

    def jobs(self) -> DataFrame:
        """Training jobs whose dataset is there."""
        return without_removed(self.runs.jobs(), self._removed(), {"dataset_id": "id"})

    def logs(self) -> DataFrame:
        """Log lines of jobs that are there."""
        own = self.jobs().select(F.col("id").alias("training_job_id"))
        return self.runs.logs().join(own, "training_job_id", "left_semi")

    def create_version(self, dataset_id: int, df: DataFrame, *args, **given) -> str:
        """Store a version; it becomes the dataset's current one."""
        version_id = self.store.create(dataset_id, df, *args, **given)
        self.update(dataset_id, current_version_id=version_id)
        return version_id

    def delete_version(self, dataset_id: int, version_id: str, drop_data: bool = True) -> bool:
        """Remove a version; if it was the current one, the newest of the others is now."""
        if not self.store.delete(dataset_id, version_id, drop_data):
            return False
        own = by_id(self.datasets(), dataset_id).first()
        if own is not None and own["current_version_id"] == version_id:
            newest = self.store.latest(dataset_id)
            self.update(dataset_id, current_version_id=newest["version_id"] if newest else None)
        return True

    def delete(self, dataset_id: int) -> bool:
        """Remove a dataset; its columns, versions, jobs and logs disappear with it."""
        if by_id(self.datasets(), dataset_id).isEmpty():
            return False
        self._append("removed", self.spark.createDataFrame([(dataset_id,)], "id int"))
        return True
