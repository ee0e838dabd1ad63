"""Training runs as tables: states, logs, metrics, configurations, check results."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from dataloom.functions.columns import epoch_micros, free_names, quoted
from dataloom.plans.append_only import AppendOnly
from dataloom.plans.shared import stored
from dataloom.plans.states import latest_state, without_removed

# The states of a run, the level of a log line, and the tables.
CREATED, RUNNING, COMPLETED, FAILED = "created", "running", "completed", "failed"
INFO = "INFO"
JOBS = (
    "id int, name string, description string, dataset_id int, model_type string, task_type string, "
    "created_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz, status string, "
    "hyperparameters string, metrics string, model_path string, config string"
)
LOGS = (
    "id long, training_job_id int, timestamp timestamp_ntz, level string, message string, metrics string"
)


def job_state(events: DataFrame) -> DataFrame:
    """State of each job from its status events (job_id, ts, event_id, status, metrics).

    One grouping with partial aggregation: the last status and metrics, the first time
    of each kind, and the seconds from start to end.
    """
    last = F.max(F.struct("ts", "event_id", "status", "metrics"))

    def first_time(*states: str) -> Column:
        return F.min(F.when(F.col("status").isin(*states), F.col("ts")))

    def last_time(*states: str) -> Column:
        return F.max(F.when(F.col("status").isin(*states), F.col("ts")))

    jobs = events.groupBy("job_id").agg(
        last.alias("e"), first_time(CREATED).alias("created_at"),
        first_time(RUNNING).alias("started_at"),
        last_time(COMPLETED, FAILED).alias("ended_at"),
    )
    seconds = (epoch_micros(F.col("ended_at")) - epoch_micros(F.col("started_at"))) / 1e6
    return jobs.select(
        "job_id", F.col("e.status").alias("status"), F.col("e.ts").alias("updated_at"),
        F.col("e.metrics").alias("metrics"), "created_at", "started_at", "ended_at",
        F.when(F.col("ended_at") >= F.col("started_at"), seconds).alias("duration_seconds"),
    )


def jobs_of_datasets(jobs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Jobs joined with the dataset they train on."""
    names = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    return jobs.join(names, "dataset_id")


def job_by_id(jobs: DataFrame, job_id: int) -> DataFrame:
    return jobs.filter(F.col("job_id") == job_id)


def logs(rows: DataFrame, job_id: int | None = None) -> DataFrame:
    if job_id is not None:
        rows = rows.filter(F.col("job_id") == job_id)
    return rows.orderBy("job_id", "ts", "event_id")


def log_tail(rows: DataFrame, n: int = 10) -> DataFrame:
    """The last n log rows of each job, newest first.

    The rank limit sits right above the window, so Spark keeps n rows per job and task
    before the shuffle, also for a job that wrote most of the log.
    """
    newest = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)


def metric_series(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Each log row's JSON metrics as columns."""
    values = F.from_json("metrics", "map<string,double>")
    return rows.withColumn("_m", values).select(
        "job_id", "ts", "event_id", *[F.col("_m")[m].alias(m) for m in metrics]
    )


def metric_columns(rows: DataFrame, name: str = "metrics") -> DataFrame:
    """The other columns and one for each metric that any row's JSON object has.

    Metrics may be nested, in any mixture: a column is called by its path (``loss.train``)
    and has the type that holds all its values; values of types that have nothing in
    common, and lists, are JSON texts. One pass finds the paths. A text that is not JSON,
    or no object, has no metrics.
    """
    variant = F.try_parse_json(quoted(name))
    found = rows.select(variant.alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT<"))
    shape = found.agg(F.schema_of_variant_agg("v")).first()[0]
    rest = [quoted(c) for c in rows.columns if c != name]
    if not shape.startswith("OBJECT<"):
        return rows.select(*rest)
    # The session's own parser reads the shape, whose objects are structs.
    struct = rows.sparkSession.createDataFrame([], f"v {shape.replace('OBJECT<', 'STRUCT<')}").schema["v"].dataType
    paths = list(_leaves(struct, ()))
    names = free_names(rows.select(*rest), [".".join(p) for p, _ in paths])

    def value(path: tuple[str, ...], dtype: T.DataType) -> Column:
        at = "$" + "".join("[" + repr(p) + "]" for p in path)
        if isinstance(dtype, (T.ArrayType, T.VariantType)):
            return F.to_json(F.try_variant_get(variant, at, "variant"))
        # JSON has one kind of fractions, which a variant keeps as decimals.
        kind = "double" if isinstance(dtype, T.DecimalType) else dtype.simpleString()
        return F.try_variant_get(variant, at, kind)

    return rows.select(*rest, *[value(p, t).alias(n) for n, (p, t) in zip(names, paths)])


def _leaves(struct: T.StructType, path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], T.DataType]]:
    for field in struct:
        own = (*path, field.name)
        if isinstance(field.dataType, T.StructType) and field.dataType.fields:
            yield from _leaves(field.dataType, own)
        else:
            yield own, field.dataType


def save_config(rows: DataFrame, fields: list[str], name: str = "config") -> DataFrame:
    return rows.withColumn(name, F.to_json(F.struct(*[quoted(f) for f in fields])))


def load_config(rows: DataFrame, schema: str, name: str = "config") -> DataFrame:
    """The JSON configuration as columns; an absent one reads as ``{}``."""
    parsed = F.from_json(F.coalesce(quoted(name), F.lit("{}")), schema)
    return rows.withColumn("_c", parsed).select("*", "_c.*").drop("_c", name)


def checks_by_tool(checks: DataFrame) -> DataFrame:
    """Check results per tool: files, issues, mean score."""
    return checks.groupBy("tool").agg(
        F.count("*").alias("checks"), F.sum("issues_count").alias("issues"),
        F.avg("score").alias("mean_score"),
    )


def checks_of(
    checks: DataFrame, filename: str | None = None, tool: str | None = None
) -> DataFrame:
    if filename is not None:
        checks = checks.filter(F.col("filename") == filename)
    if tool is not None:
        checks = checks.filter(F.col("tool") == tool)
    return checks


class Runs(AppendOnly):
    """Training jobs and their logs as append-only tables.

    Whole tables of jobs or log lines are written by ``add_jobs``, ``change`` and
    ``add_logs``; the other methods are the same for one job.
    """

    _JOB_EVENTS = JOBS + ", seq long"

    def _events(self) -> DataFrame:
        return self._table("jobs", self._JOB_EVENTS)

    def _removed(self) -> DataFrame:
        return self._table("removed", "id int")

    def jobs(self) -> DataFrame:
        """The last state of every job that was not removed."""
        state = latest_state(self._events(), "id", ["seq"]).drop("seq")
        return without_removed(state, self._removed(), {"id": "id"})

    def logs(self, job_id: int | None = None) -> DataFrame:
        """Log lines of jobs that were not removed."""
        rows = without_removed(self._table("logs", LOGS), self._removed(), {"training_job_id": "id"})
        return rows if job_id is None else rows.filter(F.col("training_job_id") == job_id)

    def _shaped(self, rows: DataFrame, schema: str) -> DataFrame:
        """The table's columns in order; those that the rows lack are NULL."""
        fields = T._parse_datatype_string(schema).fields
        return rows.select(*[
            (quoted(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
        ])

    def _put(self, rows: DataFrame) -> None:
        rows = self._shaped(rows, JOBS).withColumn("seq", F.lit(self._following(self._events(), "seq")))
        self._append("jobs", rows)

    def add_jobs(self, rows: DataFrame) -> None:
        """Append new jobs: ``id`` and any of the other columns; status is created."""
        self._put(rows if "status" in rows.columns else rows.withColumn("status", F.lit(CREATED)))

    def change(self, changes: DataFrame) -> None:
        """Append a new state of the jobs in ``changes``: ``id`` (each once) and the columns
        that change. Jobs that do not exist are left out."""
        own = [c for c in changes.columns if c != "id" and c in self.jobs().columns]
        new = changes.select("id", *[quoted(c).alias(f"new_{c}") for c in own])
        state = self.jobs().join(new, "id").withColumns({c: F.col(f"new_{c}") for c in own})
        # Read before it is appended to: the plan must not read the rows it adds.
        self._put(stored(state.drop(*[f"new_{c}" for c in own]), "jobs"))

    def remove(self, ids: DataFrame) -> None:
        """Remove the jobs in ``ids(id)``; their logs disappear with them."""
        self._append("removed", ids.select(F.col("id").cast("int").alias("id")))

    def add_logs(self, rows: DataFrame) -> None:
        """Append log lines: ``training_job_id``, ``message`` and any other columns; an id
        that is not given continues from the last one."""
        if "level" not in rows.columns:
            rows = rows.withColumn("level", F.lit(INFO))
        if "id" not in rows.columns:
            first = self._following(self._table("logs", LOGS), "id")
            rows = rows.withColumn("id", F.monotonically_increasing_id() + first)
        self._append("logs", self._shaped(rows, LOGS))

    def _one(self, job_id: int, **fields) -> bool:
        if job_by_id(self.jobs().withColumnRenamed("id", "job_id"), job_id).isEmpty():
            return False
        types = {f.name: f.dataType.simpleString() for f in T._parse_datatype_string(JOBS).fields}
        known = {k: v for k, v in fields.items() if k in types and k != "id"}
        schema = ", ".join(["id int", *[f"{k} {types[k]}" for k in known]])
        self.change(self.spark.createDataFrame([(job_id, *known.values())], schema))
        return True

    def create(
        self, name: str, dataset_id: int, model_type: str, task_type: str, description: str | None = None,
        hyperparameters: dict | None = None, now: dt.datetime | None = None,
    ) -> int:
        """Append a job and return its id."""
        job_id = self._following(self._events(), "id")
        text = None if hyperparameters is None else json.dumps(hyperparameters)
        self.add_jobs(self.spark.createDataFrame(
            [(job_id, name, description, dataset_id, model_type, task_type, now or dt.datetime.now(), text)],
            "id int, name string, description string, dataset_id int, model_type string, task_type string, "
            "created_at timestamp_ntz, hyperparameters string",
        ))
        return job_id

    def update(self, job_id: int, **fields) -> bool:
        """Change some fields of a job; unknown fields are ignored. False without the job."""
        return self._one(job_id, **fields)

    def start(self, job_id: int, now: dt.datetime | None = None) -> bool:
        return self._one(job_id, status=RUNNING, started_at=now or dt.datetime.now())

    def complete(
        self, job_id: int, metrics: dict | None = None, model_path: str | None = None, now: dt.datetime | None = None
    ) -> bool:
        return self._one(
            job_id, status=COMPLETED, completed_at=now or dt.datetime.now(),
            metrics=None if metrics is None else json.dumps(metrics), model_path=model_path,
        )

    def fail(self, job_id: int, now: dt.datetime | None = None) -> bool:
        return self._one(job_id, status=FAILED, completed_at=now or dt.datetime.now())

    def delete(self, job_id: int) -> bool:
        if job_by_id(self.jobs().withColumnRenamed("id", "job_id"), job_id).isEmpty():
            return False
        self.remove(self.spark.createDataFrame([(job_id,)], "id int"))
        return True

    def log(
        self, job_id: int, message: str, level: str = INFO, metrics: dict | None = None, now: dt.datetime | None = None
    ) -> None:
        text = None if metrics is None else json.dumps(metrics)
        self.add_logs(self.spark.createDataFrame(
            [(job_id, now or dt.datetime.now(), level, message, text)],
            "training_job_id int, timestamp timestamp_ntz, level string, message string, metrics string",
        ).coalesce(1))

    def save_config(self, job_id: int, config: dict) -> bool:
        return self._one(job_id, config=json.dumps(config))

    def config(self, job_id: int) -> dict:
        """The saved configuration; ``{}`` where there is none."""
        found = job_by_id(self.jobs().withColumnRenamed("id", "job_id"), job_id).select("config").first()
        return json.loads(found["config"]) if found and found["config"] else {}
