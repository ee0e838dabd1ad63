"""Immutable dataset versions: fingerprints, history, differences, and their store.

The functions work on a manifest table with one row per version: dataset_id,
version_id, parent_version_id, description, created_at, metadata (JSON), file_path.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from dataloom.functions.columns import canonicalise, quoted, row_hash
from dataloom.operators.profile import _bytes
from dataloom.plans.long_form import spread
from dataloom.plans.one_row import as_struct
from dataloom.plans.positions import with_position
from dataloom.plans.shared import checkpoint, drop_folder

MANIFEST = (
    "dataset_id long, version_id string, parent_version_id string, description string, "
    "created_at timestamp_ntz, metadata string, file_path string"
)
# One more column pair in the stored table: what happened, and in which order.
STORED = MANIFEST + ", event string, seq long"

# Shape of a version id; what a restored version says of itself.
ID_TIME, HASH_DIGITS, SHORT_ID = "%Y%m%d%H%M%S", 8, 8
RESTORED = "Restored from version"


# Sums of 22-bit pieces stay exact in a long for more than 10^12 rows.
def _hash_sums(hashed: Column) -> list[Column]:
    low = F.lit((1 << 22) - 1)
    pieces = [
        hashed.bitwiseAND(low),
        F.shiftright(hashed, 22).bitwiseAND(low),
        F.shiftrightunsigned(hashed, 44),
    ]
    return [F.coalesce(F.sum(p), F.lit(0)) for p in pieces]


def fingerprint(df: DataFrame, *more: Column) -> DataFrame:
    """One row: rows and an 8-digit content hash, and ``more`` aggregates of the pass.

    Sums of row hashes do not depend on the order of rows or partitions; one aggregate,
    no sort and no shuffle of rows.
    """
    df = canonicalise(df)
    layout = json.dumps([(f.name, f.dataType.simpleString()) for f in df.schema])
    sums = [s for seed in (1, 2) for s in _hash_sums(row_hash(df, seed=seed))]
    text = F.concat_ws("|", F.count("*"), *sums, F.lit(layout))
    return df.agg(
        F.count("*").alias("rows"),
        F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS).alias("content_hash"), *more,
    )


def list_versions(manifest: DataFrame, dataset_id: int | None = None) -> DataFrame:
    if dataset_id is not None:
        manifest = manifest.filter(F.col("dataset_id") == dataset_id)
    return manifest.orderBy("dataset_id", "created_at", "version_id")


def get_version(manifest: DataFrame, dataset_id: int, version_id: str) -> DataFrame:
    return manifest.filter(
        (F.col("dataset_id") == dataset_id) & (F.col("version_id") == version_id)
    )


def latest_version(manifest: DataFrame) -> DataFrame:
    """The newest version of each dataset; partial maxima meet before the shuffle."""
    rest = [c for c in manifest.columns if c not in ("dataset_id", "created_at", "version_id")]
    newest = F.max(F.struct("created_at", "version_id", *[quoted(c) for c in rest]))
    return manifest.groupBy("dataset_id").agg(newest.alias("v")).select("dataset_id", "v.*").select(
        *manifest.columns
    )


def live_versions(manifest: DataFrame, removed: DataFrame) -> DataFrame:
    """Versions without the removed ones; a version whose parent was removed gets the
    nearest ancestor that is left.

    Runs of removed versions are bridged by doubling: each round lets every pointer skip
    as far as its target's pointer, so a run of length n takes about log2(n) rounds, each
    one join on the unique version id.
    """
    ids = ["dataset_id", "version_id"]
    gone = manifest.join(removed.select(*ids).distinct(), ids, "left_semi").select(
        "dataset_id", "version_id", F.col("parent_version_id").alias("up")
    )
    gone = checkpoint(gone)
    # A round doubles what a pointer skips: more rounds than this mean a cycle of parents.
    for _ in range(gone.count().bit_length() + 2):
        above = gone.select(
            "dataset_id", F.col("version_id").alias("up"), F.col("up").alias("up2"),
            F.lit(True).alias("hit"),
        )
        step = gone.join(above, ["dataset_id", "up"], "left")
        gone_next = checkpoint(step.select(
            "dataset_id", "version_id",
            F.when(F.col("hit"), F.col("up2")).otherwise(F.col("up")).alias("up"), "hit",
        ))
        if gone_next.filter("hit").isEmpty():
            break
        gone = gone_next.drop("hit")
    else:
        raise ValueError("the parents of removed versions form a cycle")
    bridge = gone.select(
        "dataset_id", F.col("version_id").alias("parent_version_id"), "up",
        F.lit(True).alias("bridged"),
    )
    kept = manifest.join(removed.select(*ids).distinct(), ids, "left_anti")
    return kept.join(bridge, ["dataset_id", "parent_version_id"], "left").withColumn(
        "parent_version_id",
        F.when(F.col("bridged"), F.col("up")).otherwise(F.col("parent_version_id")),
    ).select(*manifest.columns)


def version_metrics(manifest: DataFrame, dataset_id: int | None = None) -> DataFrame:
    """Rows and columns of each version over time, with a short id."""
    sizes = F.from_json("metadata", "rows long, columns long")
    return list_versions(manifest, dataset_id).select(
        "dataset_id", F.concat(F.substring("version_id", 1, SHORT_ID), F.lit("...")).alias("version"),
        F.col("created_at").alias("date"),
        F.coalesce(sizes["rows"], F.lit(0)).alias("rows"),
        F.coalesce(sizes["columns"], F.lit(0)).alias("columns"),
        "version_id", "description",
    )


def schema_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """(column, change, from_type, to_type, rows_diff): added, removed, type_changed."""
    types = [{f.name: f.dataType.simpleString() for f in d.schema} for d in (first, second)]
    old, new = types
    rows = [(c, "removed", old[c], None) for c in old if c not in new]
    rows += [(c, "added", None, new[c]) for c in new if c not in old]
    rows += [(c, "type_changed", old[c], new[c]) for c in old if c in new and old[c] != new[c]]
    changes = first.sparkSession.createDataFrame(
        rows, "column string, change string, from_type string, to_type string"
    )
    count = F.count("*").alias("rows")
    difference = as_struct(second.agg(count))["rows"] - as_struct(first.agg(count))["rows"]
    return changes.withColumn("rows_diff", difference)


def _common(first: DataFrame, second: DataFrame) -> tuple[list[str], list[str]]:
    """Shared column names: all of them, and those of equal type."""
    new = {f.name: f.dataType for f in second.schema}
    shared = [f.name for f in first.schema if f.name in new]
    same = [n for n in shared if first.schema[n].dataType == new[n]]
    return shared, same


def _column_hashes(df: DataFrame, names: list[str], side: str) -> DataFrame:
    df = canonicalise(df.select(*[quoted(n) for n in names]))
    sums = []
    for i, n in enumerate(names):
        pieces = _hash_sums(row_hash(df, [n]))
        sums.append(F.concat_ws("|", F.count("*"), *pieces).alias(f"{side}{i}"))
    return df.agg(*sums) if names else df.agg(F.count("*").alias("rows"))


def value_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """(column, type_changed, values_changed) per shared column, row order ignored.

    One aggregate per side: count and hash sums of each column. A column of changed
    type is not compared further.
    """
    shared, same = _common(first, second)
    session = first.sparkSession
    retyped = session.createDataFrame(
        [(n, True, None) for n in shared if n not in same],
        "column string, type_changed boolean, values_changed boolean",
    )
    if not same:
        return retyped
    one = _column_hashes(first, same, "a").withColumn(
        "_b", as_struct(_column_hashes(second, same, "b"))
    ).select("*", "_b.*").drop("_b")
    compared = spread(one, {n: {"a": f"a{i}", "b": f"b{i}"} for i, n in enumerate(same)})
    return compared.select(
        "column", F.lit(False).alias("type_changed"),
        (F.col("a") != F.col("b")).alias("values_changed"),
    ).unionAll(retyped)


def value_diff_positional(first: DataFrame, second: DataFrame, order_by: list[str]) -> DataFrame:
    """(column, type_changed, differing_rows): row n of one side against row n of the
    other in the given order; missing equals missing, a row without partner differs."""
    shared, same = _common(first, second)

    def placed(df: DataFrame, side: str) -> DataFrame:
        keys = [quoted(k) for k in order_by]
        rows = canonicalise(df.select(*[quoted(c) for c in dict.fromkeys([*same, *order_by])]))
        rows = with_position(rows, keys)
        return rows.select(
            "position", F.lit(True).alias(side),
            *[quoted(n).alias(f"{side}{i}") for i, n in enumerate(same)],
        )

    both = placed(first, "a").join(placed(second, "b"), "position", "full")
    alone = F.col("a").isNull() | F.col("b").isNull()
    counts = both.agg(*[
        F.coalesce(
            F.count_if(alone | ~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))), F.lit(0)
        ).alias(f"d{i}")
        for i in range(len(same))
    ])
    session = first.sparkSession
    retyped = session.createDataFrame(
        [(n, True, None) for n in shared if n not in same],
        "column string, type_changed boolean, differing_rows long",
    )
    return spread(counts, {n: {"d": f"d{i}"} for i, n in enumerate(same)}).select(
        "column", F.lit(False).alias("type_changed"), F.col("d").alias("differing_rows")
    ).unionAll(retyped)


def row_diff(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Key, change (added, removed, changed) and names of the changed columns.

    Both sides meet in one grouping by key, so a missing key is a key like any other and
    nothing multiplies. A key that repeats is compared as a whole: a column is changed
    where the two sides' values, taken as bags, differ; a different number of rows is a
    change of all columns. Values are compared by sums of hashes that no order enters.
    """
    _, same = _common(first, second)
    values = [n for n in same if n not in key]

    def side(df: DataFrame, sign: int) -> DataFrame:
        df = canonicalise(df)
        return df.select(
            *[quoted(k).alias(f"k{i}") for i, k in enumerate(key)], F.lit(sign).cast("long").alias("sign"),
            *[row_hash(df, [v]).alias(f"v{i}") for i, v in enumerate(values)],
        )

    # The sums of 32-bit halves stay exact in a long.
    halves = [(F.shiftright(f"v{i}", 32), F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF))) for i in range(len(values))]
    met = side(first, -1).unionAll(side(second, 1)).groupBy(*[f"k{i}" for i in range(len(key))]).agg(
        F.count_if(F.col("sign") < 0).alias("before"), F.count_if(F.col("sign") > 0).alias("after"),
        *[F.struct(*[F.sum(F.col("sign") * h) for h in pair]).alias(f"d{i}") for i, pair in enumerate(halves)],
    )
    uneven = F.col("before") != F.col("after")
    names = F.concat_ws(",", *[
        F.when(uneven | (F.col(f"d{i}")["col1"] != 0) | (F.col(f"d{i}")["col2"] != 0), v) for i, v in enumerate(values)
    ])
    change = (
        F.when(F.col("before") == 0, "added").when(F.col("after") == 0, "removed")
        .when(uneven | (names != ""), "changed")
    )
    return met.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(key)], change.alias("change"),
        F.when(change == "changed", names).alias("changed_columns"),
    ).filter("change is not null")


def row_diff_keyless(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of which one side has more copies: the columns, change and how many more.

    Both sides meet in one grouping that counts copies with opposite signs.
    """
    _, same = _common(first, second)

    def signed(df: DataFrame, sign: int) -> DataFrame:
        rows = canonicalise(df.select(*[quoted(c) for c in same]))
        return rows.withColumn("_sign", F.lit(sign).cast("long"))

    balance = signed(first, -1).unionAll(signed(second, 1)).groupBy(
        *[quoted(c) for c in same]
    ).agg(F.sum("_sign").alias("_balance")).filter("_balance <> 0")
    return balance.select(
        *[quoted(c) for c in same],
        F.when(F.col("_balance") > 0, "added").otherwise("removed").alias("change"),
        F.abs("_balance").alias("copies"),
    )


def pending_changes(latest: DataFrame, current: DataFrame) -> DataFrame:
    """One row: difference in rows and columns to the latest version; same content?"""
    before, now = as_struct(fingerprint(latest)), as_struct(fingerprint(current))
    return current.sparkSession.range(1).select(
        (now["rows"] - before["rows"]).alias("rows_diff"),
        F.lit(len(current.columns) - len(latest.columns)).cast("long").alias("columns_diff"),
        (now["content_hash"] == before["content_hash"]).alias("unchanged"),
    )


class VersionStore:
    """Versions kept under one folder: a Parquet folder per snapshot and an append-only
    manifest table. A snapshot is written before its manifest row, so a failed job leaves
    an unused folder and never a row without data. One writer per dataset.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._events = f"{self.root}/manifest"

    def _stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(STORED).parquet(self._events)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], STORED)

    def manifest(self) -> DataFrame:
        """The live versions: the last event of each version, removals left out."""
        last = self._stored().groupBy("dataset_id", "version_id").agg(
            F.max_by(F.struct("*"), "seq").alias("e")
        )
        names = [f.strip().split(" ")[0] for f in MANIFEST.split(",")]
        return last.select("e.*").filter("event <> 'removed'").select(*names)

    def _append(self, rows: list[tuple]) -> None:
        # A handful of rows per call: a version, or a removal with its children.
        frame = self.spark.createDataFrame(rows, STORED)
        frame.coalesce(1).write.mode("append").parquet(self._events)

    def _next_seq(self) -> int:
        return (self._stored().agg(F.max("seq")).first()[0] or 0) + 1

    def _one(self, dataset_id: int, version_id: str):
        found = get_version(self.manifest(), dataset_id, version_id).first()
        if found is None:
            raise ValueError(f"version {version_id} not found for dataset {dataset_id}")
        return found

    def latest(self, dataset_id: int):
        one = self.manifest().filter(F.col("dataset_id") == dataset_id)
        return latest_version(one).first()

    def create(
        self, dataset_id: int, df: DataFrame, description: str = "",
        metadata: dict | None = None, parent: str | None = None,
        now: dt.datetime | None = None,
    ) -> str:
        """Write a snapshot and record it; returns the version id."""
        now = now or dt.datetime.now()
        path = f"{self.root}/data/{dataset_id}/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(path)
        snapshot = self.spark.read.parquet(path)
        mark = fingerprint(snapshot, F.coalesce(F.sum(_bytes(snapshot)), F.lit(0)).alias("size")).first()
        details = dict(metadata or {})
        details |= {
            "rows": mark["rows"], "columns": len(df.columns), "column_names": df.columns,
            "content_hash": mark["content_hash"],
            "dtypes": {f.name: f.dataType.simpleString() for f in df.schema}, "bytes": mark["size"],
        }
        return self._record(dataset_id, path, details, description, parent, now)

    def _record(
        self, dataset_id: int, path: str, details: dict, description: str, parent: str | None, now: dt.datetime
    ) -> str:
        version_id = f"{now.strftime(ID_TIME)}_{details['content_hash']}"
        # Equal content twice in a second: the later one has a number behind its id.
        given = self._stored().filter((F.col("dataset_id") == dataset_id) & F.col("version_id").startswith(version_id))
        again = given.select("version_id").distinct().count()
        if again:
            version_id = f"{version_id}_{again + 1}"
        if parent is None:
            before = self.latest(dataset_id)
            parent = before["version_id"] if before else None
        self._append([(
            dataset_id, version_id, parent, description, now, json.dumps(details), path,
            "created", self._next_seq(),
        )])
        return version_id

    def load(self, dataset_id: int, version_id: str) -> DataFrame:
        return self.spark.read.parquet(self._one(dataset_id, version_id)["file_path"])

    def restore(
        self, dataset_id: int, version_id: str, description: str | None = None,
        now: dt.datetime | None = None,
    ) -> str:
        """The data of an old version as a new one, whose parent is the old one. Snapshots
        do not change, so both versions share the folder; nothing is copied."""
        old = self._one(dataset_id, version_id)
        details = json.loads(old["metadata"]) | {"restored_from": version_id}
        return self._record(
            dataset_id, old["file_path"], details, description or f"{RESTORED} {version_id}", version_id,
            now or dt.datetime.now(),
        )

    def delete(self, dataset_id: int, version_id: str, drop_data: bool = True) -> bool:
        """Record the removal; children take the removed version's parent."""
        old = get_version(self.manifest(), dataset_id, version_id).first()
        if old is None:
            return False
        seq = self._next_seq()
        children = self.manifest().filter(
            (F.col("dataset_id") == dataset_id) & (F.col("parent_version_id") == version_id)
        )
        moved = children.withColumns({
            "parent_version_id": F.lit(old["parent_version_id"]).cast("string"),
            "event": F.lit("moved"), "seq": F.lit(seq),
        })
        gone = self.spark.createDataFrame([(*old, "removed", seq)], STORED)
        # Read before it is appended to: the plan must not read the rows it adds.
        events = checkpoint(moved.unionByName(gone))
        events.coalesce(1).write.mode("append").parquet(self._events)
        # A folder that a restored version shares stays.
        if drop_data and self.manifest().filter(F.col("file_path") == old["file_path"]).isEmpty():
            drop_folder(self.spark, old["file_path"])
        return True

    def compare(self, dataset_id: int, first: str, second: str) -> dict[str, DataFrame]:
        old, new = self.load(dataset_id, first), self.load(dataset_id, second)
        return {"schema": schema_diff(old, new), "values": value_diff(old, new)}

    def pending(self, dataset_id: int, df: DataFrame) -> DataFrame | None:
        last = self.latest(dataset_id)
        if last is None:
            return None
        return pending_changes(self.spark.read.parquet(last["file_path"]), df)
