"""Version store, differences, catalog."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dataloom.operators import catalog, versions

DAY = [dt.datetime(2024, 1, d, 12, 30, 15) for d in range(1, 9)]


@pytest.fixture
def store(spark, tmp_path):
    return versions.VersionStore(spark, f"{tmp_path}/store")


def table(spark, n, extra=0):
    return spark.range(n).select("id", (F.col("id") * 2 + extra).alias("v"))


def parents(store):
    return {r.version_id: r.parent_version_id for r in store.manifest().collect()}


def test_create_list_load(spark, store):
    a = store.create(1, table(spark, 5), "a", now=DAY[0])
    b = store.create(1, table(spark, 6), "b", {"note": "x"}, now=DAY[1])
    other = store.create(2, table(spark, 5), "c", now=DAY[2])
    assert a.startswith("20240101123015_") and a.split("_")[1] == other.split("_")[1]
    assert parents(store) == {a: None, b: a, other: None}
    assert [r.version_id for r in versions.list_versions(store.manifest(), 1).collect()] == [a, b]
    assert store.latest(1)["version_id"] == b and store.latest(9) is None
    assert store.load(1, b).exceptAll(table(spark, 6)).isEmpty()
    metrics = versions.version_metrics(store.manifest(), 1).collect()
    assert [(r.rows, r.columns, r.version) for r in metrics] == [(5, 2, "20240101..."), (6, 2, "20240102...")]


def test_same_content_in_the_same_second_gets_its_own_id(spark, store):
    first = store.create(1, table(spark, 5), now=DAY[0])
    second = store.create(1, table(spark, 5), now=DAY[0])
    assert second == f"{first}_2" and parents(store) == {first: None, second: first}


def test_cycle_of_removed_versions_is_an_error(spark):
    rows = [(1, "a", "b"), (1, "b", "a"), (1, "c", "b")]
    manifest = spark.createDataFrame(rows, "dataset_id long, version_id string, parent_version_id string")
    with pytest.raises(ValueError, match="cycle"):
        versions.live_versions(manifest, manifest.where("version_id <> 'c'"))


def test_missing_version(store):
    with pytest.raises(ValueError, match="not found"):
        store.load(1, "nothing")
    assert store.delete(1, "nothing") is False


def test_restore(spark, store):
    import json

    a = store.create(1, table(spark, 5), now=DAY[0])
    b = store.create(1, table(spark, 7), now=DAY[1])
    c = store.restore(1, a, now=DAY[2])
    d = store.restore(1, c, now=DAY[3])
    assert store.load(1, d).exceptAll(table(spark, 5)).isEmpty()
    rows = {r.version_id: r for r in store.manifest().collect()}
    assert (rows[b].parent_version_id, rows[c].parent_version_id, rows[d].parent_version_id) == (a, a, c)
    assert json.loads(rows[d].metadata)["restored_from"] == c


def test_delete_gives_children_the_grandparent(spark, store):
    a, b, c = [store.create(1, table(spark, 5 + i), now=DAY[i]) for i in range(3)]
    path = store._one(1, b)["file_path"]
    assert store.delete(1, b)
    assert parents(store) == {a: None, c: a}
    assert store.delete(1, a)
    assert parents(store) == {c: None}
    assert store.load(1, c).count() == 7
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    assert store.delete(1, c) and store.latest(1) is None


def test_long_runs_of_removed_versions(spark):
    rows = [(1, f"v{i}", f"v{i - 1}" if i else None, None, DAY[0], None, None) for i in range(40)]
    manifest = spark.createDataFrame(rows, versions.MANIFEST)
    removed = manifest.filter("version_id not in ('v2', 'v39')")
    live = {r.version_id: r.parent_version_id for r in versions.live_versions(manifest, removed).collect()}
    assert live == {"v2": None, "v39": "v2"}


def test_fingerprint_ignores_order_only(spark):
    def mark(df):
        return versions.fingerprint(df).first()["content_hash"]

    df = table(spark, 100)
    assert mark(df) == mark(df.repartition(7).sortWithinPartitions(F.desc("v")))
    assert mark(df) != mark(df.withColumn("v", F.when(F.col("id") == 50, 0).otherwise(F.col("v"))))
    assert mark(df) != mark(df.withColumnRenamed("v", "w"))
    assert mark(df) != mark(df.unionAll(df.limit(1)))


def test_pending(spark, store):
    assert store.pending(1, table(spark, 5)) is None
    store.create(1, table(spark, 5), now=DAY[0])
    same = store.pending(1, table(spark, 5).repartition(3)).first()
    assert (same.rows_diff, same.columns_diff, same.unchanged) == (0, 0, True)
    more = store.pending(1, table(spark, 9).withColumn("w", F.lit(1))).first()
    assert (more.rows_diff, more.columns_diff, more.unchanged) == (4, 1, False)


def test_compare(spark, store):
    a = store.create(1, table(spark, 5), now=DAY[0])
    b = store.create(1, table(spark, 5, extra=1).withColumn("w", F.lit(1)), now=DAY[1])
    found = store.compare(1, a, b)
    assert [tuple(r) for r in found["schema"].collect()] == [("w", "added", None, "int", 0)]
    assert {r.column: r.values_changed for r in found["values"].collect()} == {"id": False, "v": True}


def test_differences_see_missing_values_and_copies(spark):
    first = spark.createDataFrame([(1, None), (2, 2.0), (2, 2.0)], "k int, v double")
    second = spark.createDataFrame([(1, float("nan")), (2, 2.0), (3, 1.0)], "k int, v double")
    rows = {(r.k, r.change, r.copies) for r in versions.row_diff_keyless(first, second).collect()}
    assert rows == {(2, "removed", 1), (3, "added", 1)}
    place = {r.column: r.differing_rows
             for r in versions.value_diff_positional(first, second, ["k", "v"]).collect()}
    assert place == {"k": 1, "v": 1}


def test_catalog(spark, tmp_path):
    book = catalog.Catalog(spark, f"{tmp_path}/catalog")
    a = book.store_profile(table(spark, 10), "first", now=DAY[0])
    b = book.store_profile(table(spark, 20), "second", "text", now=DAY[1])
    assert (a, b) == (1, 2)
    assert catalog.by_name(book.datasets(), "second").first().rows == 20
    assert {r.name: r.max_value for r in book.columns(b).collect()} == {"id": 19.0, "v": 38.0}
    assert book.update(a, now=DAY[2], description="new", nonsense=1)
    row = catalog.by_id(book.datasets(), a).first()
    assert (row.description, row.updated_at, row.created_at) == ("new", DAY[2], DAY[0])
    assert book.datasets().count() == 2
    assert book.delete(a) and not book.delete(a) and not book.update(a, name="x")
    assert [r.id for r in book.datasets().collect()] == [b]
    assert book.columns().count() == 2
    joined = catalog.with_columns_of(book.datasets(), book.columns())
    assert {(r.name, r.column) for r in joined.collect()} == {("second", "id"), ("second", "v")}
