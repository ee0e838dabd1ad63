"""What one task reads and holds does not grow with the table."""

from dataloom.operators import charts
from dataloom.plans.shared import scratch_path, stored
from dataloom.queries import preview_sources, tables
from dataloom.sources import readers, record_ranges


def test_written_files_have_a_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(preview_sources, "FILE_BYTES", 4000)
    rows = spark.range(600).selectExpr("id", "repeat('x', 20) AS text")
    path = scratch_path(spark, "json")
    preview_sources.as_documents(preview_sources.in_files(rows), "[", "]", path, ending=" ")
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(sizes) >= 6 and max(sizes) < 8000
    assert sorted(readers.read_json(spark, path, rows.schema).collect()) == sorted(rows.collect())
    assert preview_sources.in_files(rows.limit(3), 2).rdd.getNumPartitions() == 2
    assert preview_sources.in_files(rows.limit(0)).rdd.getNumPartitions() == 1


def test_rows_are_dealt_anew_by_their_size(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    before = {k: spark.conf.get(k) for k in conf}
    rows = spark.range(1000).selectExpr("id", "nullif(id % 100, 7) AS k")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        moved = tables.dealt_anew(rows, "k", "id")
        assert moved.rdd.getNumPartitions() == 23
        assert sorted(r.id for r in moved.sortWithinPartitions("id").collect()) == list(range(1000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_sums_meet_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(charts, "POSITIONS", 10)
    rows = spark.range(95).selectExpr("id", "nullif(id * 7 % 95, 3) AS v")
    got = charts.smoothed_sorted(rows, "v", ["id"])
    # 95 positions in ten tasks, dealt before they are grouped.
    assert "hashpartitioning(at" in (plan := plan_of(got)) and ", 10), REPARTITION_BY_NUM" in plan
    values = sorted(v for v in range(95) if v != 3) + [None]
    for r in got.collect():
        near = [v for v in values[max(0, r.position - 4):r.position + 5] if v is not None]
        assert r.x == values[r.position] and r.smoothed == sum(near) / len(near)
    assert charts.smoothed_sorted(rows.limit(0), "v", ["id"]).collect() == []


def test_ends_of_ranges_are_found_without_a_sort(spark, monkeypatch, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": [{"b": 1}, {"b": 2}]}, {"a": []}]')
    plans = []
    monkeypatch.setattr(record_ranges, "stored", lambda df, name: (plans.append((name, plan_of(df))), stored(df, name))[1])
    assert sorted(r.n for r in readers.read_json(spark, str(tmp_path)).selectExpr("size(a) AS n").collect()) == [0, 2]
    (plan,) = [p for n, p in plans if n == "ranges"]
    assert "HashAggregate" in plan and "SortAggregate" not in plan
