"""Exactness under skew, and plans that hold at any size."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from dataloom.operators import charts, pairs, profile, validate
from dataloom.operators.profile import duplicate_count, top_values
from dataloom.operators.runs import log_tail
from dataloom.plans import quantiles
from dataloom.plans.positions import with_position
from dataloom.plans.quantiles import group_quantiles
from dataloom.plans.states import latest_state
from dataloom.queries import all_queries

PROBS = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q3": 0.75, "p99": 0.99, "high": 1.0}


def check_quantiles(spark, groups, **options):
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in group_quantiles(df, ["g"], "v", PROBS, **options).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12), (g, name)


def test_quantiles_of_skewed_groups(spark):
    random = np.random.default_rng(1)
    groups = {
        "hot": random.lognormal(0, 3, 30_000), "ties": [7.0] * 5_000 + list(range(50)),
        "half": [25.0] * 2_000 + list(random.uniform(25, 26, 2_000)), "one": [3.0],
        "two": [-1.0, 1.0], "negative": -random.exponential(5, 999),
    }
    check_quantiles(spark, groups)


@pytest.mark.parametrize("large", [10, 100_000])
def test_quantiles_with_a_coarse_sketch(spark, monkeypatch, large):
    """The sketch only proposes cuts: a poor one changes nothing."""
    monkeypatch.setattr(quantiles, "LARGE_GROUP", large)
    random = np.random.default_rng(2)
    groups = {"a": random.normal(0, 1, 5_000), "b": np.round(random.normal(0, 3, 5_000))}
    check_quantiles(spark, groups, accuracy=5)


def test_quantiles_when_groups_are_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", 2)
    monkeypatch.setattr(quantiles, "HEAVY_GROUPS", 4)
    random = np.random.default_rng(3)
    sizes = {"hot": 900, **{str(i): 40 for i in range(12)}}
    check_quantiles(spark, {g: random.normal(0, 1, n) for g, n in sizes.items()})


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_subnormal=False), min_size=1, max_size=60))
def test_quantiles_of_any_list(spark, values):
    check_quantiles(spark, {"g": values})


def test_positions_are_dense_and_ordered(spark):
    df = spark.range(5_000).withColumn("v", F.col("id") % 3)
    got = with_position(df, ["v", "id"]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(5_000))
    assert [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in got)


def test_hot_copies_are_counted_and_listed(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"))
    assert duplicate_count(df).first()[0] == 9_999
    copies = validate.duplicate_rows(df)
    assert copies.count() == 9_999 and copies.distinct().count() == 1


def test_very_frequent_row_is_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(validate, "_CHUNK", 7)
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 8 + [(3,)], "v int")
    rows = validate.duplicate_rows(df).groupBy("v").count().collect()
    assert {r.v: r["count"] for r in rows} == {1: 49, 2: 7}


@pytest.mark.parametrize("rows,test", [(1, 0.1), (10, 0.1), (995, 0.1), (3_000, 0.37), (500, 1.0)])
def test_split_is_exact_disjoint_complete(spark, rows, test):
    split = pairs.train_test_split(spark.range(rows), "id", test, seed=3).collect()
    assert len({r.id for r in split}) == len(split) == rows
    assert sum(r.split == "test" for r in split) == -(-rows * test // 1)


def test_split_without_exact_size(spark):
    split = pairs.train_test_split(spark.range(20_000), "id", 0.1, exact=False)
    assert 0.08 < split.filter("split = 'test'").count() / 20_000 < 0.12


def test_split_repeats_and_follows_the_seed(spark):
    def test_ids(seed):
        split = pairs.train_test_split(spark.range(2_000), "id", 0.1, seed)
        return {r.id for r in split.filter("split = 'test'").collect()}

    assert test_ids(1) == test_ids(1) != test_ids(2)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_ranks_are_limited_before_the_shuffle(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").selectExpr(
        "user_id job_id", "ts", "event_id"
    )
    part = spark.read.parquet(f"{folder}/part.parquet")
    for df in (log_tail(events, 5), top_values(part)):
        assert "row_number(), 5, Partial" in plan(df)


def test_latest_state_has_no_window(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "a")], "id int, ts timestamp, v string")
    text = plan(latest_state(df, "id", ["ts"]))
    assert "Window" not in text and "partial_max" in text


def test_correlation_shuffles_sums_only(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    text = plan(charts.correlation_pairs(lines))
    # Sums of matrix products leave a task: one row for each pair, added up by pair.
    assert "hashpartitioning(pair" in text and text.index("partial_sum(xy") < text.index("MapInArrow")
    assert "l_shipdate" not in text and "covar" not in text
    doubles = lines.selectExpr("l_quantity c0", "l_discount c1", "l_tax c2").repartition(5)
    sums = charts._pair_sums(doubles, [(0, 1), (0, 2), (1, 2)], [0.0, 0.0, 0.0])
    tasks = sums._jdf.queryExecution().optimizedPlan().children().head()
    assert "MapInArrow" in tasks.nodeName()
    assert spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, tasks).count() == 5 * 3


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_plan_multiplies_rows(spark, folder, name):
    text = plan(all_queries()[name](spark, folder))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def scans(df):
    """How often the optimised plan reads a table."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_each_table_is_read_few_times(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    assert scans(validate.quality_metrics(orders)) == 1
    assert scans(profile.dataset_info(orders)) == 1
    assert scans(charts.date_like_columns(orders.drop("o_orderdate"), ["o_orderkey"])) == 1
