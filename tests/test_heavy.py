"""Frequent and smallest texts: what is found, and how many rows a task sends."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dataloom.operators import clean, features, profile
from dataloom.plans import heavy
from dataloom.plans.smallest import smallest_texts


def plain_top(values, k):
    counts = Counter(v for v in values if v is not None)
    return sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:k]


def found(rows, column):
    return [(r.string_value, r.n) for r in sorted(rows, key=lambda r: r["rank"]) if r["column"] == column]


def columns_of(n):
    own = random.Random(n)
    same = "<html>" + "x" * 100
    return {
        "few": [own.choice(["b", "a", "ä", None]) for _ in range(n)],
        "unlike": [f"{same}{k * 7919 % n:07d}" for k in range(n)],
        "hot": [own.choice(["hot", "hot", f"v{k}"]) for k in range(n)],
        "pairs": [f"{same}{k // 2 * 7919 % n:07d}" if k < n // 2 else f"{same}0{k}" for k in range(n)],
        "none": [None] * n,
        "skewed": [str(int(1.0 / (own.random() + 1e-4))) for _ in range(n)],
    }


@pytest.mark.parametrize("ties", [20, heavy.FEW_TIES])
def test_top_texts(spark, monkeypatch, ties):
    monkeypatch.setattr(heavy, "FEW_TIES", ties)
    n = 4000
    data = columns_of(n)
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} string" for c in data)).repartition(7)
    rows = heavy.top_texts(df, list(data), 5).collect()
    for i, (name, values) in enumerate(data.items()):
        assert found(rows, i) == plain_top(values, 5), name
    counted = profile.top_values(df, counted=profile.stored(profile.frequencies(df).select("column", "h1", "h2", "n"), "f")).collect()
    assert sorted((r["column"], r["value"], r["n"]) for r in counted) == sorted(
        (c, v, m) for c, values in data.items() for v, m in plain_top(values, 5)
    )


def test_candidates_are_proven(spark):
    """A sketch that does not hold the frequent texts is not believed."""
    values = [f"u{k}" for k in range(30_000)] + ["b"] * 3 + ["a"] * 3
    df = spark.createDataFrame([(v,) for v in values], "t string").repartition(5)
    assert found(heavy.top_texts(df, ["t"], 2).collect(), 0) == [("a", 3), ("b", 3)]
    counted, levels = heavy._counts(df.select(F.col("t").alias("c0")), 1, 2)
    assert 0 not in levels
    many = df.unionAll(df.sparkSession.createDataFrame([("z",)] * 300 + [("y",)] * 200, "t string"))
    counted, levels = heavy._counts(many.select(F.col("t").alias("c0")), 1, 2)
    assert levels[0].n == 200 and counted.count() <= heavy.CANDIDATES


def task_rows(df):
    """Rows of the first Python stage of a plan, counted as it stands."""
    node = df._jdf.queryExecution().optimizedPlan()
    while "MapInArrow" not in node.nodeName():
        node = node.children().head()
    return df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(df.sparkSession._jsparkSession, node).count()


def test_smallest_texts(spark):
    values = [f"{k * 7919 % 5000:05d}" for k in range(5000)] * 4 + [None, "ä", "", "€", "🙂"]
    df = spark.createDataFrame([(v, "one") for v in values], "t string, u string").repartition(6)
    small = smallest_texts(df, ["t", "u"], 11)
    got = [(r["column"], r["value"]) for r in small.collect()]
    want = sorted({v for v in values if v is not None})[:11]
    assert sorted(got) == sorted([(0, v) for v in want] + [(1, "one")])
    # Of 20,000 rows a task sends no more than asked for of a column.
    assert task_rows(small) <= 6 * (11 + 1)
    assert smallest_texts(df, [], 3).count() == 0
    assert sorted(r["value"] for r in smallest_texts(df, ["t"], 10_000).collect()) == sorted({v for v in values if v is not None})


def test_indicators_send_few_rows(spark, monkeypatch):
    df = spark.range(30_000).select(
        F.col("id"), F.lit("x").alias("same"), (F.col("id") % 3).cast("string").alias("three"), F.col("id").cast("string").alias("all")
    ).repartition(4)
    sent = []

    def watched(*given):
        frame = smallest_texts(*given)
        sent.append(task_rows(frame))
        return frame

    monkeypatch.setattr(features, "smallest_texts", watched)
    made = features.one_hot_low_card(df, 10)
    assert made.columns == ["id", "same", "three", "all", "three_1", "three_2"]
    assert sent[0] <= 4 * (1 + 3 + 11)
    with pytest.raises(ValueError, match="categories"):
        features.one_hot_all(df, 50)
    assert sent[1] <= 4 * (1 + 3 + 51)
    assert features.one_hot_all(df.drop("all"), 50).columns == ["id", "same_x", "three_0", "three_1", "three_2"]


def test_modes_of_texts_that_begin_alike(spark):
    begin = "<!doctype html>" * 6
    values = [f"{begin}{k}" for k in range(300)] + [f"{begin}7", None]
    df = spark.createDataFrame([(v,) for v in values], "page string").repartition(3)
    assert clean.impute_mode(df).where(F.col("page") == f"{begin}7").count() == 3
